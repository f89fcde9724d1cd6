"""Panels over spans that begin inside a bucket, read from stored tiers."""

from __future__ import annotations

import datetime as dt

from gaugeworks.operators import tiers as Z
from gaugeworks.plans.registry import query
from gaugeworks.plans.sql import HOUR, MINUTE, avg, high, low, n_status, over_events, within
from gaugeworks.session import fresh_path
from gaugeworks.sources.sample_tables import ORIGIN, newest_time, telemetry


def stored_tiers(spark, sf_dir: str, compression: int, behind: dt.timedelta):
    """All events and their rollups, which end ``behind`` the newest event; and that event's time."""
    base, as_of = fresh_path(spark, "tiers"), newest_time(spark, sf_dir, compression)
    start = dt.datetime.fromisoformat(ORIGIN)
    Z.build_tiers(spark, telemetry(spark, sf_dir, compression=compression), base, start, as_of - behind)
    return base, as_of


@query("device_stats_tiered", over_events(f"""
SELECT device_id, count(*) AS message_count, {avg('temperature')} AS avg_temperature, {low('temperature')} AS min_temperature,
  {high('temperature')} AS max_temperature, {avg('pressure')} AS avg_pressure, {n_status('WARN')} AS warning_count
FROM ev WHERE {within('9 days')} GROUP BY 1""", compression=1))
def device_stats_tiered(spark, sf_dir):
    """Nine days: a cut minute, minutes, hours, whole days, and the rest up to now as raw events."""
    base, as_of = stored_tiers(spark, sf_dir, 1, dt.timedelta(hours=7, minutes=25))
    return Z.device_stats_tiered(spark, base, "9 days", as_of)


@query("timeseries_tiered", over_events(f"""
SELECT {MINUTE} AS minute, {avg('temperature')} AS avg_temperature, {avg('pressure')} AS avg_pressure, count(*) AS event_count
FROM ev WHERE {within('1 hour')} GROUP BY 1"""))
def timeseries_tiered(spark, sf_dir):
    base, as_of = stored_tiers(spark, sf_dir, 60, dt.timedelta(minutes=12))
    return Z.timeseries_tiered(spark, base, "1 hour", as_of)


@query("hourly_stats_tiered", over_events(f"""
SELECT {HOUR} AS hour, count(*) AS events, {avg('temperature')} AS avg_temperature, {avg('pressure')} AS avg_pressure,
  count(DISTINCT device_id) AS active_devices
FROM ev WHERE {within('24 hours')} GROUP BY 1""", compression=1))
def hourly_stats_tiered(spark, sf_dir):
    base, as_of = stored_tiers(spark, sf_dir, 1, dt.timedelta(minutes=95))
    return Z.hourly_stats_tiered(spark, base, "24 hours", as_of)
