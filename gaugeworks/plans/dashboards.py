"""Trailing-window queries: caches, history endpoints, panels."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeworks.functions import newest, seconds_between
from gaugeworks.operators import devices as D
from gaugeworks.operators import filters as Fl
from gaugeworks.operators import summaries as A
from gaugeworks.plans.registry import doubled, query, recent
from gaugeworks.plans.sql import (
    HOUR, MINUTE, RANGE5, any_of, avg, doubles, high, label, latest, low, mean, n_status, over_events, pct, r, within,
)
from gaugeworks.plans.views import register_views
from gaugeworks.schema import (
    ALERT_RULES, BATTERY_BANDS, FRESHNESS_BANDS, LAST_EVENT_BANDS, LOCATIONS, METRICS, RANGE_RULES, WARNING_BANDS,
)
from gaugeworks.sources.sample_tables import ORIGIN, device_metadata, newest_time, presence_notices, telemetry

# -- caches ---------------------------------------------------------------------------------------

_DEVICE_STATS = f"""
SELECT device_id, count(*) AS message_count, {avg('temperature')} AS avg_temperature,
  {low('temperature')} AS min_temperature, {high('temperature')} AS max_temperature,
  {avg('pressure')} AS avg_pressure, {n_status('WARN')} AS warning_count
FROM ev WHERE {within('5 minutes')} GROUP BY device_id ORDER BY device_id"""


@query("device_stats", over_events(_DEVICE_STATS))
def device_stats(spark, sf_dir):
    ev, as_of = recent(spark, sf_dir, "5 minutes")
    return A.device_stats(ev, "5 minutes", as_of)


@query("device_stats_default_time", over_events(_DEVICE_STATS))
def device_stats_default_time(spark, sf_dir):
    return A.device_stats(telemetry(spark, sf_dir))


@query("timeseries_1h", over_events(f"""
SELECT {MINUTE} AS minute, {avg('temperature')} AS avg_temperature, {avg('pressure')} AS avg_pressure,
  count(*) AS event_count
FROM ev WHERE {within('1 hour')} GROUP BY 1 ORDER BY 1"""))
def timeseries_1h(spark, sf_dir):
    ev, as_of = recent(spark, sf_dir, "1 hour")
    return A.timeseries(ev, "1 hour", "minute", as_of)


@query("system_health", over_events(f"""
SELECT count(*) AS total_events, {n_status('OK')} AS ok_count, {n_status('WARN')} AS warn_count,
  count(DISTINCT device_id) AS active_devices, {avg('temperature')} AS avg_temperature,
  {avg('pressure')} AS avg_pressure,
  {r(f"(CAST({n_status('OK')} AS DOUBLE) / greatest(count(*), 1) * 100)", 1)} AS health_score
FROM ev WHERE {within('5 minutes')}"""))
def system_health(spark, sf_dir):
    ev, as_of = recent(spark, sf_dir, "5 minutes")
    return A.system_health(ev, "5 minutes", as_of)


@query("hourly_stats_24h", over_events(f"""
SELECT {HOUR} AS hour, count(*) AS events, {avg('temperature')} AS avg_temperature,
  {avg('pressure')} AS avg_pressure, count(DISTINCT device_id) AS active_devices
FROM ev WHERE {within('24 hours')} GROUP BY 1 ORDER BY 1""", compression=1))
def hourly_stats_24h(spark, sf_dir):
    ev, as_of = recent(spark, sf_dir, "24 hours", compression=1)
    return A.hourly_stats(ev, "24 hours", as_of)


@query("latest_events", over_events(f"""
SELECT device_id, {doubles('temperature', 'pressure')}, status, timestamp AS last_seen
FROM {latest('device_id', within('5 minutes'))} ORDER BY device_id"""))
def latest_events(spark, sf_dir):
    ev, as_of = recent(spark, sf_dir, "5 minutes")
    return doubled(D.latest_events(ev, "5 minutes", as_of))


@query("device_status", over_events(f"""
SELECT l.device_id, l.device_type, l.location, CAST(l.temperature AS DOUBLE) AS last_temperature,
  CAST(l.pressure AS DOUBLE) AS last_pressure, CAST(l.humidity AS DOUBLE) AS last_humidity,
  CAST(l.battery_level AS DOUBLE) AS last_battery, l.status AS last_status, l.timestamp AS last_seen,
  n.total_events
FROM {latest('device_id, device_type, location', within('1 hour'))} l
JOIN (SELECT device_id, count(*) AS total_events FROM ev WHERE {within('1 hour')} GROUP BY 1) n USING (device_id)"""))
def device_status(spark, sf_dir):
    ev, as_of = recent(spark, sf_dir, "1 hour")
    return doubled(D.device_status(ev, "1 hour", as_of))


# -- history endpoints ----------------------------------------------------------------------------

@query("temperature_timeseries", over_events(f"""
SELECT {MINUTE} AS minute, {avg('temperature')} AS avg_temp, {low('temperature')} AS min_temp,
  {high('temperature')} AS max_temp
FROM ev WHERE {within('60 minutes')} AND temperature IS NOT NULL GROUP BY 1 ORDER BY 1"""))
def temperature_timeseries(spark, sf_dir):
    ev, as_of = recent(spark, sf_dir, "60 minutes")
    return A.temperature_timeseries(ev, 60, as_of)


_HOURLY_SUMMARY = """
SELECT {hour} AS hour, count(*) AS events, {avg_t} AS avg_temp, {max_t} AS max_temp, {min_t} AS min_temp,
  {avg_p} AS avg_pressure, {warn} AS warnings
FROM ev WHERE {bound} GROUP BY 1 ORDER BY 1""".format(
    hour=HOUR, avg_t=avg("temperature"), max_t=high("temperature"), min_t=low("temperature"),
    avg_p=avg("pressure"), warn=n_status("WARN", "CRITICAL"), bound=within("24 hours"),
)


@query("hourly_summary", over_events(_HOURLY_SUMMARY))
def hourly_summary(spark, sf_dir):
    ev, as_of = recent(spark, sf_dir, "24 hours")
    return A.hourly_summary(ev, 24, as_of)


@query("hourly_summary_24h_of_30d", over_events(_HOURLY_SUMMARY, compression=1))
def hourly_summary_24h_of_30d(spark, sf_dir):
    ev, as_of = recent(spark, sf_dir, "24 hours", compression=1)
    return A.hourly_summary(ev, 24, as_of)


@query("device_leaderboard", over_events(f"""
SELECT e.device_id, coalesce(min(device_type), 'unknown') AS device_type,
  coalesce(min(location), 'unknown') AS location, count(*) AS total_events,
  {avg('temperature')} AS avg_temperature, {avg('pressure')} AS avg_pressure, {avg('humidity')} AS avg_humidity,
  {r('max(l.battery)', 1)} AS battery_level, {n_status('WARN', 'CRITICAL')} AS warnings,
  max(timestamp) AS last_seen
FROM ev e JOIN (SELECT device_id, battery_level AS battery FROM {latest('device_id', within('1 hour'))}) l
  ON e.device_id = l.device_id
WHERE {within('1 hour')} GROUP BY e.device_id ORDER BY total_events DESC, e.device_id LIMIT 20"""))
def device_leaderboard(spark, sf_dir):
    ev, as_of = recent(spark, sf_dir, "1 hour")
    return A.device_leaderboard(ev, "1 hour", 20, as_of)


def _per_bucket(span: str, every: str, compression: int = 60) -> str:
    return over_events(
        f"SELECT date_trunc('{every}', timestamp) AS {every}, count(*) AS events FROM ev "
        f"WHERE {within(span)} GROUP BY 1 ORDER BY 1", compression=compression,
    )


@query("events_per_minute_60m", _per_bucket("60 minutes", "minute"))
def events_per_minute_60m(spark, sf_dir):
    ev, as_of = recent(spark, sf_dir, "60 minutes")
    return A.events_per_minute(ev, 60, as_of)


@query("events_per_minute_6h", _per_bucket("6 hours", "minute"))
def events_per_minute_6h(spark, sf_dir):
    ev, as_of = recent(spark, sf_dir, "6 hours")
    return A.events_per_bucket(ev, "6 hours", "minute", as_of)


@query("events_per_hour_24h", _per_bucket("24 hours", "hour", 1))
def events_per_hour_24h(spark, sf_dir):
    ev, as_of = recent(spark, sf_dir, "24 hours", compression=1)
    return A.events_per_bucket(ev, "24 hours", "hour", as_of)


# -- panels ---------------------------------------------------------------------------------------

def _by_device(metric: str) -> str:
    return over_events(
        f"SELECT {MINUTE} AS minute, device_id, {avg(metric, 3)} AS {metric} FROM ev "
        f"WHERE {within('1 hour')} GROUP BY 1, 2"
    )


@query("temperature_by_device", _by_device("temperature"))
def temperature_by_device(spark, sf_dir):
    ev, as_of = recent(spark, sf_dir, "1 hour")
    return A.metric_by_device(ev, "temperature", "1 hour", as_of)


@query("pressure_by_device", _by_device("pressure"))
def pressure_by_device(spark, sf_dir):
    ev, as_of = recent(spark, sf_dir, "1 hour")
    return A.metric_by_device(ev, "pressure", "1 hour", as_of)


def _distribution(span: str) -> str:
    return over_events(f"SELECT status, count(*) AS count FROM ev WHERE {within(span)} GROUP BY 1")


@query("status_distribution_5m", _distribution("5 minutes"))
def status_distribution_5m(spark, sf_dir):
    ev, as_of = recent(spark, sf_dir, "5 minutes")
    return A.status_distribution(ev, "5 minutes", as_of)


@query("status_distribution_1h", _distribution("1 hour"))
def status_distribution_1h(spark, sf_dir):
    ev, as_of = recent(spark, sf_dir, "1 hour")
    return A.status_distribution(ev, "1 hour", as_of)


@query("status_over_time", over_events(
    f"SELECT {MINUTE} AS minute, status, count(*) AS count FROM ev WHERE {within('1 hour')} GROUP BY 1, 2"))
def status_over_time(spark, sf_dir):
    ev, as_of = recent(spark, sf_dir, "1 hour")
    return A.status_over_time(ev, "1 hour", as_of)


@query("status_over_time_wide", over_events(
    f"SELECT {MINUTE} AS minute, {n_status('OK')} AS ok, {n_status('WARN')} AS warn, "
    f"{n_status('CRITICAL')} AS critical, {n_status('ERROR')} AS error FROM ev WHERE {within('1 hour')} GROUP BY 1"))
def status_over_time_wide(spark, sf_dir):
    ev, as_of = recent(spark, sf_dir, "1 hour")
    return A.status_over_time(ev, "1 hour", as_of, ("OK", "WARN", "CRITICAL", "ERROR"))


@query("warnings_by_device_5m", over_events(
    f"SELECT device_id, {n_status('WARN')} AS warnings FROM ev WHERE {within('5 minutes')} "
    "GROUP BY 1 ORDER BY warnings DESC, device_id LIMIT 10"))
def warnings_by_device_5m(spark, sf_dir):
    ev, as_of = recent(spark, sf_dir, "5 minutes")
    return A.warnings_by_device(ev, "5 minutes", 10, True, as_of)


@query("warnings_by_device_1h", over_events(
    f"SELECT device_id, count(*) AS warnings FROM ev WHERE {within('1 hour')} AND status = 'WARN' "
    "GROUP BY 1 ORDER BY warnings DESC, device_id LIMIT 10"))
def warnings_by_device_1h(spark, sf_dir):
    ev, as_of = recent(spark, sf_dir, "1 hour")
    return A.warnings_by_device(ev, "1 hour", 10, False, as_of)


def _active(where: str) -> str:
    return over_events(f"SELECT count(DISTINCT device_id) AS devices FROM ev WHERE {where}")


@query("active_devices_5m", _active(within("5 minutes")))
def active_devices_5m(spark, sf_dir):
    ev, as_of = recent(spark, sf_dir, "5 minutes")
    return A.active_devices(ev, "5 minutes", as_of)


@query("active_devices_1h", _active(within("1 hour")))
def active_devices_1h(spark, sf_dir):
    ev, as_of = recent(spark, sf_dir, "1 hour")
    return A.active_devices(ev, "1 hour", as_of)


@query("active_devices_all", _active("true"))
def active_devices_all(spark, sf_dir):
    return A.active_devices(telemetry(spark, sf_dir), None)


def _readable(n: str) -> str:
    step = lambda size, unit: (
        f"WHEN {n} >= {size} THEN printf('%.2f {unit}', {r(f'(CAST({n} AS DOUBLE) / {size})', 2)})"
    )
    return (
        f"CASE {step(10**12, 'trillion')} {step(10**9, 'billion')} {step(10**6, 'million')} "
        f"{step(10**3, 'thousand')} ELSE printf('%.2f', CAST({n} AS DOUBLE)) END"
    )


def _total(where: str, compression: int = 60) -> str:
    return over_events(
        f"SELECT count(*) AS events, {_readable('count(*)')} AS readable FROM ev WHERE {where}", compression=compression
    )


@query("total_events_all", _total("true"))
def total_events_all(spark, sf_dir):
    return A.total_events(telemetry(spark, sf_dir))


@query("total_events_5m", _total(within("5 minutes")))
def total_events_5m(spark, sf_dir):
    ev, as_of = recent(spark, sf_dir, "5 minutes")
    return A.total_events(ev, "5 minutes", as_of)


@query("total_events_24h", _total(within("24 hours"), 1))
def total_events_24h(spark, sf_dir):
    ev, as_of = recent(spark, sf_dir, "24 hours", compression=1)
    return A.total_events(ev, "24 hours", as_of)


def _average(metric: str) -> str:
    return over_events(f"SELECT {avg(metric, 1)} AS avg_{metric} FROM ev WHERE {within('15 minutes')}")


@query("average_temperature_15m", _average("temperature"))
def average_temperature_15m(spark, sf_dir):
    ev, as_of = recent(spark, sf_dir, "15 minutes")
    return A.metric_average(ev, "temperature", "15 minutes", as_of)


@query("average_pressure_15m", _average("pressure"))
def average_pressure_15m(spark, sf_dir):
    ev, as_of = recent(spark, sf_dir, "15 minutes")
    return A.metric_average(ev, "pressure", "15 minutes", as_of)


@query("average_humidity_15m", _average("humidity"))
def average_humidity_15m(spark, sf_dir):
    ev, as_of = recent(spark, sf_dir, "15 minutes")
    return A.metric_average(ev, "humidity", "15 minutes", as_of)


@query("throughput_1m", over_events(
    f"SELECT {r('(CAST(count(*) AS DOUBLE) / 60)', 2)} AS eps FROM ev WHERE {within('1 minute')}"))
def throughput_1m(spark, sf_dir):
    ev, as_of = recent(spark, sf_dir, "1 minute")
    return A.throughput(ev, "1 minute", as_of)


@query("throughput_since_start", over_events(
    f"SELECT {r(f'''(CAST(count(*) AS DOUBLE) / greatest(epoch_us((SELECT t FROM lim)) // 1000000 - epoch_us(TIMESTAMP '{ORIGIN}') // 1000000, 1))''', 2)}"
    f" AS msg_per_sec FROM ev WHERE timestamp >= TIMESTAMP '{ORIGIN}'"))
def throughput_since_start(spark, sf_dir):
    return A.throughput_since_start(telemetry(spark, sf_dir), ORIGIN)


def _rate(status: str, span: str) -> str:
    return over_events(f"SELECT {pct(n_status(status))} AS {status.lower()}_pct FROM ev WHERE {within(span)}")


@query("warning_rate_5m", _rate("WARN", "5 minutes"))
def warning_rate_5m(spark, sf_dir):
    ev, as_of = recent(spark, sf_dir, "5 minutes")
    return A.status_rate(ev, "WARN", "5 minutes", as_of)


@query("warning_rate_15m", _rate("WARN", "15 minutes"))
def warning_rate_15m(spark, sf_dir):
    ev, as_of = recent(spark, sf_dir, "15 minutes")
    return A.status_rate(ev, "WARN", "15 minutes", as_of)


@query("error_rate_15m", _rate("ERROR", "15 minutes"))
def error_rate_15m(spark, sf_dir):
    ev, as_of = recent(spark, sf_dir, "15 minutes")
    return A.status_rate(ev, "ERROR", "15 minutes", as_of)


def _rank(metric: str, span: str, order: str) -> str:
    return over_events(
        f"SELECT device_id, {avg(metric, 1)} AS {metric} FROM ev WHERE {within(span)} GROUP BY 1 ORDER BY {order}"
    )


@query("battery_by_device", _rank("battery_level", "15 minutes", "2"))
def battery_by_device(spark, sf_dir):
    ev, as_of = recent(spark, sf_dir, "15 minutes")
    return A.device_metric_rank(ev, "battery_level", "15 minutes", True, None, as_of)


@query("top_power_consumers", _rank("power_consumption", "5 minutes", "2 DESC NULLS LAST, 1 LIMIT 8"))
def top_power_consumers(spark, sf_dir):
    ev, as_of = recent(spark, sf_dir, "5 minutes")
    return A.device_metric_rank(ev, "power_consumption", "5 minutes", False, 8, as_of)


@query("hottest_devices", _rank("temperature", "1 hour", "2 DESC NULLS LAST, 1 LIMIT 10"))
def hottest_devices(spark, sf_dir):
    ev, as_of = recent(spark, sf_dir, "1 hour")
    return A.device_metric_rank(ev, "temperature", "1 hour", False, 10, as_of)


def _busiest(limit: int) -> str:
    return over_events(
        f"SELECT device_id, count(*) AS events FROM ev WHERE {within('1 hour')} GROUP BY 1 "
        f"ORDER BY events DESC, device_id LIMIT {limit}"
    )


@query("busiest_devices_20", _busiest(20))
def busiest_devices_20(spark, sf_dir):
    ev, as_of = recent(spark, sf_dir, "1 hour")
    return A.busiest_devices(ev, "1 hour", 20, as_of)


@query("busiest_devices_10", _busiest(10))
def busiest_devices_10(spark, sf_dir):
    ev, as_of = recent(spark, sf_dir, "1 hour")
    return A.busiest_devices(ev, "1 hour", 10, as_of)


@query("device_table", over_events(f"""
SELECT device_id, location, count(*) AS events, {avg('temperature', 1)} AS avg_temp,
  {avg('pressure', 1)} AS avg_pressure, {avg('humidity', 1)} AS avg_humidity,
  {avg('battery_level', 1)} AS battery, max(timestamp) AS last_seen
FROM ev WHERE {within('1 hour')} GROUP BY 1, 2"""))
def device_table(spark, sf_dir):
    ev, as_of = recent(spark, sf_dir, "1 hour")
    return A.device_table(ev, "1 hour", as_of)


@query("uptime_heatmap", over_events(
    f"SELECT {HOUR} AS hour, device_id, count(*) AS events FROM ev WHERE {within('24 hours')} GROUP BY 1, 2"))
def uptime_heatmap(spark, sf_dir):
    ev, as_of = recent(spark, sf_dir, "24 hours")
    return A.uptime_heatmap(ev, "24 hours", as_of)


@query("hourly_trend", over_events(
    f"SELECT {HOUR} AS hour, count(*) AS events, {n_status('WARN')} AS warnings, {n_status('ERROR')} AS errors "
    f"FROM ev WHERE {within('24 hours')} GROUP BY 1 ORDER BY 1"))
def hourly_trend(spark, sf_dir):
    ev, as_of = recent(spark, sf_dir, "24 hours")
    return A.hourly_trend(ev, "24 hours", as_of)


@query("anomaly_count", over_events(f"SELECT count(*) AS anomalies FROM ev WHERE {within('1 hour')} AND {RANGE5}"))
def anomaly_count(spark, sf_dir):
    ev, as_of = recent(spark, sf_dir, "1 hour")
    return A.anomaly_count(ev, "1 hour", as_of)


@query("anomaly_series", over_events(
    f"SELECT {MINUTE} AS minute, device_id, {avg('temperature', 3)} AS temp FROM ev "
    f"WHERE {within('24 hours')} AND (temperature > 80 OR temperature < 10) GROUP BY 1, 2"))
def anomaly_series(spark, sf_dir):
    ev, as_of = recent(spark, sf_dir, "24 hours")
    return A.anomaly_series(ev, "24 hours", as_of=as_of)


@query("low_battery_devices", over_events(
    f"SELECT count(DISTINCT device_id) AS low_battery_devices FROM ev WHERE {within('15 minutes')} AND battery_level < 20"))
def low_battery_devices(spark, sf_dir):
    ev, as_of = recent(spark, sf_dir, "15 minutes")
    return A.low_battery_devices(ev, "15 minutes", as_of=as_of)


_QUALITY_BY_LOCATION = """
SELECT location, count(*) AS total_events, {ok} AS ok_events, {warn} AS warnings, {error} AS errors,
  {rate} AS ok_rate, {mean} AS avg_temp, {dev} AS temp_stddev, count(DISTINCT device_id) AS devices
FROM ev WHERE {bound} GROUP BY 1""".format(
    ok=n_status("OK"), warn=n_status("WARN"), error=n_status("ERROR"), rate=pct(n_status("OK"), digits=1),
    mean=avg("temperature", 1), dev=r("stddev_pop(CAST(temperature AS DOUBLE))", 2), bound=within("1 hour"),
)


@query("quality_by_location", over_events(_QUALITY_BY_LOCATION))
def quality_by_location(spark, sf_dir):
    ev, as_of = recent(spark, sf_dir, "1 hour")
    return A.quality_by_location(ev, "1 hour", as_of)


_HOT = f"""
SELECT coalesce({r(mean("CASE WHEN " + within('5 minutes') + " THEN temperature END"), 2)}, 0) AS avg_temperature_5m,
  coalesce({r(mean("CASE WHEN " + within('5 minutes') + " THEN pressure END"), 2)}, 0) AS avg_pressure_5m,
  coalesce({high('temperature')}, 0) AS max_temperature_15m, coalesce({low('temperature')}, 0) AS min_temperature_15m,
  count(*) FILTER (WHERE {within('1 minute')}) AS events_1m, count(DISTINCT device_id) AS active_devices,
  {n_status('WARN', 'CRITICAL')} AS warning_count, count(*) FILTER (WHERE {RANGE5}) AS anomaly_count,
  {r(f"(CAST(count(*) FILTER (WHERE {within('1 minute')}) AS DOUBLE) / 60)", 2)} AS msg_per_sec
FROM ev WHERE {within('15 minutes')}"""


@query("hot_metrics", over_events(_HOT))
def hot_metrics(spark, sf_dir):
    ev, as_of = recent(spark, sf_dir, "15 minutes")
    return A.hot_metrics(ev, as_of)


def _long(section: str, source: str, bucket: str, measures: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{section}' AS section, {bucket} AS bucket, '{m}' AS measure, CAST({m} AS DOUBLE) AS value FROM {source}"
        for m in measures
    )


_HOT_NAMES = [
    "avg_temperature_5m", "avg_pressure_5m", "max_temperature_15m", "min_temperature_15m", "events_1m",
    "active_devices", "warning_count", "anomaly_count", "msg_per_sec",
]


@query("dashboard_bundle", over_events(
    " UNION ALL ".join([
        _long("hot_metrics", "hot", "CAST(NULL AS TIMESTAMP)", _HOT_NAMES),
        _long("temperature_timeseries", "series", "minute", ["avg_temp", "min_temp", "max_temp"]),
        _long("hourly_stats", "hours", "hour",
              ["events", "avg_temp", "max_temp", "min_temp", "avg_pressure", "warnings"]),
    ]),
    f"hot AS ({_HOT})",
    f"""series AS (SELECT {MINUTE} AS minute, {avg('temperature')} AS avg_temp, {low('temperature')} AS min_temp,
      {high('temperature')} AS max_temp FROM ev WHERE {within('60 minutes')} AND temperature IS NOT NULL GROUP BY 1)""",
    f"hours AS ({_HOURLY_SUMMARY})"))
def dashboard_bundle(spark, sf_dir):
    ev, as_of = recent(spark, sf_dir, "24 hours")
    return A.dashboard_bundle(ev, as_of)


# -- filters and labels ---------------------------------------------------------------------------

@query("trailing_rows_1h", over_events(
    f"SELECT timestamp, device_id, {doubles('temperature', 'pressure')}, status, msg_id FROM ev WHERE {within('1 hour')}"))
def trailing_rows_1h(spark, sf_dir):
    ev, as_of = recent(spark, sf_dir, "1 hour")
    return doubled(Fl.trailing(ev, "1 hour", as_of).select("timestamp", "device_id", "temperature", "pressure", "status", "msg_id"))


@query("alert_status_rows", over_events(
    "SELECT timestamp, device_id, status, msg_id FROM ev WHERE status IN ('WARN', 'CRITICAL')"))
def alert_status_rows(spark, sf_dir):
    return Fl.status_in(telemetry(spark, sf_dir), ("WARN", "CRITICAL")).select("timestamp", "device_id", "status", "msg_id")


ALERTS = f"""
SELECT timestamp, device_id, device_type, location, {doubles('temperature', 'pressure')}, status,
  {label(ALERT_RULES, 'normal')} AS anomaly_type, msg_id
FROM ev WHERE status IN ('WARN', 'CRITICAL')"""


@query("classified_alerts", over_events(ALERTS))
def classified_alerts(spark, sf_dir):
    return doubled(Fl.classify_alerts(telemetry(spark, sf_dir)))


@query("recent_anomalies", over_events(f"""
SELECT timestamp, device_id, location, {doubles('temperature', 'pressure', 'humidity', 'battery_level')}, status,
  {label(RANGE_RULES, 'Unknown')} AS anomaly_type, msg_id
FROM ev WHERE {within('1 hour')} AND {any_of(RANGE_RULES)}
ORDER BY timestamp DESC, msg_id DESC LIMIT 50"""))
def recent_anomalies(spark, sf_dir):
    ev, as_of = recent(spark, sf_dir, "1 hour")
    return doubled(Fl.recent_anomalies(ev, "1 hour", 50, as_of))


@query("anomaly_points", over_events(
    f"SELECT {MINUTE} AS minute, device_id, {doubles('temperature')} FROM ev "
    f"WHERE {within('24 hours')} AND (temperature > 80 OR temperature < 10)"))
def anomaly_points(spark, sf_dir):
    ev, as_of = recent(spark, sf_dir, "24 hours")
    return doubled(Fl.anomaly_points(ev, span="24 hours", as_of=as_of))


@query("distinct_devices_1d", over_events(f"SELECT DISTINCT device_id FROM ev WHERE {within('1 day')}", compression=1))
def distinct_devices_1d(spark, sf_dir):
    ev, as_of = recent(spark, sf_dir, "1 day", compression=1)
    return Fl.distinct_devices(ev, "1 day", as_of)


@query("assigned_status", over_events("""
SELECT device_id, msg_id, CASE
  WHEN temperature >= 40 OR pressure >= 1070 OR humidity >= 95 OR voltage <= 2.5 OR battery_level <= 10 THEN 'CRITICAL'
  WHEN temperature >= 35 OR pressure >= 1050 OR humidity >= 85 OR voltage <= 2.8 OR battery_level <= 20 THEN 'WARN'
  ELSE 'OK' END AS assigned FROM ev"""))
def assigned_status(spark, sf_dir):
    return Fl.assign_status(telemetry(spark, sf_dir), col="assigned").select("device_id", "msg_id", "assigned")


@query("value_bands", over_events("""
SELECT device_id, battery, warnings, CAST(idle AS BIGINT) AS idle,
  CASE WHEN battery >= 50 THEN 'green' WHEN battery >= 20 THEN 'yellow' ELSE 'red' END AS battery_band,
  CASE WHEN warnings >= 10 THEN 'red' WHEN warnings >= 5 THEN 'yellow' ELSE 'green' END AS warning_band,
  CASE WHEN idle >= 300 THEN 'red' WHEN idle >= 60 THEN 'yellow' ELSE 'green' END AS freshness_band,
  CASE WHEN idle >= 60 THEN 'red' WHEN idle >= 30 THEN 'yellow' ELSE 'green' END AS last_event_band
FROM s""", f"""s AS (SELECT device_id, {avg('battery_level', 1)} AS battery, count(*) FILTER (WHERE status = 'WARN') AS warnings,
  epoch_us((SELECT t FROM lim)) // 1000000 - epoch_us(max(timestamp)) // 1000000 AS idle FROM ev GROUP BY 1)"""))
def value_bands(spark, sf_dir):
    ev = telemetry(spark, sf_dir)
    per_device = ev.groupBy("device_id").agg(
        A.avg("battery_level", 1).alias("battery"), A.having_status("WARN").alias("warnings"),
        F.max("timestamp").alias("seen"),
    )
    per_device = per_device.withColumn("idle", seconds_between(F.col("seen"), newest(ev))).drop("seen")
    for col, steps, out in (
        ("battery", BATTERY_BANDS, "battery_band"), ("warnings", WARNING_BANDS, "warning_band"),
        ("idle", FRESHNESS_BANDS, "freshness_band"), ("idle", LAST_EVENT_BANDS, "last_event_band"),
    ):
        per_device = Fl.band(per_device, col, steps, out)
    return per_device


@query("device_tints", over_events(f"""
SELECT device_id,
  CASE WHEN temperature IS NULL THEN NULL WHEN temperature > 35 THEN 'red' WHEN temperature > 30 THEN 'orange'
    WHEN temperature < 15 THEN 'blue' ELSE 'white' END AS temperature_tint,
  CASE WHEN battery_level > 80 THEN 'green' WHEN battery_level > 50 THEN 'lightGreen'
    WHEN battery_level > 20 THEN 'orange' ELSE 'red' END AS battery_tint,
  CASE WHEN (epoch_us((SELECT t FROM lim)) - epoch_us(timestamp)) // 60000000 < 5 THEN 'green'
    WHEN (epoch_us((SELECT t FROM lim)) - epoch_us(timestamp)) // 60000000 < 15 THEN 'yellow' ELSE 'red' END AS last_seen_tint
FROM {latest('device_id')}"""))
def device_tints(spark, sf_dir):
    latest_rows = D.latest_reading(telemetry(spark, sf_dir)).withColumnRenamed("timestamp", "last_seen")
    return Fl.device_tints(latest_rows)


@query("unexpired_messages", over_events("""
SELECT device_id, msg_id, CAST(CASE WHEN status <> 'OK' THEN 60 + msg_id % 36000 END AS BIGINT) AS expiry_seconds
FROM ev WHERE status = 'OK' OR timestamp + to_seconds(60 + msg_id % 36000) > (SELECT t FROM lim)"""))
def unexpired_messages(spark, sf_dir):
    life = F.when(F.col("status") != "OK", 60 + F.col("msg_id") % 36000)
    ev = telemetry(spark, sf_dir).withColumn("expiry_seconds", life)
    return Fl.drop_expired(ev, newest_time(spark, sf_dir)).select("device_id", "msg_id", "expiry_seconds")


# -- device state ---------------------------------------------------------------------------------

@query("latest_readings", over_events(
    f"SELECT device_id, timestamp, status, msg_id, {doubles(*METRICS)} FROM {latest('device_id')}"))
def latest_readings(spark, sf_dir):
    return doubled(D.latest_reading(telemetry(spark, sf_dir)))


@query("latest_reading_of_device", over_events(
    f"SELECT device_id, timestamp, status, msg_id, {doubles(*METRICS)} FROM {latest('device_id')} "
    "WHERE device_id = (SELECT max(device_id) FROM ev)"))
def latest_reading_of_device(spark, sf_dir):
    ev = telemetry(spark, sf_dir)
    return doubled(D.latest_reading(ev, ev.agg(F.max("device_id")).first()[0]))


@query("stale_device_count", over_events(f"""
SELECT (SELECT count(DISTINCT device_id) FROM ev WHERE {within('1 hour')})
  - (SELECT count(DISTINCT device_id) FROM ev WHERE {within('5 minutes')}) AS stale_devices"""))
def stale_device_count(spark, sf_dir):
    ev, as_of = recent(spark, sf_dir, "1 hour")
    return D.stale_device_count(ev, as_of=as_of)


@query("stale_devices", over_events(f"""
SELECT device_id, last_seen, age_seconds,
  CASE WHEN age_seconds / 60.0 >= 15 THEN 'red' WHEN age_seconds / 60.0 >= 5 THEN 'yellow' ELSE 'green' END AS band
FROM (SELECT device_id, max(timestamp) AS last_seen,
    CAST(epoch_us((SELECT t FROM lim)) // 1000000 - epoch_us(max(timestamp)) // 1000000 AS BIGINT) AS age_seconds
  FROM ev WHERE {within('1 hour')} GROUP BY 1)
WHERE last_seen < (SELECT t FROM lim) - INTERVAL '5 minutes'"""))
def stale_devices(spark, sf_dir):
    ev, as_of = recent(spark, sf_dir, "1 hour")
    return D.stale_devices(ev, as_of=as_of)


@query("devices_with_metadata", over_events("""
SELECT device_id, events, c.c_name AS device_name, c.site
FROM (SELECT device_id, count(*) AS events FROM ev GROUP BY 1)
LEFT JOIN (SELECT 'device-' || lpad(CAST(c_custkey AS VARCHAR), greatest(length(CAST(c_custkey AS VARCHAR)), 4)::INTEGER, '0') AS device_id,
  c_name, (SITES)[c_custkey % 16 + 1] AS site FROM customer) c USING (device_id)"""
    .replace("SITES", "[" + ", ".join(f"'{p}'" for p in LOCATIONS) + "]")))
def devices_with_metadata(spark, sf_dir):
    per_device = A.summarise(telemetry(spark, sf_dir), {"events": A.events()}, keys=["device_id"])
    return D.with_device_metadata(per_device, device_metadata(spark, sf_dir))


@query("device_presence", over_events("""
SELECT device_id, arg_max(status <> 'ERROR', msg_id) AS online, max(timestamp) AS last_notice FROM ev GROUP BY 1"""))
def device_presence(spark, sf_dir):
    return D.device_presence(presence_notices(spark, sf_dir))


def buffer_sql(n: int) -> str:
    return over_events(
        f"SELECT timestamp, device_id, msg_id, status, {doubles('temperature', 'pressure')} FROM ev "
        f"ORDER BY timestamp DESC, msg_id DESC LIMIT {n}"
    )


BUFFERED = ("timestamp", "device_id", "msg_id", "status", "temperature", "pressure")


@query("replay_buffer_10000", buffer_sql(10_000))
def replay_buffer_10000(spark, sf_dir):
    return doubled(D.replay_buffer(telemetry(spark, sf_dir), 10_000).select(*BUFFERED))


@query("replay_buffer_1000", buffer_sql(1_000))
def replay_buffer_1000(spark, sf_dir):
    return doubled(D.replay_buffer(telemetry(spark, sf_dir), 1_000).select(*BUFFERED))


LIVE_STATS = over_events(f"""
SELECT (SELECT count(DISTINCT device_id) FROM ev WHERE {within('5 minutes')}) AS active_devices,
  least((SELECT count(*) FROM ev), 10000) AS stream_length""")


@query("live_stats", LIVE_STATS)
def live_stats(spark, sf_dir):
    return D.live_stats(telemetry(spark, sf_dir))


# -- SQL over the registered views ----------------------------------------------------------------

@query("alerts_by_type_view", over_events(
    "SELECT anomaly_type, status, count(*) AS alerts, max(timestamp) AS latest FROM a GROUP BY 1, 2", f"a AS ({ALERTS})"))
def alerts_by_type_view(spark, sf_dir):
    register_views(telemetry(spark, sf_dir))
    return spark.sql(
        "SELECT anomaly_type, status, count(*) AS alerts, max(timestamp) AS latest FROM telemetry_anomalies GROUP BY ALL"
    )


@query("hourly_events_view", over_events(
    f"SELECT {HOUR} AS hour, count(*) AS events, {n_status('WARN')} AS warnings FROM ev "
    "WHERE device_type = 'multi-sensor' GROUP BY 1"))
def hourly_events_view(spark, sf_dir):
    register_views(telemetry(spark, sf_dir))
    return spark.sql(
        "SELECT bucket AS hour, sum(events) AS events, sum(warnings) AS warnings FROM telemetry_events_hour "
        "WHERE device_type = 'multi-sensor' GROUP BY bucket"
    )
