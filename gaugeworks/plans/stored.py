"""Rollups, quality, triggers, faults and metric samples."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from gaugeworks.functions import instant, rounded
from gaugeworks.operators import anomalies as W
from gaugeworks.operators import maintenance as X
from gaugeworks.operators import quality as Q
from gaugeworks.operators import rollups as R
from gaugeworks.operators import samples as M
from gaugeworks.plans.registry import doubled, query, recent
from gaugeworks.plans.sql import avg, high, low, n_status, over_events, r, within
from gaugeworks.session import fresh_path
from gaugeworks.sources import sample_tables as S
from gaugeworks.sources.sample_tables import newest_time, telemetry

# -- rollups --------------------------------------------------------------------------------------


def rollup_sql(grain: str, metrics=R.MINUTE_METRICS, where: str = "true") -> str:
    parts = ", ".join(
        f"CAST(sum({m}) AS DOUBLE) AS sum_{m}, count({m}) AS n_{m}, "
        f"CAST(min({m}) AS DOUBLE) AS min_{m}, CAST(max({m}) AS DOUBLE) AS max_{m}"
        for m in metrics
    )
    return (
        f"SELECT date_trunc('{grain}', timestamp)::TIMESTAMP AS bucket, device_id, device_type, location, "
        f"count(*) AS events, {n_status('OK')} AS ok, {n_status('WARN')} AS warnings, "
        f"{n_status('CRITICAL')} AS criticals, {parts} FROM ev WHERE {where} GROUP BY 1, 2, 3, 4"
    )


@query("rollup_minute", over_events(rollup_sql("minute")))
def rollup_minute(spark, sf_dir):
    return doubled(R.rollup(telemetry(spark, sf_dir), "minute"))


def _retained(grain: str, keep: str, later: int, metrics):
    """A stored rollup after its retention job, ``later`` days after the newest event."""
    since = f"bucket >= (SELECT t FROM lim) + INTERVAL '{later} days' - INTERVAL '{keep}'"
    sql = over_events(f"SELECT * FROM ({rollup_sql(grain, metrics)}) WHERE {since}", compression=1)

    @query(f"retained_{grain}_rollup", sql)
    def retained(spark, sf_dir):
        path = fresh_path(spark, f"{grain}-rollup")
        R.write_rollup(R.rollup(telemetry(spark, sf_dir, compression=1), grain), path, grain)
        as_of = newest_time(spark, sf_dir, 1) + dt.timedelta(days=later)
        X.apply_table_retention(spark, {grain: path}, as_of)
        return doubled(spark.read.parquet(path).drop("part"))

    return retained


retained_minute_rollup = _retained("minute", "7 days", 0, R.MINUTE_METRICS)
retained_hour_rollup = _retained("hour", "365 days", 350, R.HOUR_METRICS)
retained_day_rollup = _retained("day", "2 years", 715, R.HOUR_METRICS)


@query("rollup_hour", over_events(rollup_sql("hour", R.HOUR_METRICS)))
def rollup_hour(spark, sf_dir):
    return doubled(R.rollup(telemetry(spark, sf_dir), "hour"))


@query("rollup_day", over_events(rollup_sql("day", R.HOUR_METRICS), compression=1))
def rollup_day(spark, sf_dir):
    return doubled(R.rollup(telemetry(spark, sf_dir, compression=1), "day"))


@query("rollup_merged_loads", over_events(rollup_sql("minute")))
def rollup_merged_loads(spark, sf_dir):
    """Two loads, split by event type so that most minutes occur in both, rolled up apart and merged."""
    ev = telemetry(spark, sf_dir)
    first = F.col("status").isin("OK", "WARN")
    return doubled(R.merge_rollup(R.rollup(ev.filter(first)), R.rollup(ev.filter(~first))))


@query("rollup_hour_from_minute", over_events(rollup_sql("hour")))
def rollup_hour_from_minute(spark, sf_dir):
    return doubled(R.coarsen(R.rollup(telemetry(spark, sf_dir), "minute"), "hour"))


@query("rollup_day_from_minute", over_events(rollup_sql("day"), compression=1))
def rollup_day_from_minute(spark, sf_dir):
    minute = R.rollup(telemetry(spark, sf_dir, compression=1), "minute")
    return doubled(R.coarsen(R.coarsen(minute, "hour"), "day"))


@query("device_stats_from_rollup", over_events(f"""
SELECT device_id, count(*) AS message_count, {avg('temperature')} AS avg_temperature,
  {low('temperature')} AS min_temperature, {high('temperature')} AS max_temperature,
  {avg('pressure')} AS avg_pressure, {n_status('WARN')} AS warning_count
FROM ev WHERE date_trunc('minute', timestamp) >= (SELECT t FROM lim) - INTERVAL '5 minutes' GROUP BY 1"""))
def device_stats_from_rollup(spark, sf_dir):
    ev, as_of = recent(spark, sf_dir, "5 minutes")
    return R.device_stats_from_rollup(R.rollup(ev, "minute"), "5 minutes", as_of)


def _trend(unit: str, span: str, compression: int) -> str:
    return over_events(
        f"SELECT date_trunc('{unit}', timestamp) AS bucket, count(*) AS events, {avg('temperature')} AS avg_temperature "
        f"FROM ev WHERE date_trunc('{unit}', timestamp) >= (SELECT t FROM lim) - INTERVAL '{span}' GROUP BY 1",
        compression=compression,
    )


@query("hourly_trend_from_rollup", _trend("hour", "24 hours", 1))
def hourly_trend_from_rollup(spark, sf_dir):
    ev, as_of = recent(spark, sf_dir, "24 hours", compression=1)
    return R.trend_from_rollup(R.rollup(ev, "hour"), "24 hours", as_of)


@query("minute_trend_from_rollup", _trend("minute", "1 hour", 60))
def minute_trend_from_rollup(spark, sf_dir):
    ev, as_of = recent(spark, sf_dir, "1 hour")
    return R.trend_from_rollup(R.rollup(ev, "minute"), "1 hour", as_of)


def _from_buckets(unit: str, name: str, columns: str, span: str, compression: int) -> str:
    """Whole buckets of the span."""
    return over_events(
        f"SELECT date_trunc('{unit}', timestamp) AS {name}, {avg('temperature')} AS avg_temperature, {avg('pressure')} AS avg_pressure, "
        f"{columns} FROM ev WHERE date_trunc('{unit}', timestamp) >= (SELECT t FROM lim) - INTERVAL '{span}' GROUP BY 1",
        compression=compression,
    )


@query("timeseries_from_rollup", _from_buckets("minute", "minute", "count(*) AS event_count", "1 hour", 60))
def timeseries_from_rollup(spark, sf_dir):
    ev, as_of = recent(spark, sf_dir, "1 hour")
    return R.timeseries_from_rollup(R.rollup(ev, "minute"), "1 hour", as_of=as_of)


@query("hourly_stats_from_rollup", _from_buckets(
    "hour", "hour", "count(*) AS events, count(DISTINCT device_id) AS active_devices", "24 hours", 1))
def hourly_stats_from_rollup(spark, sf_dir):
    ev, as_of = recent(spark, sf_dir, "24 hours", compression=1)
    return R.hourly_stats_from_rollup(R.rollup(ev, "hour"), "24 hours", as_of)


@query("hourly_coverage", over_events("""
SELECT count(*) AS row_count, min(h) AS earliest, max(h) AS latest
FROM (SELECT DISTINCT date_trunc('hour', timestamp) AS h, device_id, device_type, location FROM ev)
WHERE h >= (SELECT t FROM lim) - INTERVAL '24 hours'""", compression=1))
def hourly_coverage(spark, sf_dir):
    ev, as_of = recent(spark, sf_dir, "24 hours", compression=1)
    return R.hourly_coverage(R.rollup(ev, "hour"), "24 hours", as_of)


@query("daily_coverage", over_events("""
SELECT count(*) AS row_count, count(DISTINCT device_id) AS unique_devices, min(d) AS earliest, max(d) AS latest
FROM (SELECT DISTINCT CAST(timestamp AS DATE) AS d, device_id, device_type, location FROM ev)
WHERE d >= CAST((SELECT t FROM lim) AS DATE) - 30""", compression=1))
def daily_coverage(spark, sf_dir):
    ev = telemetry(spark, sf_dir, compression=1)
    return R.daily_coverage(R.rollup(ev, "day"), 30, newest_time(spark, sf_dir, 1))


@query("refreshed_rollup", over_events(rollup_sql("minute"), compression=1))
def refreshed_rollup(spark, sf_dir):
    """A stored rollup of the older events, brought up to date from the day on which they end."""
    path = fresh_path(spark, "rollup")
    ev = telemetry(spark, sf_dir, compression=1)
    ends = "2024-01-21 06:30:00"
    R.write_rollup(R.rollup(ev.filter(F.col("timestamp") < instant(ends))), path, "minute")
    return doubled(R.refresh_rollup(spark, path, ev, ends, "minute").drop("part"))


# -- quality and triggers -------------------------------------------------------------------------

_QUALITY = f"""
SELECT count(*) AS total_events,
  {r("(CAST(count(*) FILTER (WHERE temperature IS NULL) AS DOUBLE) / greatest(count(*), 1) * 100)", 2)} AS null_temperature_pct,
  {r("(CAST(count(*) FILTER (WHERE pressure IS NULL) AS DOUBLE) / greatest(count(*), 1) * 100)", 2)} AS null_pressure_pct,
  {r("(CAST(count(*) FILTER (WHERE temperature < -50 OR temperature > 100) AS DOUBLE) / greatest(count(*), 1) * 100)", 2)} AS temp_outlier_pct,
  {r("(CAST(count(*) FILTER (WHERE pressure < 950 OR pressure > 1050) AS DOUBLE) / greatest(count(*), 1) * 100)", 2)} AS pressure_outlier_pct,
  count(DISTINCT device_id) AS unique_devices,
  {r('''(CAST(greatest(count(*), 1) * 2 - count(*) FILTER (WHERE temperature IS NULL)
    - count(*) FILTER (WHERE pressure IS NULL) AS DOUBLE) / (greatest(count(*), 1) * 2) * 100)''', 2)} AS data_completeness,
  min(timestamp) AS earliest, max(timestamp) AS latest
FROM ev WHERE """


@query("quality_metrics", over_events(_QUALITY + within("1 hour")))
def quality_metrics(spark, sf_dir):
    ev, as_of = recent(spark, sf_dir, "1 hour")
    return Q.quality_metrics(ev, "1 hour", as_of)


@query("quality_metrics_all", over_events(_QUALITY + "true"))
def quality_metrics_all(spark, sf_dir):
    return Q.quality_metrics(telemetry(spark, sf_dir), None)


@query("quality_alerts", over_events(
    "SELECT * FROM q WHERE data_completeness < 95", f"q AS ({_QUALITY + within('1 hour')})"))
def quality_alerts(spark, sf_dir):
    ev, as_of = recent(spark, sf_dir, "1 hour")
    return Q.quality_alerts(Q.quality_metrics(ev, "1 hour", as_of))


CHECKED_AT = "2024-01-01 12:05:30"


@query("freshness", over_events(f"""
SELECT s AS lag_seconds, CASE WHEN s >= 300 THEN 'red' WHEN s >= 60 THEN 'yellow' ELSE 'green' END AS band
FROM (SELECT CAST(epoch_us(TIMESTAMP '{CHECKED_AT}') // 1000000 - epoch_us(t) // 1000000 AS BIGINT) AS s FROM lim)"""))
def freshness(spark, sf_dir):
    return Q.freshness(telemetry(spark, sf_dir), CHECKED_AT)


@query("freshness_trigger", over_events(f"""
SELECT TIMESTAMP '{CHECKED_AT}' > t + INTERVAL '5 minutes' AS fire,
  CAST(floor((epoch_us(TIMESTAMP '{CHECKED_AT}') - epoch_us(t)) / 1000000) AS BIGINT) AS age_seconds,
  CASE WHEN TIMESTAMP '{CHECKED_AT}' > t + INTERVAL '5 minutes' THEN 'freshness_alert_202401011205' END AS run_key,
  CASE WHEN TIMESTAMP '{CHECKED_AT}' > t + INTERVAL '5 minutes' THEN 'stale' ELSE 'fresh' END AS reason
FROM lim"""))
def freshness_trigger(spark, sf_dir):
    return Q.freshness_trigger(telemetry(spark, sf_dir), CHECKED_AT)


def _volume(limit: int) -> str:
    return over_events(f"""
SELECT n AS events, n > {limit} AS fire,
  CASE WHEN n > {limit} THEN 'high_volume_' || strftime((SELECT t FROM lim), '%Y%m%d%H%M') END AS run_key
FROM (SELECT count(*) AS n FROM ev WHERE {within('1 minute')})""")


@query("volume_trigger", _volume(1000))
def volume_trigger(spark, sf_dir):
    ev, as_of = recent(spark, sf_dir, "1 minute")
    return Q.volume_trigger(ev, as_of)


@query("volume_trigger_low_limit", _volume(5))
def volume_trigger_low_limit(spark, sf_dir):
    ev, as_of = recent(spark, sf_dir, "1 minute")
    return Q.volume_trigger(ev, as_of, limit=5)


@query("retained_events", over_events(
    f"SELECT device_id, msg_id, timestamp FROM ev WHERE {within('7 days')}", compression=1))
def retained_events(spark, sf_dir):
    ev, as_of = recent(spark, sf_dir, "7 days", compression=1)
    return Q.apply_retention(ev, "7 days", as_of).select("device_id", "msg_id", "timestamp")


# -- faults ---------------------------------------------------------------------------------------

def _spikes(metric: str, factor: float) -> str:
    frame = "OVER (PARTITION BY device_id ORDER BY timestamp, msg_id ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)"
    return over_events(f"""
SELECT device_id, timestamp, msg_id, CAST(v AS DOUBLE) AS value, {r('(s / n)', 3)} AS baseline
FROM (SELECT device_id, timestamp, msg_id, {metric} AS v, CAST(sum({metric}) {frame} AS DOUBLE) AS s,
    count({metric}) {frame} AS n FROM ev WHERE {metric} IS NOT NULL)
WHERE n > 0 AND (abs(CAST(v AS DOUBLE)) * n >= {factor} * abs(s) OR CAST(v AS DOUBLE) * s < 0)""")


@query("temperature_spikes", _spikes("temperature", 2.0))
def temperature_spikes(spark, sf_dir):
    return W.detect_spikes(telemetry(spark, sf_dir), "temperature")


@query("light_spikes", _spikes("light_intensity", 1.5))
def light_spikes(spark, sf_dir):
    return W.detect_spikes(telemetry(spark, sf_dir), "light_intensity", 1.5)


@query("temperature_dropouts", over_events("""
SELECT device_id, device_type, timestamp, msg_id, CAST(t AS DOUBLE) AS value
FROM (SELECT *, CASE status WHEN 'WARN' THEN CAST(0 AS DECIMAL(12,3)) WHEN 'ERROR' THEN NULL ELSE temperature END AS t FROM ev)
WHERE device_type IN ('temperature-sensor', 'multi-sensor') AND (t IS NULL OR t = 0)"""))
def temperature_dropouts(spark, sf_dir):
    """Readings whose temperature is lost: zero on a WARN row, missing on an ERROR row."""
    lost = (
        F.when(F.col("status") == "WARN", F.lit(0).cast("decimal(12,3)"))
        .when(F.col("status") == "ERROR", F.lit(None).cast("decimal(12,3)"))
        .otherwise(F.col("temperature"))
    )
    return W.detect_dropouts(telemetry(spark, sf_dir).withColumn("temperature", lost), "temperature")


@query("stuck_temperature", over_events("""
SELECT device_id, CAST(min(v) AS DOUBLE) AS value, min(timestamp) AS started, max(timestamp) AS ended, count(*) AS readings
FROM (SELECT *, sum(CASE WHEN v IS DISTINCT FROM p THEN 1 ELSE 0 END)
    OVER (PARTITION BY device_id ORDER BY timestamp, msg_id ROWS UNBOUNDED PRECEDING) AS run
  FROM (SELECT *, lag(v) OVER (PARTITION BY device_id ORDER BY timestamp, msg_id) AS p
    FROM (SELECT device_id, timestamp, msg_id, floor(CAST(temperature AS DOUBLE) / 20) * 20 AS v FROM ev WHERE temperature IS NOT NULL)))
GROUP BY device_id, run HAVING count(*) >= 5"""))
def stuck_temperature(spark, sf_dir):
    """Runs of readings in the same 20-degree step."""
    coarse = F.floor(F.col("temperature").cast("double") / 20) * 20
    return W.detect_stuck(telemetry(spark, sf_dir).withColumn("temperature", coarse), "temperature")


@query("temperature_drift", over_events(f"""
SELECT device_id, bucket, readings, {r('raw', 4)} AS slope
FROM (SELECT device_id, date_trunc('hour', timestamp) AS bucket, count(*) AS readings,
    regr_slope(CAST(temperature AS DOUBLE), (epoch_us(timestamp) - epoch_us(date_trunc('hour', timestamp))) / 1e6) AS raw
  FROM ev WHERE temperature IS NOT NULL GROUP BY 1, 2 HAVING max(timestamp) > min(timestamp))
WHERE abs({r('raw', 4)}) >= 0.01"""))
def temperature_drift(spark, sf_dir):
    return W.detect_drift(telemetry(spark, sf_dir), "temperature")


_FAULTS = """
SELECT CASE status WHEN 'CRITICAL' THEN 'spike' ELSE 'dropout' END AS type,
  CASE WHEN temperature IS NOT NULL THEN 'temperature' ELSE 'pressure' END AS metric, device_id, count(*) AS anomalies
FROM ev WHERE status IN ('CRITICAL', 'WARN') GROUP BY 1, 2, 3"""


@query("fault_counts", over_events(_FAULTS))
def fault_counts(spark, sf_dir):
    return W.anomaly_counts(S.nested_readings(spark, sf_dir))


# -- metric samples -------------------------------------------------------------------------------

_DEVICE_SERIES = "'{\"device\":\"' || device_id || '\"}'"


def _counter_rate(seconds: int, where: str) -> str:
    return f"""
SELECT series, sum(CASE WHEN p IS NULL THEN 0.0 WHEN v >= p THEN v - p ELSE v END) / CAST({seconds} AS DOUBLE) AS rate
FROM (SELECT series, v, lag(v) OVER (PARTITION BY series ORDER BY timestamp, v) AS p
  FROM (SELECT {_DEVICE_SERIES} AS series, timestamp, CAST(msg_id % 997 AS DOUBLE) AS v FROM ev WHERE {where}))
GROUP BY 1"""


@query("counter_rate_5m", over_events(f"SELECT series, {r('rate', 4)} AS rate FROM ({_counter_rate(300, within('5 minutes'))})"))
def counter_rate_5m(spark, sf_dir):
    as_of = newest_time(spark, sf_dir)
    rates = M.counter_rate(S.samples(spark, sf_dir), "cpu_idle_seconds_total", "5 minutes", as_of)
    return rates.select("series", rounded("rate", 4).alias("rate"))


@query("counter_rate_all", over_events(f"SELECT series, {r('rate', 4)} AS rate FROM ({_counter_rate(43200, 'true')})"))
def counter_rate_all(spark, sf_dir):
    rates = M.counter_rate(S.samples(spark, sf_dir), "cpu_idle_seconds_total", None, seconds=43200, chunk="1 hour")
    return rates.select("series", rounded("rate", 4).alias("rate"))


@query("busy_percent", over_events(
    f"SELECT {r('(100.0 - avg(rate) * 100)', 4)} AS busy_pct FROM ({_counter_rate(300, within('5 minutes'))})"))
def busy_percent(spark, sf_dir):
    return M.busy_percent(S.samples(spark, sf_dir), "cpu_idle_seconds_total", "5 minutes", newest_time(spark, sf_dir))


# Two samples of one series may share a time; the larger value then counts as the newer one.
_BY_SAMPLE = "SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY timestamp DESC, {value} DESC) AS rn FROM ev"


@query("gauge_latest", over_events(
    f"SELECT {_DEVICE_SERIES} AS series, timestamp AS ts, CAST(battery_level * 64 AS DOUBLE) AS value "
    f"FROM ({_BY_SAMPLE.format(keys='device_id', value='battery_level')}) WHERE rn = 1"))
def gauge_latest(spark, sf_dir):
    return M.gauge_latest(S.samples(spark, sf_dir), "memory_available_bytes", None)


@query("gauge_latest_5m", over_events(
    f"SELECT {_DEVICE_SERIES} AS series, timestamp AS ts, CAST(battery_level * 64 AS DOUBLE) AS value "
    f"FROM ({_BY_SAMPLE.format(keys='device_id', value='battery_level')}) WHERE rn = 1 AND {within('5 minutes')}"))
def gauge_latest_5m(spark, sf_dir):
    return M.gauge_latest(S.samples(spark, sf_dir), "memory_available_bytes", as_of=newest_time(spark, sf_dir))


@query("gauge_ratio", over_events(
    f"SELECT {_DEVICE_SERIES} AS series, {r('((8192.0 - CAST(battery_level * 64 AS DOUBLE)) * 100 / 8192.0)', 3)} AS used_pct "
    f"FROM ({_BY_SAMPLE.format(keys='device_id', value='battery_level')}) WHERE rn = 1"))
def gauge_ratio(spark, sf_dir):
    return M.gauge_ratio(S.samples(spark, sf_dir), "memory_available_bytes", "memory_total_bytes", None)


@query("gauge_ratio_5m", over_events(
    f"SELECT {_DEVICE_SERIES} AS series, {r('((8192.0 - CAST(battery_level * 64 AS DOUBLE)) * 100 / 8192.0)', 3)} AS used_pct "
    f"FROM ({_BY_SAMPLE.format(keys='device_id', value='battery_level')}) WHERE rn = 1 AND {within('5 minutes')}"))
def gauge_ratio_5m(spark, sf_dir):
    at = newest_time(spark, sf_dir)
    return M.gauge_ratio(S.samples(spark, sf_dir), "memory_available_bytes", "memory_total_bytes", as_of=at)


@query("running_pods", over_events(
    "SELECT CAST(sum(CASE WHEN status IN ('OK', 'WARN') THEN 1.0 ELSE 0.0 END) AS DOUBLE) AS total FROM ("
    + _BY_SAMPLE.format(keys="device_id, location", value="(CASE WHEN status IN ('OK', 'WARN') THEN 1 ELSE 0 END)")
    + ") WHERE rn = 1 AND location = 'basement'"))
def running_pods(spark, sf_dir):
    return M.sum_where(S.samples(spark, sf_dir), "pod_status_phase", {"phase": "Running", "namespace": "basement"}, None)


@query("running_pods_1h", over_events(
    "SELECT CAST(sum(CASE WHEN status IN ('OK', 'WARN') THEN 1.0 ELSE 0.0 END) AS DOUBLE) AS total FROM ("
    + _BY_SAMPLE.format(keys="device_id, location", value="(CASE WHEN status IN ('OK', 'WARN') THEN 1 ELSE 0 END)")
    + f") WHERE rn = 1 AND location = 'basement' AND {within('1 hour')}"))
def running_pods_1h(spark, sf_dir):
    wanted, at = {"phase": "Running", "namespace": "basement"}, newest_time(spark, sf_dir)
    return M.sum_where(S.samples(spark, sf_dir), "pod_status_phase", wanted, "1 hour", at)


# Bucket bounds of the request latency histogram.
LATENCY_BOUNDS = (0.01, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0)


@query("latency_histogram", over_events(
    " UNION ALL ".join(
        f"SELECT status, '{b}' AS le, count(*) FILTER (WHERE {c}) AS bucket, CAST(sum(v) AS DOUBLE) AS sum, count(v) AS count "
        "FROM lat GROUP BY status"
        for b, c in [(f"{x:g}", f"v <= {x}") for x in LATENCY_BOUNDS] + [("+Inf", "v IS NOT NULL")]
    ),
    "lat AS (SELECT status, CAST(battery_level / 20 AS DECIMAL(12,3)) AS v FROM ev)"))
def latency_histogram(spark, sf_dir):
    timed = telemetry(spark, sf_dir).select("status", (F.col("battery_level") / 20).cast("decimal(12,3)").alias("v"))
    return M.bucket_histogram(timed, "v", LATENCY_BOUNDS, ["status"])
