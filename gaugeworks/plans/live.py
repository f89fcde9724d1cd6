"""Streams over the events, drained once so that they can be compared with the same work in batch."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeworks.operators.devices import idle_filter, newest_row
from gaugeworks.operators.folders import partition_values
from gaugeworks.operators.rollups import settle_rollup
from gaugeworks.plans.dashboards import ALERTS, BUFFERED, LIVE_STATS, buffer_sql
from gaugeworks.plans.registry import doubled, query, unzoned
from gaugeworks.plans.sql import avg, doubles, high, latest, low, n_status, over_events
from gaugeworks.plans.stored import rollup_sql
from gaugeworks.plans.tables import _FLOATS, as_stored
from gaugeworks.schema import HEADER, METRICS
from gaugeworks.session import fresh_path
from gaugeworks import streaming as St
from gaugeworks.functions.timing import instant, interval
from gaugeworks.operators import sketches as K
from gaugeworks.sinks import latest_state, live_stats_of, read_replay, read_segments, sink_batched, sink_replay, upsert_latest, write_events
from gaugeworks.sources import stream_events
from gaugeworks.streaming import panes as P
from gaugeworks.sources.sample_tables import device_metadata, newest_time, telemetry, telemetry_stream

_HEAD = ", ".join(HEADER)
# A stream closes windows that end at or before the newest time minus the watermark.
_CLOSED = "(SELECT t FROM lim) - INTERVAL '10 minutes'"


def _sliding(size: int, measures: str, where: str = "true") -> str:
    """Windows of ``size`` minutes that start every minute."""
    return over_events(
        f"SELECT w AS window_start, w + INTERVAL '{size} minutes' AS window_end, {measures} FROM spread "
        f"WHERE {where} GROUP BY 1",
        f"""spread AS (SELECT ev.*, date_trunc('minute', timestamp) - to_minutes(g.i) AS w
          FROM ev, (SELECT unnest(generate_series(0, {size - 1})) AS i) g)""",
    )


@query("stream_source", over_events(f"SELECT {_HEAD}, {doubles(*METRICS)} FROM ev"))
def stream_source(spark, sf_dir):
    return doubled(unzoned(St.run_once(spark, telemetry_stream(spark, sf_dir))))


@query("stream_source_stored", over_events(f"SELECT {_HEAD}, {_FLOATS} FROM ev"))
def stream_source_stored(spark, sf_dir):
    """The stored table as a stream, two of its files in a batch."""
    path = fresh_path(spark, "events")
    write_events(as_stored(telemetry(spark, sf_dir)), path, files=4)
    feed = stream_events(spark, path, max_files=2, glob="*.parquet")
    return unzoned(St.run_once(spark, feed.select(*HEADER, *METRICS)))


@query("stream_rollup", over_events(rollup_sql("minute")))
def stream_rollup(spark, sf_dir):
    keys = ["bucket", "device_id", "device_type", "location"]
    return doubled(St.run_once(spark, St.stream_rollup(telemetry_stream(spark, sf_dir)), "update", keys))


@query("stream_rollup_closed", over_events(
    f"SELECT * FROM rolled WHERE bucket + INTERVAL '1 minute' <= {_CLOSED}", f"rolled AS ({rollup_sql('minute')})"))
def stream_rollup_closed(spark, sf_dir):
    """Append form: only windows that can no longer change."""
    return doubled(St.run_once(spark, St.stream_rollup(telemetry_stream(spark, sf_dir)), "append"))


@query("stream_rollup_stored", over_events(
    f"SELECT * FROM rolled WHERE bucket + INTERVAL '1 minute' <= {_CLOSED}", f"rolled AS ({rollup_sql('minute')})"))
def stream_rollup_stored(spark, sf_dir):
    """The stream's closed windows, landed by day and moved into the stored rollup."""
    base = fresh_path(spark, "rollup")
    St.sink_rollup(telemetry_stream(spark, sf_dir), f"{base}/landing", f"{base}/checkpoint", every=None).awaitTermination()
    settle_rollup(spark, f"{base}/landing", f"{base}/table", partition_values(spark, f"{base}/landing", "part"))
    return doubled(spark.read.parquet(f"{base}/table").drop("part"))


@query("stream_late_rows", over_events(
    """SELECT count(*) AS rows, count(*) FILTER (WHERE timestamp < reached - INTERVAL '10 minutes') AS late, max(timestamp) AS newest
    FROM ev JOIN (SELECT arrival, max(last) OVER (ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached
      FROM (SELECT msg_id % 3 AS arrival, max(timestamp) AS last FROM ev GROUP BY 1)) ON msg_id % 3 = arrival"""))
def stream_late_rows(spark, sf_dir):
    """Events that arrive in three parts, with a restart before each."""
    base = fresh_path(spark, "late")
    stored = as_stored(telemetry(spark, sf_dir))
    for arrival in range(3):
        stored.filter(F.col("msg_id") % 3 == arrival).write.mode("append").parquet(f"{base}/feed")
        feed = stream_events(spark, f"{base}/feed")
        St.count_late(feed, f"{base}/late", f"{base}/checkpoint", every=None).awaitTermination()
    return unzoned(St.late_totals(spark, f"{base}/late"))


def _panes(spark, sf_dir):
    """The minute panes of the whole stream, stored and read again."""
    base = fresh_path(spark, "panes")
    St.sink_panes(telemetry_stream(spark, sf_dir), f"{base}/table", f"{base}/checkpoint", every=None).awaitTermination()
    return St.read_panes(spark, f"{base}/table")


@query("stream_hot_averages", _sliding(5, f"{avg('temperature')} AS avg_temperature, {avg('pressure')} AS avg_pressure"))
def stream_hot_averages(spark, sf_dir):
    return P.hot_averages(_panes(spark, sf_dir))


@query("stream_extremes", _sliding(15, f"{high('temperature')} AS max_temperature, {low('temperature')} AS min_temperature"))
def stream_extremes(spark, sf_dir):
    return P.extremes(_panes(spark, sf_dir))


_DEVICES = "count(DISTINCT device_id) AS devices"


@query("pane_active_devices", _sliding(15, _DEVICES))
def pane_active_devices(spark, sf_dir):
    return P.active_devices(_panes(spark, sf_dir))


@query("stream_active_devices", _sliding(15, _DEVICES, f"w + INTERVAL '15 minutes' <= {_CLOSED}"))
def stream_active_devices(spark, sf_dir):
    """Of the same, the windows that can no longer change."""
    closed = instant(newest_time(spark, sf_dir)) - interval(St.windows.WATERMARK)
    return P.active_devices(_panes(spark, sf_dir)).filter(F.col("window_end") <= closed)


@query("stream_active_devices_by_watermark", _sliding(15, _DEVICES, f"w + INTERVAL '15 minutes' <= {_CLOSED}"))
def stream_active_devices_by_watermark(spark, sf_dir):
    return St.run_once(spark, St.stream_active_devices(telemetry_stream(spark, sf_dir)), "append")


@query("stream_activity_sessions", over_events(
    f"""SELECT * FROM (SELECT device_id, min(timestamp) AS window_start, max(timestamp) + INTERVAL '15 minutes' AS window_end,
      count(*) AS events, {n_status('WARN', 'CRITICAL')} AS warnings, {n_status('CRITICAL')} AS criticals
    FROM (SELECT *, sum(fresh) OVER (PARTITION BY device_id ORDER BY timestamp, msg_id ROWS UNBOUNDED PRECEDING) AS s
      FROM (SELECT *, CASE WHEN timestamp < lag(timestamp) OVER (PARTITION BY device_id ORDER BY timestamp, msg_id)
        + INTERVAL '15 minutes' THEN 0 ELSE 1 END AS fresh FROM ev)) GROUP BY device_id, s)
    WHERE window_end <= {_CLOSED}"""))
def stream_activity_sessions(spark, sf_dir):
    return St.run_once(spark, St.stream_counters(telemetry_stream(spark, sf_dir)), "append")


@query("stream_latest", over_events(
    f"SELECT device_id, timestamp, msg_id, status, {doubles(*METRICS)} FROM {latest('device_id')} "
    "WHERE timestamp > (SELECT t FROM lim) - INTERVAL '15 minutes'"))
def stream_latest(spark, sf_dir):
    state = unzoned(St.run_once(spark, St.stream_latest(telemetry_stream(spark, sf_dir)), "update"))
    columns = ["timestamp", "msg_id", "status", *METRICS]
    newest = state.groupBy("device_id").agg(newest_row(columns).alias("_row"))
    current = newest.select("device_id", *[F.col("_row")[c].alias(c) for c in columns])
    return doubled(idle_filter(current, "15 minutes", newest_time(spark, sf_dir), "timestamp"))


@query("stream_living", over_events(
    f"SELECT device_id, timestamp, msg_id, status, {doubles(*METRICS)} FROM {latest('device_id')} "
    "WHERE timestamp > (SELECT t FROM lim) - INTERVAL '15 minutes'"))
def stream_living(spark, sf_dir):
    """The devices whose state has not expired in the stream itself."""
    changes = St.run_once(spark, St.stream_living(telemetry_stream(spark, sf_dir), "15 minutes"), "update", [])
    return unzoned(St.living(changes))


@query("stream_event_rate", over_events(
    "SELECT date_trunc('minute', timestamp) AS window_start, date_trunc('minute', timestamp) + INTERVAL '1 minute' AS window_end, "
    "count(*) AS events FROM ev GROUP BY 1, 2"))
def stream_event_rate(spark, sf_dir):
    rate = St.stream_event_rate(telemetry_stream(spark, sf_dir))
    return St.run_once(spark, rate, "update", ["window_start", "window_end"])


@query("stream_deduplicated", over_events(f"SELECT {_HEAD}, {doubles('temperature', 'pressure')} FROM ev"))
def stream_deduplicated(spark, sf_dir):
    """Every message delivered twice, and kept once."""
    twice = telemetry_stream(spark, sf_dir).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    once = St.dedup_messages(twice).select(*HEADER, "temperature", "pressure")
    return doubled(unzoned(St.run_once(spark, once)))


@query("stream_alerts", over_events(ALERTS))
def stream_alerts(spark, sf_dir):
    return doubled(unzoned(St.run_once(spark, St.stream_alerts(telemetry_stream(spark, sf_dir)))))


@query("stream_history", over_events(f"SELECT {_HEAD}, {doubles(*METRICS)} FROM ev"))
def stream_history(spark, sf_dir):
    """Micro-batched append into the month-partitioned table."""
    base = fresh_path(spark, "history")
    sink_batched(telemetry_stream(spark, sf_dir), f"{base}/table", f"{base}/checkpoint", every=None).awaitTermination()
    return doubled(spark.read.parquet(f"{base}/table").drop("yyyymm"))


_STATE = over_events(
    f"SELECT device_id, timestamp, msg_id, {doubles('temperature', 'pressure')}, status FROM {latest('device_id')} "
    "WHERE timestamp > (SELECT t FROM lim) - INTERVAL '5 minutes'"
)


@query("stream_latest_state", _STATE)
def stream_latest_state(spark, sf_dir):
    base = fresh_path(spark, "state")
    upsert_latest(telemetry_stream(spark, sf_dir), f"{base}/table", f"{base}/checkpoint", every=None).awaitTermination()
    return doubled(latest_state(spark, f"{base}/table", "5 minutes", newest_time(spark, sf_dir)))


@query("dual_write_history", over_events(
    f"SELECT device_id, count(*) AS events, max(timestamp) AS last_seen, {n_status('WARN')} AS warnings FROM ev GROUP BY 1"))
def dual_write_history(spark, sf_dir):
    """The history side of the two-sink flow, by device."""
    base = fresh_path(spark, "dual")
    St.dual_write(
        telemetry_stream(spark, sf_dir), f"{base}/history", f"{base}/live", f"{base}/checkpoint", every=None
    ).awaitTermination()
    history = read_segments(spark, f"{base}/history")
    return history.groupBy("device_id").agg(
        F.count(F.lit(1)).alias("events"), F.max("timestamp").alias("last_seen"),
        F.count_if(F.col("status") == "WARN").alias("warnings"),
    )


@query("dual_write_state", _STATE)
def dual_write_state(spark, sf_dir):
    """The live side of the same flow."""
    base = fresh_path(spark, "dual")
    St.dual_write(
        telemetry_stream(spark, sf_dir), f"{base}/history", f"{base}/live", f"{base}/checkpoint", every=None
    ).awaitTermination()
    return doubled(latest_state(spark, f"{base}/live", "5 minutes", newest_time(spark, sf_dir)))


def _ring(spark, sf_dir, capacity: int = 10_000) -> str:
    """The replay buffer of the whole stream."""
    base = fresh_path(spark, "replay")
    sink_replay(telemetry_stream(spark, sf_dir), f"{base}/table", f"{base}/checkpoint", capacity, every=None).awaitTermination()
    return f"{base}/table"


@query("replay_ring_1000", buffer_sql(1_000))
def replay_ring_1000(spark, sf_dir):
    return doubled(read_replay(spark, _ring(spark, sf_dir, 1_000), 1_000).select(*BUFFERED))


@query("live_stats_from_stores", LIVE_STATS)
def live_stats_from_stores(spark, sf_dir):
    """Active devices from the latest state, the buffer's length from its manifest."""
    base, ring = fresh_path(spark, "state"), _ring(spark, sf_dir)
    upsert_latest(telemetry_stream(spark, sf_dir), f"{base}/table", f"{base}/checkpoint", every=None).awaitTermination()
    return live_stats_of(spark, ring, latest_state(spark, f"{base}/table", None), as_of=newest_time(spark, sf_dir))


@query("stream_enriched", over_events("""
SELECT device_id, c_name AS device_name, count(*) AS events
FROM ev LEFT JOIN (SELECT 'device-' || lpad(CAST(c_custkey AS VARCHAR), greatest(length(CAST(c_custkey AS VARCHAR)), 4)::INTEGER, '0') AS device_id,
  c_name FROM customer) c USING (device_id) GROUP BY 1, 2"""))
def stream_enriched(spark, sf_dir):
    """The stream's rows with the names of a published dictionary, by device."""
    base = fresh_path(spark, "enriched")
    St.publish_dictionary(device_metadata(spark, sf_dir), f"{base}/names")
    St.sink_enriched(telemetry_stream(spark, sf_dir), f"{base}/names", f"{base}/table", f"{base}/checkpoint", every=None).awaitTermination()
    return spark.read.parquet(f"{base}/table").groupBy("device_id", "device_name").agg(F.count(F.lit(1)).alias("events"))


# -- mergeable distinct counts --------------------------------------------------------------------

def _sketched(spark, sf_dir, compression: int = 60):
    """Minute rows with sketches, by place, stored and read again."""
    path = fresh_path(spark, "sketches")
    K.sketch_rollup(telemetry(spark, sf_dir, compression=compression), "minute", ["location"]).write.parquet(path)
    return spark.read.parquet(path)


@query("hourly_devices_from_sketches", over_events(
    "SELECT date_trunc('hour', timestamp) AS bucket, count(*) AS events, count(DISTINCT device_id) AS devices FROM ev GROUP BY 1"))
def hourly_devices_from_sketches(spark, sf_dir):
    """Hours from the sketches of minutes and places; counts of this size are exact in a sketch."""
    return K.counted(K.coarsen_sketches(_sketched(spark, sf_dir), "hour"))


@query("daily_coverage_from_sketches", over_events(
    "SELECT CAST(timestamp AS DATE) AS day, count(*) AS events, count(DISTINCT device_id) AS unique_devices FROM ev GROUP BY 1", compression=1))
def daily_coverage_from_sketches(spark, sf_dir):
    return K.daily_coverage_from_sketches(_sketched(spark, sf_dir, 1))


@query("active_devices_from_sketches", over_events(
    "SELECT count(DISTINCT device_id) AS devices FROM ev WHERE date_trunc('minute', timestamp) >= (SELECT t FROM lim) - INTERVAL '5 minutes'"))
def active_devices_from_sketches(spark, sf_dir):
    return K.active_devices_from_sketches(_sketched(spark, sf_dir), "5 minutes", newest_time(spark, sf_dir))


@query("pane_active_devices_from_sketches", _sliding(15, _DEVICES))
def pane_active_devices_from_sketches(spark, sf_dir):
    return K.sliding_devices(_sketched(spark, sf_dir), 15)
