"""Windowed and keyed aggregates over the event stream.

All of them work in event time. ``watermark`` says how late a row may come. ``flow.count_late`` counts the rows that
are later; an aggregate drops such a row only where its whole window has closed. State older than it is released.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gaugeworks.functions import mean, rounded
from gaugeworks.operators.devices import newest_row
from gaugeworks.operators.rollups import KEY, MINUTE_METRICS, parts
from gaugeworks.schema import METRICS

WATERMARK = "10 minutes"


def _marked(stream: DataFrame, watermark: str) -> DataFrame:
    return stream.withWatermark("timestamp", watermark)


def _bounds(df: DataFrame, window: str = "window") -> DataFrame:
    """Window start and end as plain columns without zone, like the batch tables hold them."""
    rest = [c for c in df.columns if c != window]
    ends = [F.col(f"{window}.{e}").cast("timestamp_ntz").alias(f"window_{e}") for e in ("start", "end")]
    return df.select(*ends, *rest)


def stream_rollup(
    stream: DataFrame, every: str = "1 minute", watermark: str = WATERMARK, metrics: Sequence[str] = MINUTE_METRICS
) -> DataFrame:
    """Rollup partials of tumbling windows, of the same shape as the batch rollup."""
    out = _marked(stream, watermark).groupBy(F.window("timestamp", every), *KEY[1:]).agg(*parts(metrics))
    start = F.col("window.start").cast("timestamp_ntz").alias("bucket")
    return out.select(start, *[c for c in out.columns if c != "window"])


def _sliding(stream: DataFrame, size: str, slide: str, watermark: str, **measures: Column) -> DataFrame:
    windows = _marked(stream, watermark).groupBy(F.window("timestamp", size, slide))
    return _bounds(windows.agg(*[c.alias(n) for n, c in measures.items()]))


def stream_hot_averages(
    stream: DataFrame, size: str = "5 minutes", slide: str = "1 minute", watermark: str = WATERMARK
) -> DataFrame:
    return _sliding(
        stream, size, slide, watermark,
        avg_temperature=rounded(mean("temperature"), 2), avg_pressure=rounded(mean("pressure"), 2),
    )


def stream_extremes(
    stream: DataFrame, size: str = "15 minutes", slide: str = "1 minute", watermark: str = WATERMARK
) -> DataFrame:
    return _sliding(
        stream, size, slide, watermark,
        max_temperature=rounded(F.max("temperature"), 2), min_temperature=rounded(F.min("temperature"), 2),
    )


def stream_active_devices(
    stream: DataFrame, size: str = "15 minutes", slide: str = "1 minute", watermark: str = WATERMARK,
    approx: bool = False,
) -> DataFrame:
    """Distinct devices per sliding window.

    Exact form: one state row per window and device, then a count of those (append mode only). No
    set of devices is ever built in one row. ``approx`` keeps a sketch of fixed size per window.
    """
    if approx:
        return _sliding(stream, size, slide, watermark, devices=F.approx_count_distinct("device_id"))
    window = F.window("timestamp", size, slide)
    seen = _marked(stream, watermark).groupBy(window, "device_id").agg(F.count(F.lit(1)).alias("events"))
    return _bounds(seen.groupBy("window").agg(F.count(F.lit(1)).alias("devices")))


def stream_counters(stream: DataFrame, gap: str = "15 minutes", watermark: str = WATERMARK) -> DataFrame:
    """Warnings and events per device and activity session; a session ends after ``gap`` of silence."""
    session = F.session_window("timestamp", gap)
    counted = _marked(stream, watermark).groupBy(session, "device_id").agg(
        F.count(F.lit(1)).alias("events"),
        F.count_if(F.col("status").isin("WARN", "CRITICAL")).alias("warnings"),
        F.count_if(F.col("status") == "CRITICAL").alias("criticals"),
    )
    return _bounds(counted, "session_window")


def stream_latest(stream: DataFrame) -> DataFrame:
    """Newest reading per device (update mode): one state row per device, whatever the history.

    Readers apply the life time with ``operators.devices.idle_filter``.
    """
    columns = ["timestamp", "msg_id", "status", *METRICS]
    newest = stream.groupBy("device_id").agg(newest_row(columns).alias("_row"))
    return newest.select("device_id", *[F.col("_row")[c].alias(c) for c in columns])


def stream_event_rate(stream: DataFrame, every: str = "1 minute", watermark: str = WATERMARK) -> DataFrame:
    counted = _marked(stream, watermark).groupBy(F.window("timestamp", every)).agg(F.count(F.lit(1)).alias("events"))
    return _bounds(counted)


def dedup_messages(
    stream: DataFrame, keys: Sequence[str] = ("device_id", "msg_id"), watermark: str = WATERMARK
) -> DataFrame:
    """Drop repeats of at-least-once delivery; a key is remembered for the length of the watermark."""
    return _marked(stream, watermark).dropDuplicatesWithinWatermark(list(keys))


def late_rows(query: StreamingQuery) -> int:
    """Late rows as Spark reports them for the recent batches, after the partial aggregate: a lower bound.

    ``flow.count_late`` counts every late row over the whole life of a stream.
    """
    return sum(
        op["numRowsDroppedByWatermark"]
        for progress in query.recentProgress
        for op in progress["stateOperators"]
    )
