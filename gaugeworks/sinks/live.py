"""Streaming sinks: history table and latest state per device."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gaugeworks.functions import month_of
from gaugeworks.functions.timing import span_seconds
from gaugeworks.operators.devices import idle_filter, latest_per
from gaugeworks.sinks.segments import merge_all, read_segments, write_segment

STATE_COLUMNS = ("timestamp", "msg_id", "temperature", "pressure", "status")


def unzoned(ev: DataFrame) -> DataFrame:
    """Rows with the time type of the stored tables."""
    return ev.withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))


def _triggered(writer, every: str | None):
    """Run on a clock, or once over what is there when ``every`` is None."""
    return writer.trigger(availableNow=True) if every is None else writer.trigger(processingTime=every)


def sink_batched(
    stream: DataFrame, path: str, checkpoint: str, max_rows: int = 500_000, every: str | None = "5 seconds"
) -> StreamingQuery:
    """Append micro-batches to a month-partitioned landing table, exactly once.

    ``every`` and ``max_rows`` bound a batch in time and a file in rows. ``settle_months`` turns the
    many small files of a month into the events table.
    """
    laid = unzoned(stream).withColumn("yyyymm", month_of("timestamp"))
    writer = (
        laid.writeStream.format("parquet").outputMode("append")
        .option("path", path).option("checkpointLocation", checkpoint)
        .option("maxRecordsPerFile", max_rows)
        .partitionBy("yyyymm")
    )
    return _triggered(writer, every).start()


def newest_of(columns: Sequence[str]) -> Callable[[DataFrame], DataFrame]:
    """How segments of the latest state merge: the newest row of each device."""
    return lambda rows: latest_per(rows, ["device_id"], columns)


def write_state_segment(batch: DataFrame, path: str, batch_id: int, columns: Sequence[str] = STATE_COLUMNS) -> None:
    """The newest row per device of one micro-batch, as a segment of the state (``sinks.segments``)."""
    newest = newest_of(columns)
    write_segment(newest(unzoned(batch)), path, batch_id, newest)


def upsert_latest(
    stream: DataFrame, path: str, checkpoint: str, every: str | None = "5 seconds",
    columns: Sequence[str] = STATE_COLUMNS,
) -> StreamingQuery:
    """Keep the latest reading per device as segments, which merge as they grow in number.

    Readers combine the few segments of one manifest (``latest_state``); ``drop_old_state`` removes devices
    that have expired.
    """
    writer = (
        stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
        .foreachBatch(lambda batch, batch_id: write_state_segment(batch, path, batch_id, columns))
    )
    return _triggered(writer, every).start()


def _moment(value) -> dt.datetime:
    return value if isinstance(value, dt.datetime) else dt.datetime.fromisoformat(str(value))


def latest_state(
    spark: SparkSession, path: str, ttl: str | None = "5 minutes", as_of=None, columns: Sequence[str] = STATE_COLUMNS
) -> DataFrame:
    """Latest reading per device; devices idle for ``ttl`` or longer are gone. Segments with none but those are not read."""
    bounded = ttl is not None and as_of is not None
    segments = read_segments(spark, path, _moment(as_of) - dt.timedelta(seconds=span_seconds(ttl)) if bounded else None)
    merged = newest_of(columns)(segments)
    return merged if ttl is None else idle_filter(merged, ttl, as_of, "timestamp")


def drop_old_state(spark: SparkSession, path: str, ttl: str, as_of, columns: Sequence[str] = STATE_COLUMNS) -> None:
    """Merge the state into one segment without the devices that have expired; only while its stream is stopped."""
    merge_all(spark, path, lambda rows: idle_filter(newest_of(columns)(rows), ttl, as_of, "timestamp"))
