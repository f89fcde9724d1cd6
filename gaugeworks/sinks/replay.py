"""The live replay buffer: the newest events of a stream, capped by count as batches arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gaugeworks.operators.summaries import active_devices
from gaugeworks.sinks.live import _triggered, unzoned
from gaugeworks.sinks.segments import manifest_of, read_segments, write_segment

CAPACITY = 10_000
_ORDER = ("_batch", "timestamp", "msg_id")


def sink_replay(
    stream: DataFrame, path: str, checkpoint: str, capacity: int = CAPACITY, every: str | None = "5 seconds"
) -> StreamingQuery:
    """Keep the last ``capacity`` events as a ring of counted segments.

    Of a batch the newest ``capacity`` events are added, and the oldest segments go as soon as the others hold as
    many. So the store has less than twice the capacity and what one merge adds, whatever has passed through it.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        last = unzoned(batch).orderBy(F.desc("timestamp"), F.desc("msg_id")).limit(capacity)
        write_segment(last.withColumn("_batch", F.lit(batch_id).cast("long")), path, batch_id, lambda rows: rows, most_rows=capacity)

    writer = stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(write)
    return _triggered(writer, every).start()


def read_replay(spark: SparkSession, path: str, n: int = CAPACITY) -> DataFrame:
    """The last ``n`` events, those of the last batch first, inside a batch the newest first; only the ring is read."""
    return read_segments(spark, path).orderBy(*[F.desc(c) for c in _ORDER]).limit(n).drop("_batch")


def replay_length(spark: SparkSession, path: str, capacity: int = CAPACITY) -> int:
    """How many events the buffer holds, from its manifest."""
    held = manifest_of(spark, path)
    return min(sum(s.rows for s in held.segments), capacity) if held else 0


def live_stats_of(spark: SparkSession, replay: str, recent: DataFrame, span: str = "5 minutes", capacity: int = CAPACITY, as_of=None) -> DataFrame:
    """``devices.live_stats`` from the live stores: active devices among ``recent`` rows or states, and the buffer's length."""
    length = F.lit(replay_length(spark, replay, capacity)).cast("long")
    return active_devices(recent, span, as_of).select(F.col("devices").alias("active_devices"), length.alias("stream_length"))
