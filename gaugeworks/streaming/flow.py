"""Running streams: several sinks from one stream, bounded runs, live alerts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from gaugeworks.functions import month_of
from gaugeworks.functions.timing import interval
from gaugeworks.operators.filters import classify_alerts
from gaugeworks.operators.folders import drop_partitions, partition_values
from gaugeworks.operators.rollups import part_column
from gaugeworks.session import STATE_STORE, fresh_path, with_settings
from gaugeworks.sinks.live import unzoned, write_state_segment
from gaugeworks.sinks.segments import write_segment
from gaugeworks.streaming.windows import WATERMARK, stream_rollup


def stream_alerts(stream: DataFrame) -> DataFrame:
    """Alert rows as they arrive, with the reason; stateless, in arrival order."""
    return classify_alerts(stream, newest_first=False)


def dual_write(stream: DataFrame, history: str, live: str, checkpoint: str, every: str | None = "5 seconds") -> StreamingQuery:
    """One stream into the history landing table and the latest state.

    The micro-batch is kept for the two writes and let go. Both are log-structured segments: a batch that Spark
    repeats after a failure replaces its own, and the folders stay few. ``sinks.read_segments`` reads the history; a
    finished month moves on with ``settle_months``.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            write_segment(unzoned(batch).withColumn("yyyymm", month_of("timestamp")), history, batch_id, lambda rows: rows, "yyyymm")
            write_state_segment(batch, live, batch_id)
        finally:
            batch.unpersist()

    writer = stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(write)
    writer = writer.trigger(availableNow=True) if every is None else writer.trigger(processingTime=every)
    return writer.start()


def sink_rollup(
    stream: DataFrame, landing: str, checkpoint: str, grain: str = "minute", every: str | None = "1 minute",
    watermark: str = WATERMARK,
) -> StreamingQuery:
    """Land the stream's closed windows as rollup rows, each exactly once, filed like the stored rollup.

    ``operators.rollups.settle_rollup`` moves finished days (or months) on into the stored table.
    """
    rolled = stream_rollup(stream, f"1 {grain}", watermark).withColumn("part", part_column(grain))
    writer = (
        rolled.writeStream.outputMode("append").format("parquet").partitionBy("part")
        .option("path", landing).option("checkpointLocation", checkpoint)
    )
    writer = writer.trigger(availableNow=True) if every is None else writer.trigger(processingTime=every)
    return writer.start()


LATE = "rows long, late long, newest timestamp"


def count_late(
    stream: DataFrame, path: str, checkpoint: str, watermark: str = WATERMARK, every: str | None = "5 seconds"
) -> StreamingQuery:
    """Count every row of the stream, and those that come late, as they arrive and before any aggregate.

    A row is late when its time is more than ``watermark`` before the newest time of all earlier batches.
    Each batch files the totals so far under its number, from those of the batch before; older ones go.
    So a repeated batch replaces its own record, a restart goes on from the last one, and the folder does
    not grow. Rows without a time are counted but never late.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        so_far = late_totals(spark, path, batch_id - 1).first()
        newest = None if so_far is None else so_far["newest"]
        limit = F.lit(newest).cast("timestamp") - interval(watermark)
        now = batch.select(F.col("timestamp").cast("timestamp").alias("at")).agg(
            F.count(F.lit(1)).alias("rows"), F.count_if(F.col("at") < limit).alias("late"), F.max("at").alias("newest")
        )
        before = so_far or {"rows": 0, "late": 0}
        totals = now.select(
            (F.col("rows") + before["rows"]).alias("rows"), (F.col("late") + before["late"]).alias("late"),
            F.greatest("newest", F.lit(newest).cast("timestamp")).alias("newest"),
        )
        totals.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        filed = partition_values(spark, path, "batch")
        drop_partitions(spark, path, "batch", [b for b in filed if int(b) < batch_id - 1])

    writer = stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(write)
    writer = writer.trigger(availableNow=True) if every is None else writer.trigger(processingTime=every)
    return writer.start()


def late_totals(spark: SparkSession, path: str, batch_id: int | None = None) -> DataFrame:
    """Rows, late rows and newest time that ``count_late`` has filed, of the last batch or of one; no row before the first."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
    filed = sorted(int(b) for b in partition_values(spark, path, "batch")) if found else []
    wanted = [b for b in filed if batch_id is None or b == batch_id]
    if not wanted:
        return spark.createDataFrame([], LATE)
    return spark.read.schema(LATE).parquet(f"{path}/batch={wanted[-1]}")


def run_once(
    spark: SparkSession, df: DataFrame, mode: str = "append", keys: Sequence[str] | None = None, name: str = "stream"
) -> DataFrame:
    """Drain the stream into a table of the shared folder and read the result.

    In update mode a key appears once per batch that changed it; ``keys`` keeps its newest state, and an empty
    list all of them with the number of their ``batch``. Rows of one batch have keys of their own, so they are gone
    through again only where several batches gave rows. Its state is kept in RocksDB in any session.
    """
    base = fresh_path(spark, name)
    schema = T.StructType(df.schema.fields + [T.StructField("batch", T.LongType())])

    filled: set[int] = set()

    def write(batch: DataFrame, batch_id: int) -> None:
        seen = Observation()
        counted = batch.observe(seen, F.count(F.lit(1)).alias("rows"))
        counted.write.mode("overwrite").parquet(f"{base}/table/batch={batch_id}")
        if seen.get["rows"]:
            filled.add(batch_id)

    writer = (
        df.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/checkpoint")
        .foreachBatch(write).trigger(availableNow=True)
    )
    with with_settings(spark, STATE_STORE):
        query = writer.start()
    query.awaitTermination()
    out = spark.read.schema(schema).option("basePath", f"{base}/table").parquet(f"{base}/table")
    if keys == []:
        return out
    if keys is None or len(filled) < 2:
        return out.drop("batch")
    rest = [c for c in out.columns if c not in (*keys, "batch")]
    newest = out.groupBy(*keys).agg(F.max(F.struct("batch", *rest)).alias("_row"))
    return newest.select(*keys, *[F.col("_row")[c].alias(c) for c in rest])
