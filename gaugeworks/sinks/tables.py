"""Stored tables: the events layout, cold archive, published result sets."""

from __future__ import annotations

from collections.abc import Sequence
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.functions import instant, month_of
from gaugeworks.operators.folders import SORT_BYTES, sort_tasks, stored_bytes, stored_files
from gaugeworks.operators.manifest import keep_manifest
from gaugeworks.operators.quality import expired
from gaugeworks.schema import EVENTS
from gaugeworks.sinks.segments import read_segments, segment_paths

LAYOUT = ("device_id", "timestamp")


#: Tasks that a layout job is cut into at most.
MOST_TASKS = 100_000


#: Stored bytes that one sorting task gets at most where rows are not counted: they grow about tenfold in memory.
SORTED_INPUT = SORT_BYTES // 8


def tasks_for(df: DataFrame, target_bytes: int = SORTED_INPUT) -> int:
    """Output tasks for a frame, from the bytes that its files have in the optimizer's estimate.

    At least the session's partition count while that many tasks still get a share; the session's count too where the
    estimate is unknown (a frame that is not read from files).
    """
    spark = df.sparkSession
    usual = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= MOST_TASKS * target_bytes * 1000:
        return usual
    return min(max(usual, -(-size // target_bytes)), MOST_TASKS)


def write_events(ev: DataFrame, path: str, files: int | None = None, replace_months: bool = False) -> None:
    """Month partitions, rows ordered by device and time.

    Range partitioning on (month, device, time) gives every file a narrow device range, so min/max
    statistics skip most files for a device query; a device with a third of all rows is split by
    time. ``files`` sets the number of output tasks; without it that follows from the input's bytes (``tasks_for``).
    With ``replace_months`` the months that occur in ``ev`` are replaced instead of added to.
    """
    laid = ev.withColumn("yyyymm", month_of("timestamp"))
    keys = ["yyyymm", *LAYOUT]
    spread = laid.repartitionByRange(files or tasks_for(laid), *keys)
    (
        spread.sortWithinPartitions(*keys)
        .write.mode("overwrite" if replace_months else "append")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("yyyymm")
        .parquet(path)
    )
    keep_manifest(ev.sparkSession, path)


def settle_months(
    spark: SparkSession, landing: str, table: str, months: tuple[str, ...], files: int | None = None
) -> None:
    """Move finished months of a landing table, plain or of segments, into the events table, sorted and in large files.

    Each month is rebuilt whole from the landing rows and replaces what the table had of it, so the
    job can be repeated. Only those months are read.
    """
    wanted = F.col("yyyymm").cast("string").isin(*months)
    segments = segment_paths(spark, landing)
    landed = (read_segments(spark, landing) if segments else spark.read.parquet(landing)).filter(wanted)
    ev = landed.select(*[c for c in EVENTS.fieldNames() if c in landed.columns])
    if files is None:
        held = sum(stored_bytes(stored_files(spark, p).filter(wanted)) for p in segments or [landing])
        files = sort_tasks(landed, held)
    write_events(ev, table, files, replace_months=True)


def write_indexed(
    ev: DataFrame, path: str, set_cols: Sequence[str] = ("status", "location"), bloom_cols: Sequence[str] = ("device_id",),
    expected_devices: int = 1_000_000,
) -> None:
    """The events layout with per-column skipping aids.

    Columns with few values are dictionary-encoded, which Parquet readers use to skip row groups;
    ``bloom_cols`` get Bloom filters sized for ``expected_devices`` distinct values; Parquet leaves a
    filter out where a complete dictionary already answers the question.
    """
    laid = ev.withColumn("yyyymm", month_of("timestamp"))
    writer = (
        laid.repartitionByRange(tasks_for(laid), "yyyymm", *LAYOUT)
        .sortWithinPartitions("yyyymm", *LAYOUT)
        .write.mode("overwrite")
        .partitionBy("yyyymm")
    )
    for c in set_cols:
        writer = writer.option(f"parquet.enable.dictionary#{c}", "true")
    for c in bloom_cols:
        writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
        writer = writer.option(f"parquet.bloom.filter.expected.ndv#{c}", str(expected_devices))
    writer.parquet(path)


def archive_expired(ev: DataFrame, path: str, keep: str, as_of) -> None:
    """Copy rows past retention to cold storage, by month and archive run.

    The run is named after ``as_of``: repeating a run replaces its own files instead of adding rows
    twice. ``sinks.move_expired`` moves whole months out of a stored table instead.
    """
    run = str(as_of).replace(" ", "T").replace(":", "")
    rows = expired(ev, keep, as_of)
    (
        rows.withColumn("yyyymm", month_of("timestamp"))
        .withColumn("run", F.lit(run))
        .repartitionByRange(tasks_for(rows), "yyyymm", *LAYOUT)
        .sortWithinPartitions("yyyymm", *LAYOUT)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", "zstd")
        .partitionBy("yyyymm", "run")
        .parquet(path)
    )


def publish_snapshot(df: DataFrame, store: str, key: str, ttl_seconds: int, as_of) -> None:
    """Publish a result set under ``key`` for ``ttl_seconds``; an earlier one is replaced.

    Each result row is one JSON document. The set is written by the tasks that computed it and never
    gathered into a single array, so it may grow with the fleet. An empty set replaces too, which is
    why the key's own folder is overwritten; a header without payload tells it from a missing one.
    ``place`` grows along the rows as ``df`` has them, so a ranking keeps its order without a number of its own.
    """
    at = instant(as_of)
    times = [at.alias("written_at"), F.timestamp_add("SECOND", F.lit(ttl_seconds), at).alias("expires_at")]
    document = F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("payload")
    documents = df.select(document, F.monotonically_increasing_id().alias("place"), *times)
    header = df.sparkSession.range(1).select(
        F.lit(None).cast("string").alias("payload"), F.lit(None).cast("long").alias("place"), *times
    )
    documents.unionByName(header).write.mode("overwrite").parquet(f"{store}/key={quote(key, safe='')}")
