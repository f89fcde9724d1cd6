"""Care of stored tables: inventory, sizes, compaction, retention of whole partitions."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.functions import day_of, instant, month_of, readable_size
from gaugeworks.functions.timing import interval
from gaugeworks.operators.folders import TARGET_BYTES, drop_partitions, partition_values, scattered_partitions, sort_tasks, stored_bytes, stored_files, stored_totals
from gaugeworks.operators.manifest import keep_manifest, refresh_manifest
from gaugeworks.schema import RETENTION


def partition_inventory(
    spark: SparkSession, path: str, part: str = "yyyymm", time_col: str = "timestamp"
) -> DataFrame:
    """Files, rows, bytes and time range of each partition, from the table's record of its files; no row is read."""
    per_file = refresh_manifest(spark, path, part, time_col)
    return (
        per_file.groupBy("partition")
        .agg(
            F.count(F.lit(1)).alias("files"), F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes"),
            F.min("min_time").alias("min_time"), F.max("max_time").alias("max_time"),
        )
        .withColumn("size", readable_size("bytes"))
        .orderBy("partition")
    )


def on_disk(spark: SparkSession, path: str) -> tuple[int, int]:
    """Data files and their bytes below a folder, as the file system tells them, hidden folders left out."""
    files, found, size = 0, [path], 0
    while found:
        place = spark._jvm.org.apache.hadoop.fs.Path(found.pop())
        for entry in place.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(place):
            name = entry.getPath().getName()
            if name.startswith(("_", ".")):
                continue
            if entry.isDirectory():
                found.append(entry.getPath().toString())
            else:
                files, size = files + 1, size + entry.getLen()
    return files, size


def table_sizes(spark: SparkSession, paths: Mapping[str, str]) -> DataFrame:
    """Size, rows and files of each table, largest first. No column is read, only row counts."""
    parts = [
        stored_totals(spark.read.parquet(path)).select(F.lit(name).alias("table"), "bytes", "rows", "files")
        for name, path in paths.items()
    ]
    return reduce(DataFrame.unionByName, parts).withColumn("size", readable_size("bytes")).orderBy(F.desc("bytes"))


def total_size(sizes: DataFrame) -> DataFrame:
    return sizes.agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"), F.sum("files").alias("files")).withColumn("size", readable_size("bytes"))


def compact(
    spark: SparkSession, path: str, part: str, order: tuple[str, ...], target_bytes: int = TARGET_BYTES,
    only: tuple[str, ...] | None = None,
) -> None:
    """Rewrite the partitions of a table as few large files, sorted by ``order``.

    Rows are range-partitioned on partition and order columns, so a hot device spreads over files and
    each file covers a narrow range; a task sorts a bounded number of rows (``sort_tasks``). Partitions are replaced when the job commits; until then, and if
    it fails, the old files stay.
    """
    table, listed = spark.read.parquet(path), stored_files(spark, path)
    if only is not None:
        chosen = F.col(part).cast("string").isin(*only)
        table, listed = table.filter(chosen), listed.filter(chosen)
    files = sort_tasks(table, stored_bytes(listed), target_bytes)
    keys = [part, *order]
    (
        table.repartitionByRange(files, *keys)
        .sortWithinPartitions(*keys)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(part)
        .parquet(path)
    )
    keep_manifest(spark, path, part)


def compact_all(spark: SparkSession, tables: Mapping[str, tuple[str, str, tuple[str, ...]]]) -> DataFrame:
    """Compact the scattered partitions of several tables; others are not touched.

    A failure is reported in its row and does not stop the rest.
    """
    done = []
    for name, (path, part, order) in tables.items():
        try:
            needy = scattered_partitions(spark, path, part)
            if needy:
                compact(spark, path, part, order, only=needy)
            done.append((name, "optimized" if needy else "unchanged"))
        except PySparkException as failure:
            done.append((name, f"error: {failure.getCondition() or type(failure).__name__}"))
    return spark.createDataFrame(done, "table string, result string")


#: Fixed value: the folder of rows whose partition column is null.
NO_VALUE = "__HIVE_DEFAULT_PARTITION__"
#: How a partition's text is made from a time, by its number of digits.
_GRAINS = {6: month_of, 8: day_of}


def drop_expired_partitions(
    spark: SparkSession, path: str, keep: str, as_of, part: str = "yyyymm", time_col: str = "timestamp"
) -> None:
    """Apply retention to a table partitioned by month or day: old partitions go whole, one is cut.

    The grain follows from the partitions themselves. Only the partition in which the limit falls is
    rewritten; those before it are removed as folders and not read. Rows without a time have a partition of
    their own, which never expires. A table whose other partitions are not all months or all days raises
    ValueError, and nothing is removed.
    """
    values = [v for v in partition_values(spark, path, part) if v != NO_VALUE]
    if not values:
        return
    digits = {len(v) if v.isdecimal() else None for v in values}
    if len(digits) > 1 or not digits <= set(_GRAINS):
        raise ValueError(f"partitions of {part} are not all months or all days")
    cutoff = instant(as_of) - interval(keep)
    edge = spark.range(1).select(_GRAINS[digits.pop()](cutoff).alias("edge")).first()["edge"]
    gone = [v for v in values if v < edge]
    if edge in values:
        kept = spark.read.parquet(path).filter((F.col(part).cast("string") == edge) & (F.col(time_col) >= cutoff))
        if kept.isEmpty():
            gone.append(edge)
        else:
            (
                kept.sortWithinPartitions("device_id", time_col)
                .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(part).parquet(path)
            )
    drop_partitions(spark, path, part, gone)
    keep_manifest(spark, path, part, time_col)


def apply_table_retention(spark: SparkSession, tables: Mapping[str, str], as_of) -> None:
    """The retention of ``schema.RETENTION`` on stored tables, named events, minute, hour or day."""
    for name, path in tables.items():
        part, time_col = ("yyyymm", "timestamp") if name == "events" else ("part", "bucket")
        drop_expired_partitions(spark, path, RETENTION[name], as_of, part, time_col)
