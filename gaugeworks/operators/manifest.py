"""A record of each file of a stored table: rows, bytes, oldest and newest time.

The record lies in a hidden folder of the table, so readers of the table do not see it. It is brought up to date from
the file listing: entries of files that are gone go, and of new files alone the time column is read, once. Inventories,
sizes and the newest time then come from the record, without any row of the table.
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.operators.folders import stored_files

FOLDER = "_manifest"
ENTRY = "partition string, file string, bytes long, rows long, min_time timestamp_ntz, max_time timestamp_ntz"
#: New files named one by one to the reader; beyond that the partitions they lie in are read.
NAMED = 5_000


def _place(spark: SparkSession, path: str) -> tuple:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def _versions(spark: SparkSession, path: str) -> list[str]:
    """Whole records, oldest first; one that was not written to its end has no success mark."""
    files, folder = _place(spark, f"{path}/{FOLDER}")
    if not files.exists(folder):
        return []
    names = sorted(e.getPath().getName() for e in files.listStatus(folder))
    return [n for n in names if files.exists(_place(spark, f"{path}/{FOLDER}/{n}/_SUCCESS")[1])]


def has_manifest(spark: SparkSession, path: str) -> bool:
    return bool(_versions(spark, path))


def listed(spark: SparkSession, path: str, part: str | None) -> DataFrame:
    """``partition``, ``file`` and ``bytes`` of each file, from the listing alone."""
    where = F.col(part).cast("string") if part else F.lit(None).cast("string")
    name = F.substring_index("path", "/", -1)
    return stored_files(spark, path).select(where.alias("partition"), name.alias("file"), F.col("length").alias("bytes"))


def _entries(spark: SparkSession, path: str, part: str | None, time_col: str, new: DataFrame) -> DataFrame:
    """Entries of new files; their time column is read."""
    where = F.col(part).cast("string") if part else F.lit(None).cast("string")
    few = new.select("partition", "file").limit(NAMED + 1).collect()
    rows = spark.read.parquet(path)
    if part:
        rows = rows.filter(where.isin(*{r["partition"] for r in few}) if len(few) <= NAMED else F.lit(True))
    if len(few) <= NAMED:
        rows = rows.filter(F.col("_metadata.file_name").isin(*{r["file"] for r in few}))
    read = rows.select(where.alias("partition"), F.col("_metadata.file_name").alias("file"), F.col(time_col).alias("at"))
    counted = read.groupBy("partition", "file").agg(
        F.count(F.lit(1)).alias("rows"), F.min("at").cast("timestamp_ntz").alias("min_time"), F.max("at").cast("timestamp_ntz").alias("max_time")
    )
    same = new.select(F.col("partition").alias("p"), F.col("file").alias("f"), "bytes")
    joined = same.join(counted, F.col("p").eqNullSafe(F.col("partition")) & (F.col("f") == F.col("file")), "left")
    return joined.select(
        F.col("p").alias("partition"), F.col("f").alias("file"), "bytes", F.coalesce("rows", F.lit(0).cast("long")).alias("rows"), "min_time", "max_time"
    )


def refresh_manifest(spark: SparkSession, path: str, part: str | None = "yyyymm", time_col: str = "timestamp") -> DataFrame:
    """The table's record, brought up to date first; rows as ``ENTRY``. One writer at a time."""
    versions = _versions(spark, path)
    files = listed(spark, path, part)
    read = lambda v: spark.read.schema(ENTRY).parquet(f"{path}/{FOLDER}/{v}")
    known = read(versions[-1]) if versions else spark.createDataFrame([], ENTRY)
    a, b = files.alias("a"), known.alias("b")
    same = F.expr("a.partition <=> b.partition AND a.file = b.file AND a.bytes = b.bytes")
    new, kept = a.join(b, same, "left_anti"), b.join(a, same, "left_semi")
    if versions and new.isEmpty() and kept.count() == known.count():
        return known
    number = int(versions[-1].split("-")[0]) + 1 if versions else 0
    name = f"{number:012d}-{uuid.uuid4().hex[:8]}"
    entries = kept if new.isEmpty() else kept.unionByName(_entries(spark, path, part, time_col, new))
    entries.coalesce(1).write.parquet(f"{path}/{FOLDER}/{name}")
    for old in versions[:-1]:
        store, folder = _place(spark, f"{path}/{FOLDER}/{old}")
        store.delete(folder, True)
    return read(name)


def keep_manifest(spark: SparkSession, path: str, part: str | None = "yyyymm", time_col: str = "timestamp") -> None:
    """What writers call when they are done: a table that has a record gets it brought up to date."""
    if has_manifest(spark, path):
        refresh_manifest(spark, path, part, time_col)


def newest_stored(spark: SparkSession, path: str, part: str | None = "yyyymm", time_col: str = "timestamp") -> dt.datetime | None:
    """Newest time of a table, from its record."""
    return refresh_manifest(spark, path, part, time_col).agg(F.max("max_time")).first()[0]
