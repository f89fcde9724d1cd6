"""Typed scans of the events table, as a batch or as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeworks.functions import from_iso
from gaugeworks.schema import EVENTS, HEADER, MESSAGE, METRICS, NARROW


def zero_filled(ev: DataFrame) -> DataFrame:
    """Missing quantities read as 0, the way a table of non-nullable floats shows them."""
    return ev.fillna(0, subset=[m for m in METRICS if m in ev.columns])


def read_events(spark: SparkSession, path: str, fmt: str = "parquet", missing_as_zero: bool = False) -> DataFrame:
    """The wide events table with its declared schema; nothing is inferred from the files.

    A month-partitioned table also shows its ``yyyymm`` column, which ``trailing`` prunes by.
    """
    if fmt == "parquet":
        ev = spark.read.schema(EVENTS).parquet(path)
    elif fmt == "json":
        raw = spark.read.schema(MESSAGE).json(path)
        ev = raw.withColumn("timestamp", from_iso("timestamp")).select(
            *HEADER, *[F.col(m).cast("float").alias(m) for m in METRICS]
        )
    else:
        raise ValueError(f"unknown format: {fmt!r}")
    return zero_filled(ev) if missing_as_zero else ev


def read_month_range(spark: SparkSession, path: str, first: str, last: str | None = None) -> DataFrame:
    """Months ``first``..``last`` (yyyyMM) of a table written by ``write_events``.

    The bounds are on the partition column, so other months are not even listed for reading.
    """
    ev = spark.read.schema(T.StructType(EVENTS.fields + [T.StructField("yyyymm", T.StringType())])).parquet(path)
    ev = ev.filter(F.col("yyyymm") >= first)
    return ev if last is None else ev.filter(F.col("yyyymm") <= last)


def stream_events(
    spark: SparkSession, folder: str, max_files: int | None = None, fmt: str = "parquet",
    schema: T.StructType = EVENTS, glob: str | None = None,
) -> DataFrame:
    """Files that arrive in a folder as a stream, with a time column that can carry a watermark."""
    reader = spark.readStream.schema(schema)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if glob is not None:
        reader = reader.option("pathGlobFilter", glob)
    raw = reader.format(fmt).load(folder)
    if "timestamp" not in raw.columns:
        return raw
    return raw.withColumn("timestamp", F.col("timestamp").cast("timestamp"))


def narrow(ev: DataFrame) -> DataFrame:
    """The six-column profile; the other columns are never read from the files."""
    return ev.select(*NARROW)
