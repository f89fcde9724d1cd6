"""Reading published result sets that have not expired."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.errors import AnalysisException

from gaugeworks.functions import instant

SNAPSHOT = T.StructType(
    [
        T.StructField("payload", T.StringType()),
        T.StructField("place", T.LongType()),
        T.StructField("written_at", T.TimestampNTZType()),
        T.StructField("expires_at", T.TimestampNTZType()),
        T.StructField("key", T.StringType()),
    ]
)


def read_snapshot(
    spark: SparkSession, store: str, key: str, schema: T.StructType, as_of, ordered: bool = False
) -> DataFrame:
    """Rows of the result set under ``key``, typed again; none once it has expired.

    ``ordered`` returns them in the order in which they were published; without it nothing is sorted.
    """
    rows = _alive(spark, store, key, as_of)
    return _documents(rows.orderBy("place") if ordered else rows, schema)


def read_ranking(
    spark: SparkSession, store: str, key: str, schema: T.StructType, as_of, limit: int, rank: str = "rank"
) -> DataFrame:
    """The first ``limit`` rows of a published ranking, numbered from 1 as they were published."""
    alive = _alive(spark, store, key, as_of).filter("payload IS NOT NULL")
    top = alive.orderBy("place").limit(limit)
    numbered = top.withColumn("nth", F.row_number().over(Window.orderBy("place")).cast("long"))
    return numbered.select(F.col("nth").alias(rank), F.from_json("payload", schema).alias("r")).select(rank, "r.*")


def _alive(spark: SparkSession, store: str, key: str, as_of) -> DataFrame:
    """Records under ``key`` that have not expired, the set's header among them.

    ``key`` is the partition column of the store, so only that folder is read.
    """
    rows = spark.read.schema(SNAPSHOT).parquet(store)
    return rows.filter((F.col("key") == key) & (F.col("expires_at") > instant(as_of)))


def _documents(alive: DataFrame, schema: T.StructType) -> DataFrame:
    return alive.filter("payload IS NOT NULL").select(F.from_json("payload", schema).alias("r")).select("r.*")


def snapshot_or(
    spark: SparkSession, store: str, key: str, schema: T.StructType, as_of, live: Callable[[], DataFrame]
) -> DataFrame:
    """The cached result set, which may be empty, or the live query when it is missing or expired."""
    try:
        alive = _alive(spark, store, key, as_of)
        found = not alive.isEmpty()
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        found = False
    return _documents(alive, schema) if found else live()
