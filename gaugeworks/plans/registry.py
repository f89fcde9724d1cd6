"""Where named queries and their checking SQL are kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeworks.sources.sample_tables import COMPRESSION, newest_time, telemetry

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, with the SQL that must give the same rows where there is one."""

    def keep(build: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return keep


def recent(spark: SparkSession, sf_dir: str, span: str, compression: int = COMPRESSION):
    """The rows of the trailing span and the time it ends at."""
    as_of = newest_time(spark, sf_dir, compression)
    return telemetry(spark, sf_dir, span, as_of, compression), as_of


def doubled(df: DataFrame) -> DataFrame:
    """Decimal columns as doubles, for output."""
    return df.select(
        *[
            F.col(f.name).cast("double").alias(f.name) if isinstance(f.dataType, T.DecimalType) else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def unzoned(df: DataFrame) -> DataFrame:
    """Stream times without zone, for output."""
    return df.select(
        *[
            F.col(f.name).cast("timestamp_ntz").alias(f.name) if isinstance(f.dataType, T.TimestampType) else F.col(f.name)
            for f in df.schema.fields
        ]
    )
