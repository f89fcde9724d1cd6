"""Rollups: stored partial aggregates that merge.

A rollup row keeps count, sum, min, max and the number of present values. Each part merges with its
own function, so rollups of separate loads combine, coarse grains come from fine ones, and a mean is
always sum over count.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.functions import bucket, day_of, month_of, rounded
from gaugeworks.functions.timing import instant, interval, newest
from gaugeworks.operators.filters import not_before
from gaugeworks.schema import METRICS

KEY = ("bucket", "device_id", "device_type", "location")
GRAINS = ("minute", "hour", "day")
STATUSES = ("OK", "WARN", "CRITICAL")
COUNTS = ("events", "ok", "warnings", "criticals")
MINUTE_METRICS = ("temperature", "pressure", "humidity", "power_consumption")
HOUR_METRICS = MINUTE_METRICS + ("battery_level", "signal_strength")


def _count_parts() -> list[Column]:
    by_status = [F.count_if(F.col("status") == s) for s in STATUSES]
    return [c.alias(n) for c, n in zip([F.count(F.lit(1)), *by_status], COUNTS)]


def _metric_parts(metric: str) -> list[Column]:
    return [
        F.sum(metric).alias(f"sum_{metric}"),
        F.count(metric).alias(f"n_{metric}"),
        F.min(metric).alias(f"min_{metric}"),
        F.max(metric).alias(f"max_{metric}"),
    ]


def parts(metrics: Sequence[str]) -> list[Column]:
    """Aggregates that turn events into partials."""
    return _count_parts() + [c for m in metrics for c in _metric_parts(m)]


def metrics_in(rolled: DataFrame) -> list[str]:
    return [m for m in METRICS if f"n_{m}" in rolled.columns]


def merged_parts(rolled: DataFrame) -> list[Column]:
    """Aggregates that turn partials into partials of a wider group."""
    out = [F.sum(c).alias(c) for c in COUNTS]
    for m in metrics_in(rolled):
        out += [
            F.sum(f"sum_{m}").alias(f"sum_{m}"), F.sum(f"n_{m}").alias(f"n_{m}"),
            F.min(f"min_{m}").alias(f"min_{m}"), F.max(f"max_{m}").alias(f"max_{m}"),
        ]
    return out


def rollup(ev: DataFrame, grain: str = "minute", metrics: Sequence[str] | None = None) -> DataFrame:
    """Partials per bucket, device, type and place; by default of the quantities the frame has."""
    if grain not in GRAINS:
        raise ValueError(f"grain must be one of {GRAINS}")
    usual = MINUTE_METRICS if grain == "minute" else HOUR_METRICS
    chosen = metrics or [m for m in usual if m in ev.columns]
    return ev.groupBy(bucket("timestamp", grain).alias("bucket"), *KEY[1:]).agg(*parts(chosen))


def merge_rollup(old: DataFrame, new: DataFrame) -> DataFrame:
    """One rollup from two loads; a bucket present in both is combined, part by part."""
    both = old.unionByName(new)
    return both.groupBy(*KEY).agg(*merged_parts(both))


def coarsen(rolled: DataFrame, grain: str) -> DataFrame:
    """A coarser grain from a finer one, without going back to the events."""
    rest = [F.col(k) for k in KEY[1:]]
    return rolled.groupBy(bucket("bucket", grain).alias("bucket"), *rest).agg(*merged_parts(rolled))


def mean_from_parts(metric: str, digits: int = 2) -> Column:
    total = F.sum(f"sum_{metric}").cast("double")
    return rounded(F.try_divide(total, F.sum(f"n_{metric}")), digits)


def _recent(rolled: DataFrame, span: str, as_of) -> DataFrame:
    if as_of is not None:
        return rolled.filter(F.col("bucket") >= instant(as_of) - interval(span))
    return rolled.filter(F.col("bucket") >= rolled.agg(F.max("bucket") - interval(span)).scalar())


def device_stats_of(partials: DataFrame) -> DataFrame:
    """The columns of the device statistics from partials of any grain."""
    return (
        partials.groupBy("device_id")
        .agg(
            F.sum("events").alias("message_count"),
            mean_from_parts("temperature").alias("avg_temperature"),
            rounded(F.min("min_temperature"), 2).alias("min_temperature"),
            rounded(F.max("max_temperature"), 2).alias("max_temperature"),
            mean_from_parts("pressure").alias("avg_pressure"),
            F.sum("warnings").alias("warning_count"),
        )
        .orderBy("device_id")
    )


def device_stats_from_rollup(rolled: DataFrame, span: str = "5 minutes", as_of=None) -> DataFrame:
    """Device statistics from whole stored buckets; one that the span cuts into is left out (``operators.tiers`` has it)."""
    return device_stats_of(_recent(rolled, span, as_of))


def trend_from_rollup(rolled: DataFrame, span: str = "24 hours", as_of=None) -> DataFrame:
    """Events and mean temperature per stored bucket (hour over a day, or minute over an hour)."""
    return (
        _recent(rolled, span, as_of)
        .groupBy("bucket")
        .agg(F.sum("events").alias("events"), mean_from_parts("temperature").alias("avg_temperature"))
        .orderBy("bucket")
    )


def timeseries_of(partials: DataFrame, grain: str = "minute") -> DataFrame:
    """The columns of the time series from partials no coarser than ``grain``."""
    out = partials.groupBy(bucket("bucket", grain).alias(grain)).agg(
        mean_from_parts("temperature").alias("avg_temperature"), mean_from_parts("pressure").alias("avg_pressure"),
        F.sum("events").alias("event_count"),
    )
    return out.orderBy(grain)


def timeseries_from_rollup(rolled: DataFrame, span: str = "1 hour", grain: str = "minute", as_of=None) -> DataFrame:
    """The time series from whole stored buckets; one that the span cuts into is left out."""
    return timeseries_of(_recent(rolled, span, as_of), grain)


def hourly_stats_of(partials: DataFrame, approx: bool = False) -> DataFrame:
    """The columns of the hourly statistics from partials no coarser than an hour."""
    distinct = F.approx_count_distinct("device_id") if approx else F.count_distinct("device_id")
    out = partials.groupBy(bucket("bucket", "hour").alias("hour")).agg(
        F.sum("events").alias("events"), mean_from_parts("temperature").alias("avg_temperature"),
        mean_from_parts("pressure").alias("avg_pressure"), distinct.alias("active_devices"),
    )
    return out.orderBy("hour")


def hourly_stats_from_rollup(rolled: DataFrame, span: str = "24 hours", as_of=None, approx: bool = False) -> DataFrame:
    """The hourly statistics from whole stored buckets; one that the span cuts into is left out."""
    return hourly_stats_of(_recent(rolled, span, as_of), approx)


def hourly_coverage(rolled: DataFrame, span: str = "24 hours", as_of=None) -> DataFrame:
    return _recent(rolled, span, as_of).agg(
        F.count(F.lit(1)).alias("row_count"), F.min("bucket").alias("earliest"), F.max("bucket").alias("latest")
    )


def daily_coverage(rolled: DataFrame, days: int = 30, as_of=None, approx: bool = False) -> DataFrame:
    """Whole days back from the day of ``as_of``."""
    date = F.col("bucket").cast("date")
    today = newest(rolled, as_of, "bucket").cast("date")
    distinct = F.approx_count_distinct("device_id") if approx else F.count_distinct("device_id")
    return rolled.filter(date >= F.date_sub(today, days)).agg(
        F.count(F.lit(1)).alias("row_count"), distinct.alias("unique_devices"),
        F.min(date).alias("earliest"), F.max(date).alias("latest"),
    )


def part_column(grain: str) -> Column:
    return day_of("bucket") if grain == "minute" else month_of("bucket")


def write_rollup(rolled: DataFrame, path: str, grain: str) -> None:
    """Minute rollups by day, coarser ones by month, sorted by device and time inside a file."""
    (
        rolled.withColumn("part", part_column(grain))
        .repartitionByRange("part", "device_id", "bucket")
        .sortWithinPartitions("part", "device_id", "bucket")
        .write.mode("overwrite")
        .partitionBy("part")
        .option("partitionOverwriteMode", "dynamic")
        .parquet(path)
    )


def settle_rollup(spark: SparkSession, landing: str, path: str, parts: Sequence[str], grain: str = "minute") -> None:
    """Move finished partitions of a landed rollup (``streaming.sink_rollup``) into the stored one.

    Each is rebuilt whole from the landed rows and replaces what the table had of it, so it may be repeated.
    """
    landed = spark.read.parquet(landing).filter(F.col("part").cast("string").isin(*parts))
    write_rollup(landed.drop("part"), path, grain)


def refresh_rollup(spark: SparkSession, path: str, ev: DataFrame, changed_since, grain: str = "minute") -> DataFrame:
    """Recompute the partitions that hold events from ``changed_since`` on; others stay untouched.

    The affected partitions are rebuilt whole from the events, so running it twice, or again after a
    lost executor, gives the same table. ``ev`` must hold every event of those partitions.
    """
    unit = "day" if grain == "minute" else "month"
    start = F.date_trunc(unit, instant(changed_since)).cast("timestamp_ntz")
    write_rollup(rollup(not_before(ev, start), grain), path, grain)
    return spark.read.parquet(path)
