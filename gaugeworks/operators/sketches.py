"""Distinct devices that can be merged: sketches stored in rollup rows and united across grains.

A rollup by minute and place that keeps no device cannot tell how many there were; an approximate count cannot be added
up either. A sketch can be united with others, so hours come from minutes and windows from panes, at a fixed size a row.
The relative error of an estimate is about 1.04 / sqrt(2 ** ``LG``) (one standard deviation); small counts are exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.functions import bucket, since
from gaugeworks.functions.timing import interval
from gaugeworks.operators.filters import not_before

#: Logarithm of a sketch's slots: 0.6 % error, some 16 KB a sketch at most.
LG = 15


def sketch_rollup(ev: DataFrame, grain: str = "minute", keys: Sequence[str] = (), lg: int = LG) -> DataFrame:
    """``bucket``, the keys, ``events`` and ``devices``: a sketch of the distinct devices."""
    return ev.groupBy(bucket("timestamp", grain).alias("bucket"), *keys).agg(
        F.count(F.lit(1)).alias("events"), F.hll_sketch_agg("device_id", lg).alias("devices")
    )


def _united() -> list[Column]:
    return [F.sum("events").alias("events"), F.hll_union_agg("devices").alias("devices")]


def coarsen_sketches(rolled: DataFrame, grain: str, keys: Sequence[str] = ()) -> DataFrame:
    """A coarser grain, or fewer keys, from stored rows; loads of one bucket may be in several rows."""
    return rolled.groupBy(bucket("bucket", grain).alias("bucket"), *keys).agg(*_united())


def counted(rolled: DataFrame) -> DataFrame:
    """Sketches as numbers."""
    return rolled.withColumn("devices", F.hll_sketch_estimate("devices"))


def active_devices_from_sketches(rolled: DataFrame, span: str | None = "5 minutes", as_of=None) -> DataFrame:
    """Distinct devices of whole stored buckets of the span."""
    rows = rolled if span is None else not_before(rolled, since(rolled, span, as_of, "bucket"), "bucket")
    united = rows.agg(F.hll_union_agg("devices").alias("devices"))
    return united.select(F.coalesce(F.hll_sketch_estimate("devices"), F.lit(0).cast("long")).alias("devices"))


def daily_coverage_from_sketches(rolled: DataFrame) -> DataFrame:
    """Events and distinct devices of each day."""
    return counted(coarsen_sketches(rolled, "day")).select(F.to_date("bucket").alias("day"), "events", F.col("devices").alias("unique_devices"))


def sliding_devices(rolled: DataFrame, minutes: int = 15) -> DataFrame:
    """Distinct devices of the windows of so many minutes that begin at each minute; one sketch a minute is copied, no row."""
    panes = rolled.groupBy("bucket").agg(*_united())
    starts = F.sequence(F.col("bucket") - interval(f"{minutes - 1} minutes"), F.col("bucket"), interval("1 minute"))
    out = panes.withColumn("window_start", F.explode(starts)).groupBy("window_start").agg(*_united())
    return counted(out).select("window_start", (F.col("window_start") + interval(f"{minutes} minutes")).alias("window_end"), "devices")
