"""Data quality, freshness, triggers and retention of frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.functions import newest, rounded, seconds_between, since
from gaugeworks.functions.timing import interval, newest_part
from gaugeworks.operators.filters import band_of, before, not_before, trailing
from gaugeworks.schema import FRESHNESS_BANDS

# Fixed value: the ranges outside which a quantity counts as faulty.
RANGES = {"temperature": (-50.0, 100.0), "pressure": (950.0, 1050.0)}
# How the keys of triggered runs begin.
STALE_RUN, VOLUME_RUN = "freshness_alert_", "high_volume_"


def _outside(metric: str, ranges) -> Column:
    lo, hi = ranges[metric]
    return F.count_if((F.col(metric) < lo) | (F.col(metric) > hi))


def quality_metrics(ev: DataFrame, span: str | None = "1 hour", as_of=None, ranges=None, approx: bool = False) -> DataFrame:
    """One row: missing and out-of-range shares, completeness of both quantities, time range.

    Completeness is the share of values that are present out of two per reading: 100 when none miss.
    """
    ranges = {**RANGES, **(ranges or {})}
    rows = ev if span is None else trailing(ev, span, as_of)
    missing_t, missing_p = F.col("_nt"), F.col("_np")
    total = F.greatest(F.col("total_events"), F.lit(1))
    share = lambda part, of: rounded(part / of * 100, 2)
    counted = rows.agg(
        F.count(F.lit(1)).alias("total_events"),
        F.count_if(F.col("temperature").isNull()).alias("_nt"),
        F.count_if(F.col("pressure").isNull()).alias("_np"),
        _outside("temperature", ranges).alias("_ot"),
        _outside("pressure", ranges).alias("_op"),
        (F.approx_count_distinct("device_id") if approx else F.count_distinct("device_id")).alias("unique_devices"),
        F.min("timestamp").alias("earliest"),
        F.max("timestamp").alias("latest"),
    )
    return counted.select(
        "total_events",
        share(missing_t, total).alias("null_temperature_pct"),
        share(missing_p, total).alias("null_pressure_pct"),
        share(F.col("_ot"), total).alias("temp_outlier_pct"),
        share(F.col("_op"), total).alias("pressure_outlier_pct"),
        "unique_devices",
        share(total * 2 - missing_t - missing_p, total * 2).alias("data_completeness"),
        "earliest",
        "latest",
    )


def quality_alerts(quality: DataFrame, min_completeness: float = 95.0) -> DataFrame:
    """The quality row again when completeness is too low, else nothing."""
    return quality.filter(F.col("data_completeness") < min_completeness)


def freshness(ev: DataFrame, as_of=None, steps=FRESHNESS_BANDS) -> DataFrame:
    """Seconds since the newest event, with its colour band."""
    now = newest(ev, as_of)
    lag = newest_part(ev).agg(F.max("timestamp").alias("latest")).select(seconds_between(F.col("latest"), now).alias("lag_seconds"))
    return lag.withColumn("band", band_of(F.col("lag_seconds"), steps))


def _run_key(prefix: str, now: Column) -> Column:
    return F.concat(F.lit(prefix), F.date_format(now, "yyyyMMddHHmm"))


def freshness_trigger(ev: DataFrame, as_of=None, limit: str = "5 minutes") -> DataFrame:
    """Whether a quality run is due: no event for longer than ``limit``. An empty table never fires."""
    now = newest(ev, as_of)
    latest = newest_part(ev).agg(F.max("timestamp").alias("latest")).withColumn("now", now)
    fire = F.coalesce(F.col("now") > F.col("latest") + interval(limit), F.lit(False))
    age_us = F.unix_micros(F.col("now").cast("timestamp")) - F.unix_micros(F.col("latest").cast("timestamp"))
    return latest.select(
        fire.alias("fire"),
        F.floor(age_us / 1_000_000).cast("long").alias("age_seconds"),
        F.when(fire, _run_key(STALE_RUN, F.col("now"))).alias("run_key"),
        F.when(F.col("latest").isNull(), "no data").when(fire, "stale").otherwise("fresh").alias("reason"),
    )


def volume_trigger(ev: DataFrame, as_of=None, limit: int = 1000, span: str = "1 minute") -> DataFrame:
    """Whether an extra cache refresh is due: more than ``limit`` events in the last minute."""
    now = newest(ev, as_of)
    counted = trailing(ev, span, as_of).agg(F.count(F.lit(1)).alias("events"))
    fire = F.col("events") > limit
    return counted.select("events", fire.alias("fire"), F.when(fire, _run_key(VOLUME_RUN, now)).alias("run_key"))


def apply_retention(ev: DataFrame, keep: str = "90 days", as_of=None, time_col: str = "timestamp") -> DataFrame:
    """Rows that are still kept: not older than ``keep``."""
    return not_before(ev, since(ev, keep, as_of, time_col), time_col)


def expired(ev: DataFrame, keep: str = "90 days", as_of=None, time_col: str = "timestamp") -> DataFrame:
    """The other side of ``apply_retention``: rows due for the archive."""
    return before(ev, since(ev, keep, as_of, time_col), time_col)
