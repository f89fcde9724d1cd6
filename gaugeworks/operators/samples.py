"""Metric samples (metric, labels, ts, value): rates, gauges, ratios, histograms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.functions import instant, percent, rounded, since
from gaugeworks.functions.timing import span_seconds
from gaugeworks.operators.chunks import CHUNK, SMALL, in_chunks

NEWEST_LAST = ("ts", "value")
#: A gauge whose newest sample is older has stopped and shows no value.
LOOK_BACK = "5 minutes"


TAGS = "_tags"


def tags(labels: str = "labels") -> Column:
    """The labels in key order, so that equal sets are one series whatever order they came in."""
    return F.sort_array(F.map_entries(labels)).alias(TAGS)


def series() -> Column:
    """The labels of a series as JSON text; made once per series, after grouping."""
    return F.to_json(F.map_from_entries(TAGS)).alias("series")


def _recent(rows: DataFrame, samples: DataFrame, span: str | None, as_of) -> DataFrame:
    """The rows of the span that ends at ``as_of``, by default at the newest of all samples."""
    if span is None:
        return rows
    within = F.col("ts") >= since(samples, span, as_of, "ts")
    return rows.filter(within if as_of is None else within & (F.col("ts") <= instant(as_of)))


def _named(samples: DataFrame, name: str, span: str | None, as_of) -> DataFrame:
    return _recent(samples.filter(F.col("metric") == name), samples, span, as_of)


def _increase(value: Column, previous: Column) -> Column:
    """Growth since the previous sample; a counter that fell has started again from 0."""
    return F.when(value >= previous, value - previous).when(previous.isNotNull(), value).otherwise(0.0)


def counter_rate(
    samples: DataFrame, name: str, span: str | None = "5 minutes", as_of=None, seconds: int | None = None,
    chunk: str = "1 minute", small: int = SMALL,
) -> DataFrame:
    """Per-second rate of every series of a counter over the span.

    Increases are summed inside chunks of a series. Each chunk keeps its first and last value, and
    the step from one chunk to the next is added from those.
    """
    length = seconds if seconds is not None else span_seconds(span)
    rows = _named(samples, name, span, as_of).select(tags(), "ts", "value")
    rows = in_chunks(rows, [TAGS], NEWEST_LAST, chunk, small)
    inside = Window.partitionBy(TAGS, CHUNK).orderBy(*NEWEST_LAST)
    steps = rows.withColumn("_up", _increase(F.col("value"), F.lag("value").over(inside)))
    per_chunk = steps.groupBy(TAGS, CHUNK).agg(
        F.sum("_up").alias("_up"),
        F.min(F.struct(*NEWEST_LAST)).alias("_first"),
        F.max(F.struct(*NEWEST_LAST)).alias("_last"),
    )
    in_order = Window.partitionBy(TAGS).orderBy(CHUNK)
    edge = _increase(F.col("_first.value"), F.lag("_last.value").over(in_order))
    rates = (
        per_chunk.withColumn("_edge", edge)
        .groupBy(TAGS)
        .agg((F.sum(F.col("_up") + F.col("_edge")) / F.lit(float(length))).alias("rate"))
    )
    return rates.select(series(), "rate")


def busy_percent(samples: DataFrame, idle_counter: str, span: str | None = "5 minutes", as_of=None, seconds=None) -> DataFrame:
    """100 minus the mean idle rate over all series, in percent."""
    rates = counter_rate(samples, idle_counter, span, as_of, seconds)
    return rates.agg(rounded(F.lit(100.0) - F.avg("rate") * 100, 4).alias("busy_pct"))


def gauge_latest(samples: DataFrame, name: str, span: str | None = LOOK_BACK, as_of=None) -> DataFrame:
    """Newest value of every series that has one within the span; ``span=None`` looks at the whole history."""
    newest = _named(samples, name, span, as_of).groupBy(tags()).agg(F.max(F.struct(*NEWEST_LAST)).alias("_last"))
    return newest.select(series(), F.col("_last.ts").alias("ts"), F.col("_last.value").alias("value"))


def gauge_ratio(samples: DataFrame, part: str, whole: str, span: str | None = LOOK_BACK, as_of=None) -> DataFrame:
    """``(1 - part/whole) * 100`` of the newest values with equal labels within the span, without a join."""
    both = _recent(samples.filter(F.col("metric").isin(part, whole)), samples, span, as_of).groupBy(tags()).agg(
        F.max(F.when(F.col("metric") == part, F.struct(*NEWEST_LAST))).alias("_part"),
        F.max(F.when(F.col("metric") == whole, F.struct(*NEWEST_LAST))).alias("_whole"),
    )
    matched = both.filter(F.col("_part").isNotNull() & F.col("_whole").isNotNull())
    used = percent(F.col("_whole.value") - F.col("_part.value"), F.col("_whole.value"), 3)
    return matched.select(series(), used.alias("used_pct"))


def sum_where(samples: DataFrame, name: str, labels: dict[str, str], span: str | None = LOOK_BACK, as_of=None) -> DataFrame:
    """Sum of the newest values, within the span, of the series that carry the given labels."""
    rows = _named(samples, name, span, as_of)
    for key, value in labels.items():
        rows = rows.filter(F.col("labels")[key] == value)
    return gauge_latest(rows, name, None).agg(F.sum("value").alias("total"))


def bucket_histogram(df: DataFrame, value: str, bounds: Sequence[float], labels: Sequence[str] = ()) -> DataFrame:
    """Cumulative buckets per label set: how many values lie at or below each bound, sum and count."""
    names = [f"{b:g}" for b in bounds]
    within = [F.count_if(F.col(value) <= b).alias(n) for b, n in zip(bounds, names)]
    counted = df.groupBy(*labels).agg(
        *within, F.count(value).alias("+Inf"),
        F.sum(value).cast("double").alias("sum"), F.count(value).alias("count"),
    )
    return counted.unpivot([*labels, "sum", "count"], [F.col(f"`{n}`") for n in [*names, "+Inf"]], "le", "bucket")
