"""One read over stored tiers: whole days, hours and minutes from rollups, the cut ends from the events.

A trailing span rarely begins on a bucket. Its exact cover takes the largest whole buckets that are known to be
complete and reads raw events only where none is: the cut bucket at its start, what has come since the last
rollup, and gaps. Which buckets are complete is a stored record that the jobs which write rollups keep; buckets that
it does not name are never trusted. Partials of all tiers are of one shape, so any panel made of counts, sums,
extremes and distinct devices is the raw one.

Layout under one folder: ``events`` by hour, ``minute`` by day, ``hour`` and ``day`` by month, ``complete``, and the
column types in ``schema``, so that tiers without any row can be read.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeworks.functions import instant
from gaugeworks.functions.timing import span_seconds
from gaugeworks.operators.rollups import MINUTE_METRICS, coarsen, device_stats_of, hourly_stats_of, rollup, timeseries_of, write_rollup

#: Tiers from coarse to fine, with the length of their buckets.
TIERS = {"day": dt.timedelta(days=1), "hour": dt.timedelta(hours=1), "minute": dt.timedelta(minutes=1)}
_EPOCH = dt.datetime(1970, 1, 1)

Spans = Sequence[tuple[dt.datetime, dt.datetime]]


@dataclass(frozen=True)
class Piece:
    """Rows of one tier from ``start`` to before ``end`` (None: all that follow)."""

    tier: str
    start: dt.datetime
    end: dt.datetime | None


def _floor(at: dt.datetime, grain: str) -> dt.datetime:
    return at - (at - _EPOCH) % TIERS[grain]


def _ceil(at: dt.datetime, grain: str) -> dt.datetime:
    return at + (_EPOCH - at) % TIERS[grain]


def cover(start: dt.datetime, end: dt.datetime | None, complete: Mapping[str, Spans], tiers: Sequence[str] = tuple(TIERS)) -> list[Piece]:
    """Pieces that hold every moment from ``start`` to before ``end`` once, in order, with as little raw as there can be.

    ``complete`` names the spans of each tier whose buckets hold all their events; they must not overlap.
    """
    if end is not None and end <= start:
        return []
    if not tiers:
        return [Piece("events", start, end)]
    tier, finer = tiers[0], tiers[1:]
    out, at = [], start
    for first, last in sorted(complete.get(tier, ())):
        first = _ceil(max(first, at), tier)
        last = _floor(last if end is None else min(last, end), tier)
        if first < last:
            out += [*cover(at, first, complete, finer), Piece(tier, first, last)]
            at = last
    return out + cover(at, end, complete, finer)


# -- the record of complete buckets ---------------------------------------------------------------

RECORD = "grain string, start timestamp_ntz, end timestamp_ntz, kept boolean"


def _note(spark: SparkSession, base: str, grain: str, start: dt.datetime, end: dt.datetime, kept: bool) -> None:
    if grain not in TIERS:
        raise ValueError(f"unknown tier: {grain!r}")
    spark.createDataFrame([(grain, start, end, kept)], RECORD).coalesce(1).write.mode("append").parquet(f"{base}/complete")


def mark_complete(spark: SparkSession, base: str, grain: str, start: dt.datetime, end: dt.datetime) -> None:
    """Record that the stored buckets inside the span hold all their events; buckets that it cuts are left out.

    To be called after the rollup has been written, so a job that fails in between leaves raw reads, not gaps.
    """
    first, last = _ceil(start, grain), _floor(end, grain)
    if first < last:
        _note(spark, base, grain, first, last, True)


def mark_dropped(spark: SparkSession, base: str, grain: str, before: dt.datetime) -> None:
    """Record that buckets before ``before`` are about to go (retention): they count as absent from now on."""
    _note(spark, base, grain, _EPOCH, _ceil(before, grain), False)


def complete_spans(spark: SparkSession, base: str, start: dt.datetime | None = None) -> dict[str, list]:
    """The complete spans of each tier that end after ``start``, adjoining ones joined.

    The record has one row for each run of a rollup job; joined, a row for each gap comes to the driver.
    """
    rows = spark.read.schema(RECORD).parquet(f"{base}/complete")
    gone = rows.filter("NOT kept").groupBy("grain").agg(F.max("end").alias("gone"))
    kept = rows.filter("kept").join(gone, "grain", "left").withColumn("start", F.greatest("start", "gone")).filter("start < end")
    if start is not None:
        kept = kept.filter(F.col("end") > instant(start))
    order = Window.partitionBy("grain").orderBy("start", "end")
    reached = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = (reached.isNull() | (F.col("start") > reached)).cast("int")
    islands = kept.withColumn("opens", opens).withColumn("island", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    joined = islands.groupBy("grain", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    out: dict[str, list] = {}
    for r in joined.collect():
        out.setdefault(r["grain"], []).append((r["start"], r["end"]))
    return out


# -- writing --------------------------------------------------------------------------------------


def hour_of(col: Column | str) -> Column:
    return F.date_format(col, "yyyyMMddHH")


def write_hours(ev: DataFrame, base: str) -> None:
    """Events by hour, so that the cut ends of a span are read without the rest of their day.

    Range partitioning by time spreads an hour with most events over several tasks.
    """
    ev.limit(0).write.mode("overwrite").parquet(f"{base}/schema")
    ev.sparkSession.createDataFrame([], RECORD).write.mode("append").parquet(f"{base}/complete")
    (
        ev.withColumn("part", hour_of("timestamp"))
        .repartitionByRange("part", "timestamp")
        .sortWithinPartitions("part", "timestamp")
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(f"{base}/events")
    )


def tier_schema(spark: SparkSession, base: str, tier: str, metrics: Sequence[str] = MINUTE_METRICS) -> T.StructType:
    """Columns of a tier; sums have the type that the events' own sums have."""
    empty = spark.read.parquet(f"{base}/schema")
    return (empty if tier == "events" else rollup(empty, tier, metrics)).schema


def stored_tier(spark: SparkSession, base: str, tier: str, metrics: Sequence[str] = MINUTE_METRICS) -> DataFrame:
    """The stored rows of a tier, with the folder they lie in as ``part``."""
    schema = tier_schema(spark, base, tier, metrics)
    return spark.read.schema(T.StructType([*schema.fields, T.StructField("part", T.StringType())])).parquet(f"{base}/{tier}")


def build_tiers(
    spark: SparkSession, ev: DataFrame, base: str, start: dt.datetime, until: dt.datetime, metrics: Sequence[str] = MINUTE_METRICS
) -> None:
    """Write all events by hour and the rollups of the buckets that lie whole in ``start`` .. ``until``, and record those.

    Each tier is made of the one below it, so the events are aggregated once. A repeated run replaces its buckets.
    """
    write_hours(ev, base)
    stored = stored_tier(spark, base, "events").drop("part")
    finer = rollup(_within(stored, "timestamp", _ceil(start, "minute"), _floor(until, "minute")), "minute", metrics)
    for grain in ("minute", "hour", "day"):
        whole = _within(finer, "bucket", _ceil(start, grain), _floor(until, grain))
        whole = whole if grain == "minute" else coarsen(whole, grain)
        columns = tier_schema(spark, base, grain, metrics).fields
        write_rollup(whole.select(*[F.col(f.name).cast(f.dataType) for f in columns]), f"{base}/{grain}", grain)
        mark_complete(spark, base, grain, start, until)
        finer = stored_tier(spark, base, grain, metrics).drop("part")


# -- reading --------------------------------------------------------------------------------------


def _within(df: DataFrame, time_col: str, start: dt.datetime, end: dt.datetime | None) -> DataFrame:
    rows = df.filter(F.col(time_col) >= instant(start))
    return rows if end is None else rows.filter(F.col(time_col) < instant(end))


_FOLDER = {"events": "%Y%m%d%H", "minute": "%Y%m%d", "hour": "%Y%m", "day": "%Y%m"}


def _inside(rows: DataFrame, tier: str, pieces: list[Piece]) -> DataFrame:
    """The rows of a tier inside its pieces, with the same bounds on its folders."""
    time_col = "timestamp" if tier == "events" else "bucket"
    folder, text = F.col("part"), _FOLDER[tier]

    def inside(p: Piece) -> Column:
        held = (F.col(time_col) >= instant(p.start)) & (folder >= p.start.strftime(text))
        if p.end is None:
            return held
        return held & (F.col(time_col) < instant(p.end)) & (folder <= (p.end - dt.timedelta(microseconds=1)).strftime(text))

    return rows.filter(reduce(lambda a, b: a | b, [inside(p) for p in pieces])).drop("part")


def tiered_partials(
    spark: SparkSession, base: str, start: dt.datetime, end: dt.datetime | None = None, tiers: Sequence[str] = tuple(TIERS),
    metrics: Sequence[str] = MINUTE_METRICS,
) -> DataFrame:
    """Rollup rows that together hold every event from ``start`` to before ``end`` once; raw ends are rolled up by minute.

    ``tiers`` must leave out those coarser than the buckets wanted.
    """
    pieces = cover(start, end, complete_spans(spark, base, start), tiers)
    frames = []
    for tier in ("events", *TIERS):
        own = [p for p in pieces if p.tier == tier]
        if own:
            rows = _inside(stored_tier(spark, base, tier, metrics), tier, own)
            frames.append(rollup(rows, "minute", metrics) if tier == "events" else rows)
    return reduce(DataFrame.unionByName, frames)


def newest_time(spark: SparkSession, base: str) -> dt.datetime | None:
    """Newest time of the stored events; only the newest hour's folder is read."""
    events = stored_tier(spark, base, "events")
    return events.filter(F.col("part") == events.agg(F.max("part")).scalar()).agg(F.max("timestamp")).first()[0]


def _begin(spark: SparkSession, base: str, span: str, as_of: dt.datetime | None) -> dt.datetime:
    at = as_of if as_of is not None else newest_time(spark, base)
    return at - dt.timedelta(seconds=span_seconds(span))


def device_stats_tiered(spark: SparkSession, base: str, span: str = "5 minutes", as_of: dt.datetime | None = None) -> DataFrame:
    """``summaries.device_stats`` over any span, from the tiers."""
    return device_stats_of(tiered_partials(spark, base, _begin(spark, base, span, as_of)))


def timeseries_tiered(spark: SparkSession, base: str, span: str = "1 hour", as_of: dt.datetime | None = None) -> DataFrame:
    """``summaries.timeseries`` by minute, from the tiers that are no coarser."""
    return timeseries_of(tiered_partials(spark, base, _begin(spark, base, span, as_of), tiers=["minute"]), "minute")


def hourly_stats_tiered(spark: SparkSession, base: str, span: str = "24 hours", as_of: dt.datetime | None = None, approx: bool = False) -> DataFrame:
    """``summaries.hourly_stats``, from the tiers that are no coarser."""
    return hourly_stats_of(tiered_partials(spark, base, _begin(spark, base, span, as_of), tiers=["hour", "minute"]), approx)


PANELS: dict[str, Callable[..., DataFrame]] = {
    "device_stats": device_stats_tiered, "timeseries_1h": timeseries_tiered, "hourly_stats_24h": hourly_stats_tiered,
}


def panel(spark: SparkSession, base: str, key: str, as_of: dt.datetime, store: str | None = None) -> DataFrame:
    """A cached panel by its key: the published set while it lives, else the tiers, which end in raw events."""
    from gaugeworks.sources.snapshots import snapshot_or

    live = PANELS[key](spark, base, as_of=as_of)
    return live if store is None else snapshot_or(spark, store, key, live.schema, as_of, lambda: live)
