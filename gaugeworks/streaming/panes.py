"""Sliding windows from panes: each row is counted once, in the minute it falls into.

A micro-batch is reduced to one partial per minute and device, device type and place before its only shuffle, and
filed as a segment of a live minute rollup whose segments merge part by part. Windows are put together from panes when
they are read: a window of fifteen minutes adds up fifteen partials, and no raw row is copied. A window shows what
has arrived by then, so there is no delay; late rows still count, as long as their panes are kept.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gaugeworks.functions import rounded
from gaugeworks.functions.timing import instant, interval, span_seconds
from gaugeworks.operators.rollups import KEY, mean_from_parts, merged_parts, rollup
from gaugeworks.sinks.live import unzoned
from gaugeworks.sinks.segments import read_segments, write_segment

PANE = 60
#: What the windows need of each pane.
MEASURED = ("temperature", "pressure")


def _merged(panes: DataFrame) -> DataFrame:
    """Panes that stand in several segments as one, of the same column types."""
    out = panes.groupBy(*KEY).agg(*merged_parts(panes))
    return out.select(*[F.col(f.name).cast(f.dataType) for f in panes.schema.fields])


def sink_panes(
    stream: DataFrame, path: str, checkpoint: str, every: str | None = "5 seconds", metrics: Sequence[str] = MEASURED, keep: str | None = None
) -> StreamingQuery:
    """Keep the stream's minute panes, exactly once; with ``keep``, those older than that before the batch's newest row go
    as soon as their whole segment is older.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        panes = rollup(unzoned(batch).filter("timestamp IS NOT NULL"), "minute", metrics)
        gone = None
        if keep is not None:
            newest = batch.agg(F.max("timestamp").cast("timestamp_ntz")).first()[0]
            gone = None if newest is None else newest - dt.timedelta(seconds=span_seconds(keep))
        write_segment(panes, path, batch_id, _merged, time_col="bucket", gone=gone)

    writer = stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(write)
    writer = writer.trigger(availableNow=True) if every is None else writer.trigger(processingTime=every)
    return writer.start()


def read_panes(spark: SparkSession, path: str, since: dt.datetime | None = None) -> DataFrame:
    """The panes of a store from ``since`` on; segments that end before it are not read. A pane may be in several rows."""
    panes = read_segments(spark, path, since)
    return panes if since is None else panes.filter(F.col("bucket") >= instant(since))


def _slots(size: str) -> int:
    seconds = span_seconds(size)
    if seconds % PANE:
        raise ValueError("windows are made of whole minutes")
    return seconds // PANE


def _starts(n: int) -> Column:
    """Starts of the ``n`` windows that a pane belongs to."""
    return F.sequence(F.col("bucket") - interval(f"{(n - 1) * PANE} seconds"), F.col("bucket"), interval(f"{PANE} seconds"))


def _sliding(panes: DataFrame, size: str, **measures: Column) -> DataFrame:
    """Measures of the windows of ``size`` that begin at each minute. Partials of a minute are added up before they are copied."""
    minutes = panes.groupBy("bucket").agg(*merged_parts(panes))
    copies = minutes.withColumn("window_start", F.explode(_starts(_slots(size))))
    out = copies.groupBy("window_start").agg(*[m.alias(n) for n, m in measures.items()])
    return out.select("window_start", (F.col("window_start") + interval(size)).alias("window_end"), *measures)


def hot_averages(panes: DataFrame, size: str = "5 minutes") -> DataFrame:
    return _sliding(panes, size, avg_temperature=mean_from_parts("temperature"), avg_pressure=mean_from_parts("pressure"))


def extremes(panes: DataFrame, size: str = "15 minutes") -> DataFrame:
    return _sliding(
        panes, size, max_temperature=rounded(F.max("max_temperature"), 2), min_temperature=rounded(F.min("min_temperature"), 2)
    )


def active_devices(panes: DataFrame, size: str = "15 minutes") -> DataFrame:
    """Distinct devices of each window, exactly, and without copying a pane to its windows.

    A device seen at a minute is in the windows that begin in the ``size`` up to it. Of each pane only the starts count
    that its device's pane before does not have: one rise and one fall. The running sum of those is taken over minutes,
    of which there is one row each.
    """
    n = _slots(size)
    step, reach = interval(f"{PANE} seconds"), interval(f"{(n - 1) * PANE} seconds")
    seen = panes.select("device_id", "bucket").distinct()
    before = F.lag("bucket").over(Window.partitionBy("device_id", "_day").orderBy("bucket"))
    # a device's panes are ordered within days; the first pane of a day looks back to the last of the day before
    day = F.to_date("bucket")
    ends = seen.groupBy("device_id", day.alias("_day")).agg(F.max("bucket").alias("_last"))
    carried = ends.select("device_id", F.date_add("_day", 1).alias("_day"), F.col("_last"))
    days = seen.withColumn("_day", day).withColumn("_before", before).join(carried, ["device_id", "_day"], "left")
    since = F.coalesce("_before", "_last")
    first = F.greatest(F.col("bucket") - reach, since + step)
    rises = days.select(first.alias("at"), F.lit(1).alias("change"))
    falls = days.select((F.col("bucket") + step).alias("at"), F.lit(-1).alias("change"))
    changes = rises.unionByName(falls).groupBy("at").agg(F.sum("change").alias("change"))
    ordered = Window.orderBy("at")
    counted = changes.select(
        "at", F.sum("change").over(ordered.rowsBetween(Window.unboundedPreceding, 0)).alias("devices"), F.lead("at").over(ordered).alias("until")
    )
    steps = counted.filter("devices > 0").select(F.explode(F.sequence("at", F.col("until") - step, step)).alias("window_start"), "devices")
    return steps.select("window_start", (F.col("window_start") + interval(size)).alias("window_end"), "devices")
