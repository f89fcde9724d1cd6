"""Per-device state: latest readings, staleness, presence, metadata, the replay buffer."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeworks.functions import bucket, from_epoch_ms, newest, seconds_between, since
from gaugeworks.functions.timing import interval, order_key, span_seconds
from gaugeworks.operators.filters import band_of, trailing
from gaugeworks.operators.summaries import active_devices
from gaugeworks.schema import METRICS, PRESENCE
from gaugeworks.session import fresh_path


def newest_row(columns: Sequence[str], time_col: str = "timestamp", tie: str = "msg_id") -> Column:
    """The newest row of a group as one struct, for streams and small frames; Spark runs it as a sort aggregate."""
    rest = [c for c in columns if c not in (time_col, tie)]
    return F.max(F.struct(time_col, tie, *rest))


KEY = "_newest"


def _is_text(df: DataFrame, c: str) -> bool:
    return not isinstance(df.schema[c].dataType, (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType))


def latest_per(
    ev: DataFrame, keys: Sequence[str], columns: Sequence[str], counts: dict[str, Column] | None = None,
    time_col: str = "timestamp", tie: str = "msg_id",
) -> DataFrame:
    """Newest row per key, with counts beside it; equal times are settled by the message number.

    All rows go through one hash aggregate with map-side combine and are never sorted: its buffers hold fixed-width
    values only, so columns that are texts (a status) are grouped by instead. What is left, a row for each key and text that
    occurs with it, is cut to the newest by a window.
    """
    counts = counts or {}
    texts = [c for c in columns if _is_text(ev, c)]
    fixed = [c for c in columns if c not in texts]
    grouped = ev.withColumn(KEY, order_key(time_col, tie)).groupBy(*keys, *texts).agg(
        F.max(KEY).alias(KEY), *[F.max_by(c, KEY).alias(c) for c in fixed], *[c.alias(n) for n, c in counts.items()]
    )
    if not texts:
        return grouped.select(*keys, *columns, *counts)
    whole = Window.partitionBy(*keys)
    nth = F.row_number().over(whole.orderBy(F.desc(KEY), *[F.desc_nulls_last(c) for c in texts]))
    placed = grouped.withColumns({"_nth": nth, **{n: F.sum(n).over(whole) for n in counts}})
    return placed.filter(F.col("_nth") == 1).select(*keys, *columns, *counts)


def latest_newest_first(
    ev: DataFrame, wanted: DataFrame, columns: Sequence[str], part: str = "yyyymm", parts: Sequence[str] | None = None
) -> DataFrame:
    """The newest row of each device in ``wanted`` (device_id), looked for from the newest folder back.

    Each folder is searched for the devices not found yet, and the search ends when none is left, so history is read
    only as far as the longest silent device asks for. Folders must follow each other in time. ``parts`` are their
    values if they are known. What has been found is kept in the shared folder between the steps.
    """
    spark = ev.sparkSession
    values = sorted((r[0] for r in ev.select(F.col(part).cast("string")).distinct().collect()) if parts is None else parts, reverse=True)
    left = wanted.select("device_id").distinct()
    found = None
    for value in values:
        if value is None:
            continue
        rows = ev.filter(F.col(part).cast("string") == value).join(left, "device_id", "left_semi")
        path = fresh_path(spark, "newest")
        latest_per(rows, ["device_id"], columns).write.parquet(path)
        here = spark.read.parquet(path)
        found = here if found is None else found.unionByName(here)
        ahead = fresh_path(spark, "wanted")
        left.join(here.select("device_id"), "device_id", "left_anti").write.parquet(ahead)
        left = spark.read.parquet(ahead)
        if left.isEmpty():
            break
    return latest_per(ev.limit(0), ["device_id"], columns) if found is None else found


def latest_events(ev: DataFrame, span: str = "5 minutes", as_of=None) -> DataFrame:
    out = latest_per(
        trailing(ev, span, as_of), ["device_id"], ["temperature", "pressure", "status", "timestamp"]
    )
    return out.withColumnRenamed("timestamp", "last_seen").orderBy("device_id")


def device_status(ev: DataFrame, span: str = "1 hour", as_of=None) -> DataFrame:
    out = latest_per(
        trailing(ev, span, as_of),
        ["device_id", "device_type", "location"],
        ["temperature", "pressure", "humidity", "battery_level", "status", "timestamp"],
        {"total_events": F.count(F.lit(1))},
    )
    return out.withColumnsRenamed(
        {
            "temperature": "last_temperature", "pressure": "last_pressure", "humidity": "last_humidity",
            "battery_level": "last_battery", "status": "last_status", "timestamp": "last_seen",
        }
    )


def latest_reading(ev: DataFrame, device_id: str | None = None, span: str | None = None, as_of=None) -> DataFrame:
    """Every quantity of the newest reading: of one device (no row if unknown) or of each."""
    rows = ev if span is None else trailing(ev, span, as_of)
    if device_id is not None:
        rows = rows.filter(F.col("device_id") == device_id)
    return latest_per(rows, ["device_id"], ["timestamp", "status", "msg_id", *METRICS])


def last_seen(ev: DataFrame, span: str, as_of=None) -> DataFrame:
    """Newest time per device: one partial and one final hash aggregate, one row per device."""
    return trailing(ev, span, as_of).groupBy("device_id").agg(F.max("timestamp").alias("last_seen"))


def stale_device_count(ev: DataFrame, recent: str = "5 minutes", span: str = "1 hour", as_of=None) -> DataFrame:
    """Devices of the span minus devices of the recent part, from one scan and without a join."""
    seen = last_seen(ev, span, as_of)
    quiet = F.col("last_seen") < since(ev, recent, as_of)
    return seen.agg(F.count_if(quiet).alias("stale_devices"))


def stale_devices(ev: DataFrame, recent: str = "5 minutes", span: str = "1 hour", as_of=None) -> DataFrame:
    """Which devices went quiet, and for how long."""
    seen = last_seen(ev, span, as_of)
    age = seconds_between(F.col("last_seen"), newest(ev, as_of))
    return seen.filter(F.col("last_seen") < since(ev, recent, as_of)).select(
        "device_id", "last_seen", age.alias("age_seconds"), band_of(age / 60, ((None, "green"), (5, "yellow"), (15, "red"))).alias("band")
    )


def with_device_metadata(df: DataFrame, meta: DataFrame, key: str = "device_id") -> DataFrame:
    """Dictionary lookup: unknown devices keep their row, with NULL metadata.

    No hint is given. The dictionary grows with the fleet, so Spark decides from its measured size
    whether to broadcast it; beyond the threshold it becomes a sort-merge join, where adaptive
    execution splits a hot device's rows.
    """
    return df.join(meta, key, "left")


def device_presence(notices: DataFrame, col: str = "message", tie: str = "seq") -> DataFrame:
    """Latest online/offline state per device.

    A notice without its own time (the broker sends it when a device is lost) ranks by arrival.
    """
    read = notices.select("device_id", F.col(tie).alias("seq"), F.inline(F.array(F.from_json(col, PRESENCE))))
    parsed = read.select("device_id", "seq", "online", from_epoch_ms("timestamp").alias("at"))
    # the number of a notice and its state as one whole number: its maximum runs as a hash aggregate
    ranked = F.col("seq").cast("decimal(20,0)") * 3 + F.when(F.col("online"), 2).when(~F.col("online"), 1).otherwise(0)
    out = parsed.groupBy("device_id").agg(F.max(ranked).alias("n"), F.max("at").alias("last_notice"))
    state = F.pmod("n", F.lit(3))
    return out.select("device_id", F.when(state > 0, state == 2).alias("online"), "last_notice")


def _newest_holding(ev: DataFrame, key: Column, n: int) -> Column:
    """The newest ``key`` from which at least ``n`` rows follow, or the oldest key there is.

    One row per month or minute of history goes through the running sum, so even decades are a small
    sort.
    """
    counts = ev.groupBy(key.alias("_key")).agg(F.count(F.lit(1)).alias("_rows"))
    running = F.sum("_rows").over(Window.orderBy(F.desc("_key")))
    enough = F.max(F.when(F.col("_running") >= n, F.col("_key")))
    return counts.withColumn("_running", running).agg(F.coalesce(enough, F.min("_key"))).scalar()


def replay_buffer(ev: DataFrame, n: int = 10_000) -> DataFrame:
    """The last ``n`` events, newest first.

    A plain top-n hands up to n rows of every task to one reducer. Counting rows per minute first
    (one column, partial aggregation) finds the newest minute from which at least n rows follow; the
    real read then starts there, and the bound is pushed into the scan. On a month-partitioned table
    row counts per month, which need no column, leave out the older months before that.
    """
    if "yyyymm" in ev.columns:
        ev = ev.filter(F.col("yyyymm") >= _newest_holding(ev, F.col("yyyymm"), n))
    start = _newest_holding(ev, bucket("timestamp", "minute"), n)
    return ev.filter(F.col("timestamp") >= start).orderBy(F.desc("timestamp"), F.desc("msg_id")).limit(n)


def live_stats(ev: DataFrame, span: str = "5 minutes", buffer: int = 10_000, as_of=None) -> DataFrame:
    """Active devices and how full the replay buffer is (its length never passes ``buffer``)."""
    held = F.least(ev.agg(F.count(F.lit(1))).scalar(), F.lit(buffer).cast("long"))
    return active_devices(ev, span, as_of).select(
        F.col("devices").alias("active_devices"), held.alias("stream_length")
    )


def idle_filter(latest: DataFrame, ttl: str, as_of=None, time_col: str = "last_seen") -> DataFrame:
    """Latest-state rows that have not expired: idle for less than ``ttl``."""
    span_seconds(ttl)
    return latest.filter(F.col(time_col) > newest(latest, as_of, time_col) - interval(ttl))
