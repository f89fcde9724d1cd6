"""Trailing-window aggregates.

Nearly all of them are one specification of ``summarise``: a time bound that reaches the scan, one
partial and one final aggregate, and, where rows are ranked, a top-k instead of a full sort.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.functions import (
    bucket, mean, newest, percent, readable_quantity, rounded, since, with_default,
)
from gaugeworks.functions.timing import interval, order_key, span_seconds
from gaugeworks.operators.filters import any_rule, not_before, trailing
from gaugeworks.schema import RANGE_RULES

ALERT = ("WARN", "CRITICAL")


def between(value: int, low: int, high: int, name: str) -> int:
    if not low <= value <= high:
        raise ValueError(f"{name} must lie in {low}..{high}, got {value}")
    return value


def events() -> Column:
    return F.count(F.lit(1))


def having_status(*statuses: str) -> Column:
    return F.count_if(F.col("status").isin(*statuses))


def devices(approx: bool = False) -> Column:
    return F.approx_count_distinct("device_id") if approx else F.count_distinct("device_id")


def low(metric: str, digits: int = 2) -> Column:
    return rounded(F.min(metric), digits)


def high(metric: str, digits: int = 2) -> Column:
    return rounded(F.max(metric), digits)


def avg(metric: str, digits: int = 2) -> Column:
    return rounded(mean(metric), digits)


def summarise(
    ev: DataFrame,
    measures: dict[str, Column],
    span: str | None = None,
    keys: Sequence[str] = (),
    every: str | None = None,
    bucket_name: str | None = None,
    where: Column | None = None,
    order: Sequence[Column | str] = (),
    limit: int | None = None,
    as_of=None,
) -> DataFrame:
    """Filter to the span, group by bucket and keys, aggregate, order, cut."""
    rows = ev if span is None else trailing(ev, span, as_of)
    if where is not None:
        rows = rows.filter(where)
    groups = [F.col(k) for k in keys]
    if every is not None:
        groups.insert(0, bucket("timestamp", every).alias(bucket_name or every))
    out = rows.groupBy(*groups).agg(*[m.alias(n) for n, m in measures.items()])
    if order:
        out = out.orderBy(*order)
    return out if limit is None else out.limit(limit)


# -- cached dashboard queries ---------------------------------------------------------------------


def device_stats(ev: DataFrame, span: str = "5 minutes", as_of=None) -> DataFrame:
    return summarise(
        ev,
        {
            "message_count": events(),
            "avg_temperature": avg("temperature"),
            "min_temperature": low("temperature"),
            "max_temperature": high("temperature"),
            "avg_pressure": avg("pressure"),
            "warning_count": having_status("WARN"),
        },
        span, keys=["device_id"], order=["device_id"], as_of=as_of,
    )


def timeseries(ev: DataFrame, span: str = "1 hour", every: str = "minute", as_of=None) -> DataFrame:
    return summarise(
        ev,
        {"avg_temperature": avg("temperature"), "avg_pressure": avg("pressure"), "event_count": events()},
        span, every=every, order=[every], as_of=as_of,
    )


def system_health(ev: DataFrame, span: str = "5 minutes", as_of=None, approx: bool = False) -> DataFrame:
    """One row; the score of an empty window is 0, not NULL."""
    out = summarise(
        ev,
        {
            "total_events": events(),
            "ok_count": having_status("OK"),
            "warn_count": having_status("WARN"),
            "active_devices": devices(approx),
            "avg_temperature": avg("temperature"),
            "avg_pressure": avg("pressure"),
        },
        span, as_of=as_of,
    )
    score = F.col("ok_count") / F.greatest(F.col("total_events"), F.lit(1)) * 100
    return out.withColumn("health_score", rounded(score, 1))


def hourly_stats(ev: DataFrame, span: str = "24 hours", as_of=None, approx: bool = False) -> DataFrame:
    return summarise(
        ev,
        {
            "events": events(), "avg_temperature": avg("temperature"),
            "avg_pressure": avg("pressure"), "active_devices": devices(approx),
        },
        span, every="hour", order=["hour"], as_of=as_of,
    )


# -- parameterised history queries ----------------------------------------------------------------


def temperature_timeseries(ev: DataFrame, minutes: int = 60, as_of=None) -> DataFrame:
    between(minutes, 5, 1440, "minutes")
    return summarise(
        ev,
        {"avg_temp": avg("temperature"), "min_temp": low("temperature"), "max_temp": high("temperature")},
        f"{minutes} minutes", every="minute", where=F.col("temperature").isNotNull(), order=["minute"], as_of=as_of,
    )


def hourly_summary(ev: DataFrame, hours: int = 24, as_of=None, warn_statuses: Sequence[str] = ALERT) -> DataFrame:
    between(hours, 1, 168, "hours")
    return summarise(
        ev,
        {
            "events": events(), "avg_temp": avg("temperature"), "max_temp": high("temperature"),
            "min_temp": low("temperature"), "avg_pressure": avg("pressure"),
            "warnings": having_status(*warn_statuses),
        },
        f"{hours} hours", every="hour", order=["hour"], as_of=as_of,
    )


def device_leaderboard(
    ev: DataFrame, span: str = "1 hour", limit: int = 20, as_of=None, warn_statuses: Sequence[str] = ALERT
) -> DataFrame:
    """The devices with most events. Rows are combined by device, type and place, whose texts a hash aggregate can only
    group by; the few rows that a moved device leaves are put together by a window."""
    between(limit, 1, 100, "limit")
    metrics = ("temperature", "pressure", "humidity")
    rows = trailing(ev, span, as_of).withColumn("_key", order_key())
    placed = rows.groupBy("device_id", "device_type", "location").agg(
        events().alias("events"), having_status(*warn_statuses).alias("warnings"), F.max("timestamp").alias("last_seen"),
        F.max("_key").alias("_key"), F.max_by("battery_level", "_key").alias("battery_level"),
        *[F.sum(m).alias(f"sum_{m}") for m in metrics], *[F.count(m).alias(f"n_{m}") for m in metrics],
    )
    device = Window.partitionBy("device_id")
    mean_of = lambda m: rounded(F.try_divide(F.sum(f"sum_{m}").over(device).cast("double"), F.sum(f"n_{m}").over(device)), 2)
    out = placed.select(
        "device_id",
        with_default(F.min("device_type").over(device), "unknown").alias("device_type"),
        with_default(F.min("location").over(device), "unknown").alias("location"),
        F.sum("events").over(device).alias("total_events"),
        *[mean_of(m).alias(f"avg_{m}") for m in metrics],
        rounded("battery_level", 1).alias("battery_level"),
        F.sum("warnings").over(device).alias("warnings"),
        F.max("last_seen").over(device).alias("last_seen"),
        F.row_number().over(device.orderBy(F.desc("_key"))).alias("_nth"),
    )
    return out.filter("_nth = 1").drop("_nth").orderBy(F.desc("total_events"), "device_id").limit(limit)


def events_per_minute(ev: DataFrame, minutes: int = 60, as_of=None) -> DataFrame:
    return events_per_bucket(ev, f"{between(minutes, 5, 1440, 'minutes')} minutes", "minute", as_of)


def events_per_bucket(ev: DataFrame, span: str, every: str, as_of=None) -> DataFrame:
    return summarise(ev, {"events": events()}, span, every=every, order=[every], as_of=as_of)


# -- panels ---------------------------------------------------------------------------------------


def metric_by_device(ev: DataFrame, metric: str, span: str = "1 hour", as_of=None) -> DataFrame:
    return summarise(
        ev, {metric: avg(metric, 3)}, span, keys=["device_id"], every="minute", order=["minute", "device_id"], as_of=as_of
    )


def status_distribution(ev: DataFrame, span: str = "5 minutes", as_of=None) -> DataFrame:
    return summarise(ev, {"count": events()}, span, keys=["status"], as_of=as_of)


def status_over_time(ev: DataFrame, span: str = "1 hour", as_of=None, statuses: Sequence[str] | None = None) -> DataFrame:
    """Counts per minute and status; with ``statuses`` given, one column per status instead."""
    if statuses is not None:
        return summarise(
            ev, {s.lower(): having_status(s) for s in statuses}, span, every="minute", order=["minute"], as_of=as_of
        )
    return summarise(ev, {"count": events()}, span, keys=["status"], every="minute", order=["minute", "status"], as_of=as_of)


def warnings_by_device(
    ev: DataFrame, span: str = "5 minutes", limit: int = 10, keep_zeros: bool = True, as_of=None
) -> DataFrame:
    """Most warnings first; ``keep_zeros`` ranks devices without a warning too."""
    return summarise(
        ev,
        {"warnings": having_status("WARN")},
        span, keys=["device_id"], where=None if keep_zeros else F.col("status") == "WARN",
        order=[F.desc("warnings"), "device_id"], limit=limit, as_of=as_of,
    )


def active_devices(ev: DataFrame, span: str | None = "5 minutes", as_of=None, approx: bool = False) -> DataFrame:
    return summarise(ev, {"devices": devices(approx)}, span, as_of=as_of)


def total_events(ev: DataFrame, span: str | None = None, as_of=None) -> DataFrame:
    return summarise(ev, {"events": events()}, span, as_of=as_of).withColumn("readable", readable_quantity("events"))


def metric_average(ev: DataFrame, metric: str, span: str = "15 minutes", as_of=None, digits: int = 1) -> DataFrame:
    return summarise(ev, {f"avg_{metric}": avg(metric, digits)}, span, as_of=as_of)


def throughput(ev: DataFrame, span: str = "1 minute", as_of=None) -> DataFrame:
    """Events per second over a trailing span of known length."""
    return summarise(ev, {"eps": rounded(events() / F.lit(span_seconds(span)), 2)}, span, as_of=as_of)


def throughput_since_start(ev: DataFrame, start, as_of=None) -> DataFrame:
    """Events per second since ``start``; less than a second counts as one."""
    began = newest(ev, start)
    elapsed = F.unix_seconds(newest(ev, as_of).cast("timestamp")) - F.unix_seconds(began.cast("timestamp"))
    counted = not_before(ev, began).agg(events().alias("events"))
    return counted.select(rounded(F.col("events") / F.greatest(elapsed, F.lit(1)), 2).alias("msg_per_sec"))


def status_rate(ev: DataFrame, status: str, span: str = "5 minutes", as_of=None) -> DataFrame:
    """Share of a status in percent; NULL when nothing arrived."""
    return summarise(ev, {f"{status.lower()}_pct": percent(having_status(status), events())}, span, as_of=as_of)


def device_metric_rank(
    ev: DataFrame, metric: str, span: str, ascending: bool = True, limit: int | None = None, as_of=None
) -> DataFrame:
    by = F.asc_nulls_last(metric) if ascending else F.desc_nulls_last(metric)
    return summarise(ev, {metric: avg(metric, 1)}, span, keys=["device_id"], order=[by, "device_id"], limit=limit, as_of=as_of)


def busiest_devices(ev: DataFrame, span: str = "1 hour", limit: int = 20, as_of=None) -> DataFrame:
    return summarise(
        ev, {"events": events()}, span, keys=["device_id"], order=[F.desc("events"), "device_id"], limit=limit, as_of=as_of
    )


def device_table(ev: DataFrame, span: str = "1 hour", as_of=None) -> DataFrame:
    return summarise(
        ev,
        {
            "events": events(), "avg_temp": avg("temperature", 1), "avg_pressure": avg("pressure", 1),
            "avg_humidity": avg("humidity", 1), "battery": avg("battery_level", 1), "last_seen": F.max("timestamp"),
        },
        span, keys=["device_id", "location"], order=[F.desc("events"), "device_id"], as_of=as_of,
    )


def uptime_heatmap(ev: DataFrame, span: str = "24 hours", as_of=None) -> DataFrame:
    return summarise(
        ev, {"events": events()}, span, keys=["device_id"], every="hour", order=["hour", "device_id"], as_of=as_of
    )


def hourly_trend(ev: DataFrame, span: str = "24 hours", as_of=None) -> DataFrame:
    return summarise(
        ev,
        {"events": events(), "warnings": having_status("WARN"), "errors": having_status("ERROR")},
        span, every="hour", order=["hour"], as_of=as_of,
    )


def anomaly_count(ev: DataFrame, span: str = "1 hour", as_of=None, rules=RANGE_RULES[:5]) -> DataFrame:
    return summarise(ev, {"anomalies": events()}, span, where=any_rule(rules), as_of=as_of)


def anomaly_series(ev: DataFrame, span: str = "1 hour", lo: float = 10.0, hi: float = 80.0, as_of=None) -> DataFrame:
    out_of_range = (F.col("temperature") > hi) | (F.col("temperature") < lo)
    return summarise(
        ev, {"temp": avg("temperature", 3)}, span, keys=["device_id"], every="minute",
        where=out_of_range, order=["minute", "device_id"], as_of=as_of,
    )


def low_battery_devices(ev: DataFrame, span: str = "15 minutes", below: float = 20.0, as_of=None) -> DataFrame:
    return summarise(ev, {"low_battery_devices": devices()}, span, where=F.col("battery_level") < below, as_of=as_of)


def quality_by_location(ev: DataFrame, span: str = "1 hour", as_of=None, approx: bool = False) -> DataFrame:
    return summarise(
        ev,
        {
            "total_events": events(),
            "ok_events": having_status("OK"),
            "warnings": having_status("WARN"),
            "errors": having_status("ERROR"),
            "ok_rate": percent(having_status("OK"), events(), 1),
            "avg_temp": avg("temperature", 1),
            "temp_stddev": rounded(F.stddev_pop(F.col("temperature").cast("double")), 2),
            "devices": devices(approx),
        },
        span, keys=["location"], order=[F.desc("total_events"), "location"], as_of=as_of,
    )


# -- combinations ---------------------------------------------------------------------------------


def hot_metrics(ev: DataFrame, as_of=None, approx: bool = False) -> DataFrame:
    """The live numbers of the last 1, 5 and 15 minutes from one pass over 15 minutes of rows."""
    rows = trailing(ev, "15 minutes", as_of)
    if as_of is None:
        five, one = since(ev, "5 minutes"), since(ev, "1 minute")
    else:
        now = newest(ev, as_of)
        five, one = now - interval("5 minutes"), now - interval("1 minute")
    in_five = F.col("timestamp") >= five
    in_one = F.col("timestamp") >= one
    out = rows.agg(
        rounded(mean(F.when(in_five, F.col("temperature"))), 2).alias("avg_temperature_5m"),
        rounded(mean(F.when(in_five, F.col("pressure"))), 2).alias("avg_pressure_5m"),
        high("temperature").alias("max_temperature_15m"),
        low("temperature").alias("min_temperature_15m"),
        F.count_if(in_one).alias("events_1m"),
        devices(approx).alias("active_devices"),
        having_status(*ALERT).alias("warning_count"),
        F.count_if(any_rule(RANGE_RULES[:5])).alias("anomaly_count"),
        rounded(F.count_if(in_one) / F.lit(60), 2).alias("msg_per_sec"),
    )
    return out.select(*[with_default(c, 0).alias(c) for c in out.columns])


HOT, SERIES, HOURS = "hot_metrics", "temperature_timeseries", "hourly_stats"


def dashboard_bundle(ev: DataFrame, as_of=None) -> DataFrame:
    """Hot metrics, the temperature series and the hourly summary in long form: section, bucket, measure, value.

    One pass over a day of rows. Each is counted once, into a partial of its minute and of the windows it lies in (the last
    hour, 15, 5 and 1 minutes); inside the 15 minutes by device too, whose number is wanted. Those partials, not the
    rows, are then copied to the sections they belong to. A section without rows has no buckets, the hot metrics are 0.
    """
    now = newest(ev, as_of)
    since_ = lambda span: F.col("timestamp") >= now - interval(span)
    flags = {f"in_{n}": since_(f"{n} minutes") for n in (60, 15, 5, 1)}
    rows = trailing(ev, "24 hours", as_of).withColumns(flags)
    partials = rows.groupBy(
        bucket("timestamp", "minute").alias("minute"), *flags, F.when(F.col("in_15"), F.col("device_id")).alias("device")
    ).agg(
        events().alias("events"), having_status(*ALERT).alias("warnings"), F.count_if(any_rule(RANGE_RULES[:5])).alias("anomalies"),
        F.sum("temperature").alias("sum_t"), F.count("temperature").alias("n_t"), F.min("temperature").alias("min_t"),
        F.max("temperature").alias("max_t"), F.sum("pressure").alias("sum_p"), F.count("pressure").alias("n_p"),
    )
    nothing = F.lit(None).cast("timestamp_ntz")
    place = lambda name, at: F.struct(F.lit(name).alias("section"), at.alias("bucket"))
    own = F.array(
        place(HOURS, bucket("minute", "hour")),
        F.when(F.col("in_60") & (F.col("n_t") > 0), place(SERIES, F.col("minute"))), F.when(F.col("in_15"), place(HOT, nothing)),
    )
    copies = partials.withColumn("at", F.explode(F.array_compact(own)))
    # the hot metrics are there even without a row
    seed = ev.sparkSession.range(1).select(place(HOT, nothing).alias("at"))
    copies = copies.unionByName(seed, allowMissingColumns=True)
    five = lambda c: F.sum(F.when(F.col("in_5"), F.col(c)))
    share = lambda total, n, name: rounded(F.try_divide(total.cast("double"), n), 2).alias(name)
    one = F.coalesce(F.sum(F.when(F.col("in_1"), F.col("events"))), F.lit(0))
    out = copies.groupBy("at.section", "at.bucket").agg(
        share(five("sum_t"), five("n_t"), "avg_temperature_5m"), share(five("sum_p"), five("n_p"), "avg_pressure_5m"),
        share(F.sum("sum_t"), F.sum("n_t"), "avg_temp"), share(F.sum("sum_p"), F.sum("n_p"), "avg_pressure"),
        high("max_t").alias("max_temp"), low("min_t").alias("min_temp"), F.sum("events").alias("events"), F.sum("warnings").alias("warnings"),
        F.sum("anomalies").alias("anomalies"), F.count_distinct("device").alias("devices"), one.alias("events_1m"),
        rounded(one / F.lit(60), 2).alias("msg_per_sec"),
    )
    measures = {
        HOT: {
            "avg_temperature_5m": "avg_temperature_5m", "avg_pressure_5m": "avg_pressure_5m", "max_temperature_15m": "max_temp",
            "min_temperature_15m": "min_temp", "events_1m": "events_1m", "active_devices": "devices", "warning_count": "warnings",
            "anomaly_count": "anomalies", "msg_per_sec": "msg_per_sec",
        },
        SERIES: {m: m for m in ("avg_temp", "min_temp", "max_temp")},
        HOURS: {m: m for m in ("events", "avg_temp", "max_temp", "min_temp", "avg_pressure", "warnings")},
    }
    listed = F
    for section, chosen in measures.items():
        value = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if section == HOT else F.col(c).cast("double")  # noqa: B023, E731
        pairs = F.array(*[F.struct(F.lit(n).alias("measure"), value(c).alias("value")) for n, c in chosen.items()])
        listed = listed.when(F.col("section") == section, pairs)
    return out.select("section", "bucket", F.inline(listed.otherwise(F.array())))
