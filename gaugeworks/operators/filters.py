"""Row filters, labels and bands."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.functions import bucket, month_of, newest, since
from gaugeworks.schema import ALERT_RULES, RANGE_RULES, THRESHOLDS

Rule = tuple[str, str, float, str]


def not_before(ev: DataFrame, bound: Column, time_col: str = "timestamp") -> DataFrame:
    """Rows from ``bound`` on; on a month-partitioned table the bound is put on ``yyyymm`` too."""
    rows = ev.filter(F.col(time_col) >= bound)
    if time_col == "timestamp" and "yyyymm" in ev.columns:
        rows = rows.filter(F.col("yyyymm").cast("string") >= month_of(bound))
    return rows


def before(ev: DataFrame, bound: Column, time_col: str = "timestamp") -> DataFrame:
    """Rows older than ``bound``, with the same bound on the months."""
    rows = ev.filter(F.col(time_col) < bound)
    if time_col == "timestamp" and "yyyymm" in ev.columns:
        rows = rows.filter(F.col("yyyymm").cast("string") <= month_of(bound))
    return rows


def trailing(ev: DataFrame, span: str, as_of=None) -> DataFrame:
    """Rows of the last ``span`` before ``as_of`` (lower bound only, newer rows stay in).

    On a month-partitioned table the bound is also put on ``yyyymm``, so that older months are left
    out when the plan is made or, if the bound is only known then, when the query starts.
    """
    return not_before(ev, since(ev, span, as_of))


def status_in(ev: DataFrame, statuses: Iterable[str]) -> DataFrame:
    return ev.filter(F.col("status").isin(*statuses))


def _hits(rule: Rule) -> Column:
    metric, sign, limit, _ = rule
    return F.col(metric) > F.lit(limit) if sign == ">" else F.col(metric) < F.lit(limit)


def label_of(rules: Sequence[Rule], default: str) -> Column:
    """Label of the first rule that holds; a missing quantity matches no rule."""
    chain = F
    for rule in rules:
        chain = chain.when(_hits(rule), F.lit(rule[3]))
    return chain.otherwise(F.lit(default))


def any_rule(rules: Sequence[Rule]) -> Column:
    return reduce(lambda a, b: a | b, [_hits(r) for r in rules])


def classify_alerts(ev: DataFrame, statuses: Sequence[str] = ("WARN", "CRITICAL"), newest_first: bool = True) -> DataFrame:
    """Rows with an alert status and the reason, newest first."""
    alerts = status_in(ev, statuses).select(
        "timestamp", "device_id", "device_type", "location", "temperature", "pressure", "status",
        label_of(ALERT_RULES, "normal").alias("anomaly_type"), "msg_id",
    )
    if newest_first:
        return alerts.orderBy(F.desc("timestamp"), F.desc("msg_id"))
    return alerts


def recent_anomalies(
    ev: DataFrame, span: str = "1 hour", limit: int = 50, as_of=None, rules: Sequence[Rule] = RANGE_RULES
) -> DataFrame:
    """The newest readings outside their range, with the reason."""
    out = trailing(ev, span, as_of).filter(any_rule(rules))
    return (
        out.select(
            "timestamp", "device_id", "location", "temperature", "pressure", "humidity", "battery_level",
            "status", label_of(rules, "Unknown").alias("anomaly_type"), "msg_id",
        )
        .orderBy(F.desc("timestamp"), F.desc("msg_id"))
        .limit(limit)
    )


def anomaly_points(
    ev: DataFrame, lo: float = 10.0, hi: float = 80.0, span: str = "1 hour", as_of=None, metric: str = "temperature"
) -> DataFrame:
    """Raw out-of-range values, by minute and device."""
    out = trailing(ev, span, as_of).filter((F.col(metric) > hi) | (F.col(metric) < lo))
    in_order = out.orderBy("timestamp", "msg_id")
    return in_order.select(bucket("timestamp", "minute").alias("minute"), "device_id", metric)


def distinct_devices(ev: DataFrame, span: str = "1 day", as_of=None) -> DataFrame:
    return trailing(ev, span, as_of).select("device_id").distinct()


def assign_status(ev: DataFrame, thresholds=THRESHOLDS, col: str = "status") -> DataFrame:
    """OK, WARN or CRITICAL from the limits of every quantity; the worst one counts.

    High-side limits are crossed upwards, low-side limits downwards.
    """
    severity = []
    for metric, _, warn, critical, direction in thresholds:
        if metric not in ev.columns:
            continue
        value = F.col(metric)
        beyond = (lambda limit: value >= limit) if direction == "high" else (lambda limit: value <= limit)
        severity.append(F.when(beyond(critical), 2).when(beyond(warn), 1).otherwise(0))
    worst = F.greatest(*severity) if len(severity) > 1 else severity[0]
    return ev.withColumn(col, F.when(worst == 2, "CRITICAL").when(worst == 1, "WARN").otherwise("OK"))


def band_of(value: Column, steps: Sequence[tuple[float | None, str]]) -> Column:
    """Label of the highest step the value reaches; the first step has no lower limit."""
    chain = F
    for start, label in reversed(steps[1:]):
        chain = chain.when(value >= F.lit(start), F.lit(label))
    return F.when(value.isNull(), F.lit(None).cast("string")).otherwise(chain.otherwise(F.lit(steps[0][1])))


def band(df: DataFrame, col: str, steps: Sequence[tuple[float | None, str]], out: str = "band") -> DataFrame:
    return df.withColumn(out, band_of(F.col(col), steps))


# Tints of the device table, as (sign, limit, label), first match wins.
TEMPERATURE_TINTS = ((">", 35, "red"), (">", 30, "orange"), ("<", 15, "blue"))
BATTERY_TINTS = ((">", 80, "green"), (">", 50, "lightGreen"), (">", 20, "orange"))
LAST_SEEN_TINTS = (("<", 5, "green"), ("<", 15, "yellow"))


def tint_of(value: Column, steps, default: str) -> Column:
    """First-match label with strict limits on either side."""
    chain = F.when(value.isNull(), F.lit(None).cast("string"))
    for sign, limit, label in steps:
        chain = chain.when(value > limit if sign == ">" else value < limit, F.lit(label))
    return chain.otherwise(F.lit(default))


def device_tints(latest: DataFrame, as_of=None) -> DataFrame:
    """Colours of the device table: temperature, battery level, minutes since last seen."""
    now = newest(latest, as_of, "last_seen")
    idle = F.timestamp_diff("MINUTE", F.col("last_seen"), now)
    return latest.select(
        "device_id",
        tint_of(F.col("temperature"), TEMPERATURE_TINTS, "white").alias("temperature_tint"),
        tint_of(F.col("battery_level"), BATTERY_TINTS, "red").alias("battery_tint"),
        tint_of(idle, LAST_SEEN_TINTS, "red").alias("last_seen_tint"),
    )


def drop_expired(messages: DataFrame, as_of=None, expiry_col: str = "expiry_seconds") -> DataFrame:
    """Messages whose own life time has not passed; no life time means they stay."""
    now = newest(messages, as_of)
    expires = F.timestamp_add("SECOND", F.col(expiry_col).cast("long"), F.col("timestamp"))
    return messages.filter(F.col(expiry_col).isNull() | (expires > now))
