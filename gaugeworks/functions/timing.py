"""Time expressions: spans, trailing bounds, buckets, parsing.

Batch frames carry TIMESTAMP_NTZ and streams carry TIMESTAMP (watermarks need it). The session
time zone is UTC, so both read the same.
"""

from __future__ import annotations

import re
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SPAN = re.compile(r"^\s*(\d+)\s+(second|minute|hour|day|week|month|year)s?\s*$", re.IGNORECASE)


def interval(span: str) -> Column:
    """``"5 minutes"`` as a constant interval."""
    found = _SPAN.match(span)
    if not found:
        raise ValueError(f"not a span: {span!r}")
    size, unit = F.lit(int(found.group(1))), found.group(2).lower()
    if unit == "year":
        return F.make_ym_interval(years=size)
    if unit == "month":
        return F.make_ym_interval(months=size)
    if unit == "week":
        return F.make_dt_interval(days=size * 7)
    if unit == "day":
        return F.make_dt_interval(days=size)
    if unit == "hour":
        return F.make_dt_interval(hours=size)
    if unit == "minute":
        return F.make_dt_interval(mins=size)
    return F.make_dt_interval(secs=size.cast("decimal(18,6)"))


def span_seconds(span: str) -> int:
    """Length of a span of fixed length, in seconds."""
    found = _SPAN.match(span)
    units = {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800}
    if not found or found.group(2).lower() not in units:
        raise ValueError(f"not a span of fixed length: {span!r}")
    return int(found.group(1)) * units[found.group(2).lower()]


def _time_type(df: DataFrame, time_col: str) -> str:
    return df.schema[time_col].dataType.simpleString()


def instant(value: Column | datetime | str, time_type: str = "timestamp_ntz") -> Column:
    """A point in time given by the caller, as a constant of the column's own type."""
    if isinstance(value, Column):
        return value
    text = value.isoformat(sep=" ") if isinstance(value, datetime) else value
    return F.lit(text).cast(time_type)


def newest_part(df: DataFrame, time_col: str = "timestamp") -> DataFrame:
    """The part of a month-partitioned table that holds its newest time; other months are not read."""
    if "yyyymm" not in df.columns or time_col != "timestamp":
        return df
    return df.filter(F.col("yyyymm") == df.agg(F.max("yyyymm")).scalar())


def newest(df: DataFrame, as_of=None, time_col: str = "timestamp") -> Column:
    """``as_of``, or the newest time of the frame as an uncorrelated scalar subquery."""
    if as_of is not None:
        return instant(as_of, _time_type(df, time_col))
    return newest_part(df, time_col).agg(F.max(time_col)).scalar()


def since(df: DataFrame, span: str, as_of=None, time_col: str = "timestamp") -> Column:
    """Lower bound of the trailing span.

    With ``as_of`` given the bound is a constant, so it reaches the Parquet reader as a static
    filter. Without it the subtraction sits inside the subquery: the outer filter then compares the
    bare column with one value, which Spark pushes into the scan when the query runs.
    """
    if as_of is not None:
        return instant(as_of, _time_type(df, time_col)) - interval(span)
    return newest_part(df, time_col).agg(F.max(time_col) - interval(span)).scalar()


def bucket(col: Column | str, unit: str, time_type: str = "timestamp_ntz") -> Column:
    """Start of the minute, hour or day (``date_trunc`` alone returns a zoned timestamp)."""
    if unit not in ("second", "minute", "hour", "day", "month"):
        raise ValueError(f"unknown bucket: {unit!r}")
    return F.date_trunc(unit, col).cast(time_type)


def month_of(col: Column | str) -> Column:
    return F.date_format(col, "yyyyMM")


def day_of(col: Column | str) -> Column:
    return F.date_format(col, "yyyyMMdd")


def seconds_between(start: Column, end: Column) -> Column:
    """Second boundaries crossed between two times (each side floors to its second)."""
    return F.unix_seconds(end.cast("timestamp")) - F.unix_seconds(start.cast("timestamp"))


def from_epoch_ms(col: Column | str, time_type: str = "timestamp_ntz") -> Column:
    return F.timestamp_millis(col).cast(time_type)


def from_iso(col: Column | str, time_type: str = "timestamp_ntz") -> Column:
    """ISO-8601 text to a time cut to whole milliseconds; text that is no time gives NULL."""
    parsed = F.try_to_timestamp(col if isinstance(col, Column) else F.col(col))
    return F.date_trunc("millisecond", parsed).cast(time_type)


def order_key(time_col: str = "timestamp", tie: str = "msg_id") -> Column:
    """Time and number of a row as one decimal that sorts like the pair, nulls first.

    A decimal has a fixed width, so a maximum of it runs as a hash aggregate, which a struct's does not.
    """
    us = F.unix_micros(F.col(time_col).cast("timestamp")).cast("decimal(17,0)")
    number = F.coalesce(F.col(tie).cast("decimal(20,0)"), F.lit("-9223372036854775809").cast("decimal(20,0)"))
    earliest = F.lit("-99999999999999999").cast("decimal(17,0)")
    return (F.coalesce(us, earliest) * F.lit("18446744073709551616").cast("decimal(20,0)") + number).cast("decimal(38,0)")
