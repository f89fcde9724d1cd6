"""The given tables read as telemetry.

``events`` (event_id, ts, user_id, event_type, value, props) becomes the wide events table. Time can
be compressed so that minute-sized windows hold rows; every quantity is a decimal, so sums are exact.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeworks.functions.timing import instant, span_seconds
from gaugeworks.schema import LOCATIONS, METRICS

ORIGIN = "2024-01-01 00:00:00"
COMPRESSION = 60

SOURCE = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("props", T.StringType()),
    ]
)

_DEC = "decimal(12,3)"
_EPOCH = dt.datetime(1970, 1, 1)
_ORIGIN_US = (dt.datetime.fromisoformat(ORIGIN) - _EPOCH) // dt.timedelta(microseconds=1)


def _tick_ms(us: int, compression: int) -> int:
    """Whole milliseconds since the origin, after compression, of a stored time."""
    return (us - _ORIGIN_US) // (1000 * compression)


def _time_sql(compression: int) -> str:
    """The mapped time; Spark's side of ``_tick_ms``."""
    us = "timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)"
    tick = f"cast(floor(({us} - {_ORIGIN_US}) / {1000 * compression}) as bigint)"
    return f"timestampadd(MICROSECOND, {tick} * 1000, timestamp_ntz'{ORIGIN}')"


def _device_sql(number: str) -> str:
    """Four digits at least; longer numbers keep all their digits."""
    text = f"cast({number} as string)"
    return f"concat('device-', lpad({text}, greatest(length({text}), 4), '0'))"


def _site_sql(number: str) -> str:
    names = ", ".join(f"'{p}'" for p in LOCATIONS)
    return f"element_at(array({names}), cast({number} % {len(LOCATIONS)} + 1 as int))"


def _thousandths(whole: str) -> str:
    """A decimal with three places from a whole number of thousandths."""
    return f"cast(({whole}) / 1000D as {_DEC})"


# What each quantity is made of; u is the last digit of the user, k the number in props.
_VALUES = {
    "temperature": f"if(u < 4 or u >= 7, cast(cast(value as decimal(12,2)) * 0.2 + 15 as {_DEC}), null)",
    "pressure": f"if(u >= 4, {_thousandths('1013250 + (k - 50) * 1400')}, null)",
    "humidity": f"if(u < 4 or u >= 7, {_thousandths('30000 + k * 680')}, null)",
    "voltage": _thousandths("3300 - event_id % 90 * 10"),
    "light_intensity": f"if(u >= 7, {_thousandths('500000 + (k - 50) * 8000')}, null)",
    "co2": f"if(u >= 7, {_thousandths('400000 + event_id % 200 * 1000')}, null)",
    "vibration": f"if(u >= 7, {_thousandths('500 + event_id % 20 * 100')}, null)",
    "power_consumption": f"if(u >= 7, {_thousandths('150000 + (k - 50) * 1000')}, null)",
    "signal_strength": _thousandths("-70000 + (k - 50) * 300"),
    "battery_level": _thousandths("100000 - event_id % 1000 * 100"),
}


def _mapped(src: DataFrame, compression: int, time_type: str = "timestamp_ntz") -> DataFrame:
    """Stored events as telemetry. The number in ``props`` is parsed once per row, in its own step."""
    parsed = src.selectExpr("*", "user_id % 10 as u", "cast(get_json_object(props, '$.k') as int) as k")
    return parsed.selectExpr(
        f"cast({_time_sql(compression)} as {time_type}) as timestamp",
        f"{_device_sql('user_id + 1')} as device_id",
        "case when u < 4 then 'temperature-sensor' when u < 7 then 'pressure-sensor' else 'multi-sensor' end as device_type",
        f"{_site_sql('user_id')} as location",
        "case event_type when 'error' then 'CRITICAL' when 'purchase' then 'WARN' when 'signup' then 'ERROR' "
        "else 'OK' end as status",
        "event_id as msg_id",
        *[f"{_VALUES[m]} as {m}" for m in METRICS],
    )


def _source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.schema(SOURCE).parquet(f"{sf_dir}/events.parquet")


def newest_time(spark: SparkSession, sf_dir: str, compression: int = COMPRESSION) -> dt.datetime:
    """Newest time of the telemetry: one pass over the ``ts`` column, one value to the driver."""
    top = _source(spark, sf_dir).agg(F.max("ts")).first()[0]
    tick = _tick_ms((top - _EPOCH) // dt.timedelta(microseconds=1), compression)
    return dt.datetime.fromisoformat(ORIGIN) + dt.timedelta(milliseconds=tick)


def telemetry(
    spark: SparkSession, sf_dir: str, within: str | None = None, as_of=None, compression: int = COMPRESSION
) -> DataFrame:
    """The wide events frame.

    ``within`` and ``as_of`` state that the caller looks at that trailing span only. The bound is
    then also put on the stored ``ts`` column (the mapping is monotone, so it is exact), where the
    Parquet reader can skip row groups.
    """
    src = _source(spark, sf_dir)
    if within is not None:
        src = src.filter(F.col("ts") >= _stored_bound(within, as_of, compression))
    return _mapped(src, compression)


def _stored_bound(within: str, as_of: dt.datetime, compression: int) -> Column:
    """The smallest stored time whose mapped time is not before ``as_of - within``."""
    origin = dt.datetime.fromisoformat(ORIGIN)
    first = as_of - dt.timedelta(seconds=span_seconds(within))
    return instant(origin + (first - origin) * compression)


def telemetry_stream(spark: SparkSession, sf_dir: str, max_files: int | None = None) -> DataFrame:
    """The same rows as a stream, with a zoned time column for watermarks."""
    reader = spark.readStream.schema(SOURCE).option("pathGlobFilter", "events.parquet")
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    src = reader.parquet(sf_dir)
    return _mapped(src, COMPRESSION, "timestamp")


def nested_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings as devices hold them: a map of quantities and a list of injected faults or NULL.

    The fault of a reading follows from its stored event: errors carry a spike, and purchases a
    dropout, on the first quantity the device type reports.
    """
    ev = telemetry(spark, sf_dir)
    entries = F.filter(
        F.array(*[F.struct(F.lit(m).alias("key"), F.col(m).cast("double").alias("value")) for m in METRICS]),
        lambda e: e["value"].isNotNull(),
    )
    first = F.element_at(entries, 1)
    fault = lambda kind, changed: F.array(
        F.struct(
            F.lit(kind).alias("type"), first["key"].alias("metric"),
            first["value"].alias("original"), changed.alias("modified"),
        )
    )
    faults = (
        F.when(F.col("status") == "CRITICAL", fault("spike", first["value"] * 2.0))
        .when(F.col("status") == "WARN", fault("dropout", F.lit(0.0)))
    )
    return ev.select(
        *[c for c in ev.columns if c not in METRICS],
        F.map_from_entries(entries).alias("metrics"),
        faults.alias("anomalies"),
    )


def presence_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Presence messages: a device signs off with every ERROR reading and is online otherwise."""
    ev = telemetry(spark, sf_dir)
    ms = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("timestamp"))
    return ev.select(
        "device_id",
        F.to_json(
            F.struct(
                (F.col("status") != "ERROR").alias("online"),
                F.floor(ms / 1000).cast("long").alias("timestamp"),
            )
        ).alias("message"),
        F.col("msg_id").alias("seq"),
    )


def device_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Device names from ``customer``: customer n names device n."""
    cust = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return cust.selectExpr(
        f"{_device_sql('c_custkey')} as device_id", "c_name as device_name", f"{_site_sql('c_custkey')} as site"
    )


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metric samples (metric, labels, ts, value) drawn from every event.

    The counter runs with the event number and starts again at 0 now and then; the gauges follow
    the stored value and ``props.k``.
    """
    ev = telemetry(spark, sf_dir)
    labels = lambda *pairs: F.create_map(*[x for k, v in pairs for x in (F.lit(k), v)])
    device = ("device", F.col("device_id"))
    running = F.when(F.col("status").isin("OK", "WARN"), 1.0).otherwise(0.0)
    pod = (device, ("phase", F.lit("Running")), ("namespace", F.col("location")))
    series = (
        ("cpu_idle_seconds_total", labels(device), F.col("msg_id") % 997),
        ("memory_available_bytes", labels(device), F.col("battery_level") * 64),
        ("memory_total_bytes", labels(device), F.lit(8192.0)),
        ("pod_status_phase", labels(*pod), running),
    )
    # One branch per metric: a filter on the name leaves only the branches it needs in the plan.
    branches = [
        ev.select(
            F.lit(name).alias("metric"), tags.alias("labels"), F.col("timestamp").alias("ts"),
            value.cast("double").alias("value"),
        )
        for name, tags, value in series
    ]
    return reduce(DataFrame.unionByName, branches)
