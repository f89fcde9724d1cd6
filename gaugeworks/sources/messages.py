"""Device messages: JSON text in, typed rows out, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeworks.functions import from_epoch_ms, from_iso
from gaugeworks.schema import ALT_MESSAGE, HEADER, MESSAGE, METRICS

_CORRUPT = "_rejected"


def _parsed_once(document: Column) -> Column:
    """The fields of a parsed document as columns.

    A generator, unlike a struct, is not repeated by the optimizer: filters and further columns on
    the fields read its output, so a text is parsed once however often its fields are used.
    """
    return F.inline(F.array(document))


def parse_messages(df: DataFrame, col: str = "message", time_type: str = "timestamp_ntz") -> DataFrame:
    """Flat JSON readings to typed columns; text that does not parse is kept in ``rejected``.

    A reading without a device or a usable time is rejected too: no later step could place it.
    """
    schema = T.StructType(MESSAGE.fields + [T.StructField(_CORRUPT, T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT}
    parsed = df.select(F.col(col).alias("_text"), _parsed_once(F.from_json(col, schema, options)))
    parsed = parsed.withColumn("timestamp", from_iso("timestamp", time_type))
    bad = F.col(_CORRUPT).isNotNull() | F.col("timestamp").isNull() | F.col("device_id").isNull()
    return parsed.select(
        *[F.when(~bad, F.col(c)).alias(c) for c in (*HEADER, *METRICS)],
        F.when(bad, F.col("_text")).alias("rejected"),
    )


def rejected_messages(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("rejected").isNotNull()).select("rejected")


def parse_alt_messages(df: DataFrame, col: str = "message", time_type: str = "timestamp_ntz") -> DataFrame:
    """Messages of the load-test clients in the shape of the events table; padding is dropped.

    Text that does not parse, and messages without a device or a time, are kept in ``rejected`` instead.
    """
    schema = T.StructType(ALT_MESSAGE.fields + [T.StructField(_CORRUPT, T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT}
    parsed = df.select(F.col(col).alias("_text"), _parsed_once(F.from_json(col, schema, options))).select(
        "_text", _CORRUPT, from_epoch_ms("timestamp", time_type).alias("timestamp"), F.col("deviceId").alias("device_id"),
        "temperature", "humidity", "pressure",
    )
    bad = F.col(_CORRUPT).isNotNull() | F.col("timestamp").isNull() | F.col("device_id").isNull()
    columns = ("timestamp", "device_id", "temperature", "humidity", "pressure")
    return parsed.select(*[F.when(~bad, F.col(c)).alias(c) for c in columns], F.when(bad, F.col("_text")).alias("rejected"))


def normalise_alt_messages(df: DataFrame, col: str = "message", time_type: str = "timestamp_ntz") -> DataFrame:
    """The sound ones of these messages; what is wrong with the others is in ``parse_alt_messages``."""
    return parse_alt_messages(df, col, time_type).filter("rejected IS NULL").drop("rejected")


def flatten_readings(df: DataFrame) -> DataFrame:
    """Nested readings (a map of quantities) to one column per quantity."""
    return df.select(*HEADER, *[F.col("metrics")[m].alias(m) for m in METRICS])


def _iso(c: Column | str) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def to_messages(ev: DataFrame, col: str = "message") -> DataFrame:
    """Rows as flat JSON text, the form devices publish; quantities not measured are left out."""
    present = [m for m in METRICS if m in ev.columns]
    return ev.select(
        F.to_json(
            F.struct(
                _iso("timestamp").alias("timestamp"),
                *HEADER[1:],
                *[F.col(m).cast("double").alias(m) for m in present],
            )
        ).alias(col)
    )
