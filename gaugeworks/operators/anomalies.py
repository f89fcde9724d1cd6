"""Detecting the four fault patterns of a sensor: spike, dropout, stuck value, drift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.functions import bucket, rounded
from gaugeworks.operators.chunks import CHUNK, SMALL, in_chunks, over_previous
from gaugeworks.schema import DEVICE_METRICS

ORDER = ("timestamp", "msg_id")


def detect_spikes(
    ev: DataFrame, metric: str, factor: float = 2.0, n: int = 20, chunk: str = "1 hour", small: int = SMALL
) -> DataFrame:
    """Values at least ``factor`` times the mean of the ``n`` readings before, or of opposite sign."""
    rows = ev.filter(F.col(metric).isNotNull()).select("device_id", *ORDER, F.col(metric).alias("value"))
    chunked = in_chunks(rows, ["device_id"], ORDER, chunk, small)
    before = {"_total": F.sum("value"), "_count": F.count("value")}
    seen = over_previous(chunked, ["device_id"], ORDER, n, before).withColumn("_total", F.col("_total").cast("double"))
    value = F.col("value").cast("double")
    jump = F.abs(value) * F.col("_count") >= F.lit(float(factor)) * F.abs(F.col("_total"))
    flip = value * F.col("_total") < 0
    return seen.filter((F.col("_count") > 0) & (jump | flip)).select(
        "device_id", *ORDER, value.alias("value"), rounded(F.col("_total") / F.col("_count"), 3).alias("baseline")
    )


def reports(metric: str) -> Column:
    """Whether the device type of a row measures the quantity."""
    return F.col("device_type").isin(*[t for t, ms in DEVICE_METRICS.items() if metric in ms])


def detect_dropouts(ev: DataFrame, metric: str) -> DataFrame:
    """Zero or missing where the device should report a value."""
    lost = F.col(metric).isNull() | (F.col(metric) == 0)
    return ev.filter(reports(metric) & lost).select(
        "device_id", "device_type", *ORDER, F.col(metric).cast("double").alias("value")
    )


def _new_run() -> Column:
    previous = Window.partitionBy("device_id", CHUNK).orderBy(*ORDER)
    return (~F.col("value").eqNullSafe(F.lag("value").over(previous))).cast("int")


def detect_stuck(
    ev: DataFrame, metric: str, min_run: int = 5, chunk: str = "1 hour", small: int = SMALL
) -> DataFrame:
    """Runs of at least ``min_run`` equal consecutive values.

    Runs are found inside each chunk. Only the first and last run of a chunk can go on in another
    one; those, two per device and chunk at most, are joined up in a second, small pass.
    """
    rows = ev.filter(F.col(metric).isNotNull()).select("device_id", *ORDER, F.col(metric).alias("value"))
    rows = in_chunks(rows, ["device_id"], ORDER, chunk, small).withColumn("_new", _new_run())
    inside = Window.partitionBy("device_id", CHUNK).orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)
    runs = (
        rows.withColumn("_run", F.sum("_new").over(inside))
        .groupBy("device_id", CHUNK, "_run")
        .agg(
            F.min("value").alias("value"), F.min("timestamp").alias("started"),
            F.max("timestamp").alias("ended"), F.count(F.lit(1)).alias("readings"),
        )
        .withColumn("_runs", F.max("_run").over(Window.partitionBy("device_id", CHUNK)))
    )
    opens, closes = F.col("_run") == 1, F.col("_run") == F.col("_runs")

    whole = runs.filter(~opens & ~closes)
    edges = runs.filter(opens | closes).withColumn("_opens", opens).withColumn("_closes", closes)
    in_order = Window.partitionBy("device_id").orderBy(CHUNK, "_run")
    goes_on = (
        F.col("_opens")
        & F.coalesce(F.lag("_closes").over(in_order), F.lit(False))
        & F.col("value").eqNullSafe(F.lag("value").over(in_order))
    )
    joined = (
        edges.withColumn("_starts", (~goes_on).cast("int"))
        .withColumn("_chain", F.sum("_starts").over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("device_id", "_chain")
        .agg(
            F.min("value").alias("value"), F.min("started").alias("started"),
            F.max("ended").alias("ended"), F.sum("readings").alias("readings"),
        )
    )
    columns = ["device_id", F.col("value").cast("double").alias("value"), "started", "ended", "readings"]
    return whole.select(*columns).unionByName(joined.select(*columns)).filter(F.col("readings") >= min_run)


def detect_drift(ev: DataFrame, metric: str, every: str = "hour", min_slope: float = 0.01) -> DataFrame:
    """Slope per second of each device and bucket whose size reaches ``min_slope``.

    Seconds count from the start of the bucket, which keeps the sums small and the slope stable.
    """
    start = bucket("timestamp", every)
    seconds = (F.unix_micros(F.col("timestamp").cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / 1e6
    rows = ev.filter(F.col(metric).isNotNull()).select(
        "device_id", start.alias("bucket"), seconds.alias("x"), F.col(metric).cast("double").alias("y")
    )
    fitted = rows.groupBy("device_id", "bucket").agg(
        F.regr_slope("y", "x").alias("raw"), F.count(F.lit(1)).alias("readings")
    )
    return fitted.withColumn("slope", rounded("raw", 4)).filter(F.abs("slope") >= min_slope).drop("raw")


def anomaly_counts(readings: DataFrame, keys=("type", "metric", "device_id")) -> DataFrame:
    """Reported faults by kind, quantity and device; readings without a fault do not count."""
    faults = readings.select("device_id", F.explode("anomalies").alias("a")).select("device_id", "a.*")
    return faults.groupBy(*keys).agg(F.count(F.lit(1)).alias("anomalies"))
