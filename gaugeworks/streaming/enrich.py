"""Device names joined to a running stream, from a dictionary that is read again when its life time is over."""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gaugeworks.functions.timing import span_seconds
from gaugeworks.operators.devices import with_device_metadata
from gaugeworks.sinks.live import _triggered, unzoned

_VERSION = "version="
_PINS = "_dictionary"


def _place(spark: SparkSession, path: str) -> tuple:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def _names(spark: SparkSession, path: str) -> list[str]:
    files, folder = _place(spark, path)
    return [e.getPath().getName() for e in files.listStatus(folder)] if files.exists(folder) else []


def dictionary_versions(spark: SparkSession, base: str) -> list[int]:
    """Versions that have been written to their end."""
    found = [n.removeprefix(_VERSION) for n in _names(spark, base) if n.startswith(_VERSION)]
    return sorted(int(v) for v in found if "_SUCCESS" in _names(spark, f"{base}/{_VERSION}{v}"))


def publish_dictionary(meta: DataFrame, base: str) -> int:
    """Write the dictionary as its next version; versions are never changed, so running batches keep theirs."""
    spark = meta.sparkSession
    taken = [int(n.removeprefix(_VERSION)) for n in _names(spark, base) if n.startswith(_VERSION)]
    version = max(taken, default=0) + 1
    meta.write.parquet(f"{base}/{_VERSION}{version}")
    return version


def read_dictionary(spark: SparkSession, base: str, version: int) -> DataFrame:
    return spark.read.parquet(f"{base}/{_VERSION}{version}")


def _pin(spark: SparkSession, out: str, batch_id: int) -> dict | None:
    files, path = _place(spark, f"{out}/{_PINS}/{batch_id}")
    if not files.exists(path):
        return None
    stream = files.open(path)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def _store_pin(spark: SparkSession, out: str, batch_id: int, pin: dict) -> None:
    files, draft = _place(spark, f"{out}/{_PINS}/.{batch_id}")
    stream = files.create(draft, True)
    try:
        stream.write(bytearray(json.dumps(pin).encode()))
    finally:
        stream.close()
    files.rename(draft, _place(spark, f"{out}/{_PINS}/{batch_id}")[1])
    for old in _names(spark, f"{out}/{_PINS}"):
        if old.isdecimal() and int(old) < batch_id - 1:
            files.delete(_place(spark, f"{out}/{_PINS}/{old}")[1], False)


def sink_enriched(
    stream: DataFrame, dictionary: str, out: str, checkpoint: str, ttl: str = "300 seconds", key: str = "device_id", every: str | None = "5 seconds"
) -> StreamingQuery:
    """Append the stream's rows with their device metadata under ``out``, a folder for each batch.

    A version of the dictionary serves until event time is ``ttl`` past the newest event of the batch that began with
    it; the batch that reaches that begins with the newest version. Which version a batch uses is recorded before its
    rows are written, so a repeated batch gives the same rows. The join carries no hint (``with_device_metadata``).
    """
    life = dt.timedelta(seconds=span_seconds(ttl))

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        pin = _pin(spark, out, batch_id)
        if pin is None:
            pin = _pin(spark, out, batch_id - 1)
            now = batch.agg(F.max("timestamp").cast("timestamp_ntz")).first()[0]
            since = None if pin is None or pin["since"] is None else dt.datetime.fromisoformat(pin["since"])
            if pin is None or since is None or (now is not None and now - since >= life):
                pin = {"version": dictionary_versions(spark, dictionary)[-1], "since": None if now is None else now.isoformat()}
            _store_pin(spark, out, batch_id, pin)
        named = with_device_metadata(unzoned(batch), read_dictionary(spark, dictionary, pin["version"]), key)
        named.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    writer = stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(write)
    return _triggered(writer, every).start()
