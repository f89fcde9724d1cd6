"""Moving expired months into the archive, in steps that may stop anywhere.

A run is planned, archived, committed and then dropped, each step behind a record in a hidden folder of the archive.
The plan names the files that move; rows that arrive later lie in other files and wait for the next run. Until the
commit the archived copies do not count; after it the planned files do not. So a reader of both tables sees each row
once at any moment, and a run that stopped is taken up where its last record says.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.functions import instant, interval, month_of
from gaugeworks.operators.folders import stored_files
from gaugeworks.operators.manifest import keep_manifest
from gaugeworks.sinks.tables import LAYOUT, tasks_for

RECORDS = "_moves"
STEPS = ("plan", "commit", "done")


def _place(spark: SparkSession, path: str) -> tuple:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def _record(spark: SparkSession, archive: str, run: str, step: str, held: dict) -> None:
    """Written under another name first, so a record that can be seen is whole."""
    files, draft = _place(spark, f"{archive}/{RECORDS}/.{run}.{step}")
    out = files.create(draft, True)
    try:
        out.write(bytearray(json.dumps(held).encode()))
    finally:
        out.close()
    files.rename(draft, _place(spark, f"{archive}/{RECORDS}/{run}.{step}")[1])


def _read(spark: SparkSession, archive: str, run: str, step: str) -> dict | None:
    files, path = _place(spark, f"{archive}/{RECORDS}/{run}.{step}")
    if not files.exists(path):
        return None
    stream = files.open(path)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def _runs(spark: SparkSession, archive: str, step: str) -> list[str]:
    files, folder = _place(spark, f"{archive}/{RECORDS}")
    names = [e.getPath().getName() for e in files.listStatus(folder)] if files.exists(folder) else []
    return sorted(n.removesuffix(f".{step}") for n in names if n.endswith(f".{step}") and not n.startswith("."))


def _plan(spark: SparkSession, path: str, keep: str, as_of) -> dict:
    """The files of all months that lie whole before the limit, from the listing alone."""
    edge = spark.range(1).select(month_of(instant(as_of) - interval(keep)).alias("edge")).first()["edge"]
    month = F.col("yyyymm").cast("string")
    found = stored_files(spark, path).filter(month.isNotNull() & (month < edge)).select("path").collect()
    return {"before": edge, "files": sorted(r["path"] for r in found)}


def _archive(spark: SparkSession, path: str, archive: str, run: str, plan: dict) -> None:
    rows = spark.read.option("basePath", path).parquet(*plan["files"]).drop("yyyymm")
    (
        rows.withColumn("yyyymm", month_of("timestamp")).withColumn("run", F.lit(run))
        .repartitionByRange(tasks_for(rows), "yyyymm", *LAYOUT).sortWithinPartitions("yyyymm", *LAYOUT)
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd")
        .partitionBy("yyyymm", "run").parquet(archive)
    )


def _drop(spark: SparkSession, path: str, plan: dict) -> None:
    """Delete the planned files, and the folders that they leave empty."""
    for name in plan["files"]:
        files, file = _place(spark, name)
        files.delete(file, False)
        if files.exists(file.getParent()) and not files.listStatus(file.getParent()):
            files.delete(file.getParent(), False)


def move_expired(spark: SparkSession, path: str, archive: str, keep: str, as_of) -> None:
    """Move the months that lie whole before ``as_of - keep`` from the events table into the archive.

    Runs that began earlier and did not end are ended first. Repeating a finished run does nothing: what has arrived
    for its months since then moves with the next ``as_of``.
    """
    run = str(as_of).replace(" ", "T").replace(":", "")
    open_runs = [r for r in _runs(spark, archive, "plan") if r not in _runs(spark, archive, "done")]
    for r in [*open_runs, *([run] if run not in open_runs else [])]:
        if _read(spark, archive, r, "done") is not None:
            continue
        plan = _read(spark, archive, r, "plan")
        if plan is None:
            plan = _plan(spark, path, keep, as_of)
            _record(spark, archive, r, "plan", plan)
        if _read(spark, archive, r, "commit") is None:
            if plan["files"]:
                _archive(spark, path, archive, r, plan)
            _record(spark, archive, r, "commit", {})
        _drop(spark, path, plan)
        _record(spark, archive, r, "done", {})
    keep_manifest(spark, path)


def live_rows(spark: SparkSession, path: str, archive: str) -> DataFrame:
    """The events table without files that a committed run has archived but not yet dropped."""
    moving = [r for r in _runs(spark, archive, "commit") if r not in _runs(spark, archive, "done")]
    gone = {f.rsplit("/", 2)[-2] + "/" + f.rsplit("/", 1)[-1] for r in moving for f in _read(spark, archive, r, "plan")["files"]}
    table = spark.read.parquet(path)
    if not gone:
        return table
    file = F.substring_index(F.col("_metadata.file_path"), "/", -2)
    return table.filter(~file.isin(*gone))


def archived_rows(spark: SparkSession, archive: str) -> DataFrame | None:
    """The rows of committed runs, or None before the first."""
    done = [r for r in _runs(spark, archive, "commit") if _read(spark, archive, r, "plan")["files"]]
    return spark.read.parquet(archive).filter(F.col("run").isin(*done)) if done else None


def all_rows(spark: SparkSession, path: str, archive: str) -> DataFrame:
    """Every event once, wherever it is stored."""
    live, old = live_rows(spark, path, archive), archived_rows(spark, archive)
    return live if old is None else live.unionByName(old.drop("run"))
