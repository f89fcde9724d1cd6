"""Batches of a stream as log-structured segments: few folders, however many batches there were.

Each batch becomes a segment of level 0. ``FAN`` neighbours of one level are merged into one of the next, so a
store of n batches has at most ``FAN`` - 1 segments on each of about log(n) levels, and a row is rewritten once a
level. A manifest, numbered by the batch, names the segments that make up the state. Readers take the newest whole
manifest and read what it names; segments are never changed, and stay for ``KEEP`` batches after a merge has replaced
them, so a reader during a merge sees the state before it.

A segment's folder has a name of its own for every attempt, and the manifest is written last. A batch that is
repeated after a failure starts from the manifest before it and replaces its own; folders of failed attempts go with
the next cleaning. A store has one writer, the stream.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeworks.operators.folders import TARGET_BYTES

FAN = 8
KEEP = 8


@dataclass(frozen=True)
class Segment:
    """A folder with the rows of batches ``first`` to ``last``; ``newest`` is its newest time as text."""

    folder: str
    level: int
    first: int
    last: int
    rows: int
    newest: str | None


@dataclass(frozen=True)
class Manifest:
    """What a state is made of; ``part`` is the column that its segments are partitioned by, if any."""

    version: int
    schema: str
    part: str | None
    segments: tuple[Segment, ...]


def _place(spark: SparkSession, path: str) -> tuple:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def _names(spark: SparkSession, path: str) -> list[str]:
    files, folder = _place(spark, path)
    return [e.getPath().getName() for e in files.listStatus(folder)] if files.exists(folder) else []


def _versions(spark: SparkSession, base: str) -> list[int]:
    return sorted(int(n) for n in _names(spark, f"{base}/manifest") if n.isdecimal())


def _load(spark: SparkSession, base: str, version: int) -> Manifest | None:
    """A manifest, or None if it was not written to its end."""
    files, path = _place(spark, f"{base}/manifest/{version}")
    stream = files.open(path)
    try:
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    try:
        held = json.loads(text)
    except ValueError:
        return None
    return Manifest(held["version"], held["schema"], held["part"], tuple(Segment(**s) for s in held["segments"]))


def _store(spark: SparkSession, base: str, manifest: Manifest) -> None:
    files, path = _place(spark, f"{base}/manifest/{manifest.version}")
    out = files.create(path, True)
    try:
        out.write(bytearray(json.dumps(asdict(manifest)).encode()))
    finally:
        out.close()


def manifest_of(spark: SparkSession, base: str, before: int | None = None) -> Manifest | None:
    """The newest whole manifest, or the newest below a version."""
    for version in reversed(_versions(spark, base)):
        if before is None or version < before:
            found = _load(spark, base, version)
            if found is not None:
                return found
    return None


def is_store(spark: SparkSession, base: str) -> bool:
    return bool(_versions(spark, base))


def _write(df: DataFrame, base: str, level: int, first: int, last: int, part: str | None, time_col: str) -> Segment:
    """Write one segment; rows and newest time are observed on the way."""
    seen = Observation()
    counted = df.observe(seen, F.count(F.lit(1)).alias("rows"), F.max(F.col(time_col).cast("timestamp_ntz")).alias("newest"))
    folder = f"segment-{level}-{first}-{last}-{uuid.uuid4().hex[:12]}"
    writer = counted.write.mode("overwrite")
    (writer.partitionBy(part) if part else writer).parquet(f"{base}/{folder}")
    newest = seen.get["newest"]
    return Segment(folder, level, first, last, seen.get["rows"], None if newest is None else newest.isoformat())


def _read(spark: SparkSession, base: str, schema: T.StructType, segments: list[Segment], part: str | None) -> DataFrame:
    if not segments:
        return spark.createDataFrame([], schema)
    paths = [f"{base}/{s.folder}" for s in segments]
    if part is None:
        return spark.read.schema(schema).parquet(*paths)
    # partitioned folders of several roots are tables of their own to Spark; there are few
    return reduce(DataFrame.unionByName, [spark.read.schema(schema).parquet(p) for p in paths])


def _bytes(spark: SparkSession, base: str, segments: list[Segment]) -> int:
    total = 0
    for s in segments:
        files, folder = _place(spark, f"{base}/{s.folder}")
        total += files.getContentSummary(folder).getLength()
    return total


def _clean(spark: SparkSession, base: str, version: int, keep: int) -> None:
    """Remove manifests older than ``keep`` versions, and segments that no remaining one names."""
    named: set[str] = set()
    for v in _versions(spark, base):
        held = _load(spark, base, v)
        if v > version or v <= version - keep or held is None:
            files, path = _place(spark, f"{base}/manifest/{v}")
            files.delete(path, False)
        else:
            named |= {s.folder for s in held.segments}
    for name in _names(spark, base):
        if name.startswith("segment-") and name not in named:
            files, path = _place(spark, f"{base}/{name}")
            files.delete(path, True)


def write_segment(
    batch: DataFrame, base: str, batch_id: int, merge: Callable[[DataFrame], DataFrame], part: str | None = None,
    time_col: str = "timestamp", fan: int = FAN, keep: int = KEEP, gone: dt.datetime | None = None,
    most_rows: int | None = None,
) -> Manifest:
    """Add a batch to the store and merge segments that have come to ``fan`` on a level.

    ``merge`` turns the rows of several segments into those of one (the newest of each key, added-up partials, or
    the rows themselves). Segments whose newest time is before ``gone`` are left out of the state without being read.
    ``part`` names a column that segments are partitioned by. With ``most_rows`` the oldest segments leave as soon as the
    others hold that many rows.
    """
    spark = batch.sparkSession
    before = manifest_of(spark, base, batch_id)
    held = [s for s in before.segments if s.last < batch_id] if before else []
    if gone is not None:
        held = [s for s in held if s.newest is None or s.newest >= gone.isoformat()]
    held.append(_write(batch, base, 0, batch_id, batch_id, part, time_col))
    while most_rows is not None and len(held) > 1 and sum(s.rows for s in held[1:]) >= most_rows:
        del held[0]
    while len(held) >= fan and len({s.level for s in held[-fan:]}) == 1:
        group = held[-fan:]
        files = max(1, -(-_bytes(spark, base, group) // TARGET_BYTES))
        rows = merge(_read(spark, base, batch.schema, group, part))
        rows = rows.repartition(int(files), part) if part else rows.repartition(int(files))
        held[-fan:] = [_write(rows, base, group[0].level + 1, group[0].first, group[-1].last, part, time_col)]
    manifest = Manifest(batch_id, batch.schema.json(), part, tuple(held))
    _store(spark, base, manifest)
    _clean(spark, base, batch_id, keep)
    return manifest


def read_segments(spark: SparkSession, base: str, since: dt.datetime | None = None, manifest: Manifest | None = None) -> DataFrame:
    """The rows of all segments of the newest (or a pinned) manifest, as they were written or merged.

    Segments whose newest time is before ``since`` are not read.
    """
    pinned = manifest or manifest_of(spark, base)
    if pinned is None:
        raise ValueError(f"no segments under {base}")
    wanted = [s for s in pinned.segments if since is None or (s.newest is not None and s.newest >= since.isoformat())]
    return _read(spark, base, T.StructType.fromJson(json.loads(pinned.schema)), wanted, pinned.part)


def segment_paths(spark: SparkSession, base: str) -> list[str]:
    """Folders that make up the newest state."""
    pinned = manifest_of(spark, base)
    return [f"{base}/{s.folder}" for s in pinned.segments] if pinned else []


def merge_all(spark: SparkSession, base: str, merge: Callable[[DataFrame], DataFrame], time_col: str = "timestamp") -> None:
    """Merge a store into one segment, under the same version; only while its stream is stopped."""
    pinned = manifest_of(spark, base)
    if pinned is None or not pinned.segments:
        return
    rows = merge(read_segments(spark, base, manifest=pinned))
    level = max(s.level for s in pinned.segments) + 1
    whole = _write(rows, base, level, pinned.segments[0].first, pinned.segments[-1].last, pinned.part, time_col)
    _store(spark, base, Manifest(pinned.version, pinned.schema, pinned.part, (whole,)))
    _clean(spark, base, pinned.version, 1)
