"""Log-structured segments and panes over many batches, merges, repeats and readers in between."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from gaugeworks import streaming as St
from gaugeworks.operators.devices import latest_per
from gaugeworks.plans.tables import as_stored
from gaugeworks.session import fresh_path
from gaugeworks.sinks import latest_state, read_segments, segments, write_segment
from gaugeworks.sources import stream_events
from gaugeworks.sources.sample_tables import telemetry
from gaugeworks.streaming import panes as P

START = dt.datetime(2024, 5, 1, 12)
ROWS = "timestamp timestamp_ntz, device_id string, msg_id long"


def newest(rows):
    return latest_per(rows, ["device_id"], ["timestamp", "msg_id"]).select("timestamp", "device_id", "msg_id")


def batch(spark, i, n=5):
    return spark.createDataFrame([(START + dt.timedelta(minutes=i), f"d{(i * k) % 7}", 10 * i + k) for k in range(n)], ROWS)


def folders(base):
    return [f for f in os.listdir(base) if f.startswith("segment-")]


def ids(df):
    return sorted(r["msg_id"] for r in df.collect())


def test_folders_grow_with_the_logarithm_of_the_batches(spark):
    base, want = fresh_path(spark, "segments"), []
    for i in range(40):
        write_segment(batch(spark, i), base, i, lambda rows: rows, fan=3, keep=2)
        want += ids(batch(spark, i))
        held = segments.manifest_of(spark, base).segments
        assert len(held) <= 2 * 4 and held[0].first == 0 and held[-1].last == i
        assert [a.last + 1 for a in held[:-1]] == [b.first for b in held[1:]]
        assert len(folders(base)) <= 2 * 4 + 3 * 2
    assert ids(read_segments(spark, base)) == sorted(want)
    assert max(s.level for s in held) == 3 and len(os.listdir(f"{base}/manifest")) <= 2 * 2  # with their checksums


def test_merges_keep_the_newest_of_each_key(spark):
    base, frames = fresh_path(spark, "segments"), []
    for i in range(10):
        frames.append(batch(spark, i))
        write_segment(newest(frames[-1]), base, i, newest, fan=2)
    whole = frames[0]
    for f in frames[1:]:
        whole = whole.unionByName(f)
    assert sorted(map(tuple, newest(read_segments(spark, base)).collect())) == sorted(map(tuple, newest(whole).collect()))
    assert sum(s.rows for s in segments.manifest_of(spark, base).segments) <= 2 * 7


def test_a_reader_during_merges_sees_one_state(spark):
    base = fresh_path(spark, "segments")
    for i in range(4):
        write_segment(batch(spark, i), base, i, lambda rows: rows, fan=2, keep=3)
    pinned, want = segments.manifest_of(spark, base), ids(read_segments(spark, base))
    frame = read_segments(spark, base, manifest=pinned)
    for i in (4, 5):
        write_segment(batch(spark, i), base, i, lambda rows: rows, fan=2, keep=3)
        assert ids(frame) == want and ids(read_segments(spark, base)) != want


def test_a_batch_that_stops_anywhere_is_repeated(spark, monkeypatch):
    """Stopped after its segment, during the merge, or with half a manifest: readers see the state before, a repeat completes it."""
    base = fresh_path(spark, "segments")
    add = lambda i: write_segment(batch(spark, i), base, i, lambda rows: rows, fan=2)
    add(0)
    want = ids(batch(spark, 0))
    for stop in (1, 2):
        calls, write = [], segments._write

        def broken(*args):
            if len(calls) == stop:
                raise RuntimeError("lost")
            calls.append(1)
            return write(*args)

        monkeypatch.setattr(segments, "_write", broken if stop < 2 else write)
        if stop == 2:
            monkeypatch.setattr(segments, "_store", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            add(1)
        assert ids(read_segments(spark, base)) == want
        monkeypatch.undo()
    os.makedirs(f"{base}/manifest", exist_ok=True)
    with open(f"{base}/manifest/1", "w") as half:
        half.write('{"version": 1, "schema"')
    assert ids(read_segments(spark, base)) == want
    for _ in range(2):
        add(1)
        assert ids(read_segments(spark, base)) == sorted(want + ids(batch(spark, 1)))
    named = {s.folder for i in (0, 1) for s in segments._load(spark, base, i).segments}
    assert set(folders(base)) == named


def test_old_segments_leave_unread(spark):
    base = fresh_path(spark, "segments")
    for i in range(3):
        write_segment(batch(spark, 100 * i), base, i, lambda rows: rows, gone=START + dt.timedelta(minutes=100 * i - 150))
    assert ids(read_segments(spark, base)) == sorted(ids(batch(spark, 100)) + ids(batch(spark, 200)))
    since = read_segments(spark, base, START + dt.timedelta(minutes=150))
    assert ids(since) == ids(batch(spark, 200)) and len(since.inputFiles()) <= len(read_segments(spark, base).inputFiles()) / 2 + 1


def test_empty_batches_and_no_store(spark):
    base = fresh_path(spark, "segments")
    with pytest.raises(ValueError):
        read_segments(spark, base)
    parted = batch(spark, 1).withColumn("part", F.lit("x"))
    for i in range(4):
        write_segment(parted.limit(0) if i % 2 else parted, base, i, lambda rows: rows, "part", fan=3)
    assert read_segments(spark, base).count() == 10 and read_segments(spark, base).columns == parted.columns


@pytest.fixture(scope="module")
def shuffled(spark, sf_dir):
    """Events in nine batches that overlap in time."""
    folder = fresh_path(spark, "feed")
    ev = as_stored(telemetry(spark, sf_dir))
    ev.repartition(9, (F.col("msg_id") % 9)).write.parquet(folder)
    return ev, folder


def rows(df):
    columns = sorted(df.columns)
    return sorted([tuple(r) for r in df.select(*columns).collect()], key=repr)


def test_windows_from_panes_are_those_of_the_rows(spark, shuffled, monkeypatch):
    ev, folder = shuffled
    base = fresh_path(spark, "panes")
    for _ in range(2):
        St.sink_panes(stream_events(spark, folder, max_files=1), f"{base}/table", f"{base}/checkpoint", every=None).awaitTermination()
    panes = St.read_panes(spark, f"{base}/table")
    copied = ev.withColumn("window_start", F.explode(F.sequence(F.date_trunc("minute", "timestamp").cast("timestamp_ntz") - F.expr("interval 14 minutes"),
                           F.date_trunc("minute", "timestamp").cast("timestamp_ntz"), F.expr("interval 1 minute"))))
    counted = copied.groupBy("window_start").agg(F.count_distinct("device_id").alias("devices"))
    assert rows(P.active_devices(panes).drop("window_end")) == rows(counted)
    extremes = P.extremes(panes).select("window_start", "max_temperature")
    highest = copied.groupBy("window_start").agg((F.floor(F.max("temperature").cast("double") * 100 + 0.5) / 100).alias("max_temperature"))
    assert rows(extremes) == rows(highest)


def test_active_devices_of_any_gaps(spark):
    rng = random.Random(3)
    seen = {(f"d{rng.randrange(5)}", rng.randrange(6000)) for _ in range(250)}
    panes = spark.createDataFrame([(d, dt.datetime(2024, 5, 1, 20) + dt.timedelta(minutes=m)) for d, m in seen], "device_id string, bucket timestamp_ntz")
    want = {}
    for d, m in seen:
        for start in range(m - 14, m + 1):
            want.setdefault(start, set()).add(d)
    got = {(r["window_start"] - dt.datetime(2024, 5, 1, 20)) // dt.timedelta(minutes=1): r["devices"] for r in P.active_devices(panes).collect()}
    assert got == {k: len(v) for k, v in want.items()}


def test_one_row_per_pane_and_device_reaches_the_shuffle(spark, shuffled):
    from gaugeworks.operators.rollups import rollup

    plan = rollup(shuffled[0], "minute", P.MEASURED)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "partial_sum" in plan and "Expand" not in plan and "Generate" not in plan


def test_panes_are_kept_for_a_time(spark, shuffled):
    ev, _ = shuffled
    base, folder = fresh_path(spark, "panes"), fresh_path(spark, "feed")
    ev.repartitionByRange(4, "timestamp").write.parquet(folder)
    newest_row = ev.agg(F.max("timestamp")).first()[0]
    St.sink_panes(stream_events(spark, folder, max_files=1), f"{base}/table", f"{base}/checkpoint", every=None, keep="2 hours").awaitTermination()
    panes = St.read_panes(spark, f"{base}/table", newest_row - dt.timedelta(hours=2))
    assert panes.agg(F.sum("events")).first()[0] >= ev.filter(F.col("timestamp") >= newest_row - dt.timedelta(hours=1)).count()
    assert read_segments(spark, f"{base}/table").agg(F.sum("events")).first()[0] < ev.count()


def test_state_over_many_batches(spark, shuffled):
    from gaugeworks.sinks import upsert_latest

    ev, folder = shuffled
    base = fresh_path(spark, "state")
    upsert_latest(stream_events(spark, folder, max_files=1), f"{base}/table", f"{base}/checkpoint", every=None).awaitTermination()
    got = {(r["device_id"], r["msg_id"]) for r in latest_state(spark, f"{base}/table", None).collect()}
    assert got == {(r["device_id"], r["msg_id"]) for r in latest_per(ev, ["device_id"], ["timestamp", "msg_id"]).collect()}
    assert len(segments.manifest_of(spark, f"{base}/table").segments) <= 8
