"""Streams over several micro-batches: late rows, repeats, updates, restarts."""

import datetime as dt
import os
import subprocess
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from gaugeworks import streaming as St
from gaugeworks.operators import rollups as R
from gaugeworks.plans.tables import as_stored
from gaugeworks.session import fresh_path
from gaugeworks.sinks import drop_old_state, latest_state, read_segments, settle_months, sink_batched, upsert_latest
from gaugeworks.sources import read_events, stream_events
from gaugeworks.sources.sample_tables import telemetry
from gaugeworks.streaming import expiring

START = dt.datetime(2024, 5, 1, 12)


@pytest.fixture()
def feed(spark, readings):
    """A folder that micro-batches are dropped into, one file at a time, and its stream."""
    folder = fresh_path(spark, "feed")

    def drop(rows):
        full = [((START + dt.timedelta(seconds=s)).isoformat(" "), d, st, i, t, None) for s, d, st, i, t in rows]
        ev = readings(full)
        for missing in ("voltage", "light_intensity", "co2", "vibration", "power_consumption", "signal_strength"):
            ev = ev.withColumn(missing, F.lit(None).cast("double"))
        as_stored(ev).coalesce(1).write.mode("append").parquet(folder)

    return folder, drop, lambda: stream_events(spark, folder, max_files=1)


def drained(spark, stream, mode, base):
    """Run what is there; a later call with the same base goes on where this one stopped."""
    def write(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{base}/table/batch={batch_id}")

    query = (stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/checkpoint")
             .foreachBatch(write).trigger(availableNow=True).start())
    query.awaitTermination()
    return query


def test_late_rows_are_dropped_and_counted(spark, feed):
    folder, drop, stream = feed
    base = fresh_path(spark, "rate")
    drop([(0, "a", "OK", 1, 1.0), (30, "a", "OK", 2, 1.0), (1800, "a", "OK", 3, 1.0)])
    drained(spark, St.stream_event_rate(stream(), watermark="10 minutes"), "append", base)
    drop([(5, "a", "OK", 4, 1.0), (1790, "a", "OK", 5, 1.0), (3600, "a", "OK", 6, 1.0)])
    query = drained(spark, St.stream_event_rate(stream(), watermark="10 minutes"), "append", base)
    assert St.late_rows(query) == 1
    got = {r["window_start"]: r["events"] for r in spark.read.parquet(f"{base}/table").collect()}
    assert got == {START: 2, START + dt.timedelta(minutes=29): 1, START + dt.timedelta(minutes=30): 1}


def test_every_late_row_is_counted(spark, feed):
    """Fifty late rows of one minute are fifty, also over a restart and over a batch that is repeated."""
    folder, drop, stream = feed
    base = fresh_path(spark, "late")
    drop([(0, "a", "OK", 1, 1.0), (3600, "a", "OK", 2, 1.0)])
    St.count_late(stream(), f"{base}/late", f"{base}/checkpoint", every=None).awaitTermination()
    drop([(60 + i, "a", "OK", 10 + i, 1.0) for i in range(50)] + [(3590, "a", "OK", 3, 1.0)])
    drop([(7200, "a", "OK", 90, 1.0), (5, "b", "OK", 91, 1.0)])
    for _ in range(2):
        St.count_late(stream(), f"{base}/late", f"{base}/checkpoint", every=None).awaitTermination()
    got = St.late_totals(spark, f"{base}/late").first()
    assert (got["rows"], got["late"]) == (55, 51)


def test_late_rows_of_more_than_a_hundred_batches(spark, feed):
    folder, drop, stream = feed
    base = fresh_path(spark, "late")
    drop([(7200, "a", "OK", 0, 1.0)])
    St.count_late(stream(), f"{base}/late", f"{base}/checkpoint", every=None).awaitTermination()
    as_rows = [(i, "a", "OK", i, 1.0) for i in range(1, 106)]
    drop(as_rows)
    one = spark.read.parquet(folder).filter("msg_id > 0")
    one.repartitionByRange(105, "msg_id").write.mode("overwrite").parquet(f"{base}/feed")
    many = stream_events(spark, f"{base}/feed", max_files=1)
    St.count_late(many, f"{base}/many", f"{base}/many-checkpoint", watermark="0 seconds", every=None).awaitTermination()
    got = St.late_totals(spark, f"{base}/many").first()
    assert got["rows"] == 105
    St.count_late(stream(), f"{base}/late", f"{base}/checkpoint", every=None).awaitTermination()
    assert St.late_totals(spark, f"{base}/late").first()["late"] == 105


def test_landed_rollup_settles_by_day(spark, feed):
    folder, drop, stream = feed
    base = fresh_path(spark, "rollup")
    day = 86400
    drop([(0, "a", "OK", 1, 1.0), (10, "a", "WARN", 2, 3.0), (day, "a", "OK", 3, 5.0)])
    drop([(2 * day, "a", "OK", 4, 1.0)])
    for _ in range(2):
        St.sink_rollup(stream(), f"{base}/landing", f"{base}/checkpoint", every=None).awaitTermination()
    for _ in range(2):
        R.settle_rollup(spark, f"{base}/landing", f"{base}/table", ("20240501", "20240502"))
    got = spark.read.parquet(f"{base}/table").orderBy("bucket").collect()
    assert [(r["part"], r["events"], r["warnings"], r["sum_temperature"]) for r in got] == [
        (20240501, 2, 1, 4.0), (20240502, 1, 0, 5.0),
    ]


def test_stream_equals_batch_over_many_batches(spark, sf_dir):
    folder = fresh_path(spark, "feed")
    ev = as_stored(telemetry(spark, sf_dir))
    ev.repartitionByRange(5, "timestamp").write.parquet(folder)
    keys = ["bucket", "device_id", "device_type", "location"]
    stream = stream_events(spark, folder, max_files=1)
    rolled = St.run_once(spark, St.stream_rollup(stream, watermark="365 days", metrics=["temperature"]), "update", keys)
    exact = R.rollup(ev, "minute", ["temperature"])
    columns = sorted(c for c in exact.columns if c != "sum_temperature")
    assert sorted(map(tuple, rolled.select(*columns).collect()), key=repr) == sorted(map(tuple, exact.select(*columns).collect()), key=repr)


def test_repeats_across_batches_are_dropped(spark, feed):
    folder, drop, stream = feed
    rows = [(i, "a", "OK", i, float(i)) for i in range(10)]
    drop(rows)
    drop(rows[5:] + [(20, "a", "OK", 20, 1.0)])
    out = St.run_once(spark, St.dedup_messages(stream()).select("msg_id"))
    assert sorted(r[0] for r in out.collect()) == list(range(10)) + [20]


def test_latest_state_over_batches(spark, feed):
    folder, drop, stream = feed
    base = fresh_path(spark, "state")
    run = lambda: upsert_latest(stream(), f"{base}/table", f"{base}/checkpoint", every=None).awaitTermination()
    drop([(0, "a", "OK", 1, 1.0), (10, "a", "WARN", 2, 2.0), (0, "b", "OK", 3, 3.0)])
    run()
    drop([(300, "a", "CRITICAL", 4, 4.0), (5, "a", "OK", 5, 5.0)])
    run()
    at = lambda t: {r["device_id"]: (r["msg_id"], r["status"]) for r in latest_state(spark, f"{base}/table", t, START + dt.timedelta(seconds=310)).collect()}
    assert at("15 minutes") == {"a": (4, "CRITICAL"), "b": (3, "OK")}
    assert at("5 minutes") == {"a": (4, "CRITICAL")}
    assert latest_state(spark, f"{base}/table", None).count() == 2


def test_history_is_exactly_once_over_restarts(spark, feed):
    folder, drop, stream = feed
    base = fresh_path(spark, "history")
    run = lambda: sink_batched(stream(), f"{base}/table", f"{base}/checkpoint", max_rows=4, every=None).awaitTermination()
    drop([(i, "a", "OK", i, 1.0) for i in range(10)])
    run()
    run()
    drop([(i, "b", "OK", i, 1.0) for i in range(10, 15)])
    run()
    got = spark.read.parquet(f"{base}/table")
    assert sorted(r[0] for r in got.select("msg_id").collect()) == list(range(15))
    assert got.groupBy("_metadata.file_path").count().agg(F.max("count")).first()[0] <= 4


@pytest.mark.parametrize("flow", ["batched", "dual"])
def test_landed_months_settle_into_the_events_table(spark, feed, flow):
    folder, drop, stream = feed
    base = fresh_path(spark, "landing")
    month = 31 * 86400
    drop([(i, "a", "OK", i, 1.0) for i in range(10)] + [(month + i, "b", "OK", 100 + i, 1.0) for i in range(5)])
    drop([(20 + i, "b", "OK", 50 + i, 1.0) for i in range(5)])
    if flow == "batched":
        sink_batched(stream(), f"{base}/history", f"{base}/checkpoint", every=None).awaitTermination()
    else:
        St.dual_write(stream(), f"{base}/history", f"{base}/live", f"{base}/checkpoint", every=None).awaitTermination()
    for _ in range(2):
        settle_months(spark, f"{base}/history", f"{base}/events", ("202405",))
        table = read_events(spark, f"{base}/events")
        assert sorted(r[0] for r in table.select("msg_id").collect()) == list(range(10)) + list(range(50, 55))
    settle_months(spark, f"{base}/history", f"{base}/events", ("202406",))
    assert read_events(spark, f"{base}/events").count() == 20


def test_old_state_goes_by_the_hour(spark, feed):
    folder, drop, stream = feed
    base = fresh_path(spark, "state")
    drop([(0, "a", "OK", 1, 1.0), (7200, "b", "OK", 2, 1.0)])
    drop([(7300, "a", "OK", 3, 1.0), (100, "c", "OK", 4, 1.0)])
    upsert_latest(stream(), f"{base}/table", f"{base}/checkpoint", every=None).awaitTermination()
    now = START + dt.timedelta(seconds=7400)
    alive = lambda: {(r["device_id"], r["msg_id"]) for r in latest_state(spark, f"{base}/table", "15 minutes", now).collect()}
    before = alive()
    drop_old_state(spark, f"{base}/table", "15 minutes", now)
    assert alive() == before == {("a", 3), ("b", 2)}
    assert latest_state(spark, f"{base}/table", None).count() == 2


def test_dual_write_repeats_safely(spark, feed):
    """A batch that is written again, as after a lost driver, replaces its own rows."""
    folder, drop, stream = feed
    base = fresh_path(spark, "dual")
    drop([(i, "a", "OK", i, 1.0) for i in range(10)])
    for attempt in ("one", "two"):
        St.dual_write(stream(), f"{base}/history", f"{base}/live", f"{base}/{attempt}", every=None).awaitTermination()
    assert read_segments(spark, f"{base}/history").count() == 10
    assert latest_state(spark, f"{base}/live", None).first()["msg_id"] == 9


def test_sessions(spark, feed):
    folder, drop, stream = feed
    drop([(0, "a", "WARN", 1, 1.0), (600, "a", "CRITICAL", 2, 1.0), (1600, "a", "OK", 3, 1.0), (90_000, "z", "OK", 4, 1.0)])
    got = St.run_once(spark, St.stream_counters(stream(), "15 minutes"), "append")
    assert sorted((r["device_id"], r["events"], r["warnings"], r["criticals"]) for r in got.collect()) == [
        ("a", 1, 0, 0), ("a", 2, 2, 1),
    ]


def test_sketch_of_active_devices(spark, feed):
    folder, drop, stream = feed
    drop([(i, f"d{i % 40}", "OK", i, 1.0) for i in range(80)])
    active = St.stream_active_devices(stream(), "2 minutes", "2 minutes", approx=True)
    got = St.run_once(spark, active, "update", ["window_start", "window_end"])
    assert got.count() == 1 and abs(got.first()["devices"] - 40) <= 4


def test_an_idle_device_leaves_the_state_store(spark, feed):
    folder, drop, stream = feed
    base = fresh_path(spark, "living")
    run = lambda: drained(spark, St.stream_living(stream(), "15 minutes", "5 minutes"), "update", base)
    held = lambda: {r["key"]["device_id"]: r["value"]["msg_id"] for r in spark.read.format("statestore")
                    .option("stateVarName", "latest").load(f"{base}/checkpoint").collect()}
    changes = lambda: spark.read.parquet(f"{base}/table")
    alive = lambda: {r["device_id"]: r["msg_id"] for r in St.living(changes()).collect()}
    drop([(0, "a", "OK", 1, 1.0), (10, "b", "WARN", 2, 2.0), (5, "a", "OK", 3, 3.0), (5, "a", "OK", 4, None)])
    run()
    assert held() == alive() == {"a": 4, "b": 2}
    drop([(600, "b", "OK", 5, 1.0), (500, "b", "OK", 6, 1.0), (20, "a", "OK", 7, 1.0)])
    run()
    assert held() == alive() == {"a": 7, "b": 5}  # the row at 20 s is not yet late, and moves the timer of "a"
    drop([(919, "c", "OK", 8, 1.0)])
    run()
    assert held() == alive() == {"a": 7, "b": 5, "c": 8}
    drop([(930, "c", "OK", 9, 1.0)])
    run()
    assert held() == alive() == {"b": 5, "c": 9}
    drop([(1200, "a", "OK", 10, 1.0)])
    run()
    assert held() == alive() == {"a": 10, "b": 5, "c": 9}
    gone = changes().filter("expired").select("device_id", "msg_id").collect()
    assert [r["device_id"] for r in gone] == ["a"]


def test_living_devices_in_a_session_without_settings(spark, feed):
    """Timers need the RocksDB store: a session that does not select it gets it for the run, and keeps its own setting."""
    folder, drop, stream = feed
    drop([(0, "a", "OK", 1, 1.0), (2000, "b", "OK", 2, 1.0), (2300, "c", "OK", 3, 1.0)])
    key = "spark.sql.streaming.stateStore.providerClass"
    other = spark.newSession()
    own = "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"
    other.conf.set(key, own)
    changes = St.run_once(other, St.stream_living(stream_events(other, folder, max_files=1), "15 minutes", "5 minutes"), "update", [])
    assert sorted(r["device_id"] for r in St.living(changes).collect()) == ["b", "c"]
    assert other.conf.get(key) == own


def test_the_processor_loads_without_the_package(tmp_path):
    """Spark loads it in Python processes that need not have this package on their path."""
    (tmp_path / "latest").write_bytes(cloudpickle.dumps((expiring.Latest(1, 2), expiring._newest_of_batch)))
    load = "import pickle; p, f = pickle.load(open('latest', 'rb')); print(p._expires(2), f.__name__)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    ran = subprocess.run([sys.executable, "-c", load], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert ran.stdout.split() == ["1", "_newest_of_batch"], ran.stderr


def test_rows_of_a_single_batch_are_read_as_they_are(spark, feed):
    """Keys of one batch are distinct: no aggregate over them; with several batches the newest state of each key."""
    folder, drop, stream = feed
    keys = ["bucket", "device_id", "device_type", "location"]
    rolled = lambda: St.run_once(spark, St.stream_rollup(stream(), watermark="365 days", metrics=["temperature"]), "update", keys)
    drop([(0, "a", "OK", 1, 1.0), (10, "a", "OK", 2, 2.0), (70, "b", "OK", 3, 3.0)])
    one = rolled()
    assert "Aggregate" not in one._jdf.queryExecution().executedPlan().toString()
    assert sorted((r["device_id"], r["events"], r["sum_temperature"]) for r in one.collect()) == [("a", 2, 3.0), ("b", 1, 3.0)]
    drop([(20, "a", "WARN", 4, 4.0)])
    two = rolled()
    assert two.columns == one.columns
    assert sorted((r["device_id"], r["events"], r["sum_temperature"]) for r in two.collect()) == [("a", 3, 7.0), ("b", 1, 3.0)]
