"""The replay ring, the reloading dictionary, sketches and the one-pass bundle."""

import datetime as dt

import pytest
from compare import rows_read
from pyspark.sql import functions as F

from gaugeworks import streaming as St
from gaugeworks.operators import sketches as K
from gaugeworks.operators import summaries as A
from gaugeworks.plans.tables import as_stored
from gaugeworks.session import fresh_path
from gaugeworks.sinks import read_replay, replay_length, segments, sink_replay
from gaugeworks.sources import stream_events
from gaugeworks.sources.sample_tables import newest_time, telemetry

START = dt.datetime(2024, 5, 1, 12)
ROWS = "timestamp timestamp_ntz, device_id string, msg_id long, temperature double"


def at(seconds):
    return START + dt.timedelta(seconds=seconds)


@pytest.mark.parametrize("capacity", [1, 25, 40, 1000])
def test_the_ring_holds_the_last_events(spark, capacity):
    feed, base = fresh_path(spark, "feed"), fresh_path(spark, "ring")
    want = []
    for i in range(12):
        size = (0, 3, 60, 7)[i % 4]
        rows = [(at(100 * i + k), f"d{k}", 1000 * i + k, 1.0) for k in range(size)]
        spark.createDataFrame(rows, ROWS).coalesce(1).write.mode("append").parquet(feed)
        want = [r[2] for r in reversed(rows)] + want
        query = sink_replay(stream_events(spark, feed, schema=spark.read.parquet(feed).schema), f"{base}/table", f"{base}/checkpoint", capacity, every=None)
        query.awaitTermination()
        if i % 4 == 3:
            held = read_replay(spark, f"{base}/table", capacity)
            assert [r["msg_id"] for r in held.collect()] == want[:capacity]
            assert replay_length(spark, f"{base}/table", capacity) == min(capacity, len(want))
            assert sum(s.rows for s in segments.manifest_of(spark, f"{base}/table").segments) < 2 * capacity + 70
    assert replay_length(spark, fresh_path(spark, "none")) == 0


def test_a_changed_name_shows_after_the_limit_and_not_before(spark):
    feed, base = fresh_path(spark, "feed"), fresh_path(spark, "enriched")
    names = lambda text: spark.createDataFrame([("a", text)], "device_id string, device_name string")
    St.publish_dictionary(names("first"), f"{base}/names")

    def batch(second, msg):
        spark.createDataFrame([(at(second), "a", msg, 1.0), (at(second), "b", msg, 1.0)], ROWS).coalesce(1).write.mode("append").parquet(feed)
        stream = stream_events(spark, feed, schema=spark.read.parquet(feed).schema)
        St.sink_enriched(stream, f"{base}/names", f"{base}/out", f"{base}/checkpoint", "300 seconds", every=None).awaitTermination()
        rows = spark.read.parquet(f"{base}/out").filter(F.col("msg_id") == msg).collect()
        return {r["device_id"]: r["device_name"] for r in rows}

    assert batch(0, 1) == {"a": "first", "b": None}
    St.publish_dictionary(names("second"), f"{base}/names")
    assert batch(100, 2) == {"a": "first", "b": None}
    assert batch(299, 3) == {"a": "first", "b": None}
    assert batch(300, 4) == {"a": "second", "b": None}
    St.publish_dictionary(names("third"), f"{base}/names")
    assert batch(599, 5) == {"a": "second", "b": None}
    assert batch(900, 6) == {"a": "third", "b": None}
    assert spark.read.parquet(f"{base}/out").count() == 12


def test_a_repeated_batch_uses_the_version_it_began_with(spark):
    feed, base = fresh_path(spark, "feed"), fresh_path(spark, "enriched")
    spark.createDataFrame([(at(0), "a", 1, 1.0)], ROWS).write.parquet(feed)
    names = lambda text: spark.createDataFrame([("a", text)], "device_id string, device_name string")
    for attempt in ("one", "two"):
        St.publish_dictionary(names(attempt), f"{base}/names")
        stream = stream_events(spark, feed, schema=spark.read.parquet(feed).schema)
        St.sink_enriched(stream, f"{base}/names", f"{base}/out", f"{base}/{attempt}", every=None).awaitTermination()
    assert [r["device_name"] for r in spark.read.parquet(f"{base}/out").collect()] == ["one"]


def test_sketches_unite(spark):
    ev = spark.range(200_000).select(
        F.timestamp_add("SECOND", F.col("id") % 7200, F.lit(START)).cast("timestamp_ntz").alias("timestamp"),
        F.concat(F.lit("d"), F.col("id") % 70_001).alias("device_id"), (F.col("id") % 3).cast("string").alias("location"),
    )
    minute = K.sketch_rollup(ev, "minute", ["location"])
    twice = minute.unionByName(minute)  # a row met twice counts once
    raw = {r["bucket"]: r["n"] for r in ev.groupBy(F.date_trunc("hour", "timestamp").cast("timestamp_ntz").alias("bucket")).agg(F.count_distinct("device_id").alias("n")).collect()}
    for rolled in (minute, twice):
        got = {r["bucket"]: r["devices"] for r in K.counted(K.coarsen_sketches(rolled, "hour")).collect()}
        assert got.keys() == raw.keys() and all(abs(got[h] - raw[h]) <= 0.03 * raw[h] for h in raw)
    direct = {r["bucket"]: r["devices"] for r in K.counted(K.sketch_rollup(ev, "hour")).collect()}
    assert all(abs(got[h] - direct[h]) <= 0.01 * direct[h] for h in raw)
    assert K.active_devices_from_sketches(minute.limit(0), None).first()["devices"] == 0


def long_form(df, section, bucket_col=None):
    rows = []
    for r in df.collect():
        rows += [(section, r[bucket_col] if bucket_col else None, c, None if r[c] is None else float(r[c])) for c in df.columns if c != bucket_col]
    return rows


@pytest.mark.parametrize("later", [0, 3, 200, 100_000])
def test_the_bundle_is_its_parts_in_one_scan(spark, sf_dir, later):
    now = newest_time(spark, sf_dir) + dt.timedelta(seconds=later)
    ev = telemetry(spark, sf_dir)
    want = long_form(A.hot_metrics(ev, now), "hot_metrics")
    want += long_form(A.temperature_timeseries(ev, 60, now), "temperature_timeseries", "minute") + long_form(A.hourly_summary(ev, 24, now), "hourly_stats", "hour")
    bundle = A.dashboard_bundle(ev, now)
    assert bundle._jdf.queryExecution().executedPlan().toString().count("FileScan parquet") == 1
    assert sorted(map(tuple, bundle.collect()), key=repr) == sorted(want, key=repr)


def test_a_ring_is_read_without_the_stream(spark, sf_dir):
    feed, base = fresh_path(spark, "feed"), fresh_path(spark, "ring")
    as_stored(telemetry(spark, sf_dir)).repartitionByRange(6, "timestamp").write.parquet(feed)
    sink_replay(stream_events(spark, feed, max_files=1), f"{base}/table", f"{base}/checkpoint", 100, every=None).awaitTermination()
    assert sum(rows_read(read_replay(spark, f"{base}/table", 100)).values()) < 300
