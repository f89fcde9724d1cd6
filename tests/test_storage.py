"""Stored tables: layout, pruning, retention, archive, compaction, snapshots."""

import pytest
from pyspark.sql import functions as F

from gaugeworks.operators import folders
from gaugeworks.operators import maintenance as X
from gaugeworks.operators import quality as Q
from gaugeworks.operators.devices import latest_newest_first, latest_per, replay_buffer
from gaugeworks.operators.filters import trailing
from gaugeworks.plans.tables import _stretched, as_stored
from gaugeworks.session import fresh_path
from gaugeworks.sinks import archive_expired, publish_snapshot, write_events, write_indexed
from gaugeworks.sources import narrow, read_events, read_month_range, read_ranking, read_snapshot, snapshot_or
from gaugeworks.sources.sample_tables import telemetry


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def year(spark, sf_dir):
    """Events spread over a year, in the month layout."""
    path = fresh_path(spark, "events")
    write_events(_stretched(spark, sf_dir), path, files=24)
    return path


def ids(df):
    return sorted(r[0] for r in df.select("msg_id").collect())


def test_layout_round_trip(spark, sf_dir, year):
    assert ids(read_events(spark, year)) == ids(telemetry(spark, sf_dir))
    assert read_events(spark, year).filter("temperature is null").count() > 0
    assert read_events(spark, year, missing_as_zero=True).filter("temperature is null").count() == 0


def test_given_time_prunes_months_and_reaches_the_scan(spark, year):
    recent = narrow(trailing(read_events(spark, year), "30 days", "2024-12-20 00:00:00"))
    text = plan_of(recent)
    assert "PartitionFilters: [isnotnull(yyyymm" in text and "GreaterThanOrEqual(timestamp,2024-11-20T00:00)" in text
    assert "humidity" not in text.split("ReadSchema")[1]
    assert {r["f"].split("yyyymm=")[1][:6] for r in trailing(read_events(spark, year), "30 days", "2024-12-20 00:00:00")
            .select(F.col("_metadata.file_path").alias("f")).collect()} <= {"202411", "202412"}


def test_default_time_prunes_months_when_the_query_starts(spark, year):
    recent = trailing(read_events(spark, year), "30 days").select("msg_id", F.col("_metadata.file_path").alias("f"))
    text = plan_of(recent)
    assert text.count("PartitionFilters: [isnotnull(yyyymm") >= 2  # the newest month, and the months of the span
    assert {r["f"].split("yyyymm=")[1][:6] for r in recent.collect()} <= {"202411", "202412"}
    newest = read_events(spark, year).agg(F.max("timestamp")).first()[0]
    assert ids(recent) == ids(trailing(read_events(spark, year), "30 days", newest))


@pytest.mark.parametrize("n", [1, 50, 300, 10_000])
def test_replay_buffer_reads_only_the_months_it_needs(spark, year, n):
    table = read_events(spark, year)
    want = [r[0] for r in table.orderBy(F.desc("timestamp"), F.desc("msg_id")).select("msg_id").collect()][:n]
    held = replay_buffer(table.withColumn("f", F.col("_metadata.file_path")), n).collect()
    assert [r["msg_id"] for r in held] == want
    if n == 1:
        assert {r["f"].split("yyyymm=")[1][:6] for r in held} == {"202412"}


def test_freshness_of_a_stored_table(spark, year):
    table = read_events(spark, year)
    newest = table.agg(F.max("timestamp")).first()[0]
    assert Q.freshness(table, newest).first()["lag_seconds"] == 0
    assert Q.freshness(table).first()["band"] == "green"


def test_month_range(spark, year):
    months = read_month_range(spark, year, "202403", "202404").select("yyyymm").distinct().collect()
    assert {r[0] for r in months} == {"202403", "202404"}


def test_rows_are_sorted_inside_files(spark, year):
    files = [r[0] for r in spark.read.parquet(year).select("_metadata.file_path").distinct().collect()]
    got = [tuple(r) for r in spark.read.parquet(files[0]).select("device_id", "timestamp").collect()]
    assert got == sorted(got)


def test_bloom_filters_and_dictionaries_are_written(spark, sf_dir, sql):
    path = fresh_path(spark, "indexed")
    write_indexed(as_stored(telemetry(spark, sf_dir)), path, expected_devices=1000)
    device = "device-0003"
    assert read_events(spark, path).filter(F.col("device_id") == device).count() == telemetry(spark, sf_dir).filter(
        F.col("device_id") == device).count()
    meta = sql.sql(
        f"SELECT path_in_schema, bloom_filter_offset, encodings FROM parquet_metadata('{path}/**/*.parquet')"
    ).fetchall()
    assert all("DICTIONARY" in e for c, _, e in meta if c in ("status", "location", "device_id"))

    # A column too varied for a dictionary gets its Bloom filter.
    varied = spark.range(400_000).select(F.sha2(F.col("id").cast("string"), 256).alias("device_id"), "id")
    ev = varied.join(as_stored(telemetry(spark, sf_dir)).drop("device_id").limit(1))
    path = fresh_path(spark, "indexed")
    write_indexed(ev, path, expected_devices=100_000)
    meta = sql.sql(
        f"SELECT path_in_schema, bloom_filter_offset FROM parquet_metadata('{path}/**/*.parquet')"
    ).fetchall()
    assert {c for c, bloom in meta if bloom is not None} == {"device_id"}


def test_compaction_keeps_every_row_in_fewer_files(spark, sf_dir):
    path = fresh_path(spark, "events")
    for i in range(3):
        write_events(_stretched(spark, sf_dir).filter(F.col("msg_id") % 3 == i), path, files=12)
    before = X.partition_inventory(spark, path).agg(F.sum("files"), F.sum("rows")).first()
    expected = ids(spark.read.parquet(path))
    X.compact(spark, path, "yyyymm", ("device_id", "timestamp"))
    after = X.partition_inventory(spark, path).agg(F.sum("files"), F.sum("rows")).first()
    assert ids(spark.read.parquet(path)) == expected
    assert after[1] == before[1] and after[0] < before[0] / 2


def test_compaction_of_one_month_leaves_the_others(spark, sf_dir):
    path = fresh_path(spark, "events")
    write_events(_stretched(spark, sf_dir), path, files=40)
    files = lambda: {r[0] for r in spark.read.parquet(path).filter("yyyymm <> 202405").select("_metadata.file_path").distinct().collect()}
    before, expected = files(), ids(spark.read.parquet(path))
    X.compact(spark, path, "yyyymm", ("device_id", "timestamp"), only=("202405",))
    assert files() == before and ids(spark.read.parquet(path)) == expected


def test_a_second_compaction_rewrites_nothing(spark, sf_dir):
    path = fresh_path(spark, "events")
    for i in range(4):
        write_events(_stretched(spark, sf_dir).filter(F.col("msg_id") % 4 == i), path, files=40)
    files = lambda: {r[0] for r in spark.read.parquet(path).select("_metadata.file_path").distinct().collect()}
    expected, done = ids(spark.read.parquet(path)), []
    for _ in range(2):
        done.append((X.compact_all(spark, {"events": (path, "yyyymm", ("device_id", "timestamp"))}).first()["result"], files()))
    assert [r for r, _ in done] == ["optimized", "unchanged"] and done[0][1] == done[1][1]
    assert ids(spark.read.parquet(path)) == expected


def test_compaction_sorts_a_bounded_number_of_rows_a_task(spark, sf_dir, monkeypatch):
    """Files are small and rows many: tasks follow the rows, and a second compaction still rewrites nothing."""
    path = fresh_path(spark, "events")
    ev = as_stored(telemetry(spark, sf_dir))
    write_events(ev, path, files=64)
    monkeypatch.setattr(folders, "SORT_BYTES", ev.count() * folders._row_bytes(spark.read.parquet(path)) // 4 + 1)
    done = lambda: X.compact_all(spark, {"events": (path, "yyyymm", ("device_id", "timestamp"))}).first()["result"]
    assert done() == "optimized"
    table = spark.read.parquet(path)
    spans = table.groupBy(F.input_file_name()).agg(F.count(F.lit(1)).alias("n")).collect()
    assert len(spans) >= 4 and max(r["n"] for r in spans) < ev.count() / 2
    assert table.drop("yyyymm").exceptAll(ev).isEmpty() and table.count() == ev.count()
    assert done() == "unchanged"


def test_compaction_reports_failures(spark, sf_dir):
    path = fresh_path(spark, "events")
    for i in range(4):
        write_events(_stretched(spark, sf_dir).filter(F.col("msg_id") % 4 == i), path, files=40)
    got = X.compact_all(spark, {
        "gone": (path + "-gone", "yyyymm", ("device_id",)), "events": (path, "yyyymm", ("device_id", "timestamp")),
    })
    assert {r["table"]: r["result"] for r in got.collect()} == {"gone": "error: PATH_NOT_FOUND", "events": "optimized"}


@pytest.mark.parametrize("as_of", ["2024-12-20 12:00:00", "2024-12-30 00:00:00", "2026-01-01 00:00:00"])
def test_retention_job_equals_the_filter(spark, sf_dir, as_of):
    path = fresh_path(spark, "events")
    write_events(_stretched(spark, sf_dir), path)
    table = spark.read.parquet(path)
    kept, gone = ids(Q.apply_retention(table, "90 days", as_of)), ids(Q.expired(table, "90 days", as_of))
    assert sorted(kept + gone) == ids(table)
    X.drop_expired_partitions(spark, path, "90 days", as_of)
    left = ids(read_events(spark, path))
    assert left == kept


def test_archive_and_live_rows_make_the_whole(spark, sf_dir):
    path = fresh_path(spark, "archive")
    ev = _stretched(spark, sf_dir)
    for _ in range(2):  # repeating a run adds nothing
        archive_expired(ev, path, "30 days", "2024-12-20 00:00:00")
    cold = ids(spark.read.parquet(path))
    assert sorted(cold + ids(Q.apply_retention(ev, "30 days", "2024-12-20 00:00:00"))) == ids(ev)


def test_snapshots_expire_and_are_replaced_by_key(spark):
    store = fresh_path(spark, "snapshots")
    df = spark.createDataFrame([(1, None), (2, "x")], "a int, b string")
    publish_snapshot(df, store, "one", 120, "2024-05-01 12:00:00")
    publish_snapshot(df.filter("a = 2"), store, "two", 120, "2024-05-01 12:00:00")
    read = lambda key, at: sorted(tuple(r) for r in read_snapshot(spark, store, key, df.schema, at).collect())
    assert read("one", "2024-05-01 12:01:59") == [(1, None), (2, "x")]
    assert read("one", "2024-05-01 12:02:00") == [] and read("none", "2024-05-01 12:00:00") == []
    publish_snapshot(df.filter("a = 1"), store, "one", 120, "2024-05-01 12:01:00")
    assert read("one", "2024-05-01 12:02:30") == [(1, None)] and read("two", "2024-05-01 12:01:00") == [(2, "x")]


def test_a_set_keeps_its_order(spark):
    store, now = fresh_path(spark, "snapshots"), "2024-05-01 12:00:00"
    many = spark.range(0, 5000, 1, 7).select((F.col("id") * 7919 % 5000).alias("n"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several files
    try:
        publish_snapshot(many.orderBy(F.desc("n")), store, "falling", 120, now)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert spark.read.parquet(store).select(F.input_file_name()).distinct().count() > 2
    read = read_snapshot(spark, store, "falling", many.schema, now, ordered=True)
    assert [r["n"] for r in read.collect()] == list(range(4999, -1, -1))
    top = read_ranking(spark, store, "falling", many.schema, now, 3)
    assert [tuple(r) for r in top.orderBy("rank").collect()] == [(1, 4999), (2, 4998), (3, 4997)]
    publish_snapshot(many.limit(0), store, "falling", 120, now)
    assert read_ranking(spark, store, "falling", many.schema, now, 3).isEmpty()


def test_an_empty_result_replaces_an_older_one(spark):
    store = fresh_path(spark, "snapshots")
    df = spark.createDataFrame([(1, None), (2, "x")], "a int, b string")
    publish_snapshot(df, store, "dash:one", 120, "2024-05-01 12:00:00")
    assert read_snapshot(spark, store, "dash:one", df.schema, "2024-05-01 12:00:10").count() == 2
    publish_snapshot(df.limit(0), store, "dash:one", 120, "2024-05-01 12:00:00")
    assert read_snapshot(spark, store, "dash:one", df.schema, "2024-05-01 12:00:10").count() == 0
    served = lambda at: snapshot_or(spark, store, "dash:one", df.schema, at, lambda: df).count()
    assert served("2024-05-01 12:00:10") == 0 and served("2024-05-01 12:02:00") == 2


def test_missing_store_falls_back(spark):
    df = spark.createDataFrame([(1,)], "a int")
    got = snapshot_or(spark, fresh_path(spark, "nothing"), "k", df.schema, "2024-05-01 12:00:00", lambda: df)
    assert got.count() == 1


def test_json_scan(spark, sf_dir):
    from gaugeworks.sources import to_messages

    path = fresh_path(spark, "json")
    ev = telemetry(spark, sf_dir)
    to_messages(ev).write.text(path)
    back = read_events(spark, path, "json")
    assert back.schema["temperature"].dataType.simpleString() == "float"
    assert ids(back) == ids(ev)
    assert back.agg(F.max("timestamp")).first() == ev.agg(F.max("timestamp")).first()
    with pytest.raises(ValueError):
        read_events(spark, path, "csv")


@pytest.mark.parametrize("part", ["hourly", "2024"])
def test_retention_refuses_other_partitions(spark, part):
    path = fresh_path(spark, "odd")
    df = spark.createDataFrame([("d", "2020-01-01 00:00:00", part)], "device_id string, timestamp string, yyyymm string")
    df.withColumn("timestamp", df["timestamp"].cast("timestamp_ntz")).write.partitionBy("yyyymm").parquet(path)
    with pytest.raises(ValueError):
        X.drop_expired_partitions(spark, path, "7 days", "2024-12-20 12:00:00")
    assert spark.read.parquet(path).count() == 1


def test_newest_first_reads_only_what_it_needs(spark, year):
    """Devices that all spoke in the newest month are found there; one that fell silent is looked for further back."""
    table = read_events(spark, year)
    columns = ["timestamp", "msg_id", "temperature", "status"]
    whole = {tuple(r) for r in latest_per(table, ["device_id"], columns).collect()}
    newest = {r[0] for r in table.filter("yyyymm = '202412'").select("device_id").distinct().collect()}
    some = spark.createDataFrame([(d,) for d in sorted(newest)[:5]], "device_id string")
    one = latest_newest_first(table, some, columns, parts=sorted({str(r[0]) for r in table.select("yyyymm").distinct().collect()} | {"209901"}))
    assert {tuple(r) for r in one.collect()} == {r for r in whole if r[0] in {d[0] for d in some.collect()}}
    everyone = table.select("device_id").distinct().unionByName(spark.createDataFrame([("none",)], "device_id string"))
    assert {tuple(r) for r in latest_newest_first(table, everyone, columns).collect()} == whole
    assert latest_newest_first(table.limit(0), some, columns).collect() == []


def test_newest_first_stops(spark, year, monkeypatch):
    """Folders older than the last one needed may be unreadable."""
    table = read_events(spark, year)
    newest = table.filter("yyyymm = '202412'").select("device_id").distinct()
    bad = F.when(F.col("yyyymm") < "202412", F.raise_error(F.lit("read"))).otherwise(F.col("temperature"))
    broken = table.withColumn("temperature", bad)
    assert latest_newest_first(broken, newest, ["timestamp", "msg_id", "temperature"], parts=["202410", "202411", "202412"]).count() == newest.count()


def test_newest_row_of_odd_rows(spark):
    rows = [("a", None, 5, "OK", 1.0), ("a", None, None, "WARN", 2.0), ("b", "2024-05-01 00:00:00", None, "x" * 60, None),
            ("b", "1969-12-31 23:59:59", 9, None, 1.0), ("c", "2024-05-01 00:00:00", -(2**63), "OK", 1.0), ("c", "2024-05-01 00:00:00", 2**63 - 1, None, 2.0)]
    df = spark.createDataFrame(rows, "device_id string, t string, msg_id long, status string, temperature double").withColumn("timestamp", F.col("t").cast("timestamp_ntz"))
    got = {r["device_id"]: (r["status"], r["temperature"], r["msg_id"]) for r in latest_per(df, ["device_id"], ["timestamp", "msg_id", "status", "temperature"]).collect()}
    assert got == {"a": ("OK", 1.0, 5), "b": ("x" * 60, None, None), "c": (None, 2.0, 2**63 - 1)}
