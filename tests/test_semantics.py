"""Edge cases on hand-written rows: missing values, empty input, ties, rounding, bounds."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from gaugeworks import functions as fn
from gaugeworks.operators import anomalies as W
from gaugeworks.operators import devices as D
from gaugeworks.operators import filters as Fl
from gaugeworks.operators import quality as Q
from gaugeworks.operators import samples as M
from gaugeworks.operators import summaries as A
from gaugeworks.schema import FRESHNESS_BANDS
from gaugeworks.sources import messages, zero_filled

NOW = "2024-05-01 12:00:00"


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0].asDict()


@pytest.fixture(scope="module")
def few(readings):
    return readings(
        [
            ("2024-05-01 11:59:00", "a", "OK", 1, 20.0, None),
            ("2024-05-01 11:59:30", "a", "WARN", 2, None, None),
            ("2024-05-01 11:59:59.900", "b", "CRITICAL", 3, 0.0, 1000.0),
            ("2024-05-01 11:00:00", "c", "OK", 4, 99.0, 1013.0),
            ("2024-05-01 10:59:59.999", "d", "OK", 5, 10.0, 1013.0),
        ]
    )


def test_missing_values_are_skipped_not_zero(few):
    rows = {r["device_id"]: r for r in A.device_stats(few, "5 minutes", NOW).collect()}
    assert rows["a"]["avg_temperature"] == 20.0 and rows["a"]["avg_pressure"] is None
    assert rows["a"]["message_count"] == 2 and rows["a"]["warning_count"] == 1
    assert rows["b"]["avg_temperature"] == 0.0  # a true zero stays


def test_zero_filled_reproduces_tables_without_null(few):
    rows = {r["device_id"]: r for r in A.device_stats(zero_filled(few), "5 minutes", NOW).collect()}
    assert rows["a"]["avg_temperature"] == 10.0 and rows["a"]["avg_pressure"] == 0.0


def test_lower_bound_is_included_and_newer_rows_stay(few):
    got = {r["device_id"] for r in Fl.trailing(few, "1 hour", NOW).collect()}
    assert got == {"a", "b", "c"}
    assert Fl.trailing(few, "5 minutes", "2024-05-01 11:00:00").count() == 4 + 1


def test_default_time_is_the_newest_row(few):
    assert Fl.trailing(few, "59 minutes").count() == 3


def test_empty_window(few):
    late = "2024-06-01 00:00:00"
    health = one(A.system_health(few, "5 minutes", late))
    assert health["total_events"] == 0 and health["health_score"] == 0.0 and health["avg_temperature"] is None
    assert one(A.status_rate(few, "WARN", "5 minutes", late))["warn_pct"] is None
    assert set(one(A.hot_metrics(few, late)).values()) == {0}
    assert A.device_stats(few, "5 minutes", late).count() == 0
    assert one(Q.quality_metrics(few, "1 hour", late))["data_completeness"] == 100.0


def test_empty_table(few):
    empty = few.limit(0)
    assert one(Q.freshness_trigger(empty, NOW)) == {
        "fire": False, "age_seconds": None, "run_key": None, "reason": "no data"
    }
    assert one(Q.freshness(empty, NOW))["band"] is None
    assert D.replay_buffer(empty, 10).count() == 0
    assert W.detect_spikes(empty, "temperature").count() == 0
    assert W.detect_stuck(empty, "temperature").count() == 0


def test_seconds_count_boundaries(spark):
    at = lambda s: F.lit(s).cast("timestamp_ntz")
    got = spark.range(1).select(fn.seconds_between(at("2024-01-01 00:00:00.9"), at("2024-01-01 00:00:01.1"))).first()[0]
    assert got == 1


def test_rounding_is_half_up(spark):
    df = spark.createDataFrame([(2.5, 0), (0.125, 2), (-0.5, 0)], "x double, d int")
    got = [r[0] for r in df.select(F.when(F.col("d") == 0, fn.rounded("x", 0)).otherwise(fn.rounded("x", 2))).collect()]
    assert got == [3.0, 0.13, 0.0]


def test_ties_settled_by_message_number_in_any_row_order(readings):
    rows = [("2024-05-01 11:59:00", "a", "OK", i, float(i), None) for i in range(50)]
    for order in (rows, rows[::-1], rows[25:] + rows[:25]):
        ev = readings(order).repartition(7)
        assert one(D.latest_events(ev, "5 minutes", NOW))["temperature"] == 49.0
        assert one(A.device_leaderboard(ev, "1 hour", 5, NOW))["total_events"] == 50


def test_latest_value_may_be_missing(readings):
    ev = readings([("2024-05-01 11:58:00", "a", "OK", 1, 5.0, 1.0), ("2024-05-01 11:59:00", "a", "OK", 2, None, 2.0)])
    got = one(D.latest_events(ev, "5 minutes", NOW))
    assert got["temperature"] is None and got["pressure"] == 2.0


def test_latest_reading_of_an_unknown_device(spark, sf_dir):
    from gaugeworks.sources.sample_tables import telemetry

    assert D.latest_reading(telemetry(spark, sf_dir), "device-none").count() == 0


def test_status_follows_the_direction_of_its_limits(spark):
    rows = [(20.0, 3.3, 100.0), (36.0, 3.3, 100.0), (20.0, 2.8, 100.0), (36.0, 2.4, 100.0), (20.0, 3.3, 10.0), (None, None, None)]
    df = spark.createDataFrame(rows, "temperature double, voltage double, battery_level double")
    got = [r["status"] for r in Fl.assign_status(df).collect()]
    assert got == ["OK", "WARN", "WARN", "CRITICAL", "CRITICAL", "OK"]


def test_completeness_of_whole_rows_is_100(readings):
    ev = readings([("2024-05-01 11:59:00", "a", "OK", i, 20.0, 1000.0) for i in range(4)])
    q = Q.quality_metrics(ev, "1 hour", NOW)
    assert one(q)["data_completeness"] == 100.0 and Q.quality_alerts(q).count() == 0
    half = readings([("2024-05-01 11:59:00", "a", "OK", i, 20.0, None) for i in range(4)])
    assert one(Q.quality_alerts(Q.quality_metrics(half, "1 hour", NOW)))["data_completeness"] == 50.0


def test_bands(spark):
    df = spark.createDataFrame([(59,), (60,), (299,), (300,), (None,)], "s int")
    got = [r["band"] for r in Fl.band(df, "s", FRESHNESS_BANDS).collect()]
    assert got == ["green", "yellow", "yellow", "red", None]


def test_argument_bounds(few):
    for call in (
        lambda: A.temperature_timeseries(few, 4), lambda: A.hourly_summary(few, 169),
        lambda: A.device_leaderboard(few, limit=0), lambda: A.events_per_minute(few, 1441),
        lambda: Fl.trailing(few, "5 minutes; drop", NOW), lambda: fn.bucket("timestamp", "week"),
    ):
        with pytest.raises(ValueError):
            call()


def test_stale_devices(readings):
    ev = readings(
        [("2024-05-01 11:59:00", "live", "OK", 1, 1.0, 1.0), ("2024-05-01 11:54:59", "quiet", "OK", 2, 1.0, 1.0),
         ("2024-05-01 11:10:00", "gone", "OK", 3, 1.0, 1.0), ("2024-05-01 10:00:00", "old", "OK", 4, 1.0, 1.0)]
    )
    assert one(D.stale_device_count(ev, as_of=NOW))["stale_devices"] == 2
    got = {r["device_id"]: (r["age_seconds"], r["band"]) for r in D.stale_devices(ev, as_of=NOW).collect()}
    assert got == {"quiet": (301, "yellow"), "gone": (3000, "red")}


def test_presence_without_a_time(spark):
    rows = [("a", '{"online":true,"timestamp":1735654321000}', 1), ("a", '{"online":false}', 2),
            ("b", '{"online":false}', 1), ("b", '{"online":true,"timestamp":1735654321000}', 2)]
    got = {r["device_id"]: r for r in D.device_presence(spark.createDataFrame(rows, "device_id string, message string, seq long")).collect()}
    assert got["a"]["online"] is False and got["a"]["last_notice"] == dt.datetime(2024, 12, 31, 14, 12, 1)
    assert got["b"]["online"] is True


def test_unknown_devices_keep_their_row(spark):
    df = spark.createDataFrame([("a",), ("zz",)], "device_id string")
    meta = spark.createDataFrame([("a", "Pump")], "device_id string, device_name string")
    got = {r["device_id"]: r["device_name"] for r in D.with_device_metadata(df, meta).collect()}
    assert got == {"a": "Pump", "zz": None}


def test_messages(spark):
    texts = [
        '{"timestamp":"2025-12-19T10:30:00.123456Z","device_id":"device-0001","device_type":"multi-sensor",'
        '"location":"lobby","status":"OK","msg_id":12345,"temperature":25.42}',
        '{"timestamp":"2025-12-19T12:30:00.000+02:00","device_id":"device-0002","temperature":0.0}',
        '{"timestamp":"2025-12-19T10:30:00', "not json", '{"timestamp":"yesterday","device_id":"device-0003"}', "",
    ]
    df = spark.createDataFrame([(t,) for t in texts], "message string")
    parsed = messages.parse_messages(df)
    good = parsed.filter("rejected is null").orderBy("device_id").collect()
    assert [g["device_id"] for g in good] == ["device-0001", "device-0002"]
    assert good[0]["timestamp"] == dt.datetime(2025, 12, 19, 10, 30, 0, 123000) and good[0]["pressure"] is None
    assert good[1]["timestamp"] == dt.datetime(2025, 12, 19, 10, 30) and good[1]["temperature"] == 0.0
    assert {r["rejected"] for r in messages.rejected_messages(parsed).collect()} == set(texts[2:])


def test_alternate_message(spark):
    text = '{"deviceId":"device-00042-xkcd","timestamp":1735654321000,"temperature":23.45,"humidity":58.32,"pressure":1015.67,"padding":"xxx"}'
    got = one(messages.normalise_alt_messages(spark.createDataFrame([(text,)], "message string")))
    assert got == {
        "timestamp": dt.datetime(2024, 12, 31, 14, 12, 1), "device_id": "device-00042-xkcd",
        "temperature": 23.45, "humidity": 58.32, "pressure": 1015.67,
    }


def test_readable_numbers(spark):
    df = spark.createDataFrame([(0,), (999,), (1000,), (1536,), (12_345_678,), (3 * 1024**4,)], "n long")
    got = [tuple(r) for r in df.select(fn.readable_size("n"), fn.readable_quantity("n"), fn.short_count("n")).collect()]
    assert got == [
        ("0.00 B", "0.00", "0"), ("999.00 B", "999.00", "999"), ("1000.00 B", "1.00 thousand", "1.0K"),
        ("1.50 KiB", "1.54 thousand", "1.5K"), ("11.77 MiB", "12.35 million", "12.3M"),
        ("3.00 TiB", "3.30 trillion", "3298534.9M"),
    ]


def test_counter_reset(spark):
    rows = [("c", "a", f"2024-05-01 11:{50 + i}:00", v) for i, v in enumerate([10.0, 40.0, 5.0, 15.0])]
    df = spark.createDataFrame(rows, "metric string, device string, t string, value double").select(
        "metric", F.create_map(F.lit("device"), "device").alias("labels"), F.col("t").cast("timestamp_ntz").alias("ts"), "value"
    )
    got = one(M.counter_rate(df, "c", "30 minutes", NOW))
    assert got["rate"] == (30 + 5 + 10) / 1800 and got["series"] == '{"device":"a"}'


def test_labels_in_another_order_are_one_series(spark):
    df = spark.sql(
        "select 'g' metric, map('a','1','b','2') labels, timestamp_ntz'2024-01-01 00:00:00' ts, 1D value "
        "union all select 'g', map('b','2','a','1'), timestamp_ntz'2024-01-01 00:01:00', 2D"
    )
    assert one(M.gauge_latest(df, "g"))["value"] == 2.0
    assert one(M.sum_where(df, "g", {"b": "2"}))["total"] == 2.0


def test_a_gauge_that_stopped_shows_no_value(spark):
    rows = [("g", "old", "11:50", 1.0), ("g", "new", "11:58", 2.0), ("all", "old", "11:50", 4.0), ("all", "new", "11:58", 4.0), ("g", "late", "12:01", 9.0)]
    df = spark.createDataFrame(rows, "metric string, device string, t string, value double").select(
        "metric", F.create_map(F.lit("device"), "device").alias("labels"),
        F.concat(F.lit("2024-05-01 "), "t").cast("timestamp_ntz").alias("ts"), "value",
    )
    at = "2024-05-01 12:00:00"
    assert one(M.gauge_latest(df, "g", as_of=at))["value"] == 2.0
    assert one(M.gauge_ratio(df, "g", "all", as_of=at))["used_pct"] == 50.0
    assert one(M.sum_where(df, "g", {"device": "old"}, as_of=at))["total"] is None
    assert M.gauge_latest(df, "g", None).count() == 3
    assert {r["value"] for r in M.gauge_latest(df, "g").collect()} == {2.0, 9.0}


def test_histogram(spark):
    df = spark.createDataFrame([(0.01,), (0.02,), (7.0,), (None,)], "v double")
    got = {r["le"]: r["bucket"] for r in M.bucket_histogram(df, "v", [0.01, 0.05, 5]).collect()}
    assert got == {"0.01": 1, "0.05": 2, "5": 2, "+Inf": 3}


def test_dropouts_only_where_the_type_reports(readings):
    rows = [("2024-05-01 11:59:00", "a", "OK", 1, None, None), ("2024-05-01 11:59:01", "a", "OK", 2, 0.0, 3.0)]
    assert W.detect_dropouts(readings(rows), "temperature").count() == 2
    assert W.detect_dropouts(readings(rows, "pressure-sensor"), "temperature").count() == 0
    assert W.detect_dropouts(readings(rows, "pressure-sensor"), "pressure").count() == 1


def test_device_names_keep_long_numbers(spark, tmp_path):
    from gaugeworks.sources import sample_tables as S

    df = spark.createDataFrame([(1, "2024-01-01 00:00:00", u, "view", 1.0, '{"k": 1}') for u in (0, 9999, 123455)],
                               "event_id long, t string, user_id long, event_type string, value double, props string")
    df.withColumn("ts", F.col("t").cast("timestamp_ntz")).drop("t").write.parquet(f"{tmp_path}/events.parquet")
    got = {r["device_id"] for r in S.telemetry(spark, str(tmp_path)).collect()}
    assert got == {"device-0001", "device-10000", "device-123456"}


def test_sketches_stay_close(spark, sf_dir):
    from gaugeworks.operators import rollups as R
    from gaugeworks.sources.sample_tables import telemetry

    ev = telemetry(spark, sf_dir)
    exact, close = A.active_devices(ev, None).first()[0], A.active_devices(ev, None, approx=True).first()[0]
    assert abs(exact - close) <= 0.1 * exact
    day = R.rollup(ev, "day")
    assert abs(one(R.daily_coverage(day))["unique_devices"] - one(R.daily_coverage(day, approx=True))["unique_devices"]) <= 2
    for build in (A.system_health, A.hourly_stats, A.hot_metrics, A.quality_by_location, Q.quality_metrics):
        assert build(ev, approx=True).count() == build(ev).count()
