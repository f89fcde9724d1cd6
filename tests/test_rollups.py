"""The algebra of rollups: whatever way they are put together, the numbers are those of the events."""

import pytest
from pyspark.sql import functions as F

from gaugeworks.functions import instant
from gaugeworks.operators import rollups as R
from gaugeworks.operators import summaries as A
from gaugeworks.session import fresh_path
from gaugeworks.sources.sample_tables import newest_time, telemetry


def rows(df):
    columns = sorted(df.columns)
    return sorted([tuple(r) for r in df.select(*columns).collect()], key=repr)


@pytest.fixture(scope="module")
def ev(spark, sf_dir):
    return telemetry(spark, sf_dir).persist()


def test_split_loads_merge_to_the_whole(ev):
    part = F.col("msg_id") % 3
    thirds = [R.rollup(ev.filter(part == i)) for i in range(3)]
    merged = R.merge_rollup(R.merge_rollup(thirds[0], thirds[1]), thirds[2])
    other_way = R.merge_rollup(thirds[2], R.merge_rollup(thirds[1], thirds[0]))
    assert rows(merged) == rows(R.rollup(ev)) == rows(other_way)


def test_coarse_from_fine(ev):
    minute = R.rollup(ev, "minute", R.HOUR_METRICS)
    assert rows(R.coarsen(minute, "hour")) == rows(R.rollup(ev, "hour"))
    assert rows(R.coarsen(R.coarsen(minute, "hour"), "day")) == rows(R.coarsen(minute, "day")) == rows(R.rollup(ev, "day"))


def test_same_answers_as_the_raw_queries(ev):
    whole_minute = "2024-01-01 11:30:00"
    minute = R.rollup(ev)
    assert rows(R.device_stats_from_rollup(minute, "5 minutes", whole_minute)) == rows(A.device_stats(ev, "5 minutes", whole_minute))
    raw = A.timeseries(ev, "1 hour", "minute", whole_minute).select(
        F.col("minute").alias("bucket"), F.col("event_count").alias("events"), "avg_temperature"
    )
    assert rows(R.trend_from_rollup(minute, "1 hour", whole_minute)) == rows(raw)


def test_extremes_are_not_added_up(readings):
    ev = readings([("2024-05-01 11:59:00", "a", "OK", 1, 10.0, None), ("2024-05-01 11:59:01", "a", "OK", 2, 30.0, None)])
    twice = R.merge_rollup(R.rollup(ev), R.rollup(ev)).first()
    assert (twice["events"], twice["min_temperature"], twice["max_temperature"], twice["sum_temperature"]) == (4, 10.0, 30.0, 80.0)
    assert twice["n_pressure"] == 0 and twice["sum_pressure"] is None


def test_a_moved_device_keeps_both_places(readings):
    ev = readings([("2024-05-01 11:59:00", "a", "OK", 1, 10.0, None), ("2024-05-01 11:59:01", "a", "OK", 2, 30.0, None)])
    moved = ev.withColumn("location", F.when(F.col("msg_id") == 1, "roof").otherwise("lobby"))
    assert {r["location"] for r in R.rollup(moved).collect()} == {"roof", "lobby"}


def test_refresh_replaces_only_changed_days_and_repeats_safely(spark, sf_dir):
    ev = telemetry(spark, sf_dir, compression=1)
    path = fresh_path(spark, "rollup")
    ends = "2024-01-20 08:00:00"
    R.write_rollup(R.rollup(ev.filter(F.col("timestamp") < instant(ends))), path, "minute")
    files = lambda day: {r[0] for r in spark.read.parquet(path).filter(F.col("part").cast("string") == day).select("_metadata.file_path").distinct().collect()}
    before = files("20240110")
    for _ in range(2):
        out = R.refresh_rollup(spark, path, ev, ends, "minute").drop("part")
    assert rows(out) == rows(R.rollup(ev))
    assert files("20240110") == before


def test_default_time_of_a_rollup_is_its_newest_bucket(spark, sf_dir, ev):
    minute = R.rollup(ev)
    newest = newest_time(spark, sf_dir).replace(second=0, microsecond=0)
    assert rows(R.trend_from_rollup(minute, "1 hour")) == rows(R.trend_from_rollup(minute, "1 hour", newest))


def test_unknown_grain(ev):
    with pytest.raises(ValueError):
        R.rollup(ev, "week")
