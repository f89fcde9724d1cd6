"""Shapes of the physical plans that must hold at scale."""

import re

import pytest
from compare import rows_read
from pyspark.sql import functions as F

from gaugeworks.operators import devices as D
from gaugeworks.operators import filters as Fl
from gaugeworks.operators import summaries as A
from gaugeworks.plans.catalog import QUERIES

BATCH = [n for n in QUERIES if not n.startswith(("stream_", "dual_write"))]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", BATCH)
def test_no_cross_join_and_no_python_in_the_hot_path(spark, sf_dir, name):
    plan = plan_of(QUERIES[name](spark, sf_dir))
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "MapInPandas", "FlatMapGroups"):
        assert word not in plan


@pytest.mark.parametrize("name", ["device_stats", "system_health", "hot_metrics", "device_leaderboard", "quality_metrics"])
def test_time_bound_reaches_the_scan(spark, sf_dir, name):
    assert "GreaterThanOrEqual(ts," in plan_of(QUERIES[name](spark, sf_dir))


def test_default_time_is_pushed_down_when_the_query_runs(spark, sf_dir):
    ev = spark.read.parquet(f"{sf_dir}/events.parquet").withColumnRenamed("ts", "timestamp").withColumnRenamed("user_id", "device_id")
    recent = Fl.trailing(ev, "5 hours").select("device_id")
    assert re.search(r"PushedFilters: \[[^]]*GreaterThanOrEqual\(ts,ScalarSubquery", plan_of(recent))


def test_columns_are_pruned(spark, sf_dir):
    ev = spark.read.parquet(f"{sf_dir}/events.parquet").withColumnRenamed("ts", "timestamp").withColumnRenamed("user_id", "device_id")
    plan = plan_of(A.active_devices(ev, "1 hour", "2024-01-30 00:00:00"))
    assert "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint>" in plan


def test_ranking_is_a_top_k(spark, sf_dir):
    assert "TakeOrderedAndProject" in plan_of(QUERIES["busiest_devices_20"](spark, sf_dir))


def test_aggregates_combine_before_the_shuffle(spark, sf_dir):
    plan = plan_of(QUERIES["rollup_minute"](spark, sf_dir))
    assert plan.count("HashAggregate") >= 2 and "partial_sum" in plan and plan.count("Exchange") == 1


def test_one_scan_for_several_windows(spark, sf_dir):
    plan = plan_of(QUERIES["hot_metrics"](spark, sf_dir))
    assert plan.count("FileScan parquet") == 1


def test_staleness_needs_no_join(spark, sf_dir):
    from gaugeworks.sources.sample_tables import telemetry

    plan = plan_of(D.stale_device_count(telemetry(spark, sf_dir), as_of="2024-01-01 12:00:00"))
    assert "Join" not in plan and plan.count("FileScan") == 1


def test_series_are_never_ordered_whole(spark, sf_dir):
    """The only windows over a series as a whole run on chunk summaries, after an aggregate."""
    for name in ("temperature_spikes", "stuck_temperature"):
        plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
        for line in plan.splitlines():
            if "Window [" in line and "_chunk" not in line.split("windowspec")[0]:
                over = re.findall(r"windowspecdefinition\(([^)]*)", line)
                assert all("_chunk" in o or "_run" in o for o in over), line


@pytest.mark.parametrize("name", ["temperature_spikes", "stuck_temperature", "counter_rate_all"])
def test_ordered_work_reads_the_rows_once(spark, sf_dir, name):
    """The count of crowded stretches is a job of its own; the query itself scans and shuffles the rows once."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    assert rows_read(QUERIES[name](spark, sf_dir)) == {"events.parquet": events}


def test_metadata_lookup_leaves_the_choice_to_size(spark):
    big = spark.range(10).select(F.col("id").cast("string").alias("device_id"))
    joined = D.with_device_metadata(big, big)
    assert "ResolvedHint" not in joined._jdf.queryExecution().analyzed().toString()


def test_filters_reach_through_the_views(spark, sf_dir):
    from gaugeworks.plans.views import register_views

    ev = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr(
        "ts as timestamp", "cast(user_id as string) as device_id", "event_type as device_type", "event_type as location",
        "event_type as status", "event_id as msg_id", "value as temperature", "value as pressure", "value as humidity",
        "value as battery_level",
    )
    names = register_views(ev, "2024-01-30 00:00:00", "checked_")
    assert len(names) == 6 and all(spark.catalog.tableExists(n) for n in names)
    plan = plan_of(spark.sql("SELECT sum(events) FROM checked_events_day WHERE location = 'view'"))
    assert "EqualTo(event_type,view)" in plan and "value" not in plan.split("ReadSchema")[1]


@pytest.mark.parametrize("name", [
    "latest_readings", "latest_events", "device_status", "device_leaderboard", "device_presence", "latest_reading_of_device",
])
def test_newest_values_do_not_sort_the_rows(spark, sf_dir, name):
    plan = plan_of(QUERIES[name](spark, sf_dir))
    assert "SortAggregate" not in plan and plan.count("HashAggregate") >= 2
