"""The tiered read gives what the raw events give, and reads of them only the cut ends."""

import datetime as dt
import random

import pytest
from compare import rows_read
from pyspark.sql import functions as F

from gaugeworks.operators import rollups as R
from gaugeworks.operators import summaries as A
from gaugeworks.operators import tiers as Z
from gaugeworks.session import fresh_path
from gaugeworks.sinks import publish_snapshot
from gaugeworks.sources.sample_tables import telemetry

START, END = dt.datetime(2024, 5, 1), dt.datetime(2024, 5, 4)


def at(text):
    return dt.datetime.fromisoformat(f"2024-05-{text}")


def rows(df):
    columns = sorted(df.columns)
    return sorted([tuple(r) for r in df.select(*columns).collect()], key=repr)


def test_a_cover_holds_every_moment_once():
    rng = random.Random(4)
    for _ in range(300):
        complete = {}
        for tier in Z.TIERS:
            cuts = sorted(START + dt.timedelta(seconds=rng.randrange(300_000)) for _ in range(2 * rng.randint(0, 3)))
            complete[tier] = list(zip(cuts[::2], cuts[1::2]))
        a, b = sorted(START + dt.timedelta(seconds=rng.randrange(300_000)) for _ in range(2))
        pieces = Z.cover(a, b, complete)
        edges = [a, *[p.end for p in pieces]]
        assert [p.start for p in pieces] == edges[:-1] and edges[-1] == b or a == b and not pieces
        for p in pieces:
            assert p.tier == "events" or any(s <= p.start and p.end <= e for s, e in complete[p.tier])
            if p.tier != "events":
                assert (p.start - START) % Z.TIERS[p.tier] == (p.end - START) % Z.TIERS[p.tier] == dt.timedelta(0)


def test_the_largest_complete_buckets_are_taken():
    complete = {"day": [(at("02"), at("03"))], "hour": [(at("01"), at("04"))], "minute": [(at("01"), at("04"))]}
    got = [(p.tier, p.start, p.end) for p in Z.cover(at("01 22:58:30"), None, complete)]
    assert got == [
        ("events", at("01 22:58:30"), at("01 22:59:00")), ("minute", at("01 22:59:00"), at("01 23:00:00")), ("hour", at("01 23:00:00"), at("02")),
        ("day", at("02"), at("03")), ("hour", at("03"), at("04")), ("events", at("04"), None),
    ]


@pytest.fixture(scope="module")
def stored(spark, sf_dir):
    ev = telemetry(spark, sf_dir, compression=10).persist()
    base = fresh_path(spark, "tiers")
    Z.build_tiers(spark, ev, base, dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 3, 21, 40, 20))
    return ev, base


NOW = dt.datetime(2024, 1, 3, 22, 11, 13)


@pytest.mark.parametrize("span", ["7 minutes", "50 minutes", "3 hours", "1 day", "47 hours", "2 days"])
def test_same_as_the_events(spark, stored, span):
    ev, base = stored
    assert rows(Z.device_stats_tiered(spark, base, span, NOW)) == rows(A.device_stats(ev, span, NOW))
    assert rows(Z.timeseries_tiered(spark, base, span, NOW)) == rows(A.timeseries(ev, span, "minute", NOW))
    assert rows(Z.hourly_stats_tiered(spark, base, span, NOW)) == rows(A.hourly_stats(ev, span, NOW))


def test_default_time_is_the_newest_event(spark, stored):
    ev, base = stored
    assert rows(Z.hourly_stats_tiered(spark, base, "5 hours")) == rows(A.hourly_stats(ev, "5 hours"))


def test_only_the_cut_ends_are_read_raw(spark, stored):
    ev, base = stored
    begin = NOW - dt.timedelta(hours=47)
    read = rows_read(Z.device_stats_tiered(spark, base, "47 hours", NOW))
    first_hour = ev.filter((F.col("timestamp") >= begin.replace(minute=0, second=0)) & (F.col("timestamp") < begin.replace(minute=0, second=0) + dt.timedelta(hours=1)))
    newest = ev.filter(F.col("timestamp") >= dt.datetime(2024, 1, 3, 21))
    assert read["events"] <= first_hour.count() + newest.count() < ev.count() / 10
    assert read["day"] > 0 and read["hour"] > 0 and read["minute"] > 0


def test_what_is_not_recorded_is_read_raw(spark, sf_dir, stored):
    """A minute rollup with an hour lost, not yet recorded, or dropped by retention gives the same answers."""
    ev, _ = stored
    base = fresh_path(spark, "tiers")
    Z.write_hours(ev, base)
    lost = (dt.datetime(2024, 1, 2, 5), dt.datetime(2024, 1, 2, 6))
    minute = R.rollup(ev.filter(~F.col("timestamp").between(*lost)))
    R.write_rollup(minute, f"{base}/minute", "minute")
    Z.mark_complete(spark, base, "minute", dt.datetime(2024, 1, 1), lost[0])
    Z.mark_complete(spark, base, "minute", lost[1], dt.datetime(2024, 1, 3, 12))
    Z.mark_complete(spark, base, "minute", lost[1], dt.datetime(2024, 1, 3, 20))
    Z.mark_dropped(spark, base, "minute", dt.datetime(2024, 1, 1, 10, 0, 1))
    assert Z.complete_spans(spark, base) == {"minute": [(dt.datetime(2024, 1, 1, 10, 1), lost[0]), (lost[1], dt.datetime(2024, 1, 3, 20))]}
    for span in ("5 hours", "70 hours"):
        assert rows(Z.hourly_stats_tiered(spark, base, span, NOW)) == rows(A.hourly_stats(ev, span, NOW))


def test_a_panel_comes_from_the_cache_while_it_lives(spark, stored):
    ev, base = stored
    store = fresh_path(spark, "snapshots")
    raw = rows(A.timeseries(ev, as_of=NOW))
    assert rows(Z.panel(spark, base, "timeseries_1h", NOW, store)) == raw
    publish_snapshot(A.timeseries(ev, as_of=NOW).limit(3), store, "timeseries_1h", 120, NOW)
    assert len(rows(Z.panel(spark, base, "timeseries_1h", NOW + dt.timedelta(seconds=60), store))) == 3
    later = NOW + dt.timedelta(seconds=121)
    assert rows(Z.panel(spark, base, "timeseries_1h", later, store)) == rows(A.timeseries(ev, as_of=later))


def test_no_events(spark, stored):
    ev, _ = stored
    base = fresh_path(spark, "tiers")
    Z.build_tiers(spark, ev.limit(0), base, NOW, NOW)
    assert Z.newest_time(spark, base) is None
    assert Z.complete_spans(spark, base) == {}
    assert rows(Z.device_stats_tiered(spark, base, "1 day", NOW)) == []
