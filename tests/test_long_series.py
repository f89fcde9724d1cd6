"""Chunked work on long series against a plain walk over each series."""

import datetime as dt
import random
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from gaugeworks.operators import anomalies as W
from gaugeworks.operators import samples as M
from gaugeworks.operators.chunks import in_chunks

START = dt.datetime(2024, 5, 1)


@pytest.fixture(scope="module")
def skewed(spark):
    """One device holds most rows, many of them within one hour; others are sparse or bursty."""
    rng = random.Random(7)
    rows, msg = [], 0
    for device, count, spread in (("hot", 900, 4000), ("hot", 300, 200_000), ("thin", 25, 400_000), ("one", 1, 10)):
        for _ in range(count):
            at = START + dt.timedelta(seconds=rng.randrange(spread), milliseconds=rng.choice((0, 0, 500)))
            value = rng.choice((10.0, 10.0, 10.0, 25.0, -4.0, 0.0)) if rng.random() > 0.05 else None
            rows.append((device, at, msg, value))
            msg += 1
    df = spark.createDataFrame(rows, "device_id string, timestamp timestamp_ntz, msg_id long, temperature double")
    by_device = {}
    for r in sorted((r for r in rows if r[3] is not None), key=lambda r: (r[0], r[1], r[2])):
        by_device.setdefault(r[0], []).append(r)
    return df, by_device


# Few rows per chunk force series to be cut inside an hour; the large limit leaves whole hours.
LIMITS = [(5, "1 hour"), (50, "1 hour"), (1_000_000, "1 hour"), (3, "1 minute"), (1_000_000, "30 days")]


@pytest.mark.parametrize("small,chunk", LIMITS)
@pytest.mark.parametrize("n", [1, 4, 20])
def test_spikes(skewed, small, chunk, n):
    df, by_device = skewed
    want = set()
    for rows in by_device.values():
        for i, (device, _, msg, value) in enumerate(rows):
            before = [r[3] for r in rows[max(0, i - n):i]]
            if before and (abs(value) * len(before) >= 2 * abs(sum(before)) or value * sum(before) < 0):
                want.add((device, msg))
    got = W.detect_spikes(df, "temperature", 2.0, n, chunk, small).collect()
    assert len(got) == len(want)
    assert {(r["device_id"], r["msg_id"]) for r in got} == want


@pytest.mark.parametrize("small,chunk", LIMITS)
def test_stuck(skewed, small, chunk):
    df, by_device = skewed
    want = set()
    for device, rows in by_device.items():
        for value, run in groupby(rows, key=lambda r: r[3]):
            run = list(run)
            if len(run) >= 3:
                want.add((device, value, run[0][1], run[-1][1], len(run)))
    got = W.detect_stuck(df, "temperature", 3, chunk, small).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("small,chunk", LIMITS)
def test_rate(skewed, small, chunk):
    df, by_device = skewed
    samples = df.filter("temperature is not null").select(
        F.lit("c").alias("metric"), F.create_map(F.lit("d"), "device_id").alias("labels"),
        F.col("timestamp").alias("ts"), F.abs("temperature").alias("value"),
    )
    want = {}
    for device, rows in by_device.items():
        values = [abs(r[3]) for r in sorted(rows, key=lambda r: (r[1], abs(r[3])))]
        grown = sum(b - a if b >= a else b for a, b in zip(values, values[1:]))
        want[f'{{"d":"{device}"}}'] = grown / 1000
    got = {r["series"]: r["rate"] for r in M.counter_rate(samples, "c", None, seconds=1000, chunk=chunk, small=small).collect()}
    assert got == pytest.approx(want)


def test_a_long_run_over_many_chunks(spark):
    df = spark.range(5000).select(
        F.lit("a").alias("device_id"), F.col("id").alias("msg_id"), F.lit(1.5).alias("temperature"),
        F.timestamp_add("SECOND", F.col("id"), F.lit("2024-05-01 00:00:00").cast("timestamp_ntz")).alias("timestamp"),
    )
    got = W.detect_stuck(df, "temperature", 5, "1 minute", 10).collect()
    assert [r["readings"] for r in got] == [5000]


@pytest.mark.parametrize("small", [7, 100, 1_000_000])
def test_a_burst_at_one_moment(spark, small):
    """All rows of a device bear one time; their order is the message number, and chunks are cut inside the moment."""
    rng = random.Random(11)
    values = [rng.choice((1.0, 1.0, 1.0, 9.0)) for _ in range(600)]
    rows = [("a", START, i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "device_id string, timestamp timestamp_ntz, msg_id long, temperature double").repartition(5)
    chunks = in_chunks(df, ["device_id"], W.ORDER, "1 hour", small).groupBy("_chunk").count()
    assert (chunks.count() > 1) == (small < 600) and chunks.agg(F.sum("count")).first()[0] == 600
    want = {i for i in range(1, 600) if values[i] * len(b := values[max(0, i - 20):i]) >= 2 * sum(b)}
    assert {r["msg_id"] for r in W.detect_spikes(df, "temperature", 2.0, 20, "1 hour", small).collect()} == want
    runs = [len(list(g)) for _, g in groupby(values)]
    got = W.detect_stuck(df, "temperature", 2, "1 hour", small).collect()
    assert sorted(r["readings"] for r in got) == sorted(n for n in runs if n >= 2)
