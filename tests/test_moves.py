"""The record of files and the archive as a move: stops at every step, late rows, files that cannot be read."""

import os

import pytest
from compare import rows_read
from pyspark.sql import functions as F

from gaugeworks.operators import maintenance as X
from gaugeworks.operators import manifest as N
from gaugeworks.plans.tables import _stretched
from gaugeworks.session import fresh_path
from gaugeworks.sinks import all_rows, move_expired, moves, write_events
from gaugeworks.sinks.tables import tasks_for

NOW = "2024-12-20 12:00:00"


@pytest.fixture(scope="module")
def year(spark, sf_dir):
    return _stretched(spark, sf_dir).persist()


def ids(df):
    return sorted(r[0] for r in df.select("msg_id").collect())


def data_files(path):
    return [os.path.join(d, f) for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet") and "_manifest" not in d]


def test_inventory_reads_no_row_of_the_table(spark, year):
    path = fresh_path(spark, "events")
    write_events(year, path, files=6)
    want = X.partition_inventory(spark, path).collect()
    assert sum(r["rows"] for r in want) == year.count() and sum(r["files"] for r in want) == len(data_files(path))
    assert sum(r["bytes"] for r in want) == sum(os.path.getsize(f) for f in data_files(path)) == X.on_disk(spark, path)[1]
    for f in data_files(path):  # of the same size, but no longer readable
        size = os.path.getsize(f)
        with open(f, "wb") as broken:
            broken.write(b"\0" * size)
        os.remove(os.path.join(os.path.dirname(f), f".{os.path.basename(f)}.crc"))
    again = X.partition_inventory(spark, path)
    assert again.collect() == want
    assert N.newest_stored(spark, path) == max(r["max_time"] for r in want)
    assert set(rows_read(again)) == {N._versions(spark, path)[-1]}


def test_writers_keep_the_record(spark, year):
    path = fresh_path(spark, "events")
    write_events(year.filter("timestamp < '2024-06-15'"), path, files=5)
    assert not N.has_manifest(spark, path)
    N.refresh_manifest(spark, path)
    counted = lambda: spark.read.schema(N.ENTRY).parquet(f"{path}/{N.FOLDER}/{N._versions(spark, path)[-1]}").agg(F.sum("rows"), F.count(F.lit(1))).first()
    write_events(year.filter("timestamp >= '2024-06-15'"), path, files=5)
    assert counted()[0] == year.count() and counted()[1] == len(data_files(path))
    X.compact(spark, path, "yyyymm", ("device_id", "timestamp"))
    assert counted()[0] == year.count() and counted()[1] == len(data_files(path))
    X.drop_expired_partitions(spark, path, "90 days", NOW)
    assert counted()[0] == spark.read.parquet(path).count() < year.count()
    assert len(os.listdir(f"{path}/{N.FOLDER}")) <= 2
    draft = f"{path}/{N.FOLDER}/999999999999-half"
    os.makedirs(draft)  # a record without its success mark does not count
    assert X.partition_inventory(spark, path).agg(F.sum("rows")).first()[0] == spark.read.parquet(path).count()


def test_many_new_files_are_read_by_partition(spark, year, monkeypatch):
    path = fresh_path(spark, "events")
    write_events(year, path, files=6)
    monkeypatch.setattr(N, "NAMED", 3)
    assert X.partition_inventory(spark, path).agg(F.sum("rows")).first()[0] == year.count()


def test_an_unpartitioned_table(spark, year):
    path = fresh_path(spark, "events")
    year.repartition(3).write.parquet(path)
    got = N.refresh_manifest(spark, path, None).agg(F.sum("rows"), F.count(F.lit(1)), F.max("max_time")).first()
    assert tuple(got) == (year.count(), 3, year.agg(F.max("timestamp")).first()[0])


class Stop(RuntimeError):
    pass


@pytest.mark.parametrize("step", ["_plan", "_record 1", "_archive", "_record 2", "_drop", "half of _drop", "_record 3"])
def test_a_move_that_stops_is_taken_up(spark, year, monkeypatch, step):
    path, archive = fresh_path(spark, "events"), fresh_path(spark, "archive")
    write_events(year, path, files=6)
    want = ids(year)
    calls = []

    def stops(name, after):
        real = getattr(moves, name)

        def run(*args):
            calls.append(name)
            if name == "_record" and calls.count(name) != after:
                return real(*args)
            if step == "half of _drop":
                real(args[0], args[1], {"files": args[2]["files"][::2]})
            raise Stop

        monkeypatch.setattr(moves, name, run)

    name, _, after = step.removeprefix("half of ").partition(" ")
    stops(name, int(after or 0))
    with pytest.raises(Stop):
        move_expired(spark, path, archive, "90 days", NOW)
    monkeypatch.undo()
    assert ids(all_rows(spark, path, archive)) == want
    late = year.filter("timestamp < '2024-02-01'").limit(3).withColumn("msg_id", F.col("msg_id") + 10_000_000)
    write_events(late, path, files=1)
    want = sorted(want + ids(late))
    assert ids(all_rows(spark, path, archive)) == want
    for _ in range(2):
        move_expired(spark, path, archive, "90 days", NOW)
        assert ids(all_rows(spark, path, archive)) == want
    move_expired(spark, path, archive, "90 days", "2024-12-21 12:00:00")
    assert ids(all_rows(spark, path, archive)) == want
    assert min(r[0] for r in spark.read.parquet(path).select(F.col("yyyymm").cast("string")).distinct().collect()) == "202409"
    assert moves.archived_rows(spark, archive).filter("timestamp >= '2024-09-01'").isEmpty()


def test_nothing_to_move(spark, year):
    path, archive = fresh_path(spark, "events"), fresh_path(spark, "archive")
    write_events(year, path, files=3)
    move_expired(spark, path, archive, "2 years", NOW)
    assert moves.archived_rows(spark, archive) is None and ids(all_rows(spark, path, archive)) == ids(year)


def test_rows_without_a_time_do_not_stop_retention(spark, year):
    path = fresh_path(spark, "events")
    write_events(year.unionByName(year.limit(2).withColumn("timestamp", F.lit(None).cast("timestamp_ntz"))), path, files=4)
    X.drop_expired_partitions(spark, path, "90 days", NOW)
    left = spark.read.parquet(path)
    assert left.filter("timestamp IS NULL").count() == 2 and left.agg(F.min("timestamp")).first()[0].month == 9


def test_output_tasks_follow_the_bytes(spark, year):
    path = fresh_path(spark, "events")
    write_events(year, path, files=6)
    stored = spark.read.parquet(path)
    size = sum(os.path.getsize(f) for f in data_files(path))
    assert tasks_for(stored) == 8 and 50 <= tasks_for(stored, size // 50) <= 60
