"""Scans, messages, stored tables, snapshots and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeworks import functions as fn
from gaugeworks.operators import maintenance as X
from gaugeworks.operators import summaries as A
from gaugeworks.plans.dashboards import _DEVICE_STATS
from gaugeworks.plans.refresh import refresh_cache
from gaugeworks.plans.registry import doubled, query, recent
from gaugeworks.plans.sql import avg, doubles, n_status, over_events, r, within
from gaugeworks.schema import EVENTS, HEADER, METRICS
from gaugeworks.session import fresh_path
from gaugeworks.operators.folders import partition_values
from gaugeworks.operators.manifest import newest_stored
from gaugeworks.sinks import archive_expired, move_expired, publish_snapshot, write_events, write_indexed
from gaugeworks.sinks.moves import archived_rows, live_rows
from gaugeworks.sources import (
    flatten_readings, narrow, normalise_alt_messages, parse_alt_messages, parse_messages, read_events, read_month_range,
    read_ranking, read_snapshot, rejected_messages, snapshot_or, to_messages, zero_filled,
)
from gaugeworks.sources import sample_tables as S
from gaugeworks.sources.sample_tables import newest_time, telemetry

_HEAD = ", ".join(HEADER)

# -- scans ----------------------------------------------------------------------------------------


@query("events_scan", over_events(f"SELECT {_HEAD}, {doubles(*METRICS)} FROM ev"))
def events_scan(spark, sf_dir):
    return doubled(telemetry(spark, sf_dir))


@query("events_scan_zero_filled", over_events(
    f"SELECT {_HEAD}, " + ", ".join(f"CAST(coalesce({m}, 0) AS DOUBLE) AS {m}" for m in METRICS) + " FROM ev"))
def events_scan_zero_filled(spark, sf_dir):
    return doubled(zero_filled(telemetry(spark, sf_dir)))


@query("narrow_events", over_events(
    f"SELECT timestamp, device_id, {doubles('temperature', 'pressure')}, status, msg_id FROM ev"))
def narrow_events(spark, sf_dir):
    return doubled(narrow(telemetry(spark, sf_dir)))


def as_stored(ev):
    """Rows in the declared column types of the events table."""
    return ev.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in EVENTS.fields])


_FLOATS = ", ".join(f"CAST({m} AS FLOAT) AS {m}" for m in METRICS)


@query("stored_events", over_events(f"SELECT {_HEAD}, {_FLOATS} FROM ev", compression=1))
def stored_events(spark, sf_dir):
    """Written in the month layout and read back with the declared schema."""
    path = fresh_path(spark, "events")
    write_events(as_stored(telemetry(spark, sf_dir, compression=1)), path)
    return read_events(spark, path).drop("yyyymm")


@query("stored_events_by_month", over_events(
    "SELECT strftime(timestamp, '%Y%m') AS yyyymm, count(*) AS events FROM ev WHERE timestamp >= TIMESTAMP '2024-01-01' "
    "GROUP BY 1", compression=1))
def stored_events_by_month(spark, sf_dir):
    path = fresh_path(spark, "events")
    write_events(as_stored(telemetry(spark, sf_dir, compression=1)), path)
    return read_month_range(spark, path, "202401").groupBy("yyyymm").agg(A.events().alias("events"))


@query("indexed_events_by_location", over_events(
    "SELECT location, status, count(*) AS events FROM ev GROUP BY 1, 2", compression=1))
def indexed_events_by_location(spark, sf_dir):
    path = fresh_path(spark, "indexed")
    write_indexed(as_stored(telemetry(spark, sf_dir, compression=1)), path)
    return read_events(spark, path).groupBy("location", "status").agg(A.events().alias("events"))


# -- messages -------------------------------------------------------------------------------------

def _messages(spark, sf_dir):
    """Every reading as JSON text; signups arrive torn, without their closing brace."""
    ev = telemetry(spark, sf_dir)
    whole = to_messages(ev.filter(F.col("status") != "ERROR"))
    torn = to_messages(ev.filter(F.col("status") == "ERROR")).select(F.regexp_replace("message", "}$", "").alias("message"))
    return whole.unionByName(torn)


@query("parsed_messages", over_events(f"SELECT {_HEAD}, {doubles(*METRICS)} FROM ev WHERE status <> 'ERROR'"))
def parsed_messages(spark, sf_dir):
    parsed = parse_messages(_messages(spark, sf_dir))
    return parsed.filter(F.col("rejected").isNull()).drop("rejected")


@query("rejected_messages", over_events("SELECT count(*) AS rejected FROM ev WHERE status = 'ERROR'"))
def rejected_message_count(spark, sf_dir):
    return rejected_messages(parse_messages(_messages(spark, sf_dir))).agg(F.count("rejected").alias("rejected"))


@query("alternate_messages", over_events(
    f"SELECT timestamp, device_id, {doubles('temperature', 'humidity', 'pressure')} FROM ev"))
def alternate_messages(spark, sf_dir):
    ev = telemetry(spark, sf_dir)
    ms = F.unix_millis(F.col("timestamp").cast("timestamp"))
    texts = ev.select(
        F.to_json(
            F.struct(
                F.col("device_id").alias("deviceId"), ms.alias("timestamp"),
                *[F.col(m).cast("double").alias(m) for m in ("temperature", "humidity", "pressure")],
                F.repeat(F.lit("x"), 16).alias("padding"),
            )
        ).alias("message")
    )
    return normalise_alt_messages(texts)


@query("rejected_alternate_messages", over_events(
    "SELECT CASE WHEN msg_id % 3 = 0 THEN 'noise ' || msg_id ELSE '{\"timestamp\":' || msg_id || '}' END AS rejected FROM ev"))
def rejected_alternate_messages(spark, sf_dir):
    """Every event once as text that is no message or lacks a device, and once sound: the former come back."""
    ev = telemetry(spark, sf_dir)
    number = F.col("msg_id").cast("string")
    broken = F.when(F.col("msg_id") % 3 == 0, F.concat(F.lit("noise "), number)).otherwise(
        F.concat(F.lit('{"timestamp":'), number, F.lit("}")))
    sound = F.to_json(F.struct(F.col("device_id").alias("deviceId"), F.col("msg_id").alias("timestamp")))
    texts = ev.select(broken.alias("message")).unionByName(ev.select(sound.alias("message")))
    return rejected_messages(parse_alt_messages(texts))


@query("both_message_forms", over_events(f"""
SELECT device_id, count(*) AS events, count(msg_id) AS numbered, {avg('temperature')} AS avg_temperature
FROM (SELECT device_id, msg_id, temperature FROM ev WHERE status <> 'ERROR'
  UNION ALL SELECT device_id, NULL, temperature FROM ev) GROUP BY 1"""))
def both_message_forms(spark, sf_dir):
    """The two message forms side by side in one shape."""
    flat = parsed_messages(spark, sf_dir)
    both = flat.unionByName(alternate_messages(spark, sf_dir), allowMissingColumns=True)
    exact = both.withColumn("temperature", F.col("temperature").cast("decimal(12,3)"))
    return exact.groupBy("device_id").agg(
        A.events().alias("events"), F.count("msg_id").alias("numbered"), A.avg("temperature").alias("avg_temperature")
    )


@query("flattened_readings", over_events(f"SELECT {_HEAD}, {doubles(*METRICS)} FROM ev"))
def flattened_readings(spark, sf_dir):
    return flatten_readings(S.nested_readings(spark, sf_dir))


# -- snapshots ------------------------------------------------------------------------------------

@query("snapshot_read", over_events(_DEVICE_STATS))
def snapshot_read(spark, sf_dir):
    store = fresh_path(spark, "snapshots")
    ev, as_of = recent(spark, sf_dir, "5 minutes")
    live = A.device_stats(ev, as_of=as_of)
    publish_snapshot(live, store, "device_stats", 120, as_of)
    return read_snapshot(spark, store, "device_stats", live.schema, as_of)


@query("snapshot_expired_falls_back", over_events(_DEVICE_STATS))
def snapshot_expired_falls_back(spark, sf_dir):
    """A set that is past its life time is not served; the live query answers instead."""
    store = fresh_path(spark, "snapshots")
    ev, as_of = recent(spark, sf_dir, "5 minutes")
    live = A.device_stats(ev, as_of=as_of)
    old = A.device_stats(ev.filter(F.col("status") == "OK"), as_of=as_of)
    publish_snapshot(old, store, "device_stats", 120, "2024-01-01 00:00:00")
    return snapshot_or(spark, store, "device_stats", live.schema, as_of, lambda: live)


@query("snapshot_ranking", over_events(f"""
SELECT row_number() OVER (ORDER BY events DESC, device_id) AS rank, device_id, events
FROM (SELECT device_id, count(*) AS events FROM ev WHERE {within('1 hour')} GROUP BY 1)
QUALIFY rank <= 20"""))
def snapshot_ranking(spark, sf_dir):
    """A cached ranking is served in the order in which it was published."""
    store = fresh_path(spark, "snapshots")
    ev, as_of = recent(spark, sf_dir, "1 hour")
    ranked = A.busiest_devices(ev, "1 hour", 20, as_of)
    publish_snapshot(ranked, store, "busiest_devices", 120, as_of)
    return read_ranking(spark, store, "busiest_devices", ranked.schema, as_of, 20)


@query("snapshot_store", over_events(
    " UNION ALL ".join(
        f"SELECT '{key}' AS key, (SELECT count(*) FROM ({body})) AS documents, t AS written_at, "
        f"t + INTERVAL '{ttl} seconds' AS expires_at FROM lim"
        for key, ttl, body in (
            ("device_stats", 120, f"SELECT DISTINCT device_id FROM ev WHERE {within('5 minutes')}"),
            ("timeseries_1h", 120, f"SELECT DISTINCT date_trunc('minute', timestamp) FROM ev WHERE {within('1 hour')}"),
            ("system_health", 120, "SELECT 1"),
            ("latest_events", 60, f"SELECT DISTINCT device_id FROM ev WHERE {within('5 minutes')}"),
            ("hourly_stats_24h", 300, f"SELECT DISTINCT date_trunc('hour', timestamp) FROM ev WHERE {within('24 hours')}"),
        )
    )))
def snapshot_store(spark, sf_dir):
    """All cached sets after one scheduled refresh."""
    store = fresh_path(spark, "snapshots")
    ev, as_of = recent(spark, sf_dir, "24 hours")
    refresh_cache(ev, store, as_of)
    return spark.read.parquet(store).groupBy("key", "written_at", "expires_at").agg(F.count("payload").alias("documents"))


# -- archive, retention, inventory, compaction ----------------------------------------------------

@query("archived_events", over_events(
    "SELECT device_id, msg_id, timestamp FROM ev WHERE timestamp < (SELECT t FROM lim) - INTERVAL '7 days'", compression=1))
def archived_events(spark, sf_dir):
    path = fresh_path(spark, "archive")
    ev = telemetry(spark, sf_dir, compression=1)
    archive_expired(ev, path, "7 days", newest_time(spark, sf_dir, 1))
    return spark.read.parquet(path).select("device_id", "msg_id", "timestamp")


def _stretched(spark, sf_dir):
    """The events over a year: one stored day becomes twelve, so several months are filled."""
    ev = as_stored(telemetry(spark, sf_dir, compression=1))
    origin = F.lit(S.ORIGIN).cast("timestamp_ntz")
    elapsed = F.timestamp_diff("MICROSECOND", origin, F.col("timestamp"))
    return ev.withColumn("timestamp", F.timestamp_add("MICROSECOND", elapsed * 12, origin))


_STRETCHED = (
    f"TIMESTAMP '{S.ORIGIN}' + to_microseconds((epoch_us(timestamp) - epoch_us(TIMESTAMP '{S.ORIGIN}')) * 12)"
)


@query("retained_months", over_events(f"""
SELECT strftime(s, '%Y%m') AS yyyymm, count(*) AS events, min(s) AS earliest
FROM (SELECT {_STRETCHED} AS s FROM ev)
WHERE s >= TIMESTAMP '2024-12-20 12:00:00' - INTERVAL '90 days' GROUP BY 1""", compression=1))
def retained_months(spark, sf_dir):
    """What a stored table holds after the 90-day retention job."""
    path = fresh_path(spark, "events")
    write_events(_stretched(spark, sf_dir), path)
    X.drop_expired_partitions(spark, path, "90 days", "2024-12-20 12:00:00")
    left = spark.read.parquet(path)
    return left.groupBy(F.col("yyyymm").cast("string").alias("yyyymm")).agg(
        A.events().alias("events"), F.min("timestamp").alias("earliest")
    )


def _stored_year(spark, sf_dir):
    path = fresh_path(spark, "events")
    write_events(_stretched(spark, sf_dir), path)
    return path


_BY_MONTH = (
    f"SELECT strftime(s, '%Y%m') AS partition, count(*) AS rows, min(s) AS min_time, max(s) AS max_time {{more}} "
    f"FROM (SELECT {_STRETCHED} AS s FROM ev) GROUP BY 1"
)


@query("partition_inventory", over_events(_BY_MONTH.format(more=", true AS files_agree, true AS bytes_agree"), compression=1))
def partition_inventory(spark, sf_dir):
    """The inventory, and whether its files and bytes are those that the file system tells."""
    path = _stored_year(spark, sf_dir)
    found = X.partition_inventory(spark, path)
    held = {v: X.on_disk(spark, f"{path}/yyyymm={v}") for v in partition_values(spark, path, "yyyymm")}
    told = spark.createDataFrame([(v, *n) for v, n in held.items()], "partition string, told_files long, told_bytes long")
    agree = [(F.col(c) == F.col(f"told_{c}")).alias(f"{c}_agree") for c in ("files", "bytes")]
    return found.join(told, "partition", "left").select("partition", "rows", "min_time", "max_time", *agree)


@query("partition_rows", over_events(_BY_MONTH.format(more=""), compression=1))
def partition_rows(spark, sf_dir):
    return X.partition_inventory(spark, _stored_year(spark, sf_dir)).select("partition", "rows", "min_time", "max_time")


@query("newest_from_manifest", over_events(f"SELECT max({_STRETCHED}) AS newest FROM ev", compression=1))
def newest_from_manifest(spark, sf_dir):
    newest = newest_stored(spark, _stored_year(spark, sf_dir))
    return spark.createDataFrame([(newest,)], "newest timestamp_ntz")


@query("moved_events", over_events(f"""
SELECT s < TIMESTAMP '2024-09-01' AS archived, strftime(s, '%Y%m') AS yyyymm, count(*) AS events, sum(msg_id)::BIGINT AS ids
FROM (SELECT *, {_STRETCHED} AS s FROM ev) GROUP BY 1, 2""", compression=1))
def moved_events(spark, sf_dir):
    """Live table and archive after the months before the 90-day limit have moved."""
    path, archive = _stored_year(spark, sf_dir), fresh_path(spark, "archive")
    move_expired(spark, path, archive, "90 days", "2024-12-20 12:00:00")
    sides = live_rows(spark, path, archive).withColumn("archived", F.lit(False)).unionByName(
        archived_rows(spark, archive).drop("run").withColumn("archived", F.lit(True)))
    return sides.groupBy("archived", F.col("yyyymm").cast("string").alias("yyyymm")).agg(
        A.events().alias("events"), F.sum("msg_id").alias("ids"))


GIVEN_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
)


def _sizes(spark, sf_dir):
    return X.table_sizes(spark, {n: f"{sf_dir}/{n}.parquet" for n in GIVEN_TABLES})


_COUNTS = " UNION ALL ".join(f"SELECT '{n}' AS \"table\", (SELECT count(*) FROM {n}) AS rows" for n in GIVEN_TABLES)


@query("table_sizes", f"SELECT *, true AS files_agree, true AS bytes_agree FROM ({_COUNTS})")
def table_sizes(spark, sf_dir):
    """Sizes of the given tables as they are stored, held against the file system."""
    held = [(n, *X.on_disk(spark, f"{sf_dir}/{n}.parquet")) for n in GIVEN_TABLES]
    told = spark.createDataFrame(held, "table string, told_files long, told_bytes long")
    agree = [(F.col(c) == F.col(f"told_{c}")).alias(f"{c}_agree") for c in ("files", "bytes")]
    return _sizes(spark, sf_dir).join(told, "table", "left").select("table", "rows", *agree)


@query("total_size", f"SELECT sum(rows)::BIGINT AS rows, true AS files_agree, true AS bytes_agree FROM ({_COUNTS})")
def total_size(spark, sf_dir):
    """Rows, files and bytes of all given tables together."""
    held = [X.on_disk(spark, f"{sf_dir}/{n}.parquet") for n in GIVEN_TABLES]
    files, size = (sum(h[i] for h in held) for i in range(2))
    return X.total_size(_sizes(spark, sf_dir)).select(
        "rows", (F.col("files") == files).alias("files_agree"), (F.col("bytes") == size).alias("bytes_agree"))


@query("table_rows", _COUNTS)
def table_rows(spark, sf_dir):
    return _sizes(spark, sf_dir).select("table", "rows")


@query("compacted_events", over_events(f"""
SELECT strftime(s, '%Y%m') AS yyyymm, device_id, count(*) AS events, min(s) AS earliest, max(s) AS latest,
  sum(msg_id)::BIGINT AS ids
FROM (SELECT *, {_STRETCHED} AS s FROM ev) GROUP BY 1, 2""", compression=1))
def compacted_events(spark, sf_dir):
    """The events written as many small files and then compacted: nothing is lost or doubled."""
    path = fresh_path(spark, "events")
    write_events(_stretched(spark, sf_dir), path, files=64)
    X.compact(spark, path, "yyyymm", ("device_id", "timestamp"))
    table = spark.read.parquet(path)
    return table.groupBy(F.col("yyyymm").cast("string").alias("yyyymm"), "device_id").agg(
        A.events().alias("events"), F.min("timestamp").alias("earliest"), F.max("timestamp").alias("latest"),
        F.sum("msg_id").alias("ids"),
    )


# -- scalar functions -----------------------------------------------------------------------------

@query("time_buckets", over_events("""
SELECT msg_id, date_trunc('minute', timestamp) AS minute, date_trunc('hour', timestamp) AS hour,
  CAST(timestamp AS DATE) AS date, strftime(timestamp, '%Y%m') AS yyyymm, strftime(timestamp, '%Y%m%d') AS yyyymmdd,
  CAST(epoch_us(timestamp + INTERVAL '1 hour') // 1000000 - epoch_us(timestamp) // 1000000 AS BIGINT) AS hour_seconds,
  CAST(epoch_us((SELECT t FROM lim)) // 1000000 - epoch_us(timestamp) // 1000000 AS BIGINT) AS age_seconds,
  CAST((SELECT t FROM lim) AS DATE) - 30 AS month_back
FROM ev""", compression=1))
def time_buckets(spark, sf_dir):
    ev = telemetry(spark, sf_dir, compression=1)
    now = fn.newest(ev, newest_time(spark, sf_dir, 1))
    at = F.col("timestamp")
    return ev.select(
        "msg_id", fn.bucket(at, "minute").alias("minute"), fn.bucket(at, "hour").alias("hour"),
        F.to_date(at).alias("date"), fn.month_of(at).alias("yyyymm"), fn.day_of(at).alias("yyyymmdd"),
        fn.seconds_between(at, at + fn.interval("1 hour")).alias("hour_seconds"),
        fn.seconds_between(at, now).alias("age_seconds"), F.date_sub(now.cast("date"), 30).alias("month_back"),
    )


def _unit_text(x: str, steps, digits: int, smallest: str) -> str:
    whens = " ".join(
        f"WHEN {x} >= {size} THEN printf('%.{digits}f{unit}', {r(f'(CAST({x} AS DOUBLE) / {size})', digits)})"
        for size, unit in steps
    )
    return f"CASE {whens} ELSE {smallest} END"


_SIZES = [(1024**4, " TiB"), (1024**3, " GiB"), (1024**2, " MiB"), (1024, " KiB")]
_QUANTITIES = [(10**12, " trillion"), (10**9, " billion"), (10**6, " million"), (10**3, " thousand")]


@query("readable_numbers", over_events(f"""
SELECT device_id, n, {_unit_text('n', _SIZES, 2, "printf('%.2f B', CAST(n AS DOUBLE))")} AS size,
  {_unit_text('n', _QUANTITIES, 2, "printf('%.2f', CAST(n AS DOUBLE))")} AS quantity,
  {_unit_text('n', [(10**6, 'M'), (10**3, 'K')], 1, "CAST(n AS VARCHAR)")} AS short
FROM (SELECT device_id, CAST(sum(msg_id) * (sum(msg_id) % 997) AS BIGINT) AS n FROM ev GROUP BY 1)"""))
def readable_numbers(spark, sf_dir):
    ids = F.sum("msg_id")
    totals = telemetry(spark, sf_dir).groupBy("device_id").agg((ids * (ids % 997)).alias("n"))
    return totals.select(
        "device_id", "n", fn.readable_size("n").alias("size"), fn.readable_quantity("n").alias("quantity"),
        fn.short_count("n").alias("short"),
    )


@query("json_fields", """
SELECT event_id, json_extract_string(props, '$.k') AS k_text, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
  '{"id":' || event_id || ',"type":"' || event_type || '"}' AS encoded FROM events""")
def json_fields(spark, sf_dir):
    src = S._source(spark, sf_dir)
    return src.select(
        "event_id", F.get_json_object("props", "$.k").alias("k_text"),
        F.from_json("props", T.StructType([T.StructField("k", T.IntegerType())]))["k"].alias("k"),
        F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("type"))).alias("encoded"),
    )


@query("parsed_times", over_events("SELECT msg_id, timestamp AS from_text, timestamp AS from_number FROM ev"))
def parsed_times(spark, sf_dir):
    ev = telemetry(spark, sf_dir)
    written = ev.select(
        "msg_id", F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("text"),
        F.unix_millis(F.col("timestamp").cast("timestamp")).alias("number"),
    )
    return written.select("msg_id", fn.from_iso("text").alias("from_text"), fn.from_epoch_ms("number").alias("from_number"))


@query("default_values", over_events(f"""
SELECT msg_id, CAST(coalesce(temperature, pressure, 0) AS DOUBLE) AS first_present,
  CAST(coalesce(power_consumption, 0) AS DOUBLE) AS power, coalesce(nullif(status, 'OK'), 'unknown') AS state FROM ev"""))
def default_values(spark, sf_dir):
    """Alternate columns, then a default."""
    ev = telemetry(spark, sf_dir)
    return doubled(
        ev.select(
            "msg_id",
            fn.with_default(F.coalesce("temperature", "pressure"), 0).cast("double").alias("first_present"),
            fn.with_default("power_consumption", 0).cast("double").alias("power"),
            fn.with_default(F.nullif(F.col("status"), F.lit("OK")), "unknown").alias("state"),
        )
    )


@query("rounded_values", over_events(
    f"SELECT msg_id, {r('battery_level', 1)} AS one, {r('humidity', 2)} AS two, {r('signal_strength', 0)} AS none FROM ev"))
def rounded_values(spark, sf_dir):
    return telemetry(spark, sf_dir).select(
        "msg_id", fn.rounded("battery_level", 1).alias("one"), fn.rounded("humidity", 2).alias("two"),
        fn.rounded("signal_strength", 0).alias("none"),
    )


@query("status_counts", over_events(
    f"SELECT device_type, {n_status('OK')} AS ok, {n_status('WARN')} AS warn, {n_status('CRITICAL')} AS critical, "
    f"count(*) AS events, {r('stddev_pop(CAST(battery_level AS DOUBLE))', 3)} AS spread FROM ev GROUP BY 1"))
def status_counts(spark, sf_dir):
    return A.summarise(
        telemetry(spark, sf_dir),
        {
            "ok": A.having_status("OK"), "warn": A.having_status("WARN"), "critical": A.having_status("CRITICAL"),
            "events": A.events(),
            "spread": fn.rounded(F.stddev_pop(F.col("battery_level").cast("double")), 3),
        },
        keys=["device_type"],
    )
