"""Runs a named query and its SQL over the same tables and compares the two results."""

from __future__ import annotations

import datetime as dt
import decimal
import glob
import os

import duckdb
from pyspark.sql import DataFrame, SparkSession


def open_tables(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


# Spark type -> the SQL engine's type
SAME_TYPE = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "float": "FLOAT", "string": "VARCHAR",
    "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "date": "DATE",
}


def _plain(value):
    if isinstance(value, float):
        return ("f", repr(value))
    if isinstance(value, decimal.Decimal):
        return ("d", str(value))
    if isinstance(value, dt.datetime):
        return ("t", value.replace(tzinfo=None).isoformat())
    return (type(value).__name__, str(value))


def _rows(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_plain(r[i]) for i in order) for r in rows)


def differences(df: DataFrame, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """None when both sides give the same columns, types and rows, else what differs first."""
    rel = con.sql(sql)
    want_types = dict(zip(rel.columns, [str(t) for t in rel.types]))
    got_types = {f.name: SAME_TYPE.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema.fields}
    if got_types != want_types:
        wrong = {c: (got_types.get(c), want_types.get(c)) for c in {*got_types, *want_types}
                 if got_types.get(c) != want_types.get(c)}
        return f"columns (spark, sql): {wrong}"
    want = _rows(rel.columns, rel.fetchall())
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    if len(got) != len(want):
        return f"rows: spark {len(got)}, sql {len(want)}"
    for g, w in zip(got, want):
        if g != w:
            return f"first difference: spark {g} sql {w}"
    return None


def session(cpus: int = 8) -> SparkSession:
    from gaugeworks.session import tuned

    builder = (
        SparkSession.builder.master(f"local[{cpus}]").appName("gaugeworks-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    spark = tuned(builder).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _nodes(plan):
    name = plan.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        yield from _nodes(plan.executedPlan())
    elif name.endswith("QueryStageExec"):
        yield from _nodes(plan.plan())
    else:
        yield plan
        children = plan.children()
        for i in range(children.size()):
            yield from _nodes(children.apply(i))


def rows_read(df: DataFrame) -> dict[str, int]:
    """Runs the frame; the rows that its file scans gave out, by the last folder or file of their path."""
    df.collect()
    out: dict[str, int] = {}
    for node in _nodes(df._jdf.queryExecution().executedPlan()):
        if node.getClass().getSimpleName() == "FileSourceScanExec":
            name = node.relation().location().rootPaths().head().getName()
            out[name] = out.get(name, 0) + node.metrics().apply("numOutputRows").value()
    return out
