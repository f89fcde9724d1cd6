"""Ordered work on long series without one task per series.

A device may hold a third of all rows, so no window here is partitioned by the device alone: it is
partitioned by device and chunk. The rows are shuffled once, into their chunks. What a chunk needs from
before it is then settled among the few rows at the edges of chunks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.functions.timing import span_seconds

CHUNK = "_chunk"
EDGE = "_edge"

#: A stretch with more rows is cut further.
SMALL = 1_000_000
#: So many stretches are cut at most, the largest; any other then holds less than this fraction of all rows.
CUT = 100_000
_WIDE = 1 << 20


def in_chunks(
    rows: DataFrame, keys: Sequence[str], order: Sequence[str], length: str = "1 hour", small: int = SMALL
) -> DataFrame:
    """Rows with the number of their chunk; chunks of a series follow each other like its rows in ``order``.

    ``order`` begins with the time. A chunk is a stretch of ``length``. Stretches with more than ``small``
    rows are found first, by a count that reads the keys and the time alone and combines before the shuffle.
    Their rows are dealt out by range over the whole order, and each task's share becomes a chunk: a burst of
    rows at one moment is cut as well. The list of such stretches is collected and broadcast: ``CUT`` at most.
    """
    us = F.unix_micros(F.col(order[0]).cast("timestamp"))
    slot = F.floor(us / F.lit(span_seconds(length) * 1_000_000)).cast("long")
    group = [*keys, "_slot"]
    rows = rows.withColumn("_slot", slot)
    sizes = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("_size"))
    crowded = sizes.filter(F.col("_size") > small).orderBy(F.desc("_size")).limit(CUT).collect()
    whole = F.col("_slot") * _WIDE
    if not crowded:
        return rows.withColumn(CHUNK, whole).drop("_slot")

    spark = rows.sparkSession
    listed = F.broadcast(spark.createDataFrame(crowded, sizes.schema).drop("_size"))
    most = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = min(sum(-(-r["_size"] // small) for r in crowded), max(most, 2))
    full = rows.join(listed, group, "left_semi").repartitionByRange(parts, *keys, *order)
    cut = full.withColumn(CHUNK, whole + F.spark_partition_id())
    rest = rows.join(listed, group, "left_anti").withColumn(CHUNK, whole)
    return cut.unionByName(rest).drop("_slot")


def over_previous(rows: DataFrame, keys: Sequence[str], order: Sequence[str], n: int, measures: dict[str, Column]) -> DataFrame:
    """Aggregates over the ``n`` rows that precede each row of its series, for chunked rows (``in_chunks``).

    Inside a chunk they are a plain window for all but its first ``n`` rows. Those need the last ``n`` rows of
    the chunks before, so the first and last ``n`` rows of every chunk go through a second window over the
    series: between two of them that belong together no other row lies. Edges are at most 2n rows a chunk,
    and chunks as many as there are stretches of time or full tasks, however many events there are.
    """
    inside = Window.partitionBy(*keys, CHUNK).orderBy(*order)
    placed = rows.withColumns({
        "_place": F.row_number().over(inside), EDGE: F.lead(F.lit(1), n).over(inside).isNull(),
        **{name: m.over(inside.rowsBetween(-n, -1)) for name, m in measures.items()},
    })
    settled = placed.filter(F.col("_place") > n)
    series = Window.partitionBy(*keys).orderBy(CHUNK, *order).rowsBetween(-n, -1)
    edges = placed.filter((F.col("_place") <= n) | F.col(EDGE)).drop(*measures)
    edges = edges.withColumns({name: m.over(series) for name, m in measures.items()}).filter(F.col("_place") <= n)
    return settled.unionByName(edges).drop("_place", EDGE)
