"""Near-duplicate vectors: sign hashing in several tables, exact cosine verification, components.

Each table hashes a vector to the signs of its products with random hyperplanes. Vectors that share a
label and a hash in any table are compared exactly. The number of signs follows the number of vectors, so
that unrelated vectors seldom meet, and the number of tables follows from it and the recall asked for.
Equal vectors are one node with a weight. Buckets beyond a block are split over pairs of blocks; what
leaves a bucket is each vector's number of links and enough links to connect it, not all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm.common import in_cells, joined_labels, met_here, mix, saved, ship, shuffle_parts, whole_groups
from gaugeworks.llm.components import connected_components

COSINE = 0.98
#: Chance of meeting in some table that a pair of exactly the wanted cosine must have.
RECALL = 0.9999
BLOCK = 512
SEED = 7


def signs_and_tables(vectors: int, cosine: float = COSINE, recall: float = RECALL) -> tuple[int, int]:
    """Signs per hash and tables: about as many hashes as vectors, and as many tables as the recall needs."""
    signs = min(62, max(8, math.ceil(math.log2(max(vectors, 1) + 1))))
    meet = (1 - math.acos(cosine) / math.pi) ** signs
    return signs, math.ceil(math.log(1 - recall) / math.log(1 - meet))


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length one in double precision."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def hashes(vectors: np.ndarray, signs: int, tables: int, seed: int = SEED) -> np.ndarray:
    """One number per vector and table. Rows are multiplied in a fixed order, so equal vectors hash alike."""
    planes = np.random.default_rng([seed, vectors.shape[1]]).standard_normal((vectors.shape[1], tables * signs))
    out = np.empty((len(vectors), tables), np.int64)
    weights = np.int64(1) << np.arange(signs, dtype=np.int64)
    for at in range(0, len(vectors), 4096):
        side = np.einsum("ij,jk->ik", vectors[at : at + 4096], planes) >= 0
        out[at : at + 4096] = side.reshape(-1, tables, signs) @ weights
    return out


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.to_list(), np.float64)


def _bucket_rows(nodes: DataFrame, signs: int, tables: int) -> DataFrame:
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for size, part in batch.groupby(batch["vec"].map(len)):
                found = hashes(unit(_matrix(part["vec"])), signs, tables)
                label = mix(part["label_key"].to_numpy().view(np.uint64) + np.uint64(size))
                keys = mix(found.view(np.uint64) ^ label[:, None])
                keys = mix(keys + np.arange(tables, dtype=np.uint64)).view(np.int64)
                yield pd.DataFrame({
                    "bucket": keys.ravel(), "place": np.tile(np.arange(tables, dtype=np.int32), len(part)),
                    "k1": np.repeat(part["k1"].to_numpy(), tables), "k2": np.repeat(part["k2"].to_numpy(), tables),
                })

    return nodes.mapInPandas(rows, "bucket long, place int, k1 long, k2 long")


def _verified(met: DataFrame, cosine: float, signs: int, tables: int) -> DataFrame:
    keys = ["bucket", "place", "cell_a", "cell_b"]

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in whole_groups(batches, keys, rows=8192):
            out = []
            frame["size"] = frame["vec"].map(len)
            for _, alike in frame.groupby("size"):
                alike = alike.reset_index(drop=True)
                vectors = unit(_matrix(alike["vec"]))
                place, block = alike["place"].to_numpy(), alike["block"].to_numpy()
                group, node, copies = alike["group"].to_numpy(), alike["node"].to_numpy(), alike["copies"].to_numpy()
                label = alike["label_key"].to_numpy()
                own = hashes(vectors, signs, tables)
                starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
                for at, end in zip(starts, np.r_[starts[1:], len(group)]):
                    if end - at < 2:
                        continue
                    x = vectors[at:end]
                    a, b = np.nonzero(np.triu(x @ x.T >= cosine - 1e-9, 1))
                    a, b = a + at, b + at
                    # the sum that decides is taken in one order, whatever the block
                    near = (vectors[a] * vectors[b]).sum(axis=1) >= cosine
                    a, b = a[near], b[near]
                    mine = met_here(alike["cell_a"][at], alike["cell_b"][at], block, a, b) & (label[a] == label[b])
                    a, b = a[mine], b[mine]
                    for table in range(int(place[at])):  # pairs count in the first table where they meet
                        if not len(a):
                            break
                        first = own[a, table] != own[b, table]
                        a, b = a[first], b[first]
                    if len(a):
                        links = np.bincount(a - at, copies[b], end - at) + np.bincount(b - at, copies[a], end - at)
                        tied = joined_labels(end - at, a - at, b - at)
                        has = links > 0
                        rows = {c: alike[c].to_numpy()[at:end][has] for c in ("k1", "k2")}
                        rows |= {"a": node[at:end][has], "b": node[at:end][tied[has]], "linked": links[has].astype("i8")}
                        out.append(pd.DataFrame(rows))
            if out:
                yield pd.concat(out)

    dealt = met.repartition(shuffle_parts(met.sparkSession), *keys).sortWithinPartitions(*keys)
    return dealt.mapInPandas(verify, "k1 long, k2 long, a long, b long, linked long")


def near_vectors(
    vectors: DataFrame, cosine: float = COSINE, recall: float = RECALL, block: int = BLOCK,
    vec_id: str = "vec_id", vec: str = "embedding", label: str = "label",
) -> DataFrame:
    """One row for each vector: vec_id, n_links, component_id, kept.

    Vectors link when their labels are equal and not null, their lengths are equal and their cosine in
    double precision is at least ``cosine``. ``n_links`` counts the other vectors linked directly,
    ``component_id`` is the smallest vec_id reachable, ``kept`` says whether that is the row's own. Vectors
    that are null, empty, zero, or hold null or non-finite components, and rows without label or id, link
    with nothing and are their own component. Repeated rows are vectors that link with each other; rows
    that share an id share a component. Other columns are left aside.
    """
    spark = vectors.sparkSession
    ship(spark)
    plain = vectors.select(
        F.col(vec_id).cast("long").alias("vec_id"), F.col(label).alias("label"),
        F.transform(F.col(vec).cast("array<double>"), lambda x: x + F.lit(0.0)).alias("vec"),
    )
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    sound = (
        F.col("vec").isNotNull() & F.col("label").isNotNull() & F.col("vec_id").isNotNull() & finite
        & F.exists("vec", lambda x: x != 0)
    )
    keyed = plain.withColumn("sound", F.coalesce(sound, F.lit(False))).withColumns({
        "label_key": F.xxhash64(F.col("label").cast("string")),
        "k1": F.xxhash64("label", "vec"), "k2": F.xxhash64(F.lit("second"), "vec", "label"),
    })
    nodes = saved(
        keyed.filter("sound").groupBy("k1", "k2", "label_key", "vec").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("copies")),
        "vectors",
    )
    signs, tables = signs_and_tables(nodes.count(), cosine, recall)
    rows = _bucket_rows(nodes, signs, tables)
    crowded = rows.groupBy("bucket", "place").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    met = rows.join(crowded, ["bucket", "place"]).join(nodes, ["k1", "k2"])
    links = saved(_verified(in_cells(met, "n", F.xxhash64("k1", "k2"), block), cosine, signs, tables), "links")
    degree = links.groupBy("k1", "k2").agg(F.sum("linked").alias("linked"))
    found = connected_components(links.select("a", "b").unionByName(_shared_ids(keyed)))
    by_node = nodes.drop("vec", "label_key").join(degree, ["k1", "k2"], "left").join(found, "node", "left")
    return keyed.drop("vec").join(by_node, ["k1", "k2"], "left").select(
        "vec_id",
        F.when(F.col("sound"), F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).otherwise(F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("sound"), F.coalesce("component", "node")).otherwise(F.col("vec_id")).alias("component_id"),
    ).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _shared_ids(keyed: DataFrame) -> DataFrame:
    """Ties between the nodes of rows that share an id but not a vector."""
    sound = keyed.filter("sound").select("vec_id", "k1", "k2")
    least = sound.groupBy("k1", "k2").agg(F.min("vec_id").alias("b"))
    shared = sound.groupBy("vec_id").agg(F.min("k1").alias("low"), F.max("k1").alias("high")).filter("low < high").select("vec_id")
    return sound.join(shared, "vec_id").join(least, ["k1", "k2"]).select(F.col("vec_id").alias("a"), "b")


#: The same for sound vectors with ids of their own, in the checking engine's SQL.
ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e,
    embedding IS NOT NULL AND label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS ok FROM embeddings),
link AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE a.ok AND b.ok AND list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (SELECT vec_id, vec_id AS other FROM v UNION SELECT r.vec_id, l.y FROM reach r JOIN link l ON l.x = r.other),
part AS (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY 1),
deg AS (SELECT x AS vec_id, count(*) AS n_links FROM link GROUP BY 1)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM part LEFT JOIN deg USING (vec_id)
"""
