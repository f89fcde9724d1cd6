"""Self-join of texts by Jaccard similarity of word n-grams: MinHash bands find, full sets verify.

1. Each text is sketched once: band hashes for the search, one byte of each MinHash for a first look.
2. Rows meet on equal band hashes. Where two and more distinct texts meet, their sketches are compared;
   pairs that are clearly apart are dropped, the others tie their texts into clusters.
3. The texts of a cluster are brought together and all their pairs verified on the full n-gram sets.

Step 2 only gathers: it keeps enough ties to connect each cluster, not all pairs. Groups beyond a block
are split over pairs of blocks in steps 2 and 3, so no task holds one, and step 3 gives counts and enough
links to connect what is linked, not a row for each pair. Equal texts are one node throughout.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm.common import (
    exact_id, in_cells, joined_labels, met_here, mix, plain_id, rolled, saved, ship, shuffle_parts, split_words, text_key, whole_groups,
    word_hashes,
)
from gaugeworks.llm.components import connected_components

WORDS = 5
SIMILARITY = 0.8
ROWS = 5
#: Chance of meeting in some band that a pair of exactly the wanted similarity must have.
RECALL = 0.9999
#: Texts of one block when a group is split.
SKETCH_BLOCK = 512
VERIFY_BLOCK = 256


def bands_for(similarity: float, rows: int = ROWS, recall: float = RECALL) -> int:
    """Bands of ``rows`` MinHashes that reach the recall at the similarity."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Distinct hashes of a text's word n-grams, sorted; a shorter text is one n-gram, an empty one none."""
    hashes = word_hashes(split_words(text))
    return np.unique(rolled(hashes, min(words, len(hashes)))) if len(hashes) else np.empty(0, np.uint64)


def _min_hashes(sets: list[np.ndarray], count: int) -> np.ndarray:
    """``count`` MinHashes of each set (none may be empty), the least of a multiplied and shifted hash."""
    starts = np.cumsum([0, *map(len, sets[:-1])])
    flat = np.concatenate(sets)
    odd = mix(np.arange(1, count + 1, dtype=np.uint64)) | np.uint64(1)
    out = np.empty((len(sets), count), np.uint64)
    for k, factor in enumerate(odd):
        out[:, k] = np.minimum.reduceat((flat * factor) >> np.uint64(16), starts)
    return mix(out)


def _sketched(docs: DataFrame, words: int, rows: int, bands: int) -> DataFrame:
    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for at in range(0, len(whole), 256):
                batch = whole.iloc[at : at + 256]
                sets = [shingles(t, words) for t in batch["text"]]
                full = np.array([len(s) > 0 for s in sets], bool)
                keys, looks = [None] * len(batch), [None] * len(batch)
                if full.any():
                    hashes = _min_hashes([s for s in sets if len(s)], rows * bands)
                    weights = mix(np.arange(1, rows + 1, dtype=np.uint64)) | np.uint64(1)
                    of_band = (hashes.reshape(-1, bands, rows) * weights).sum(axis=2, dtype=np.uint64)
                    of_band = mix(of_band + np.arange(bands, dtype=np.uint64)).view(np.int64)
                    small = (hashes & np.uint64(255)).astype(np.uint8)
                    for k, row in enumerate(np.flatnonzero(full)):
                        keys[row], looks[row] = of_band[k], small[k].tobytes()
                yield batch.drop(columns="text").assign(bands=keys, sketch=looks)

    schema = "doc_id decimal(20,0), t1 long, t2 long, bands array<long>, sketch binary"
    out = plain_id(docs.withColumn("doc_id", exact_id()).mapInPandas(sketch, schema))
    return out.withColumn("row", F.monotonically_increasing_id())


def _tied(met: DataFrame, least: float) -> DataFrame:
    """Pairs that connect, within each group, the texts whose sketches agree in a share of ``least``."""

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in whole_groups(batches, ["band", "cell_a", "cell_b"]):
            looks = np.frombuffer(b"".join(frame["sketch"]), np.uint8).reshape(len(frame), -1)
            nodes, block = frame["node"].to_numpy(), frame["block"].to_numpy()
            cell_a, cell_b = frame["cell_a"].to_numpy(), frame["cell_b"].to_numpy()
            starts = np.flatnonzero(np.r_[True, frame["group"].to_numpy()[1:] != frame["group"].to_numpy()[:-1]])
            sizes = np.diff(np.r_[starts, len(frame)])
            left, right = [], []
            for size in np.unique(sizes[sizes > 1]):
                rows = starts[sizes == size]
                if size <= 16:  # many small groups of one size at once
                    i, j = np.triu_indices(size, 1)
                    a, b = (rows[:, None] + i).ravel(), (rows[:, None] + j).ravel()
                    near = np.empty(len(a), bool)
                    for k in range(0, len(a), 200_000):
                        near[k : k + 200_000] = (looks[a[k : k + 200_000]] == looks[b[k : k + 200_000]]).mean(axis=1) >= least
                    left.append(a[near])
                    right.append(b[near])
                    continue
                for row in rows:
                    own, a, b = looks[row : row + size], [], []
                    for k in range(size - 1):
                        hit = k + 1 + np.flatnonzero((own[k + 1 :] == own[k]).mean(axis=1) >= least)
                        a.append(np.full(len(hit), k))
                        b.append(hit)
                    a, b = np.concatenate(a), np.concatenate(b)
                    mine = met_here(cell_a[row], cell_b[row], block[row : row + size], a, b)
                    label = joined_labels(size, a[mine], b[mine])
                    moved = np.flatnonzero(label != np.arange(size))
                    left.append(row + moved)
                    right.append(row + label[moved])
            if left:
                a, b = np.concatenate(left), np.concatenate(right)
                yield pd.DataFrame({"a": nodes[a], "b": nodes[b]}).drop_duplicates()

    keys = ["band", "cell_a", "cell_b"]
    dealt = met.repartition(shuffle_parts(met.sparkSession), *keys).sortWithinPartitions(*keys)
    return dealt.mapInPandas(compare, "a long, b long")


def _links(sets: list[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the pairs of sets whose Jaccard similarity is at least ``similarity``."""
    if len(sets) == 2:
        common = len(np.intersect1d(*sets, assume_unique=True))
        hit = common / (len(sets[0]) + len(sets[1]) - common) >= similarity
        return (np.array([0]), np.array([1])) if hit else (np.empty(0, int), np.empty(0, int))
    sizes = np.array([len(s) for s in sets])
    _, code, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    shared = count[code] > 1
    code, owner = code[shared], owner[shared]
    distinct, code = np.unique(code, return_inverse=True)
    order = np.argsort(code, kind="stable")
    code, owner = code[order], owner[order]
    common = np.zeros((len(sets), len(sets)), np.float64)
    width = 4096
    for low in range(0, len(distinct), width):
        part = slice(*np.searchsorted(code, [low, low + width]))
        has = np.zeros((len(sets), min(width, len(distinct) - low)), np.float32)
        has[owner[part], code[part] - low] = 1
        common += has @ has.T
    near = common / (sizes[:, None] + sizes[None, :] - common) >= similarity
    return np.nonzero(np.triu(near, 1))


def _verified(members: DataFrame, words: int, similarity: float, block: int) -> DataFrame:
    """For each text of a cluster cell with links: the weight it is linked to, and the text it is tied to."""

    def sets_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.drop(columns="text").assign(grams=[shingles(t, words).tobytes() for t in batch["text"]])

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in whole_groups(batches, ["cluster", "cell_a", "cell_b"], rows=512):
            out = []
            for _, group in frame.groupby("group"):
                if len(group) < 2:
                    continue
                sets = [np.frombuffer(g, np.uint64) for g in group["grams"]]
                a, b = _links(sets, similarity)
                own = group["block"].to_numpy()
                mine = met_here(group["cell_a"].iloc[0], group["cell_b"].iloc[0], own, a, b)
                a, b = a[mine], b[mine]
                if not len(a):
                    continue
                weight, node = group["copies"].to_numpy(), group["node"].to_numpy()
                linked = np.bincount(a, weight[b], len(group)) + np.bincount(b, weight[a], len(group))
                label = joined_labels(len(group), a, b)
                has = linked > 0
                out.append(pd.DataFrame({"a": node[has], "b": node[label[has]], "linked": linked[has].astype("i8")}))
            if out:
                yield pd.concat(out)

    spark = members.sparkSession
    ready = members.mapInPandas(sets_of, "cluster long, n long, node long, copies long, grams binary")
    keys = ["cluster", "cell_a", "cell_b"]
    cells = in_cells(ready, "n", F.xxhash64("node"), block)
    dealt = cells.repartition(shuffle_parts(spark), *keys).sortWithinPartitions(*keys)
    return dealt.mapInPandas(verify, "a long, b long, linked long")


def similar_texts(
    docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, rows: int = ROWS, recall: float = RECALL,
    sketch_block: int = SKETCH_BLOCK, verify_block: int = VERIFY_BLOCK,
) -> DataFrame:
    """One row for each document (doc_id, text): class_id, n_links, component_id, kept, and the key of its text.

    A link joins two documents whose sets of word n-grams have a Jaccard similarity of at least
    ``similarity``. ``class_id`` is the smallest doc_id with the very same text, ``n_links`` the number of
    other documents linked directly (copies count one by one), ``component_id`` the smallest doc_id
    reachable over links. ``kept`` is true for one row of each component: of those with that id, the first.
    Texts without a word (null, empty, blank) link with nothing, not even each other: their component_id is
    their own. Rows without doc_id take part; an id is null only if all ids it is the smallest of are null.
    Repeated rows are documents of their own, linked with each other. Other columns are left aside.
    """
    spark = docs.sparkSession
    ship(spark)
    keyed = docs.select("doc_id", *text_key("text"), "text")
    bands = bands_for(similarity, rows, recall)
    all_rows = saved(_sketched(keyed, words, rows, bands), "sketches")
    wordy = all_rows.filter("sketch IS NOT NULL")
    classes = saved(
        wordy.groupBy("t1", "t2").agg(
            F.min("row").alias("node"), F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("copies")
        ),
        "classes",
    )
    nodes = wordy.join(classes.select(F.col("node").alias("row")), "row", "left_semi")
    by_band = nodes.select(F.col("row").alias("node"), F.explode("bands").alias("band"))
    crowded = by_band.groupBy("band").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    # a pair at the wanted similarity falls under this share with a chance of about one in 10**10
    least = similarity - 6.3 * math.sqrt(similarity * (1 - similarity) / (rows * bands))
    met = by_band.join(crowded, "band").join(nodes.select(F.col("row").alias("node"), "sketch"), "node")
    ties = _tied(in_cells(met, "n", F.xxhash64("node"), sketch_block), least)
    clusters = saved(connected_components(ties), "clusters")
    sizes = clusters.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    wanted = (
        clusters.join(sizes, "component").join(classes, "node")
        .select(F.col("component").alias("cluster"), "n", "node", "copies", "t1", "t2", "class_id")
    )
    texts = keyed.withColumnRenamed("doc_id", "class_id").groupBy("t1", "t2", "class_id").agg(F.any_value("text").alias("text"))
    same = (texts.t1 == wanted.t1) & (texts.t2 == wanted.t2) & texts.class_id.eqNullSafe(wanted.class_id)
    members = wanted.join(texts, same).select("cluster", "n", "node", "copies", "text")
    links = saved(_verified(members, words, similarity, verify_block), "links")
    degree = links.groupBy("a").agg(F.sum("linked").alias("linked")).withColumnRenamed("a", "node")
    found = connected_components(links)
    linked = classes.join(degree, "node", "left").join(found, "node", "left")
    linked = linked.withColumn("component", F.coalesce("component", "node"))
    smallest = linked.groupBy("component").agg(F.min("class_id").alias("component_id"))
    linked = saved(linked.join(smallest, "component"), "linked")
    held = wordy.join(
        linked.filter(F.col("class_id").eqNullSafe(F.col("component_id"))).select("t1", "t2", "component", "component_id"),
        ["t1", "t2"],
    ).filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    first = held.groupBy("component").agg(F.min("row").alias("first"))
    by_text = linked.join(first, "component", "left").select("t1", "t2", "class_id", "copies", "linked", "component_id", "first")
    return all_rows.drop("bands", "sketch").join(by_text, ["t1", "t2"], "left").select(
        "doc_id",
        F.coalesce("class_id", "doc_id").alias("class_id"),
        (F.coalesce("linked", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1).alias("n_links"),
        F.when(F.col("first").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        (F.col("first").isNull() | (F.col("first") == F.col("row"))).alias("kept"),
        "t1", "t2",
    )


def keep_one_of_each(docs: DataFrame, **parameters) -> DataFrame:
    """The documents without those that are near copies of a kept one; all columns of ``docs``, whatever their names.

    Of repeated rows (equal id and text) of which one stays, it is the first by the JSON text of the whole row.
    """
    counted = similar_texts(docs, **parameters).groupBy("doc_id", "t1", "t2").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if("kept").alias("stay")
    )
    kept = saved(counted.filter("stay > 0"), "kept")
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("d"), *[k.alias(f"k{i}") for i, k in enumerate(text_key("text"))])
    same = F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("k0") == F.col("t1")) & (F.col("k1") == F.col("t2"))
    out = rows.join(kept.filter("stay = rows"), same).select("row")
    some = kept.filter("stay < rows")
    if not some.isEmpty():
        first = rows.join(some, same).groupBy("doc_id", "t1", "t2").agg(F.min_by("row", F.to_json("row")).alias("row"))
        out = out.unionByName(first.select("row"))
    return out.select("row.*")


#: The same for texts with a doc_id of their own, in the checking engine's SQL.
ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
grams AS (
  SELECT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS u(i)
  WHERE len(w) > 0 GROUP BY ALL),
n AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY 1),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM grams a JOIN grams b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (
  SELECT x, y FROM common JOIN n AS p ON p.doc_id = x JOIN n AS q ON q.doc_id = y WHERE c / (p.n + q.n - c)::DOUBLE >= 0.8),
reach AS (SELECT doc_id, doc_id AS other FROM w UNION SELECT r.doc_id, l.y FROM reach r JOIN link l ON l.x = r.other),
part AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY 1),
deg AS (SELECT x AS doc_id, count(*) AS n_links FROM link GROUP BY 1),
cls AS (SELECT doc_id, CASE WHEN len(w) > 0 THEN min(doc_id) OVER (PARTITION BY text) ELSE doc_id END AS class_id FROM w)
SELECT doc_id, class_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, doc_id = component_id AS kept
FROM cls JOIN part USING (doc_id) LEFT JOIN deg USING (doc_id)
"""
