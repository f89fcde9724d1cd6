"""Spelling variants: words of the corpus that differ by one edit, grouped under their usual form.

Words are counted over all whole texts. Candidates are searched in sorted lists: a task holds lists whose
words share a beginning (or, read backwards, an end) and walks each of them once for all its words by dynamic
programming. Neighbouring words of a list share their longest common prefix, so the banded rows of the edit
matrix up to there are computed once for the whole range; where every cell of a row exceeds one edit, the
range that shares this prefix is skipped.

Two words within one edit share their first or their last half, so each word lies in a forward and a backward
list; a pair counts in one of them only. A list of more than ``LIST`` words is cut by one letter more; pairs
whose edit is exactly that letter agree in all the rest, and meet in a list of their own.

Ids may be of any type and are used as text, a null id as the empty one. Null, empty and wordless texts have
no words. Repeated rows count as often as they stand. Extra columns are not read. An empty table gives none.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm.common import saved, ship, shuffle_parts, whole_groups

#: A run has one altered spelling per document when the checksum of document and run is divisible by this.
ALTERED = 199
LEAST_LENGTH = 6
LEAST_COUNT = 5
#: A usual form is at least so many times as frequent.
STEP = 5
#: Words of one sorted list; longer lists are cut by further letters, with the same pairs.
LIST = 16_384
#: Distinct words that a task counts before it hands them on.
HELD = 400_000

_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def altered(prefix: int, run: str) -> str:
    """The run, less one letter where the checksum says so; ``prefix`` is the checksum of the document's id and a colon."""
    h = zlib.crc32(run.encode(), prefix)
    if h % ALTERED:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def _counted(least: int):
    runs = re.compile(f"[A-Za-zÀ-ÿ]{{{least},}}")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()
        lowered: dict[str, str] = {}

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                prefix = zlib.crc32(f"{doc_id}:".encode())
                for run, n in Counter(runs.findall(text.as_py())).items():
                    low = lowered.get(run)
                    if low is None:
                        low = lowered[run] = run.translate(_LOWER)
                    word = altered(prefix, low)
                    if len(word) >= least:
                        total[word] += n
                if len(lowered) > HELD:
                    lowered.clear()
                if len(total) > HELD:
                    yield flush()
                    total.clear()
        yield flush()

    return count


def vocabulary(docs: DataFrame, least_count: int = LEAST_COUNT, least_length: int = LEAST_LENGTH) -> DataFrame:
    """``word`` and ``n``: how often each word of enough letters stands in all texts, where that is often enough."""
    texts = docs.filter(F.col("text").isNotNull()).select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text")
    partial = texts.mapInArrow(_counted(least_length), "word string, n long")
    return partial.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def _half(length: Column) -> Column:
    return F.floor(length / 2).cast("int")


def _lists(vocab: DataFrame) -> DataFrame:
    """Each word in its forward and backward lists: ``side``, ``half``, ``depth`` letters that all of a list share, ``key``."""
    size = F.length("word")
    halves = F.array_distinct(F.array(_half(size), _half(size - 1)))
    sides = vocab.select("word", "n", F.explode(halves).alias("half")).select(
        "*", F.explode(F.array(F.struct(F.lit("f").alias("side"), F.col("word").alias("listed")),
                               F.struct(F.lit("b").alias("side"), F.reverse("word").alias("listed")))).alias("s")
    )
    return sides.select(
        "word", "n", "half", "s.side", "s.listed", F.col("half").alias("depth"), F.lit(False).alias("cut"),
        F.substring("s.listed", F.lit(1), F.col("half")).alias("key"),
    )


_LIST = ["side", "half", "depth", "cut", "key"]


def _cut_long(lists: DataFrame, most: int) -> DataFrame:
    """Cut lists of more than ``most`` words by one letter after the other until none is left."""
    done = None
    while True:
        sizes = lists.groupBy(*_LIST).agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > most)
        long = saved(sizes.filter(~F.col("cut")).drop("size"), "long-lists")
        if long.isEmpty():
            return lists if done is None else done.unionByName(lists)
        short = lists.join(long, _LIST, "left_anti")
        done = short if done is None else done.unionByName(short)
        depth = F.col("depth")
        here = lists.join(long, _LIST, "left_semi")
        start = F.substring("listed", F.lit(1), depth)
        rest = lambda skip: F.concat_ws("*", start, F.substring(F.col("listed"), depth + 1 + skip, F.length("listed")))
        longer = here.filter(F.length("listed") > depth)
        deeper = longer.withColumn("key", F.substring("listed", F.lit(1), depth + 1)).withColumn("depth", depth + 1)
        meets = longer.withColumn("key", rest(1)).unionByName(here.withColumn("key", rest(0))).withColumn("cut", F.lit(True))
        done = done.unionByName(meets.select(*lists.columns))
        lists = saved(deeper.select(*lists.columns), "cut-lists")


class _Lists:
    """Sorted lists as one flat array of letters: word ``i`` is ``flat[start[i]:start[i] + size[i]]``."""

    def __init__(self, words: list[str]):
        letters = [w.encode("latin-1") for w in words]
        self.size = np.array([len(w) for w in letters], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.size)[:-1]]) if letters else np.empty(0, np.int64)
        self.flat = np.frombuffer(b"".join(letters) + b"\0", np.uint8)

    def letter(self, word: np.ndarray, at) -> np.ndarray:
        """Letter of each word at a place, 0 outside."""
        inside = (at >= 0) & (at < self.size[word])
        return np.where(inside, self.flat[np.where(inside, self.start[word] + at, -1)], 0)

    def shared(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Length of the common prefix of the words a and b, ``most`` at most."""
        out = np.zeros(len(a), np.int64)
        going = np.flatnonzero(most > 0)
        at = 0
        while len(going):
            x = self.letter(a[going], at)
            going = going[(x == self.letter(b[going], at)) & (x > 0)]
            at += 1
            out[going] = at
            going = going[most[going] > at]
        return out


def one_edit_apart(lists: _Lists, group: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ordered pairs (a, b) of different words of a list, sorted and distinct, within one edit.

    ``group`` numbers the lists in ascending order; all words of a list share ``depth`` letters. The walk goes
    over all lists of the call letter by letter: a node is a range of a list that shares so many letters.
    """
    n = len(group)
    found_a, found_b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    if not n:
        return found_a[0], found_b[0]
    lcp = np.full(n, -1, np.int64)
    near = np.flatnonzero(group[1:] == group[:-1]) + 1
    lcp[near] = lists.shared(near - 1, near, np.minimum(lists.size[near - 1], lists.size[near]))
    query = node = np.empty(0, np.int64)
    row = np.empty((3, 0), np.int8)
    at, live = int(depth.min()), np.arange(n)
    while True:
        live = live[lists.size[live] >= at]
        inside = live[depth[live] <= at]
        first = lcp[inside] < at
        head = inside[first]  # first word of each node
        node_of = np.full(n, -1, np.int64)
        node_of[inside] = np.cumsum(first) - 1
        if at > int(depth.min()) and len(query):
            # children of the nodes of the level before; lists that begin here have none
            kids = np.flatnonzero(before_node[head] >= 0)
            kids_from = np.searchsorted(before_node[head[kids]], np.arange(before_count + 1))
            count = kids_from[node + 1] - kids_from[node]
            which = np.repeat(np.arange(len(node)), count)
            nth = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
            query, node, old = query[which], kids[kids_from[node][which] + nth], row[:, which]
            letter = lists.letter(head[node], at - 1)
            row = np.empty((3, len(query)), np.int8)
            left = np.full(len(query), 2, np.int8)
            for k in range(3):  # columns at - 1, at, at + 1 of the row of this letter
                column = at - 1 + k
                cell = old[k] + (letter != lists.letter(query, column - 1))
                if k < 2:
                    cell = np.minimum(cell, old[k + 1] + 1)
                cell = np.minimum(cell, left + 1)
                cell[(lists.size[query] < column) | (cell > 2)] = 2
                row[k] = left = cell
            keep = row.min(axis=0) <= 1
            query, node, row = query[keep], node[keep], row[:, keep]
        begin = inside[depth[inside] == at]
        if len(begin):
            query, node = np.concatenate([query, begin]), np.concatenate([node, node_of[begin]])
            fresh = np.empty((3, len(begin)), np.int8)
            fresh[0], fresh[1], fresh[2] = 1, 0, np.where(lists.size[begin] > at, 1, 2)
            row = np.concatenate([row, fresh], axis=1)
        width = np.diff(np.append(np.flatnonzero(first), len(inside)))
        # words that end here
        ended = lists.size[head[node]] == at
        column = lists.size[query] - at + 1
        hit = np.flatnonzero(ended & (column >= 0) & (column <= 2) & (head[node] != query))
        hit = hit[row[column[hit], hit] <= 1]
        found_a.append(query[hit])
        found_b.append(head[node[hit]])
        # a range that is the word itself, or whose only word ends here, is done
        keep = ~((width[node] == 1) & (ended | (head[node] == query)))
        query, node, row = query[keep], node[keep], row[:, keep]
        before_node, before_count = node_of, len(head)
        waiting = depth[live] > at
        if not len(query):
            if not waiting.any():
                break
            at = int(depth[live][waiting].min())
            before_count = 0
            continue
        at += 1
    return np.concatenate(found_a), np.concatenate(found_b)


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in whole_groups(batches, _LIST):
        words = frame["word"].to_numpy()
        lists = _Lists(frame["listed"].tolist())
        group = frame["group"].to_numpy(np.int64)
        depth, half, cut = frame["depth"].to_numpy(np.int64), frame["half"].to_numpy(np.int64), frame["cut"].to_numpy(bool)
        a, b = one_edit_apart(lists, group, depth)
        # a pair counts in one list: that of its own half, forward if the first halves agree, cut where it differs
        keep = half[a] == np.minimum(lists.size[a], lists.size[b]) // 2
        keep &= ~cut[a] | (lists.letter(a, depth[a]) != lists.letter(b, depth[a]))
        a, b = a[keep], b[keep]
        back = np.flatnonzero((frame["side"] == "b").to_numpy()[a])
        forward = _Lists(frame["word"].tolist())
        agree = forward.shared(a[back], b[back], half[a[back]]) >= half[a[back]]
        a, b = np.delete(a, back[agree]), np.delete(b, back[agree])
        if not len(a):
            continue
        n = frame["n"].to_numpy(np.int64)
        rank = np.empty(len(words), np.int64)
        rank[np.argsort(words, kind="stable")] = np.arange(len(words))
        order = np.lexsort((rank[b], -n[b], a))
        a, b = a[order], b[order]
        at, count = np.unique(a, return_index=True, return_counts=True)[1:]
        yield pd.DataFrame({"word": words[a[at]], "n_near": count, "near_n": n[b[at]], "near": words[b[at]]})


def near_words(vocab: DataFrame, most: int = LIST) -> DataFrame:
    """``n_near`` (words one edit away) and the most frequent of them (``near``, ``near_n``) for every word and its ``n``."""
    ship(vocab.sparkSession)
    parts = shuffle_parts(vocab.sparkSession)
    lists = _cut_long(_lists(vocab), most).repartition(parts, *_LIST).sortWithinPartitions(*_LIST, "listed")
    partial = lists.mapInPandas(_scan, "word string, n_near long, near_n long, near string")
    none = vocab.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("long").alias("near_n"), F.lit(None).cast("string").alias("near"))
    both = none.unionByName(partial.withColumn("n", F.lit(None).cast("long")))
    best = F.min(F.when(F.col("near").isNotNull(), F.struct((-F.col("near_n")).alias("less"), "near")))
    out = both.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best.alias("b"))
    return out.select("word", "n", "n_near", F.col("b.near").alias("near"), (-F.col("b.less")).alias("near_n"))


def _roots(forms: DataFrame) -> DataFrame:
    """Last form of each chain. Counts grow by ``STEP`` at each form, so a chain of 64-bit counts has under 28 links: five doublings."""
    links = saved(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        joined = links.join(ahead, "root", "left")
        further = saved(joined.select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")), "forms")
        links = further.drop("moved")
        if further.filter("moved").isEmpty():
            return links


def variants(docs: DataFrame, least_count: int = LEAST_COUNT, most: int = LIST) -> DataFrame:
    """``word``, ``n``, ``n_near``, ``form`` and ``form_n`` (null without), ``root`` of every word of the corpus.

    ``form`` is the near word of largest ``n`` (ties: the smallest in code-point order) if that is ``STEP``
    times as frequent; ``root`` follows the forms to the last one.
    """
    vocab = saved(vocabulary(docs, least_count), "vocabulary")
    usual = F.col("near_n") >= STEP * F.col("n")
    words = saved(
        near_words(vocab, most).select("word", "n", "n_near", F.when(usual, F.col("near")).alias("form"), F.when(usual, F.col("near_n")).alias("form_n")),
        "near-words",
    )
    roots = _roots(words.filter(F.col("form").isNotNull()))
    return words.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))


_BITS = "list_reduce([b::UBIGINT] || range(0, 8)::UBIGINT[], lambda a, i: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::UBIGINT) ELSE a >> 1 END)"


def crc32_sql(text: str) -> str:
    """Unsigned CRC-32 of a text's UTF-8 bytes; needs ``crc_table``, the 256 steps of one byte."""
    octets = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: ('0x' || h)::UBIGINT)"
    step = "lambda a, b: xor(a >> 8, t[(xor(a, b) & 255)::BIGINT + 1])"
    return f"xor(list_reduce([4294967295::UBIGINT] || {octets}, {step}), 4294967295::UBIGINT)"


CRC_TABLE = f"crc_table AS MATERIALIZED (SELECT list_transform(range(0, 256), lambda b: {_BITS}) AS t)"

ORACLE = f"""
WITH RECURSIVE {CRC_TABLE},
runs AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS c
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents) WHERE length(run) >= 6 GROUP BY 1, 2),
hashed AS (SELECT run, c, ({crc32_sql("id || ':' || run")})::BIGINT AS h FROM runs, crc_table),
vocab AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS w, sum(c)::BIGINT AS n
  FROM hashed GROUP BY 1 HAVING sum(c) >= 5 AND length(w) >= 6),
places AS (SELECT w, n, unnest(range(1, length(w) + 1)) AS i FROM vocab),
cut AS (SELECT w, n, i, length(w) AS l, substr(w, 1, i - 1) || substr(w, i + 1) AS rest FROM places),
near AS (SELECT DISTINCT a.w, a.n, b.w AS v, b.n AS m FROM cut a JOIN cut b ON a.i = b.i AND a.l = b.l AND a.rest = b.rest AND a.w <> b.w
  UNION SELECT a.w, a.n, b.w, b.n FROM cut a JOIN vocab b ON a.rest = b.w
  UNION SELECT b.w, b.n, a.w, a.n FROM cut a JOIN vocab b ON a.rest = b.w),
best AS (SELECT w, count(*) AS n_near, max(m) AS m FROM near GROUP BY 1),
usual AS (SELECT near.w, min(v) AS form, any_value(near.m) AS form_n FROM near JOIN best USING (w, m) WHERE near.m >= 5 * near.n GROUP BY 1),
chain AS (SELECT w, form AS last, 1 AS step FROM usual UNION ALL SELECT chain.w, usual.form, step + 1 FROM chain JOIN usual ON chain.last = usual.w),
ends AS (SELECT w, arg_max(last, step) AS root FROM chain GROUP BY 1)
SELECT w AS word, n, coalesce(n_near, 0)::BIGINT AS n_near, form, form_n, coalesce(root, w) AS root
FROM vocab LEFT JOIN best USING (w) LEFT JOIN usual USING (w) LEFT JOIN ends USING (w)"""
