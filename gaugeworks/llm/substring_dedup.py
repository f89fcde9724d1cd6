"""Repeated word sequences, found in suffix trees that are split by variable-length prefixes.

Only suffixes that begin at an anchor enter a tree: in every window of ``WINDOW`` words the anchor is the
place whose ``PREFIX`` words hash lowest, so equal windows have their anchors at equal places and no
repeat is missed, while there is one suffix to some twenty words.

1. Suffixes are counted by their prefix of ``PREFIX`` words. Prefixes of one text only have no inner node
   and go.
2. The suffixes of a prefix, each with the words of its windows, form a group of a bounded size and meet in
   one task. There, the sorted suffixes and the lengths of common beginnings of neighbours are the subtree:
   a run of neighbours with d and more words in common is an inner node of depth d. The words before the
   anchors form a second tree, read backwards. A window with k words before its anchor belongs to a node
   of depth WINDOW - k in the first tree and one of depth k in the second; windows with the same two are
   equal, and the smallest doc_id among them is the first.
3. Prefixes with more suffixes than a group may have are doubled, to 16 and 32 words, until their groups fit. A
   window that ends before its longer prefix does takes words from before the anchor instead. Where even all
   words of a window do not split a group, its windows are equal, and the first doc_id is a minimum, combined
   before the shuffle.

Equal texts are one text throughout: copies behind the first are repeats as a whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm.common import (
    SPACE, exact_id, mix, plain_id, rolled, saved, ship, shuffle_parts, split_words, text_key, whole_groups, word_hashes,
)

WINDOW = 50
PREFIX = 8
#: Suffixes of a prefix that one task may gather.
GROUP = 16384
#: Parts of segments that a task hands on at once, and suffixes that it puts into trees at once if groups are smaller.
PARTS = 4_000
#: Suffixes that a task remembers to combine equal ones; beyond it the memory starts afresh, which changes no result.
MET = 200_000
SEGMENT = ["key", "t1", "t2", "first", "starts", "windows", "before", "words"]
#: Runs of repeated windows: each goes from low to high behind each of the starts.
RUNS = "t1 long, t2 long, starts array<int>, low int, high int"


def _least_place(values: np.ndarray, span: int) -> np.ndarray:
    """Place of the smallest of ``span`` values from each place on; the first of equal ones."""
    place, width = np.arange(len(values)), 1

    def both(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return np.where(values[right] < values[left], right, left)

    while width * 2 <= span:
        place = both(place[:-width], place[width:])
        width *= 2
    return both(place[: len(values) - span + 1], place[span - width :][: len(values) - span + 1]) if span > width else place


def anchors(hashes: np.ndarray, lengths: np.ndarray, window: int, prefix: int) -> pd.DataFrame:
    """Anchors of texts that stand one after another in ``hashes``: a row for each run of windows with one anchor.

    doc (number of the text), key (hash of the prefix), start (first window, words from 0 in its text), windows
    (how many follow each other), before (words from the first window to the anchor).
    """
    ends = np.cumsum(lengths)
    doc = np.repeat(np.arange(len(lengths)), lengths)
    if len(hashes) < window:
        return pd.DataFrame({c: np.empty(0, np.int64) for c in ("doc", "key", "start", "windows", "before")})
    keys = rolled(hashes, prefix)
    place = _least_place(keys, window - prefix + 1)
    start = np.arange(len(place))
    inside = start + window <= ends[doc[: len(place)]]
    start, place = start[inside], place[inside]
    owner = doc[start]
    first = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (owner[1:] != owner[:-1])]) if len(start) else np.empty(0, int)
    count = np.diff(np.r_[first, len(start)])
    owner, base = owner[first], (ends - lengths)[owner[first]]
    return pd.DataFrame({
        "doc": owner, "key": keys[place[first]].view(np.int64), "start": start[first] - base,
        "windows": count, "before": place[first] - start[first],
    })


def _digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _read(docs: DataFrame, window: int, prefix: int) -> DataFrame:
    """Per document its words' number and digest, and its anchors."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for at in range(0, len(whole), 256):
                batch = whole.iloc[at : at + 256]
                words = [split_words(t) for t in batch["text"]]
                lengths = np.array([len(w) for w in words])
                found = anchors(word_hashes([x for w in words for x in w]), lengths, window, prefix)
                cut = np.searchsorted(found["doc"].to_numpy(), np.arange(len(words) + 1))
                lists = {
                    c: [v[a:b] for a, b in zip(cut[:-1], cut[1:])]
                    for c in ("key", "start", "windows", "before") for v in [found[c].to_numpy()]
                }
                yield batch.drop(columns="text").assign(n_words=lengths, digest=[_digest(w) for w in words], **lists)

    lists = "key array<long>, start array<int>, windows array<int>, before array<int>"
    schema = f"doc_id decimal(20,0), t1 long, t2 long, n_words long, digest string, {lists}"
    return plain_id(docs.withColumn("doc_id", exact_id()).mapInPandas(read, schema))


def _segments(held: DataFrame, window: int) -> DataFrame:
    """Each wanted suffix with the words of all its windows, combined before the shuffle.

    Suffixes of one text with the same words are one row with several ``starts``. A suffix whose words the
    task has met in a smaller document is settled: all its windows are repeats, and its row has no words.
    """

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        met: dict[bytes, int] = {}
        for batch in batches:
            rows = []
            for t1, t2, first, text, wanted in zip(batch["t1"], batch["t2"], batch["first"], batch["text"], batch["wanted"]):
                words = split_words(text)
                own: dict[tuple, list[int]] = {}
                for w in wanted:
                    start = w["start"]
                    part = b" ".join(words[start : start + w["windows"] + window - 1])
                    own.setdefault((w["key"], w["windows"], w["before"], part), []).append(start)
                for (key, windows, before, part), starts in own.items():
                    name = hashlib.blake2b(part + b"%d" % before, digest_size=16).digest()
                    smallest = met.get(name)
                    if smallest is None or first < smallest:
                        met[name] = first
                    rows.append((key, t1, t2, first, starts, windows, before, None if smallest is not None and smallest < first else part))
            if len(met) > MET:
                met.clear()
            yield pd.DataFrame(rows, columns=SEGMENT)

    schema = "key long, t1 long, t2 long, first long, starts array<int>, windows int, before int, words binary"
    return held.select("t1", "t2", "first", "text", "wanted").mapInPandas(cut, schema)


def _common(rows: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows within groups, and how many leading codes each has in common with the row before it."""
    keyed = np.concatenate([group[:, None], rows], axis=1).astype(">u4")
    order = np.argsort(np.ascontiguousarray(keyed).view(f"S{4 * keyed.shape[1]}").ravel(), kind="stable")
    sorted_rows, own = rows[order], group[order]
    alike = (sorted_rows[1:] == sorted_rows[:-1]) & (sorted_rows[1:] > 0) & (own[1:] == own[:-1])[:, None]
    return order, np.r_[0, np.logical_and.accumulate(alike, axis=1).sum(axis=1)]


def _nodes(order: np.ndarray, common: np.ndarray, group_start: np.ndarray, depth: int) -> np.ndarray:
    """The tree node of each row at a depth: runs of neighbours with that many codes in common."""
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum((common < depth) | group_start)
    return out


def repeats_in_groups(frame: pd.DataFrame, window: int) -> pd.DataFrame:
    """Windows of whole prefix groups that also start in a smaller document, as RUNS."""
    count = len(frame)
    words = [w.split() for w in frame["words"]]
    lengths = np.array([len(w) for w in words])
    codes = pd.factorize(np.array([x for w in words for x in w], dtype=object))[0].astype(np.int64) + 1
    at = np.cumsum(lengths) - lengths
    before = frame["before"].to_numpy().astype(np.int64)
    windows, first, group = frame["windows"].to_numpy(), frame["first"].to_numpy(), frame["group"].to_numpy()

    def side(step: np.ndarray, have: np.ndarray) -> np.ndarray:
        inside = np.abs(step)[None, :] <= have[:, None] if step[0] else np.abs(step)[None, :] < have[:, None]
        where = (at + before)[:, None] + step[None, :]
        return np.where(inside, codes[np.clip(where, 0, len(codes) - 1)], 0)

    trees = []
    for rows in (side(np.arange(window), lengths - before), side(-np.arange(1, window + 1), before)):
        order, common = _common(rows, group)
        own = group[order]
        trees.append((order, common, np.r_[True, own[1:] != own[:-1]]))
    row_of, start_of = [], []
    for k in range(int(before.max()) + 1):
        has = np.flatnonzero((k <= before) & (k > before - windows))
        if len(has) < 2:
            continue
        node = _nodes(*trees[0], window - k)[has] * (count + 2) + _nodes(*trees[1], k)[has]
        distinct, code = np.unique(node, return_inverse=True)
        if len(distinct) == len(has):
            continue
        least = np.full(len(distinct), np.iinfo(np.int64).max)
        np.minimum.at(least, code, first[has])
        late = has[first[has] > least[code]]
        row_of.append(late)
        start_of.append(before[late] - k)
    rows = np.concatenate(row_of) if row_of else np.empty(0, int)
    starts = np.concatenate(start_of) if row_of else np.empty(0, int)
    order = np.lexsort((starts, rows))
    rows, starts = rows[order], starts[order]
    new = np.flatnonzero(np.r_[True, (rows[1:] != rows[:-1]) | (starts[1:] != starts[:-1] + 1)]) if len(rows) else rows
    last = np.r_[new[1:], len(rows)] - 1 if len(rows) else rows
    own = frame.iloc[rows[new]]
    return pd.DataFrame({**{c: own[c].to_numpy() for c in ("t1", "t2", "starts")}, "low": starts[new], "high": starts[last]})


def _in_subtrees(segments: DataFrame, window: int) -> DataFrame:
    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in whole_groups(batches, ["key"], PARTS):
            yield repeats_in_groups(frame, window)

    dealt = segments.repartition(shuffle_parts(segments.sparkSession), "key").sortWithinPartitions("key")
    return dealt.mapInPandas(find, RUNS)


def lengthened(words: list[bytes], before: int, windows: int, length: int, window: int) -> Iterator[tuple[int, int, bytes]]:
    """(first window, how many, context) of the parts of a segment whose windows share a longer context of ``length`` words.

    The context begins at the anchor and runs to the right. A window that ends before has as many words to the left of
    the anchor instead; equal windows have their anchor at the same place, hence the same context.
    """
    reach = window - length
    whole = max(before - reach, 0)  # windows from this one on hold the context to the right of the anchor
    if whole < windows:
        yield whole, windows - whole, b" ".join(words[before : before + length])
    for w in range(min(whole, windows)):
        context = words[w + window - length : w + window]
        yield w, 1, b"%d " % (before - w) + b" ".join(context)


def _longer(segments: DataFrame, length: int, window: int) -> DataFrame:
    """The segments cut into parts by contexts of ``length`` words, which are their new keys.

    As in ``_segments``, a part whose words the task has met in a smaller document is settled, and has no words.
    """

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        met: dict[bytes, int] = {}
        rows: list[tuple] = []
        for batch in batches:
            for key, t1, t2, first, starts, windows, before, text in zip(*[batch[c] for c in SEGMENT]):
                words = text.split()
                for w, count, context in lengthened(words, before, windows, length, window):
                    part = b" ".join(words[w : w + count + window - 1])
                    name = hashlib.blake2b(b"%d %d " % (key, before - w) + part, digest_size=16).digest()
                    smallest = met.get(name)
                    if smallest is None or first < smallest:
                        met[name] = first
                    settled = smallest is not None and smallest < first
                    longer = hashlib.blake2b(b"%d %d " % (key, length) + context, digest_size=8).digest()
                    code = int.from_bytes(longer, "big", signed=True)
                    rows.append((code, t1, t2, first, np.asarray(starts) + w, count, before - w, None if settled else part))
                if len(rows) >= PARTS:
                    yield pd.DataFrame(rows, columns=SEGMENT)
                    rows = []
                if len(met) > MET:
                    met.clear()
        if rows:
            yield pd.DataFrame(rows, columns=SEGMENT)

    schema = "key long, t1 long, t2 long, first long, starts array<int>, windows int, before int, words binary"
    return segments.select(*SEGMENT).mapInPandas(cut, schema)


def _settled(parts: DataFrame) -> DataFrame:
    """Repeated windows of the parts that met a smaller document on the way."""
    return parts.filter("words IS NULL").select("t1", "t2", "starts", F.lit(0).alias("low"), (F.col("windows") - 1).alias("high"))


def _crowded(segments: DataFrame, group: int) -> DataFrame:
    return saved(segments.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > group).select("key"), "crowded")


def _in_trees(segments: DataFrame, window: int, prefix: int, group: int) -> DataFrame:
    """Repeated windows of all segments, in subtrees of at most ``group`` suffixes.

    A prefix that more suffixes have is doubled, again and again, and its suffixes go to the longer ones. A context of
    a whole window is the last: its suffixes are equal, and the smallest document among them settles them.
    """
    runs, length = None, prefix
    while True:
        crowded = _crowded(segments, group)
        if crowded.isEmpty():
            fitting, rest = segments, None
        else:
            fitting, rest = segments.join(crowded, "key", "left_anti"), segments.join(crowded, "key", "left_semi")
        found = _in_subtrees(fitting, window)
        runs = found if runs is None else runs.unionByName(found)
        if rest is None:
            return runs
        length = min(2 * length, window)
        if length == window:
            return runs.unionByName(_by_whole_window(rest, window))
        parts = saved(_longer(rest, length, window), "longer")
        runs = runs.unionByName(_settled(parts))
        segments = parts.filter("words IS NOT NULL")


def _by_whole_window(segments: DataFrame, window: int) -> DataFrame:
    """Windows that also start in a smaller document, of segments whose every context but the whole window is crowded."""

    def windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = []
            for row in batch.itertuples():
                hashes = word_hashes(row.words.split())
                one, two = rolled(hashes, window), rolled(mix(hashes + np.uint64(1)), window)
                parts.append((one.view(np.int64), two.view(np.int64), np.arange(len(one), dtype=np.int32)))
            each = [len(x[0]) for x in parts]
            columns = {c: np.repeat(batch[c].to_numpy(), each) for c in ("t1", "t2", "first", "starts")}
            yield pd.DataFrame({**dict(zip(("h1", "h2", "low"), map(np.concatenate, zip(*parts)))), **columns})

    rows = segments.select("t1", "t2", "first", "starts", "words").mapInPandas(
        windows, "h1 long, h2 long, low int, t1 long, t2 long, first long, starts array<int>"
    )
    least = rows.groupBy("h1", "h2").agg(F.min("first").alias("least"))
    late = rows.join(least, ["h1", "h2"]).filter("first > least")
    return late.select("t1", "t2", "starts", "low", F.col("low").alias("high"))


def _without(held: DataFrame, window: int) -> DataFrame:
    """What is left of the texts when the windows of ``spans`` are taken out."""

    def take_out(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        word = re.compile(f"[^{SPACE}]+")
        for batch in batches:
            rows = []
            for t1, t2, text, spans in zip(batch["t1"], batch["t2"], batch["text"], batch["spans"]):
                places = [m.span() for m in word.finditer(text)]
                edge = np.zeros(len(places) + 1, np.int64)
                for s in spans:
                    starts = np.asarray(s["starts"], np.int64)
                    np.add.at(edge, starts + s["low"], 1)
                    np.add.at(edge, starts + s["high"] + window, -1)
                gone = np.cumsum(edge[:-1]) > 0
                kept = [text[a:b].encode("utf-8", "surrogatepass") for (a, b), g in zip(places, gone) if not g]
                left, at = [], 0
                turns = np.flatnonzero(np.diff(np.r_[0, gone, 0]))
                for a, b in zip(turns[::2], turns[1::2]):
                    left.append(text[at : places[a][0]])
                    at = places[b][0] if b < len(places) else len(text)
                left.append(text[at:])
                rows.append((t1, t2, int(gone.sum()), _digest(kept), "".join(left)))
            yield pd.DataFrame(rows, columns=["t1", "t2", "n_removed", "kept_sha256", "left"])

    return held.mapInPandas(take_out, "t1 long, t2 long, n_removed long, kept_sha256 string, left string")


def remove_repeats(
    docs: DataFrame, window: int = WINDOW, prefix: int = PREFIX, group: int = GROUP, with_text: bool = False
) -> DataFrame:
    """One row for each document (doc_id, text): doc_id, n_words, n_removed, kept_sha256, t1, t2 (its text's key).

    A word goes if a window of ``window`` words over it has a sequence of words that also starts in a
    document with a smaller doc_id; windows are those of the input. Null texts have no words. Rows with
    the same doc_id are no repeats of each other; rows without doc_id neither lose words nor make others
    lose any. ``with_text`` adds ``left``, the text without those words and all else as it was. Other
    columns are left aside.
    """
    spark = docs.sparkSession
    ship(spark)
    keyed = docs.select("doc_id", *text_key("text"), "text")
    rows = saved(_read(keyed, window, prefix).withColumn("row", F.monotonically_increasing_id()), "anchors")
    least = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "row"))).alias("least")
    classes = rows.groupBy("t1", "t2").agg(least).select("t1", "t2", F.col("least.doc_id").alias("first"), F.col("least.row").alias("row"))
    classes = saved(classes, "classes")
    # of repeated first rows, one
    firsts = rows.drop("t1", "t2").join(classes.filter("row IS NOT NULL"), "row")
    classes = classes.drop("row")
    zipped = F.explode(F.arrays_zip("key", "start", "windows", "before")).alias("a")
    suffixes = firsts.select("t1", "t2", "first", zipped).select("t1", "t2", "first", "a.*")
    counted = suffixes.groupBy("key").agg(F.min("t1").alias("low"), F.max("t1").alias("high"))
    wanted = (
        suffixes.join(counted.filter("low < high").select("key"), "key")
        .groupBy("t1", "t2", "first").agg(F.collect_list(F.struct("key", "start", "windows", "before")).alias("wanted"))
    )
    texts = keyed.withColumnRenamed("doc_id", "first").groupBy("t1", "t2", "first").agg(F.any_value("text").alias("text"))
    held = saved(texts.join(wanted, ["t1", "t2", "first"]), "texts")
    segments = saved(_segments(held, window), "segments")
    settled = _settled(segments)
    open_ones = segments.filter("words IS NOT NULL")
    runs = _in_trees(open_ones, window, prefix, group)
    spans = (
        runs.unionByName(settled).groupBy("t1", "t2").agg(F.collect_list(F.struct("starts", "low", "high")).alias("spans"))
    )
    results = _without(held.select("t1", "t2", "text").join(spans, ["t1", "t2"]), window)
    if not with_text:
        results = results.drop("left")
    results = saved(results, "results")
    whole = (F.col("doc_id") > F.col("first")) & (F.col("n_words") >= window)
    own = F.col("doc_id") == F.col("first")
    out = rows.select("doc_id", "t1", "t2", "n_words", "digest").join(classes, ["t1", "t2"]).join(results, ["t1", "t2"], "left")
    columns = [
        "doc_id", "n_words",
        F.when(whole, F.col("n_words")).when(own, F.coalesce("n_removed", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("n_removed"),
        F.when(whole, F.lit(_digest([]))).when(own, F.coalesce("kept_sha256", "digest")).otherwise(F.col("digest")).alias("kept_sha256"),
        "t1", "t2",
    ]
    if with_text:
        columns.append(F.when(whole, F.lit("")).when(own, F.col("left")).alias("left"))
    return out.select(*columns)


def clean(docs: DataFrame, **parameters) -> DataFrame:
    """The documents without repeated words; all columns of ``docs``, whatever their names, other texts as they were."""
    done = remove_repeats(docs, with_text=True, **parameters).filter("left IS NOT NULL").select("doc_id", "t1", "t2", "left")
    done = done.dropDuplicates(["doc_id", "t1", "t2"])
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("d"), *[k.alias(f"k{i}") for i, k in enumerate(text_key("text"))])
    joined = rows.join(done, (F.col("d") == F.col("doc_id")) & (F.col("k0") == F.col("t1")) & (F.col("k1") == F.col("t2")), "left")
    text = F.coalesce("left", F.col("row")["text"]).alias("text")
    return joined.select(*[text if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])


#: The same for documents with ids of their own, in the checking engine's SQL.
ORACLE = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM w, unnest(range(1, len(w) - 48)) AS u(i)),
late AS (SELECT doc_id, i FROM win QUALIFY doc_id > min(doc_id) OVER (PARTITION BY h)),
gone AS (SELECT DISTINCT doc_id, i + k AS p FROM late, range(50) AS r(k)),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY 1),
word AS (SELECT doc_id, p, w[p] AS x FROM w, unnest(range(1, len(w) + 1)) AS u(p)),
kept AS (
  SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
