import itertools
import re

import numpy as np
import pytest
from compare import differences

from gaugeworks.llm import embedding_dedup, jaccard_join, quality_rules, queries, substring_dedup


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, small_dir, small_sql, name):
    assert differences(queries.QUERIES[name](spark, small_dir), small_sql, queries.ORACLES[name]) is None


def words(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def components(ids, linked):
    out = {i: i for i in ids}
    for _ in ids:
        for a, b in linked:
            out[a] = out[b] = min(out[a], out[b])
    return out


def texts_with_cases():
    rng = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(4000)]
    fresh = lambda n: [vocabulary[i] for i in rng.integers(0, len(vocabulary), n)]
    passage, base = fresh(70), fresh(120)
    texts = [None, "", " \n", "one two", "one two", "a b c d e", "A b c d e"]
    texts += [" ".join(fresh(int(n)) + passage + fresh(int(n))) for n in rng.integers(0, 90, 12)]
    for k in range(14):  # near copies of one text
        copy = list(base)
        copy[k * 8] = f"edit{k}"
        texts.append("\n".join([" ".join(copy[:60]), " ".join(copy[60:])]))
    texts += [" ".join(base)] * 4 + ["of the " * 200, "of the " * 150 + "end", "x " * 49, "x " * 50, "y " + "x " * 50]
    texts += [" ".join(passage), " ".join(passage[:49]), " ".join(passage[5:60])]
    return texts


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "s", 1) for i, t in rows], "doc_id long, text string, first string, n long").repartition(4)


def removed(rows, window=50):
    first = {}
    for i, t in sorted(rows):
        w = words(t)
        for k in range(len(w) - window + 1):
            first.setdefault(tuple(w[k : k + window]), i)
    out = {}
    for i, t in rows:
        w = words(t)
        gone = {k + d for k in range(len(w) - window + 1) if first[tuple(w[k : k + window])] < i for d in range(window)}
        kept = [x for k, x in enumerate(w) if k not in gone]
        out[i] = (len(w), len(gone), substring_dedup._digest([x.encode() for x in kept]), kept)
    return out


@pytest.mark.parametrize("group", [16384, 1, 2, 6])
def test_substrings_against_brute_force(spark, group):
    rows = list(enumerate(texts_with_cases()))
    got = substring_dedup.remove_repeats(frame(spark, rows), group=group, with_text=True).collect()
    want = removed(rows)
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got} == {i: w[:3] for i, w in want.items()}
    texts = {r["doc_id"]: r["text"] for r in substring_dedup.clean(frame(spark, rows), group=group).collect()}
    assert {i: words(t) for i, t in texts.items()} == {i: w[3] for i, w in want.items()}


def test_substring_ids(spark):
    text = " ".join(f"t{i}" for i in range(60))
    rows = [(None, text), (5, text), (5, text), (7, text + " more"), (None, text + " more")]
    got = sorted((str(r["doc_id"]), r["n_removed"]) for r in substring_dedup.remove_repeats(frame(spark, rows)).collect())
    assert got == [("5", 0), ("5", 0), ("7", 60), ("None", 0), ("None", 0)]
    assert substring_dedup.remove_repeats(frame(spark, rows).limit(0)).collect() == []


def grams(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


@pytest.mark.parametrize("block", [256, 3])
def test_near_copies_against_brute_force(spark, block):
    rows = list(enumerate(texts_with_cases()))
    sets = {i: grams(t) for i, t in rows}
    linked = [
        (a, b) for a, b in itertools.combinations(sets, 2)
        if sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8
    ]
    component = components(sets, linked)
    found = jaccard_join.similar_texts(frame(spark, rows), sketch_block=block, verify_block=block)
    got = {r["doc_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in found.collect()}
    assert got == {i: (sum(i in pair for pair in linked), component[i], component[i] == i) for i in sets}


def test_near_copy_rows(spark):
    text = " ".join(f"t{i}" for i in range(60))
    rows = [(None, text), (5, text), (5, text), (7, text + " more"), (9, None), (None, "")]
    kept = jaccard_join.keep_one_of_each(frame(spark, rows)).collect()
    assert sorted((str(r["doc_id"]), len(words(r["text"]))) for r in kept) == [("5", 60), ("9", 0), ("None", 0)]
    assert jaccard_join.similar_texts(frame(spark, rows).limit(0)).collect() == []


@pytest.mark.parametrize("block", [512, 4])
def test_vectors_against_brute_force(spark, block):
    rng = np.random.default_rng(5)
    centre = rng.standard_normal(16)
    vecs = [centre + 0.04 * rng.standard_normal(16) for _ in range(30)] + [rng.standard_normal(16) for _ in range(30)]
    vecs = [v.astype(np.float32).astype(float).tolist() for v in vecs]
    vecs += [vecs[0]] * 3 + [[2 * x for x in vecs[1]], None, [], [0.0] * 16, [float("nan")] * 16, [None] + [1.0] * 15, [float("inf")] * 16]
    rows = [(i, v, i % 2 if i < 60 else 0, "x") for i, v in enumerate(vecs)] + [(900, vecs[0], None, "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, node string").repartition(3)

    def ok(v):
        return bool(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)

    def near(a, b):
        return np.dot(a, b) / np.sqrt(np.dot(a, a) * np.dot(b, b)) >= 0.98

    sound = [r for r in rows if ok(r[1]) and r[2] is not None]
    linked = [(a[0], b[0]) for a, b in itertools.combinations(sound, 2) if a[2] == b[2] and near(a[1], b[1])]
    component = components([r[0] for r in rows], linked)
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.near_vectors(df, block=block).collect()}
    assert got == {r[0]: (sum(r[0] in p for p in linked), component[r[0]], component[r[0]] == r[0]) for r in rows}
    assert embedding_dedup.near_vectors(df.limit(0)).collect() == []


def test_line_rules(spark):
    clean = "This line ends as it should, with a mark and enough words to count.\n" * 1 + "Another line that is plain and long enough for the rules, too."
    rows = [(0, None), (1, ""), (2, clean), (3, clean + "\nhome | about | contact | help"), (4, "a$$$ b%%% c### d&&& " * 9), (None, clean),
            (5, "same eight words come here again and again " * 6)]
    got = {r["doc_id"]: r for r in quality_rules.report(frame(spark, rows)).collect()}
    assert [got[i]["kept"] for i in (0, 1, 2, 3, 4, None, 5)] == [False, False, True, True, False, True, False]
    assert got[3]["n_failed_lines"] == 1 and got[5]["n_repeat_words"] == 48
    kept = {r["doc_id"]: r["text"] for r in quality_rules.clean(frame(spark, rows)).collect()}
    assert kept[3] == clean == kept[2]


def test_contexts_of_equal_windows_are_equal_and_longer():
    from gaugeworks.llm.substring_dedup import lengthened

    words = [b"%d" % i for i in range(90)]
    for length in (16, 32):
        for before, windows in ((0, 1), (10, 11), (42, 41), (30, 5), (41, 40)):
            parts = list(lengthened(words[: windows + 49], before, windows, length, 50))
            assert sorted(w for first, count, _ in parts for w in range(first, first + count)) == list(range(windows))
            moved = list(lengthened([b"x", *words[: windows + 49]], before + 1, windows + 1, length, 50))
            contexts = lambda found, shift: {w - shift: c for first, count, c in found for w in range(first, first + count)}
            assert contexts(parts, 0).items() <= contexts(moved, 1).items()
