"""Spelling variants against plain searches, with cut lists, nulls, repeats, long words and clashing columns."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from compare import differences

from gaugeworks.llm import spelling_variants as sv
from gaugeworks.llm.queries import QUERIES


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def test_walk_finds_the_pairs_of_every_list():
    rng = random.Random(7)
    for _ in range(60):
        words, group, depth = [], [], []
        for g in range(rng.randint(1, 4)):
            shared = "".join(rng.choice("ab") for _ in range(rng.randint(0, 3)))
            some = sorted({shared + "".join(rng.choice("abé") for _ in range(rng.randint(0, 6))) for _ in range(25)})
            words += some
            group += [g] * len(some)
            depth += [len(shared)] * len(some)
        a, b = sv.one_edit_apart(sv._Lists(words), np.array(group), np.array(depth))
        want = [(i, j) for i in range(len(words)) for j in range(len(words)) if group[i] == group[j] and one_edit(words[i], words[j])]
        assert sorted(zip(a.tolist(), b.tolist())) == want


def plain(docs, least_count):
    counts = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    vocab = {w: n for w, n in counts.items() if len(w) >= 6 and n >= least_count}
    form, near = {}, {}
    for w in vocab:
        near[w] = [v for v in vocab if one_edit(w, v)]
        best = min(near[w], key=lambda v: (-vocab[v], v), default=None)
        if best and vocab[best] >= 5 * vocab[w]:
            form[w] = best
    rows = []
    for w, n in vocab.items():
        root = w
        while root in form:
            root = form[root]
        rows.append((w, n, len(near[w]), form.get(w), vocab.get(form.get(w)), root))
    return sorted(rows)


def result(df):
    return sorted(tuple(r) for r in df.select("word", "n", "n_near", "form", "form_n", "root").collect())


@pytest.mark.parametrize("most", [3, 20, sv.LIST])
def test_lists_of_any_length_give_the_same(spark, most):
    rng = random.Random(3)
    words = ["".join(rng.choice("abé") for _ in range(rng.randint(5, 8))) for _ in range(150)]
    docs = [(i, " ".join(rng.choice(words[: 5 + i % 150]) for _ in range(60))) for i in range(150)]
    got = result(sv.variants(spark.createDataFrame(docs, "doc_id long, text string"), 2, most))
    assert got == plain(docs, 2) and any(r[3] for r in got)


def test_nulls_repeats_long_words_and_clashing_columns(spark):
    long = "Ab" * 30_000
    rows = [(None, "Streets streets STREETS, street's"), (None, "streets streetz"), (1, None), (2, ""), (2, "  \n "), (3, f"{long} {long} {long}x {long}x"),
            (4, "streets streets"), (4, "streets streets"), (5, "Ünderdog ünderdog ünderdog×x ÷")]
    docs = spark.createDataFrame([(*r, 0, "w", "x") for r in rows], "doc_id long, text string, n int, word string, near string")
    assert result(sv.variants(docs, 1)) == plain(rows, 1)


def test_text_ids(spark):
    rows = [("a", "streets streetz"), (None, "streets")]
    assert result(sv.variants(spark.createDataFrame(rows, "doc_id string, text string"), 1)) == plain(rows, 1)


def test_no_documents(spark):
    assert result(sv.variants(spark.createDataFrame([], "doc_id long, text string"))) == []


def test_chains_end_at_the_last_form(spark):
    rows = [(i, "walking") for i in range(500)] + [(i, "walkinge") for i in range(70)] + [(i, "walkingen") for i in range(9)] + [(9, "walkingent")]
    assert {(r[0], r[5]) for r in result(sv.variants(spark.createDataFrame(rows, "doc_id long, text string"), 1))} >= {("walkingent", "walking")}


def test_same_as_sql(spark, small_sql, small_dir):
    assert differences(QUERIES["op11_spelling_variants"](spark, small_dir), small_sql, sv.ORACLE) is None
