"""Language identification against a plain version, on held-out documents, and on odd rows."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeworks.llm import language_id as li
from gaugeworks.llm.queries import QUERIES

DOCS = "doc_id long, text string, lang string, score double, held_out string"


def plain_profile(text, size):
    """Letter by letter, with whole numbers."""
    made = li.Profiles(size)
    line = " "
    for c in (text or "").lower():
        c = c if c.isalpha() else " "
        line += "" if c == line[-1] == " " else c
    line += "" if line[-1] == " " else " "
    total = np.zeros(size, np.int64)
    for a, b, c in zip(line, line[1:], line[2:]):
        total += np.roll(made._letter(ord(a)), 2).astype(np.int64) * np.roll(made._letter(ord(b)), 1) * made._letter(ord(c))
    return total


TEXTS = ["the cat and the hat", "der Hund und die Katze", "x", "", None, "1 2 3 !", "Straße—ñandú  été", "日本語の文", "a" * 5000 + " b"]


def test_profiles_are_those_of_a_plain_loop():
    made = li.Profiles(64)
    assert (made.profiles(TEXTS) == [plain_profile(t, 64) for t in TEXTS]).all()


@pytest.mark.parametrize("piece", [1, 2, 3, 7])
def test_pieces_join(monkeypatch, piece):
    monkeypatch.setattr(li, "PIECE", piece)
    made = li.Profiles(32)
    assert (made.profiles(TEXTS) == [plain_profile(t, 32) for t in TEXTS]).all()


def test_table_that_starts_afresh(monkeypatch):
    monkeypatch.setattr(li, "KEPT", 3)
    made = li.Profiles(32)
    for t in TEXTS * 2:
        assert (made.profiles([t])[0] == plain_profile(t, 32)).all()


def test_same_as_the_plain_version(spark):
    words = {"en": "the cat sat on that mat with this hat", "de": "der Hund lief durch die Gasse und das Tor", "fr": "le chat est dans la maison avec une amie"}
    rows = [(i, " ".join(words[lang].split()[i % 4 :]), lang, None, "x") for i, lang in enumerate(list(words) * 20)]
    rows += [(100, "the hat", None, 1.0, None), (101, None, "en", None, None), (102, "...", "de", None, None), (None, "die Katze", "fr", None, None), rows[0], rows[0]]
    got = li.languages(spark.createDataFrame(rows, DOCS).repartition(7)).collect()
    fold = {r[0]: zlib.crc32(str(r[0]).encode()) % 5 for r in rows if r[0] is not None}
    model = {lang: sum(plain_profile(r[1], li.SIZE) for r in rows if r[2] == lang and r[0] is not None and fold[r[0]]) for lang in words}
    want = []
    for doc_id, text, *_ in rows:
        p = plain_profile(text, li.SIZE)
        cos = {lang: float(p @ m / np.linalg.norm(p) / np.linalg.norm(m)) for lang, m in model.items()} if p.any() else {"und": 0.0}
        best = min(cos, key=lambda lang: (-cos[lang], lang))
        want.append((str(doc_id), doc_id is not None and fold[doc_id] == 0, best, round(max(cos[best], 0), 9)))
    assert sorted((str(r.doc_id), r.held_out, r.lang_pred, round(r.score, 9)) for r in got) == sorted(want)


def test_nothing_learned(spark):
    docs = spark.createDataFrame([(1, "the cat", None, None, None), (2, "", "en", None, None)], DOCS)
    assert {(r.lang_pred, r.score) for r in li.languages(docs).collect()} == {("und", 0.0)}
    assert li.languages(docs.limit(0)).collect() == []


def test_held_out_documents(spark, small_dir):
    got = QUERIES["op12_language_id"](spark, small_dir)
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    judged = got.join(docs, "doc_id").filter("held_out").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("right")).first()
    assert got.count() == docs.count() and judged["n"] > 100 and judged["right"] > 0.98
