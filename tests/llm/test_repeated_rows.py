"""Rows that are repeated many times, with an id or without: their texts are brought together once."""

import pytest
from pyspark.sql import functions as F

from gaugeworks.llm import jaccard_join, substring_dedup

REPEATS = 60
SHARED = " ".join(f"s{i}" for i in range(130))
NEAR = SHARED.replace("s7 ", "other ")


def _docs(spark, doc_id):
    rows = [(doc_id, SHARED)] * REPEATS + [(9, NEAR), (10, "a b c")]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(4)


def test_substring_dedup_reads_a_repeated_row_once(spark, monkeypatch):
    seen = {}
    store = substring_dedup.saved
    monkeypatch.setattr(substring_dedup, "saved", lambda df, name: seen.setdefault(name, store(df, name)))
    out = substring_dedup.remove_repeats(_docs(spark, 1)).cache()
    assert out.count() == REPEATS + 2
    assert {r["n_removed"] for r in out.filter("doc_id = 1").collect()} == {0}
    assert out.filter("doc_id = 9").first()["n_removed"] > 100
    held = seen["texts"].select("first", F.explode("wanted").alias("w")).select("first", "w.*")
    assert seen["texts"].count() == 2 and held.count() == held.distinct().count()


@pytest.mark.parametrize("doc_id", [1, None])
def test_jaccard_fetches_a_repeated_text_once(spark, monkeypatch, doc_id):
    seen = []
    verify = jaccard_join._verified
    monkeypatch.setattr(jaccard_join, "_verified", lambda members, *a: seen.append(members.cache()) or verify(members, *a))
    out = jaccard_join.similar_texts(_docs(spark, doc_id)).collect()
    assert {r["n_links"] for r in out if r["doc_id"] == doc_id} == {REPEATS}
    assert sum(r["kept"] for r in out) == 2
    assert seen[0].count() == 2
