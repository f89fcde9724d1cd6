"""Nulls, empty texts, repeated rows, empty tables and clashing columns, for the classifier and the archives."""

import hashlib

from gaugeworks.llm import cotraining, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, content string, held boolean"
GOOD = "A calm report on rivers, bridges and towns. It ends each sentence well, and says something new.\n"


def _docs(spark):
    rows = [(i, GOOD + f"Part {i} tells of place number {i * 7}." if i % 2 else "$$$ WIN!!! ### win $$$ win!!! " * 5, "en", f"s{i % 3}", 90, "x", None)
            for i in range(80)]
    rows += [(80, None, None, None, None, None, None), (81, "", "en", "s1", 0, "", True), (None, GOOD, "en", "s1", 90, "x", None), rows[1], rows[1]]
    return spark.createDataFrame(rows, DOCS)


def test_scores_of_all_rows(spark):
    docs = _docs(spark)
    labels = spark.createDataFrame(
        [(i, i % 2, 0) for i in range(70)] + [(None, 1, 0), (3, None, 0), (5, 1, 0)], "doc_id long, quality int, toxic int"
    )
    got = cotraining.score_quality(docs, labels).collect()
    assert len(got) == docs.count()
    assert all(0 <= r["score"] <= 1 for r in got)
    assert {r["kept"] for r in got if r["doc_id"] is not None and r["doc_id"] < 80 and r["doc_id"] % 2} == {True}
    assert {r["kept"] for r in got if r["doc_id"] is not None and r["doc_id"] < 80 and r["doc_id"] % 2 == 0} == {False}
    assert len({(r["score"], r["kept"]) for r in got if r["doc_id"] == 1}) == 1
    kept = cotraining.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.filter("doc_id = 1").count() == 3


def test_too_few_labels_keep_all(spark):
    docs = _docs(spark)
    for labels in ([(1, 1), (2, 0)], []):
        got = cotraining.score_quality(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()
        assert len(got) == docs.count() and all(r["kept"] and r["score"] is None for r in got)


def test_archived_pages_come_back(spark):
    long = "é" * 700
    rows = [(1, "http://a/1", long, "x"), (2, "http://a/2", long, "y"), (3, None, long, None), (4, "http://a/4", None, ""),
            (5, "http://a/\r\nX: y", "", "z"), (6, "http://b", "short", "z"), (7, "http://b", "short", "z"),
            (8, "http://c", "WARC/1.0\r\n\r\n" * 90, "z"), (None, "http://d", "no id", "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload string")
    folder = warc.fresh_folder(spark)
    manifest = warc.write_archives(pages, folder)
    got = {r["page_id"]: r for r in warc.page_rows(warc.assemble(warc.read_archives(spark, folder, manifest))).collect()}
    assert set(got) == {r[0] for r in rows}
    for page_id, _, html, _ in rows:
        payload = (html or "").encode()
        assert got[page_id]["payload_bytes"] == len(payload)
        assert got[page_id]["payload_digest"] == hashlib.sha1(payload).hexdigest()
    assert {i: r["refers_to"] for i, r in got.items() if r["record_type"] == "revisit"} == {1: 3, 2: 3}


def test_no_pages(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    folder = warc.fresh_folder(spark)
    manifest = warc.write_archives(pages, folder)
    assert warc.page_rows(warc.assemble(warc.read_archives(spark, folder, manifest))).collect() == []


def test_rows_that_share_an_id_are_judged_apart(spark):
    docs = _docs(spark)
    labels = spark.createDataFrame([(i, i % 2) for i in range(70)], "doc_id long, quality int")
    good, bad = docs.filter("doc_id = 1").limit(1).collect()[0], docs.filter("doc_id = 2").collect()[0]
    mixed = spark.createDataFrame([{**r.asDict(), "doc_id": i} for i in (None, 500) for r in (good, bad, good)], DOCS)
    kept = cotraining.keep_good(mixed, labels, teachers=docs)
    assert kept.columns == mixed.columns
    assert sorted((str(r["doc_id"]), r["text"]) for r in kept.collect()) == [(i, good["text"]) for i in ("500", "500", "None", "None")]
