"""Stages on tables with clashing column names, repeated rows, nulls, long texts; archives of repeated pages; older frames."""

import pytest

import corpus_pipeline
from gaugeworks.llm import embedding_dedup, jaccard_join, quality_rules, substring_dedup, token_records, warc

NAMES = ["rules", "row", "_t1", "_place", "_kept_doc_id", "_done_left", "licence", "t1", "k0", "d", "left", "stay", "rows", "kept"]
DOCS = "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in NAMES)
PLAIN = "The river runs past the old mill, and nobody has counted the stones in it since spring came. " * 2
OTHER = " ".join(f"word{i}" for i in range(120)) + "."


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, *[f"{n}{k}" for n in NAMES]) for k, (i, t) in enumerate(rows)], DOCS)


ROWS = [(1, PLAIN), (1, PLAIN), (2, OTHER), (3, OTHER + " More here."), (None, None), (None, None), (None, PLAIN[:-30]), (4, ""), (5, "One of a kind. " * 60_000)]


@pytest.mark.parametrize("stage", [quality_rules.clean, jaccard_join.keep_one_of_each, substring_dedup.clean])
def test_other_columns_stay_as_they_are(spark, stage):
    docs = _docs(spark, ROWS)
    out = stage(docs)
    assert out.columns == docs.columns
    rest = [c for c in docs.columns if c != "text"]
    given = {tuple(r) for r in docs.select(rest).collect()}
    found = [tuple(r) for r in out.select(rest).collect()]
    assert found and set(found) <= given and len(found) == len(set(found))
    assert stage(docs.limit(0)).collect() == []


def test_which_repeated_row_stays_is_fixed(spark):
    rows = [(1, PLAIN)] * 9 + [(2, OTHER)]
    kept = [sorted(r["rules"] for r in jaccard_join.keep_one_of_each(_docs(spark, rows).repartition(n)).collect()) for n in (1, 3, 7)]
    assert kept[0] == kept[1] == kept[2] and len(kept[0]) == 2


def test_every_page_is_a_capture(spark):
    long, longer = "x" * 1200, "y" * 1300
    rows = [(1, "http://a", long), (1, "http://a", long), (7, None, "s"), (7, "None", "s"), (None, None, None), (None, None, None), (None, None, ""),
            (3, "http://c", longer), (3, "http://d", longer), (2, "http://e", longer), (None, "http://f", longer)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    folder = warc.fresh_folder(spark)
    captures = warc.assemble(warc.read_archives(spark, folder, warc.write_archives(pages, folder)))
    got = sorted(((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.page_rows(captures).collect()), key=str)
    want = [(1, 1200, "response", None)] * 2 + [(7, 1, "response", None)] * 2 + [(None, 0, "response", None)] * 3
    want += [(3, 1300, "response", None)] * 2 + [(2, 1300, "revisit", 3), (None, 1300, "revisit", 3)]
    assert got == sorted(want, key=str)
    named = {r["response"]["refers_to"] for r in captures.collect()} - {None}
    assert len(named) == 1 and named <= {r["capture_id"] for r in captures.collect()}


def test_rows_without_id_are_spread(spark, tmp_path):
    from gaugeworks.llm.tokens import word_bpe

    docs = spark.createDataFrame([(None if i % 2 else i, f"some text {i % 50}") for i in range(2000)], "doc_id long, text string")
    manifest = token_records.write_records(docs, token_records.fresh_folder(spark), word_bpe(), files=8)
    sizes = sorted(r["n_records"] for r in manifest.collect())
    assert sum(sizes) == 2000 and sizes[-1] < 500


def test_a_stage_leaves_the_tables_of_other_frames(spark, small_dir):
    vectors = spark.createDataFrame([(i, [1.0, float(i % 3)], 1) for i in range(30)], "vec_id long, embedding array<float>, label int")
    older = embedding_dedup.near_vectors(vectors)
    docs = spark.read.parquet(f"{small_dir}/documents.parquet").limit(50)
    for _, stage in corpus_pipeline.STAGES[2:4]:
        assert stage(spark, docs, small_dir).count()
    assert older.count() == 30
