"""The classifier stage after the rules: it learns on every size."""

import os

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

DATA = os.environ.get("TEST_DATA", "/root/testdata")


@pytest.fixture(scope="module")
def bad_texts(spark):
    """Documents labelled bad that pass the rules, without their ids."""
    folder = f"{DATA}/sf0.1"
    bad = spark.read.parquet(f"{folder}/documents.parquet").join(
        spark.read.parquet(f"{folder}/labels.parquet").filter("quality = 0").select("doc_id"), "doc_id", "left_semi"
    )
    rows = corpus_pipeline.quality_rules_stage(spark, bad, folder).collect()
    assert len(rows) > 5
    return rows


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01", "sf0.1"])
def test_bad_texts_that_pass_the_rules_go(spark, bad_texts, size):
    folder = f"{DATA}/{size}"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    good, bad = (labels.filter(F.col("quality") == q).select("doc_id") for q in (1, 0))
    ruled = corpus_pipeline.quality_rules_stage(spark, docs, folder)
    planted = spark.createDataFrame([{**r.asDict(), "doc_id": -1 - i} for i, r in enumerate(bad_texts)], docs.schema)
    stage = corpus_pipeline.quality_classifier_stage(spark, ruled.unionByName(planted), folder).select("doc_id").cache()
    # none with a label stays, and of unseen ones at most the one nearest to good texts
    assert stage.join(bad, "doc_id", "left_semi").isEmpty()
    assert stage.filter("doc_id < 0").count() <= 1
    passed = ruled.join(good, "doc_id", "left_semi").agg(F.count("doc_id")).first()[0]
    assert stage.join(good, "doc_id", "left_semi").count() > 0.99 * passed
