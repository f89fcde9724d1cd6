"""Documents to training sequences: the stages, each on all that the one before it kept."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from gaugeworks.llm import cotraining, jaccard_join, packing, quality_rules, substring_dedup
from gaugeworks.llm.common import forget, own_tables
from gaugeworks.llm.tokens import word_bpe
from gaugeworks.session import fresh_path


_before: list[str] = []


def _stage(build):
    """Each stage begins when the result of the one before is stored, so the tables that one made can go; no others do."""

    @wraps(build)
    def begin(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        forget(spark, _before)
        with own_tables() as made:
            out = build(spark, docs, sf_dir)
        _before.extend(made)
        return out

    return begin


@_stage
def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that the line rules keep, without their failing lines."""
    return quality_rules.clean(docs)


@_stage
def quality_classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that the co-trained classifier keeps; it learns from all labelled documents, also those that the rules drop."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return cotraining.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), teachers=documents)


@_stage
def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One text of each group of near copies, that with the smallest id."""
    return jaccard_join.keep_one_of_each(docs)


@_stage
def substring_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that a text with a smaller id has."""
    return substring_dedup.clean(docs)


@_stage
def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all texts' tokens in training sequences."""
    return packing.pack_documents(docs, word_bpe())


STAGES = [
    ("quality rules", quality_rules_stage),
    ("quality classifier", quality_classifier_stage),
    ("n-gram Jaccard join", near_duplicates_stage),
    ("substring dedup", substring_dedup_stage),
    ("best-fit packing", packing_stage),
]

#: SQL can neither fit the classifier nor tokenize; tests hold the other stages against SQL or a plain loop, the classifier against labels.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = fresh_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    forget(spark, _before)
    return docs
