"""The registered queries: each applies one operator to the whole of its table."""

from __future__ import annotations

from gaugeworks.llm import conversation_repair, cotraining, embedding_dedup, jaccard_join, language_id, lattice_sampling, license_scan, packing, quality_rules, spelling_variants, substring_dedup, token_records, warc
from gaugeworks.llm.registry import ORACLES, QUERIES, query
from gaugeworks.llm.tokens import word_bpe

__all__ = ["ORACLES", "QUERIES"]


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_quality_rules", quality_rules.ORACLE)
def op1_quality_rules(spark, sf_dir):
    return quality_rules.report(table(spark, sf_dir, "documents"))


@query("op3_token_records")
def op3_token_records(spark, sf_dir):
    folder = token_records.fresh_folder(spark)
    manifest = token_records.write_records(table(spark, sf_dir, "documents"), folder, word_bpe())
    return token_records.read_records(spark, folder, manifest, with_ids=False)


@query("op10_best_fit_packing")
def op10_best_fit_packing(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"), word_bpe())


@query("op8_ngram_jaccard", jaccard_join.ORACLE)
def op8_ngram_jaccard(spark, sf_dir):
    return jaccard_join.similar_texts(table(spark, sf_dir, "documents")).drop("t1", "t2")


@query("op5_license_scan")
def op5_license_scan(spark, sf_dir):
    return license_scan.report(table(spark, sf_dir, "documents"))


@query("op2_embedding_dedup", embedding_dedup.ORACLE)
def op2_embedding_dedup(spark, sf_dir):
    return embedding_dedup.near_vectors(table(spark, sf_dir, "embeddings"))


@query("op4_substring_dedup", substring_dedup.ORACLE)
def op4_substring_dedup(spark, sf_dir):
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents")).drop("t1", "t2")


@query("op7_warc_transactions", warc.ORACLE)
def op7_warc_transactions(spark, sf_dir):
    folder = warc.fresh_folder(spark)
    manifest = warc.write_archives(table(spark, sf_dir, "pages"), folder)
    return warc.page_rows(warc.assemble(warc.read_archives(spark, folder, manifest, with_payload=False)))


@query("op6_quality_classifier")
def op6_quality_classifier(spark, sf_dir):
    return cotraining.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op9_lattice_sampling")
def op9_lattice_sampling(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return lattice_sampling.sample_segmentations(docs, lattice_sampling.piece_bpe(), with_ids=False)


@query("op11_spelling_variants", spelling_variants.ORACLE)
def op11_spelling_variants(spark, sf_dir):
    return spelling_variants.variants(table(spark, sf_dir, "documents"))


@query("op12_language_id")
def op12_language_id(spark, sf_dir):
    return language_id.languages(table(spark, sf_dir, "documents"))


@query("op13_conversation_repair", conversation_repair.ORACLE)
def op13_conversation_repair(spark, sf_dir):
    return conversation_repair.repair_conversations(table(spark, sf_dir, "conversations"))
