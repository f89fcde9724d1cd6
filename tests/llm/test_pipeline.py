import hashlib

import duckdb

import corpus_pipeline
from gaugeworks.llm import jaccard_join, quality_rules, substring_dedup
from gaugeworks.llm.tokens import encoder, word_bpe


def _sql(path, sql):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{path}/*.parquet')")
    return con.sql(sql).df()


def test_stages_against_plain_versions(spark, small_dir, tmp_path):
    """The rules, the join, the passages and the pieces, each on its own input, by SQL or a plain loop."""
    stages = dict(corpus_pipeline.STAGES)
    paths = {"input": f"{tmp_path}/input"}
    spark.read.parquet(f"{small_dir}/documents.parquet").write.parquet(paths["input"])
    before = "input"
    for name, stage in stages.items():
        paths[name] = f"{tmp_path}/{name.replace(' ', '-')}"
        stage(spark, spark.read.parquet(paths[before]), small_dir).write.parquet(paths[name])
        before = name
    ids = lambda name: set(spark.read.parquet(paths[name]).toPandas()["doc_id"])
    judged = _sql(paths["input"], quality_rules.ORACLE)
    assert ids("quality rules") == set(judged[judged["kept"]]["doc_id"])
    joined = _sql(paths["quality classifier"], jaccard_join.ORACLE)
    assert ids("n-gram Jaccard join") == set(joined[joined["kept"]]["doc_id"])
    cut = _sql(paths["n-gram Jaccard join"], substring_dedup.ORACLE)
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(paths["substring dedup"]).collect()}
    assert {i: hashlib.sha256(b" ".join((t or "").encode().split())).hexdigest() for i, t in texts.items()} == dict(zip(cut["doc_id"], cut["kept_sha256"]))
    enc = encoder(word_bpe())
    packed = spark.read.parquet(paths["best-fit packing"]).toPandas()
    assert dict(packed.groupby("doc_id")["length"].sum()) == {i: len(enc.encode(t)) // enc.dtype.itemsize + 1 for i, t in texts.items()}
    filled = packed.sort_values(["sequence_id", "offset"])
    assert (filled.groupby("sequence_id")["length"].cumsum() - filled["length"] == filled["offset"]).all()


def test_stages_keep_their_promises(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet").cache()
    columns, before = docs.columns, docs
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, small_dir)
        path = corpus_pipeline.fresh_path(spark, "stage")
        after.write.parquet(path)
        after = spark.read.parquet(path)
        assert after.columns == columns, name
        assert after.join(before, "doc_id", "left_anti").isEmpty(), name
        counts.append(after.count())
        before = after
    assert counts == sorted(counts, reverse=True)
    assert counts[-1] > 0.5 * counts[0]
    good = spark.read.parquet(f"{small_dir}/labels.parquet").filter("quality = 1").join(docs, "doc_id")
    long = good.filter("n_chars > 400")
    # clean texts go only where they are copies
    distinct = long.select("text").distinct().count()
    assert long.join(before, "doc_id").count() > 0.9 * distinct


def test_run(spark, small_dir):
    out = corpus_pipeline.run(spark, small_dir)
    filled = out.groupBy("sequence_id").agg({"length": "sum"}).toDF("sequence_id", "n")
    assert filled.filter("n > 4096").isEmpty()
    assert out.groupBy("doc_id", "piece").count().filter("count > 1").isEmpty()


def test_empty(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, small_dir).count() == 0, name
