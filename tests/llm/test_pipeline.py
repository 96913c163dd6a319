"""The corpus pipeline against brute force, stage by stage."""

from pyspark.sql import functions as F

import corpus_pipeline
from kinforge.llm import decontaminate, neardup, substrings


def test_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns = docs.columns
    stages = [f for _, f in corpus_pipeline.STAGES]
    good = stages[0](spark, docs, small).cache()
    assert good.columns == columns and good.schema == docs.schema
    labels = spark.read.parquet(f"{small}/labels.parquet").where("quality = 1").select("doc_id")
    assert good.join(labels, "doc_id", "left_semi").count() >= 0.95 * labels.join(docs, "doc_id", "left_semi").count()
    rows = [(r["doc_id"], r["text"]) for r in good.collect()]
    single = stages[1](spark, good, small).cache()
    assert single.columns == columns
    kept = {r[0] for r in neardup.near_duplicates_in_memory(rows) if r[3]}
    assert {r["doc_id"] for r in single.collect()} == kept
    rows = [(r["doc_id"], r["text"]) for r in single.collect()]
    cut = stages[2](spark, single, small).cache()
    assert cut.columns == columns and cut.schema == docs.schema
    want = {r[0]: r[2:] for r in substrings.remove_repeats_in_memory(rows)}
    texts = dict(rows)
    for r in cut.withColumn("h", F.sha2("text", 256)).collect():
        removed, digest = want[r["doc_id"]]
        assert (r["h"] == digest) if removed else (r["text"] == texts[r["doc_id"]])
        assert not removed or r["n_chars"] == len(r["text"])
    items = [tuple(r) for r in spark.read.parquet(f"{small}/benchmark.parquet").select("item_id", "text").collect()]
    clean = stages[3](spark, cut, small).cache()
    assert clean.columns == columns
    rows = [(r["doc_id"], r["text"]) for r in cut.collect()]
    assert {r["doc_id"] for r in clean.collect()} == {r[0] for r in decontaminate.contamination_in_memory(rows, items) if not r[5]}
    coded = stages[4](spark, clean, small)
    assert coded.columns == [*columns, "ids", "round_trip"] and coded.where("not round_trip").count() == 0 and coded.count() == clean.count()


def test_run(spark, small):
    got = corpus_pipeline.run(spark, small)
    assert 0 < got.count() < 200 and got.where("ids is null").count() == 0


def test_odd_documents(spark, small):
    rows = [(1, None, "en", None, None), (2, "", None, "s", 0), (None, "some text here", "en", "s", 14), (3, "x " * 30000, "en", "s", 60000), (3, "x " * 30000, "en", "s", 60000)]
    docs = spark.createDataFrame(rows, spark.read.parquet(f"{small}/documents.parquet").schema)
    for frame in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, frame, small).count() <= len(rows)


def test_clashing_columns(spark, small):
    docs = spark.createDataFrame([(1, "some text", "a", "b")], "doc_id long, text string, ids string, piece_round_trip string")
    got = corpus_pipeline.sentencepiece(spark, docs, small)
    assert got.columns == ["doc_id", "text", "ids", "piece_round_trip", "piece_ids", "round_trip"]
    assert got.first()["round_trip"] and got.first()["ids"] == "a"
