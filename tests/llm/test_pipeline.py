"""The pipeline's stages work on what their predecessors kept, and give the columns of documents."""

import os

import pytest

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark):
    from corpuslab.llm.common import written

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for name, stage in pipeline.STAGES:
        before = {r["doc_id"] for r in docs.select("doc_id").collect()}
        docs, _ = written(stage(spark, docs, DATA), name.replace(" ", "-"))
        after = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert after <= before
        if name != pipeline.STAGES[-1][0]:
            assert docs.columns == columns
        if name == "minhash near-dedup":
            assert docs.count() == len(after)
            texts = [r["text"] for r in docs.select("text").collect()]
            assert len(set(texts)) == len(texts)
    assert docs.where("size(ids) <> n_tokens").count() == 0
    assert 0.5 * n < docs.count()
    assert [r["doc_id"] for r in pipeline.run(spark, DATA).select("doc_id").orderBy("doc_id").collect()] == [r["doc_id"] for r in docs.select("doc_id").orderBy("doc_id").collect()]


def test_stages_on_odd_rows(spark):
    """Nulls, empty texts, ids that repeat with equal and with other texts, and columns with the operators' own names go through all stages."""
    from pyspark.sql import functions as F

    words = [f"word{i}" for i in range(400)]
    long = " ".join(words)
    own = ["_rows", "_kept_id", "_row", "_id", "_key", "_spans", "_tokens", "_posterior", "_text", "component", "rep", "score"]
    texts = [(1, long), (1, long), (2, long + " end"), (3, None), (4, ""), (5, " \n"), (5, "b other text"), (5, "a first text"), (None, "no id here"), (None, None), (6, " ".join(words[:120]) + " else " * 3), (7, "plain words of a short text.")]
    docs = spark.createDataFrame([(i, x, "en", f"src{k}", None if x is None else len(x), *[k] * len(own)) for k, (i, x) in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} int" for c in own)).repartition(3)
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.columns == docs.columns, name
        rows = [tuple(r) for r in out.collect()]
        assert len({r[5:] and set(r[5:]).pop() for r in rows}) <= len(texts) and all(len(set(r[5:])) == 1 for r in rows)  # the other columns stay with their rows
        docs = spark.createDataFrame(rows, docs.schema).repartition(2)
        if name == "minhash near-dedup":
            kept = {(r[0], r[1]) for r in rows}
            assert kept == {(1, long), (3, None), (4, ""), (5, " \n"), (None, "no id here"), (None, None), (6, texts[10][1]), (7, texts[11][1])}
        if name == "substring dedup":
            assert {r[0]: r[1] for r in rows if r[0] in (1, 6)} == {1: long, 6: "else else else"}
    out = pipeline.STAGES[-1][1](spark, docs, DATA)
    assert out.where("size(ids) <> n_tokens").count() == 0 and out.count() == docs.count()
    empty = docs.limit(0).withColumn("doc_id", F.col("doc_id"))
    for _, stage in pipeline.STAGES:
        empty = stage(spark, empty, DATA)
        assert empty.collect() == []
        empty = spark.createDataFrame([], empty.schema)
