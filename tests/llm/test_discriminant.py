"""The quadratic discriminant against its formulas, and on held-out labels."""

import numpy as np
import pytest

from corpuslab.llm import discriminant as q

SF = "/root/testdata/sf0.01"


def samples(n=80, seed=1):
    r = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(300)]
    good = [" ".join(r.choice(words, 60)) + ".\nEnd of it." for _ in range(n)]
    bad = [" ".join([r.choice(words)] * 40 + list(r.choice(words, 5))) + " ###$$$" for _ in range(n // 4)]
    return good + bad, np.array([1] * len(good) + [0] * len(bad))


def test_scores_are_the_densities_of_shrunk_normal_distributions():
    texts, good = samples()
    counted = np.array([q.statistics(t) for t in texts], float)
    model = q.train(counted, good, 0.7)
    x = model._shares(counted)
    x = (x - x.mean(0)) / (x.std(0) + 1e-6)
    both = sum(np.cov(x[good == k].T, bias=True) * (good == k).sum() for k in (0, 1)) / len(x)
    logs = []
    for k, prior in ((0, 0.3), (1, 0.7)):
        c = (1 - q.POOLED) * np.cov(x[good == k].T, bias=True) + q.POOLED * both
        c = (1 - q.ROUND) * c + (q.ROUND * np.trace(c) / len(c) + 1e-6) * np.eye(len(c))
        d = x - x[good == k].mean(0)
        logs.append(np.log(prior) - 0.5 * np.linalg.slogdet(c)[1] - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(c), d))
    assert np.allclose(model.differences(counted), logs[1] - logs[0])
    assert np.allclose(model.scores(texts), 1 / (1 + np.exp(-(logs[1] - logs[0]) / q.STATISTICS)))
    assert ((model.scores(texts) >= 0.5) == good).mean() > 0.98


def test_statistics():
    assert q.statistics(None) == q.statistics("") and not any(q.statistics("")[:9]) and not any(q.statistics("")[10:])
    s = q.statistics("Aa bb Aa, bb!\n7 bb\n7 bb\n\n")
    assert s[:3] == [25, 8, 3]
    assert s[3:9] == [2, 2, 2, 0, 0, 9]
    assert s[10:] == [5, 3, 16, 36, 8, 6, 0, 0, 1, 2]
    assert q.statistics("a a a b b a.")[16] == 3


def test_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    found = {r["doc_id"]: r for r in q.scored(docs, q.fit(docs, labels)).collect()}
    known = [(r["quality"], found[r["doc_id"]]) for r in labels.collect() if found[r["doc_id"]]["held_out"]]
    assert sum(y == r["predicted"] for y, r in known) / len(known) > 0.97
    assert all((r["predicted"] == 1) == (r["score"] >= 0.5) and 0 <= r["score"] <= 1 for r in found.values())


def test_held_out_labels_are_never_read(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.selectExpr("doc_id", "CASE WHEN crc32(cast(doc_id AS string)) % 3 = 1 THEN 1 - quality ELSE quality END AS quality")
    a, b = (q.fit(docs, x) for x in (labels, turned))
    assert a.share == b.share and all(np.array_equal(x, y) for x, y in zip(a.factors, b.factors, strict=True))


@pytest.mark.parametrize("label", [None, 1, 0])
def test_one_class_or_none(spark, label):
    docs = spark.createDataFrame([(0, "a b c"), (2, ""), (3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(0, label), (2, label), (None, 1)], "doc_id long, quality int")
    scores = {r["score"] for r in q.scored(docs, q.fit(docs, labels)).collect()}
    assert scores == {0.5 if label is None else float(label)}


def test_repeated_rows_nulls_long_texts_and_other_columns(spark):
    texts, good = samples(40)
    rows = [(i, t, "x", 1.0, 2) for i, t in enumerate(texts)]
    rows += rows[:10] + [(3, "another text of three", "x", 1.0, 2), (None, "no id", "x", 1.0, 2), (900, None, "x", 1.0, 2), (901, "", "x", 1.0, 2), (902, "word " * 400_000, "x", 1.0, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, good string, score double, _id int").repartition(3)
    labels = spark.createDataFrame([(i, int(y), 0) for i, y in enumerate(good)] + [(1, 0, 0), (None, 1, 0), (5, None, 0)], "doc_id long, quality int, good int")
    found = q.scored(docs, q.fit(docs, labels)).collect()
    assert len(found) == len(rows)
    by = {r["doc_id"]: r for r in found}
    assert by[902]["predicted"] == 0 and by[900]["score"] == by[901]["score"] and not by[None]["held_out"]
    empty = spark.createDataFrame([], docs.schema)
    assert q.scored(empty, q.fit(empty, labels)).collect() == []
