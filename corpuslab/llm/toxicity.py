"""Toxicity by multiple-instance learning.

A document is a bag of sentences, and only the bag has a label. A sentence's probability is a logistic function of weights
of its words and of their first letters; a document's is the noisy-or of its sentences': 1 - product(1 - p). The weights
are trained through the noisy-or from document labels, so that they point to the sentences that make a document toxic. Weights are evidence
for toxicity and never negative: clean sentences do not excuse an offending one, whatever the document's length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.llm.common import CACHE_WORDS, drop_table, written
from corpuslab.session import in_arrow

#: Labelled documents of each class at most that the model is trained on: those with the least hashes of their doc_id.
TRAIN_ROWS = 4000
#: Lengths of the word beginnings that are features.
STEMS = (3, 4, 5, 6, 7)
#: A score from which a document counts as toxic, and a sentence as offending.
TOXIC, OFFENDING = 0.7, 0.5
#: Sparsity penalty of the training.
PENALTY = 2e-5

_BREAK, _END, _MARK = "\x00", 1e6, 5e5
_PUNCT = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»“”„‘’…–—¡¿"


def word_features(run: str) -> list[str]:
    word = run.lower().strip(_PUNCT)
    return [f"={word}", *(word[:n] for n in STEMS if len(word) >= n)] if word else []


def runs(text: str) -> list[str]:
    """Words with their punctuation, and a mark for each line's end; a NUL of the text's own counts as U+FFFD."""
    return text.replace(_BREAK, "\ufffd").replace("\n", f" {_BREAK} ").split()


@dataclass
class Model:
    weights: dict[str, float]
    bias: float
    _known: dict[str, float] = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return {"weights": self.weights, "bias": self.bias, "_known": {}}

    def _value(self, run: str) -> float:
        if run == _BREAK:
            return 2 * _END
        w = self.weights
        return sum(w.get(f, 0.0) for f in set(word_features(run))) + (_END if run[-1] in ".!?…" else 0.0)

    def sentences(self, text: str) -> np.ndarray:
        """The probability of each sentence that has a word; sentences end at line ends and after . ! ? …"""
        known, found = self._known, runs(text)
        try:
            values = np.fromiter(map(known.__getitem__, found), float, len(found))
        except KeyError:
            if len(known) > CACHE_WORDS:
                known.clear()
            for r in set(found):
                if r not in known:
                    known[r] = self._value(r)
            values = np.fromiter(map(known.__getitem__, found), float, len(found))
        if not len(values):
            return np.empty(0)
        breaks = values > 1.5 * _END
        ends = values > _MARK
        values = np.where(breaks, 0, values - _END * ends)
        at = np.cumsum(ends) - ends
        some = np.bincount(at, ~breaks) > 0
        return 1 / (1 + np.exp(-(self.bias + np.bincount(at, values)[some])))

    def score(self, text: str | None) -> float:
        """Noisy-or of the sentences; 0 for a null text and one without words."""
        p = self.sentences(text or "")
        return float(-np.expm1(np.log1p(-np.minimum(p, 1 - 1e-12)).sum()))


@dataclass
class Bags:
    """Labelled documents as the training sees them: which is toxic, how many of its sentences have no feature, and of each other sentence its document, and the features in it."""

    toxic: np.ndarray
    plain: np.ndarray
    bag: np.ndarray
    sentence: np.ndarray
    feature: np.ndarray


def train(bags: Bags, chosen: list[str], share: float | None = None, steps: int = 300) -> Model:
    """Noisy-or likelihood by gradient steps with a sparsity penalty, on bags of sentences; chosen: the names of the features.

    share: of toxic documents among all, if the classes were sampled apart; it sets the classes' weights.
    """
    y, n = bags.toxic, len(bags.toxic)
    if not n or y.all() or not y.any():
        return Model({}, -9.0 if not n or not y.any() else 0.0)
    n1, n0 = int(y.sum()), int(n - y.sum())
    share = n1 / n if share is None else share
    weight = np.where(y == 1, share * n / n1, (1 - share) * n / n0) / n
    w, b = np.full(len(chosen), 0.5), -6.0
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for step in range(1, steps + 1):
        z = b + np.bincount(bags.sentence, w[bags.feature], len(bags.bag))
        p, p0 = 1 / (1 + np.exp(-z)), 1 / (1 + np.exp(-b))
        log_q = np.minimum(-(np.bincount(bags.bag, np.logaddexp(0, z), n) + bags.plain * np.logaddexp(0, b)), -1e-12)
        pull = np.where(y == 1, -np.exp(log_q) / -np.expm1(log_q), 1.0) * weight
        g = pull[bags.bag] * p
        gw, gb = np.bincount(bags.feature, g[bags.sentence], len(w)) + PENALTY, g.sum() + (pull * bags.plain).sum() * p0  # with the penalty's slope
        m, v = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw**2
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb**2
        rate = 0.1 * (1 - step / (steps + 1)) + 0.005
        w = np.maximum(0, w - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8))
        b -= rate * (mb / (1 - 0.9**step)) / (np.sqrt(vb / (1 - 0.99**step)) + 1e-8)
    return Model({f: float(x) for f, x in zip(chosen, w, strict=True) if x > 1e-3}, float(b))


def sentences_of(text: str) -> list[list[str]]:
    """The runs of each sentence that has a word."""
    out, now = [], []
    for r in runs(text):
        now += [r] if r != _BREAK else []
        if (r == _BREAK or r[-1] in ".!?…") and now:
            out.append(now)
            now = []
    return out + [now] if now else out


def _seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (toxic, text) to the distinct features of each text."""
    for batch in batches:
        out, toxic = [], []
        for t, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found = {f for r in set(runs(text or "")) for f in word_features(r)}
            out += found
            toxic += [t] * len(found)
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), pa.array(toxic, pa.int32())], ["feature", "toxic"])


def _bagged(chosen: list[str]):
    """Rows (doc_id, toxic, text) to (doc_id, toxic, sentences without a chosen feature, the features of each other sentence)."""
    index = {f: i for i, f in enumerate(chosen)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known: dict[str, list[int]] = {}
            plain, held = [], []
            for text in batch.column(2).to_pylist():
                some, empty = [], 0
                for sentence in sentences_of(text or ""):
                    ids = []
                    for r in sentence:
                        if (mine := known.get(r)) is None:
                            mine = known[r] = sorted(index[f] for f in set(word_features(r)) if f in index)
                        ids += mine
                    if ids:
                        some.append(ids)
                    else:
                        empty += 1
                plain.append(empty)
                held.append(some)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(plain, pa.int64()), pa.array(held, pa.list_(pa.list_(pa.int32())))], ["doc_id", "toxic", "plain", "held"])

    return run


def held_out(doc_id="doc_id"):
    return F.crc32(F.col(doc_id).cast("string")) % 3 == 1


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """The model of labels (doc_id, toxic) that are not held out, on at most `rows` documents of each class.

    Labels with a null doc_id or a null toxic are left out; a doc_id labelled twice counts as toxic if one of its labels says so, and of several texts of a doc_id the least is read. Without
    labelled documents of both classes the model finds nothing toxic. Texts are read on the executors: features are counted there, and what comes to the driver are the chosen ones and where
    they stand in the sentences of the sample. Of features none is left out but those that are rare, or as frequent elsewhere: the bound on the labelled rows is the only one.
    """
    known = labels.where("doc_id is not null and toxic is not null").where(~held_out())
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    sizes = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    parts = [known.where(F.col("toxic") == t).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows) for t in (0, 1)]
    # at most 2 x rows pairs of numbers: small enough to broadcast
    sample = F.broadcast(parts[0].union(parts[1]).select(F.col("doc_id").alias("_id"), "toxic"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(sample, F.col("doc_id") == F.col("_id"))
    found, found_at = written(texts.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("text").alias("text")), "sample")
    n1, n0 = (r or 0 for r in found.agg(F.sum("toxic"), F.sum(1 - F.col("toxic"))).first())
    counts = in_arrow(found.select("toxic", "text"), _seen, "feature string, toxic int").groupBy("feature").agg(F.sum("toxic").alias("k"), F.sum(1 - F.col("toxic")).alias("clean"))
    # evidence must be frequent enough in toxic documents and clearly rarer in others
    often = counts.where((F.col("k") >= 4) & (F.col("k") * n0 > 4 * n1 * (F.col("clean") + 0.5)))
    chosen = sorted(r["feature"] for r in often.select("feature").collect())
    got = in_arrow(found.select("doc_id", "toxic", "text"), _bagged(chosen), "doc_id long, toxic int, plain long, held array<array<int>>").collect()
    drop_table(docs.sparkSession, found_at)
    got.sort(key=lambda r: r["doc_id"])
    held = [(d, ids) for d, r in enumerate(got) for ids in r["held"]]
    sizes_of = [len(ids) for _, ids in held]
    numbers = lambda x: np.array(x, np.int64)
    bags = Bags(numbers([r["toxic"] for r in got]), numbers([r["plain"] for r in got]), numbers([d for d, _ in held]), np.repeat(np.arange(len(held)), numbers(sizes_of)), numbers([i for _, ids in held for i in ids]))
    total = sum(sizes.values())
    return train(bags, chosen, sizes.get(1, 0) / total if total else None)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """docs' doc_id with held_out, score, predicted, n_sentences, and offending: the numbers, from 0, of the sentences whose own probability is OFFENDING or more. Every row of docs gives one, whatever its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ps = [model.sentences(t or "") for t in batch.column(2).to_pylist()]
            scores = [float(-np.expm1(np.log1p(-np.minimum(p, 1 - 1e-12)).sum())) for p in ps]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array([int(s >= TOXIC) for s in scores], pa.int32()), pa.array([len(p) for p in ps], pa.int64()), pa.array([np.flatnonzero(p >= OFFENDING) for p in ps], pa.list_(pa.int64()))], ["doc_id", "held_out", "score", "predicted", "n_sentences", "offending"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out(), F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    return in_arrow(rows, run, "doc_id long, held_out boolean, score double, predicted int, n_sentences long, offending array<long>")


def drop_toxic(docs: DataFrame, model: Model, threshold: float = TOXIC) -> DataFrame:
    """The rows of docs, all columns, that score below the threshold."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([model.score(t) < threshold for t in batch.column(at).to_pylist()], pa.bool_()))

    return in_arrow(docs, run, docs.schema)


def offending(docs: DataFrame, model: Model, threshold: float = OFFENDING) -> DataFrame:
    """(doc_id, sentence, words, probability) of each offending sentence: its number in the text and its words joined by a space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                p = model.sentences(text or "")
                if len(p) and p.max() >= threshold:
                    parts = sentences_of(text)
                    out += [(i, k, " ".join(parts[k]), float(p[k])) for k in np.flatnonzero(p >= threshold).tolist()]
            yield pa.RecordBatch.from_arrays([pa.array([o[j] for o in out], t) for j, t in enumerate((pa.int64(), pa.int64(), pa.string(), pa.float64()))], ["doc_id", "sentence", "words", "probability"])

    return in_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, "doc_id long, sentence long, words string, probability double")
