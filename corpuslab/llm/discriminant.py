"""A quality classifier by regularised quadratic discriminant analysis.

Each whole text becomes a few statistics: shares of kinds of characters, how well it packs, how often its words, pairs of words and lines repeat, how long its words are. Shares are drawn to the training sample's
medians by some pseudo-counts, so that a short text tells little, and their logarithms are taken. Each class is a normal distribution of these, whose covariance is shrunk to the pooled one and to a multiple
of the identity; the factors of the covariances are computed once and kept with the model. A score is the difference of the two log densities, from Mahalanobis lengths, on a scale of 0 to 1.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.llm.common import drop_table, utf8, written
from corpuslab.session import in_arrow

#: Labelled documents of each class at most that the model is trained on: those with the least hashes of their doc_id.
TRAIN_ROWS = 4000
#: Bytes, words and lines that count as seen besides a text's own, at the sample's medians.
PSEUDO = np.array([150.0, 25.0, 3.0])
#: How far a class's covariance goes to the pooled one, and then to a multiple of the identity.
POOLED, ROUND = 0.2, 0.02
#: A score from which a document counts as good.
GOOD = 0.5

#: What each statistic is a share of: 0 bytes, 1 words, 2 lines.
OF = np.array([0] * 7 + [1] * 9 + [2])
SIZES, STATISTICS = 3, len(OF)

_KIND = np.full(256, 4, np.intp)  # beyond ASCII
for _c in range(128):
    _ch = chr(_c)
    _KIND[_c] = 0 if _ch.isupper() else 6 if _ch.islower() else 1 if _ch.isdigit() else 5 if _ch in " \t\n\v\f\r" else 2 if _ch in ".,;:'\"-()?!" else 3


def statistics(text: str | None) -> list[float]:
    """Bytes, words and lines of a text, then what is counted of them: capitals, digits, punctuation, other signs, bytes beyond ASCII, white space and packed bytes; distinct words, the most frequent word,
    letters of words, their squares, words of at most three letters, distinct pairs of neighbours, words that are the one before again, full stops, exclamation marks; distinct lines."""
    data = utf8(text)
    kinds = np.bincount(_KIND[np.frombuffer(data, np.uint8)], minlength=7)[:6] if data else np.zeros(6)
    words = (text or "").split()
    counts = Counter(words)
    number = {w: i for i, w in enumerate(counts)}
    at = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    lengths = np.fromiter(map(len, words), float, len(words))
    lines = [line for line in (text or "").split("\n") if line.strip()]
    pack = zlib.compressobj(1, zlib.DEFLATED, -15)
    packed = len(pack.compress(data)) + len(pack.flush())
    pairs = len(np.unique(at[:-1] * len(number) + at[1:])) if len(at) > 1 else 0
    return [
        len(data), len(words), len(lines), *kinds, packed, len(counts), max(counts.values(), default=0), lengths.sum(), (lengths**2).sum(), (lengths <= 3).sum(),
        pairs, (at[1:] == at[:-1]).sum(), (text or "").count("."), (text or "").count("!"), len(set(lines)),
    ]


@dataclass
class Model:
    """share: of label 1. typical: medians of the shares. mean, scale: of their logarithms. Of each class its centre, the inverse of its covariance's Cholesky factor, and the logarithm of that factor's determinant."""

    share: float
    typical: np.ndarray | None = None
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    centres: tuple[np.ndarray, ...] = ()
    factors: tuple[np.ndarray, ...] = ()
    volumes: tuple[float, ...] = ()

    def _shares(self, counted: np.ndarray) -> np.ndarray:
        own = counted[:, :SIZES][:, OF]
        return np.log((counted[:, SIZES:] + PSEUDO[OF] * self.typical) / (own + PSEUDO[OF]) + 0.005)

    def differences(self, counted: np.ndarray) -> np.ndarray:
        """Log density times prior of label 1, less that of label 0."""
        z = (self._shares(counted) - self.mean) / self.scale
        logs = [np.log(p) - v - 0.5 * (((z - c) @ f.T) ** 2).sum(1) for p, c, f, v in zip((1 - self.share, self.share), self.centres, self.factors, self.volumes, strict=True)]
        return logs[1] - logs[0]

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """0 to 1, and 0.5 where both classes are as likely: a logistic function of the difference for each statistic, so that no two texts meet at the ends."""
        if not self.centres or not texts:
            return np.full(len(texts), self.share)
        d = self.differences(np.array([statistics(t) for t in texts], float)) / STATISTICS
        return 1 / (1 + np.exp(-np.clip(d, -700, 700)))


def train(counted: np.ndarray, good: np.ndarray, share: float, pooled: float = POOLED, round_: float = ROUND) -> Model:
    """counted: a row of statistics() for each text; good: 0 or 1; share: of label 1 among all. With one class alone the score is the share."""
    if not len(good) or good.all() or not good.any():
        return Model(share)
    model = Model(min(max(share, 1e-6), 1 - 1e-6), np.median(counted[:, SIZES:] / np.maximum(1, counted[:, :SIZES][:, OF]), axis=0))
    logs = model._shares(counted)
    model.mean, model.scale = logs.mean(0), logs.std(0) + 1e-6
    z = (logs - model.mean) / model.scale
    parts = [z[good == k] for k in (0, 1)]
    centres = tuple(x.mean(0) for x in parts)
    spreads = [(x - c).T @ (x - c) for x, c in zip(parts, centres, strict=True)]
    both = sum(spreads) / len(z)
    factors = []
    for x, s in zip(parts, spreads, strict=True):
        shrunk = (1 - pooled) * s / len(x) + pooled * both
        shrunk = (1 - round_) * shrunk + (round_ * np.trace(shrunk) / len(shrunk) + 1e-6) * np.eye(len(shrunk))
        factors.append(np.linalg.cholesky(shrunk))
    model.centres, model.factors = centres, tuple(np.linalg.inv(f) for f in factors)
    model.volumes = tuple(float(np.log(np.diag(f)).sum()) for f in factors)
    return model


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string")) % 3 == 1


_NAMES = [f"s{i}" for i in range(SIZES + STATISTICS)]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.array([statistics(t) for t in batch.column(1).to_pylist()], float).reshape(-1, SIZES + STATISTICS)
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(found[:, i], pa.float64()) for i in range(found.shape[1]))], ["good", *_NAMES])


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """The model of labels (doc_id, quality) that are not held out, on at most `rows` documents of each class.

    Labels with a null doc_id or a null quality are left out; a doc_id labelled twice counts as good if one of its labels says so, and of several texts of a doc_id the least is read. Texts are read on the executors, and
    the statistics of the sample come to the driver. Without labelled documents of both classes every score is the share of label 1, without any 0.5.
    """
    known = labels.where("doc_id is not null and quality is not null").where(~held_out())
    known = known.groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max((F.col("quality") > 0).cast("int")).alias("good"))
    sizes = {r["good"]: r["count"] for r in known.groupBy("good").count().collect()}
    parts = [known.where(F.col("good") == t).orderBy(F.xxhash64("_id"), "_id").limit(rows) for t in (0, 1)]
    sample = F.broadcast(parts[0].union(parts[1]))  # at most 2 x rows pairs of numbers
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(sample, F.col("doc_id") == F.col("_id"))
    found, at = written(texts.groupBy("doc_id").agg(F.max("good").alias("good"), F.min("text").alias("text")).select("good", "text"), "sample")
    got = in_arrow(found, _counted, "good int, " + ", ".join(f"{n} double" for n in _NAMES)).collect()
    drop_table(docs.sparkSession, at)
    got.sort()  # sums in one order, whatever tasks end first
    counted = np.array([r[1:] for r in got], float).reshape(-1, SIZES + STATISTICS)
    total = sum(sizes.values())
    return train(counted, np.array([r["good"] for r in got], int), sizes.get(1, 0) / total if total else 0.5)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """docs' doc_id with held_out, score and predicted; every row gives one, whatever its text. Null and empty texts, of which nothing is known, score as a text of the sample's medians does; a null doc_id is not held out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = model.scores(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array(scores >= GOOD, pa.bool_()).cast(pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out(), F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    return in_arrow(rows, run, "doc_id long, held_out boolean, score double, predicted int")
