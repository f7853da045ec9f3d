"""Mixing to target weights with soft membership.

A softmax classifier, fitted on a bounded sample of a labelled table, gives each document a posterior over domains. With t the
documents' token counts, P their posteriors and r their rates, the expected tokens of the domains are P'(t r). Projected-gradient
least squares finds rates of at least a floor (0 unless asked otherwise) for which they meet the targets: each step moves a rate along its posterior
against the residual, measured by the inverse of P'diag(t)P, and cuts it off at the floor. A rate is a function of the posterior and of the
steps' directions alone, so a step is one distributed sum over a table of token counts and posteriors, and nothing about single documents is sent to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.llm.common import CACHE_WORDS, drop_table, free_names, utf8, written
from corpuslab.session import in_arrow

#: Labelled documents at most that the classifier is fitted on: those with the least hashes of their doc_id.
TRAIN_ROWS = 3000
BUCKETS = 2048
SHAPE = 5


@dataclass
class Classifier:
    """Softmax over hashed words and a few shares of the text's shape."""

    domains: list[str]
    matrix: np.ndarray
    _known: dict[bytes, int] = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return {"domains": self.domains, "matrix": self.matrix, "_known": {}}

    def features(self, text: str | None) -> tuple[np.ndarray, int]:
        words = utf8(text).lower().split()
        known = self._known
        if len(known) > CACHE_WORDS:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w) % BUCKETS
        x = np.zeros(BUCKETS + SHAPE)
        if words:
            counts = np.sqrt(np.bincount(np.fromiter(map(known.__getitem__, words), np.int64, len(words)), minlength=BUCKETS))
            x[:BUCKETS] = counts / np.linalg.norm(counts)
            size = sum(map(len, words))
            raw = np.frombuffer(b"".join(words), np.uint8)
            odd = (raw < 128) & ~(((raw >= 97) & (raw <= 122)) | ((raw >= 48) & (raw <= 57)))
            x[BUCKETS:] = (1, odd.mean() * 4, len(set(words)) / len(words), np.log1p(len(words)) / 8, size / len(words) / 8)
        else:
            x[BUCKETS] = 1
        return x, len(words)

    def posterior(self, text: str | None) -> tuple[np.ndarray, int]:
        x, n = self.features(text)
        z = x @ self.matrix
        p = np.exp(z - z.max())
        return p / p.sum(), n


def _sample_features(model: Classifier):
    """Rows (domain, text) to (domain, the numbers of the features that are not 0 as 16-bit integers, their values as 32-bit floats)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, values = [], []
            for text in batch.column(1).to_pylist():
                x = model.features(text)[0]
                some = np.flatnonzero(x)
                at.append(some.astype(np.uint16).tobytes())
                values.append(x[some].astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(at, pa.binary()), pa.array(values, pa.binary())], ["domain", "at", "value"])

    return run


def fit_classifier(docs: DataFrame, labelled: DataFrame, rows: int = TRAIN_ROWS, steps: int = 200) -> Classifier:
    """labelled: (doc_id, domain). Rows with a null in either are left out; of several domains of a doc_id the least counts, and of several texts the least.
    Without any labelled document there is one domain, ''. Texts are read on the executors; a few kilobytes of each of at most `rows` documents come to the driver, however long they are."""
    known = labelled.where("doc_id is not null and domain is not null").groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.min(F.col("domain").cast("string")).alias("domain"))
    sample = F.broadcast(known.orderBy(F.xxhash64("_id"), "_id").limit(rows))  # at most `rows` ids and names
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = texts.join(sample, F.col("doc_id") == F.col("_id")).groupBy("doc_id").agg(F.min("domain").alias("domain"), F.min("text").alias("text"))
    got = in_arrow(found.select("domain", "text"), _sample_features(Classifier([""], np.zeros((0, 1)))), "domain string, at binary, value binary").collect()
    got.sort(key=lambda r: (r["domain"], r["at"], r["value"]))
    domains = sorted({r["domain"] for r in got}) or [""]
    model = Classifier(domains, np.zeros((BUCKETS + SHAPE, len(domains))))
    if len(domains) > 1:
        x = np.zeros((len(got), BUCKETS + SHAPE), np.float32)
        for i, r in enumerate(got):
            x[i, np.frombuffer(r["at"], np.uint16)] = np.frombuffer(r["value"], np.float32)
        y = np.eye(len(domains), dtype=np.float32)[[domains.index(r["domain"]) for r in got]]
        w = np.zeros((x.shape[1], len(domains)), np.float32)
        ahead = w
        for step in range(steps):  # Nesterov's steps; features have norms near 1, so the slope's bound is near 2
            z = x @ ahead
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            new = ahead - 1.0 * (x.T @ (p - y) / len(x) + 1e-5 * ahead) * 4
            w, ahead = new, new + step / (step + 3) * (new - w)
        model.matrix = w.astype(float)
    return model


#: Columns that with_posteriors() adds.
TOKENS, POSTERIOR = "_tokens", "_posterior"


def with_posteriors(docs: DataFrame, model: Classifier, columns: list[str] | None = None) -> tuple[DataFrame, str]:
    """The given columns of docs (all of them unless told otherwise) with _tokens and _posterior of each row's text, as a written table and its path: texts are read once.

    Null and empty texts have no tokens; repeated rows and ids are rows of their own; an empty table gives none. docs must have no columns of these two names.
    """
    names = docs.columns if columns is None else columns
    if TOKENS in names or POSTERIOR in names:
        raise ValueError(f"there is a column {TOKENS} or {POSTERIOR}")
    size = len(model.domains)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.posterior(t) for t in batch.column(len(names)).to_pylist()]
            p = np.array([f[0] for f in found]).reshape(-1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(p) + 1, size, dtype=np.int32)), pa.array(p, pa.float64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(names))), pa.array([f[1] for f in found], pa.int64()), lists], [*names, TOKENS, POSTERIOR])

    (text,) = free_names([*names, TOKENS, POSTERIOR], "_text")
    rows = docs.select(*names, F.col("text").cast("string").alias(text))
    schema = docs.select(*names).withColumns({TOKENS: F.lit(0).cast("long"), POSTERIOR: F.array().cast("array<double>")}).schema
    return written(in_arrow(rows, run, schema), "posteriors")


def tempered(totals: np.ndarray, power: float = 0.7) -> np.ndarray:
    """Weights in proportion to a power of the present totals: small domains gain."""
    w = np.where(totals > 0, totals, 0) ** power
    return w / w.sum() if w.sum() else w


@dataclass
class Rates:
    """How a posterior becomes a rate."""

    model: Classifier
    steps: list[tuple[float, np.ndarray]]
    least: float
    targets: np.ndarray
    reached: np.ndarray
    #: How far the last step moved the rates, in relation to them: near 0 where no better rates are left.
    moved: float

    def of(self, p: np.ndarray) -> np.ndarray:
        return rates_of(p, self.steps, self.least)[1]


def rates_of(p: np.ndarray, steps: list[tuple[float, np.ndarray]], least: float) -> tuple[np.ndarray, np.ndarray]:
    """The rates of posteriors before and after the last step: a step goes on by `beta` of what the one before changed, then along u, and stops at the floor."""
    before = r = np.full(len(p), max(1.0, least))
    for beta, u in steps:
        before, r = r, np.maximum(least, r + beta * (r - before) + p @ u)
    return before, r


def sums_of(t: np.ndarray, p: np.ndarray, steps: list[tuple[float, np.ndarray]], least: float) -> np.ndarray:
    """The sum of t r p, and, behind it, of t (what the last step changed of r)**2 and of t r**2."""
    before, r = rates_of(p, steps, least)
    return np.array([*(t * r) @ p, t @ (r - before) ** 2, t @ r**2])


def _summed(table: DataFrame, size: int, each) -> np.ndarray:
    """The sum over a table's batches of each(tokens, posteriors)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0.0
        for batch in batches:
            total = total + each(batch.column(0).to_numpy().astype(float), batch.column(1).flatten().to_numpy().reshape(-1, size))
        total = np.atleast_1d(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total.astype(float))], ["k", "v"])

    # a task for each core: a step is short, and so should its tasks' beginnings be
    cores = max(1, table.sparkSession.sparkContext.defaultParallelism)
    rows = in_arrow(table.select(TOKENS, POSTERIOR).coalesce(cores), run, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()  # as many as there are domains, or pairs of them
    return np.array([r["v"] for r in sorted(rows)])


def descent(gram: np.ndarray, targets: np.ndarray, least: float, sums, most_steps: int) -> tuple[list[tuple[float, np.ndarray]], np.ndarray, float]:
    """Steps, what they reach, and how far the last one moved the rates. sums(steps): sums_of() over all rows.

    With A r = P'(t r) the steps are those of Nesterov's projected gradient for half of (b - A r)' G^-1 (b - A r), G = P'diag(t)P, in the metric of the tokens t, in which the slope's bound
    is 1; the momentum starts anew where the value rises, and the steps up to the least value count.
    """
    inverse = np.linalg.pinv(gram, rcond=1e-9)
    value = lambda x: float((targets - x) @ inverse @ (targets - x))
    steps: list[tuple[float, np.ndarray]] = []
    before = now = gram.sum(1) * max(1.0, least)
    moved, k = np.inf, 0
    best = (value(now), 0, now, 0.0)
    while len(steps) < most_steps and moved > 1e-7 and np.linalg.norm(targets - now) > 1e-6 * max(1.0, np.linalg.norm(targets)):
        beta = k / (k + 3)
        steps.append((beta, inverse @ (targets - now - beta * (now - before))))
        got = sums(steps)
        moved = float(np.sqrt(got[-2] / max(got[-1], 1e-300)))
        k = 0 if value(got[:-2]) > value(now) else k + 1
        before, now = now, got[:-2]
        if value(now) < best[0]:
            best = (value(now), len(steps), now, moved)
    return steps[: best[1]], best[2], best[3]


def fit_rates(table: DataFrame, model: Classifier, weights: dict[str, float] | None = None, least: float = 0.0, keep_all: bool = False, most_steps: int = 40) -> Rates:
    """Rates for the rows of with_posteriors(), by descent().

    weights: of the domains in the mix (not negative, in any unit; domains left out weigh nothing), or None for tempered ones. The mix has as
    many expected tokens as the rows; with keep_all every rate is at least 1, and the mix as many as that takes. Targets that posteriors allow are met in some 20 steps; those that they do not
    are come near in most_steps, and `moved` says whether more would help. Rows without tokens have no say. An empty table has no steps.
    """
    size = len(model.domains)
    least = max(least, 1.0) if keep_all else least
    gram = _summed(table, size, lambda t, p: ((p * t[:, None]).T @ p).ravel())
    gram = gram.reshape(size, size) if gram.size == size * size else np.zeros((size, size))
    now = gram.sum(1)
    w = tempered(now) if weights is None else np.array([max(0.0, weights.get(d, 0.0)) for d in model.domains])
    w = w / w.sum() if w.sum() else w
    total = max(now[w > 0] / w[w > 0], default=0.0) if keep_all else now.sum()
    targets = w * total
    steps, reached, moved = descent(gram, targets, least, lambda some: _summed(table, size, lambda t, p: sums_of(t, p, some, least)), most_steps if now.any() else 0)
    return Rates(model, steps, least, targets, reached, moved)


def copies_of(ids: list[int | None], rates: np.ndarray) -> np.ndarray:
    """Whole numbers with the rates as means: the fraction decides by a hash of the id, so that a run repeats."""
    u = np.array([xxhash.xxh3_64_intdigest(str(i).encode()) for i in ids], np.uint64).astype(float) / 2.0**64
    whole = np.floor(rates)
    return (whole + (u < rates - whole)).astype(np.int64)


def rated(table: DataFrame, rates: Rates) -> DataFrame:
    """(doc_id, n_tokens, domain, posterior, rate, copies) of every row of with_posteriors(); domain is the likeliest one. Null and empty texts have no tokens; a null doc_id draws as one id."""
    size, domains = len(rates.model.domains), rates.model.domains

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = batch.column(2).flatten().to_numpy().reshape(-1, size)
            r = rates.of(p)
            at = p.argmax(1) if len(p) else np.empty(0, int)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([domains[i] for i in at], pa.string()), pa.array(p.max(1) if len(p) else [], pa.float64()), pa.array(r), pa.array(copies_of(batch.column(0).to_pylist(), r))],
                ["doc_id", "n_tokens", "domain", "posterior", "rate", "copies"],
            )

    rows = table.select(F.col("doc_id").cast("long").alias("doc_id"), TOKENS, POSTERIOR)
    return in_arrow(rows, run, "doc_id long, n_tokens long, domain string, posterior double, rate double, copies long")


def mixed(table: DataFrame, rates: Rates) -> DataFrame:
    """The rows of with_posteriors(), without its two columns, each as often as its copies say: rows of one id and posterior are copied alike."""
    names = [c for c in table.columns if c not in (TOKENS, POSTERIOR)]
    ids_at, size = names.index("doc_id"), len(rates.model.domains)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = copies_of(batch.column(ids_at).to_pylist(), rates.of(batch.column(len(names)).flatten().to_numpy().reshape(-1, size)))
            at, own = np.repeat(np.arange(len(n)), n), pa.RecordBatch.from_arrays(batch.columns[: len(names)], names)
            for i in range(0, len(at), max(1, len(n))):  # no batch grows beyond its input
                yield own.take(pa.array(at[i : i + max(1, len(n))]))

    return in_arrow(table.select(*names, POSTERIOR), run, table.select(*names).schema)


def mix(docs: DataFrame, model: Classifier, weights: dict[str, float] | None = None, least: float = 0.0, keep_all: bool = False) -> DataFrame:
    """The rows of docs, all columns, repeated by fitted rates; they are read from the table of posteriors. Columns may have any names. An empty table gives none."""
    own = [c for c in docs.columns if c.lower() in (TOKENS, POSTERIOR)]
    apart = dict(zip(own, free_names([*docs.columns, TOKENS, POSTERIOR], *own), strict=True))
    table, _ = with_posteriors(docs.withColumnsRenamed(apart), model)
    return mixed(table, fit_rates(table, model, weights, least, keep_all)).withColumnsRenamed({b: a for a, b in apart.items()})


def mixing_rates(docs: DataFrame, model: Classifier, weights: dict[str, float] | None = None) -> DataFrame:
    """rated() of docs (doc_id, text), as a written table."""
    table, path = with_posteriors(docs, model, ["doc_id"])
    result, _ = written(rated(table, fit_rates(table, model, weights)), "rates")
    drop_table(docs.sparkSession, path)
    return result
