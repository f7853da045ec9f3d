"""Hard negatives by distributed radix selection.

An anchor's positives are the best rows of its own label; for each anchor and positive a window of scores holds the rows of other labels that are hard, and of those the best few are wanted. Nothing is sorted
and no pair is written: tasks count integer scores by their highest digit, the counts tell in which bucket of a window the k-th best score lies, the next pass counts the next digit inside that bucket alone, and the last one
gathers the rows above the k-th score and, of those at it, the ones with the least ids. A task reports of a window only its highest buckets that hold k rows, as the k-th best of all rows is in none below them.

Anchors are a stated query set; they meet all rows in waves. A wave's anchors are broadcast and have a bounded size, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpuslab.llm.common import drop_table, new_path, written
from corpuslab.session import in_arrow

#: Anchors of a wave, and bytes of their vectors, about; the anchors of a block, which meet a batch of rows at a time.
WAVE, WAVE_BYTES, BLOCK = 4096, 16 << 20, 256
#: Bits of a digit.
DIGIT = 8
#: Vectors whose squared length reaches this take no part: products, and twenty times them, then always fit 64 bits.
LONGEST = 2.0**57
_EXACT = 2.0**53

_RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def _quantised(scale: float):
    """Rows (id, label, vector) to those that take part, with their vectors as 32-bit integers and the squared lengths of these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, labels, vectors = batch.columns
            lengths = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            values = pc.list_flatten(vectors).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(lengths)), lengths)
            with np.errstate(all="ignore"):
                scaled = np.floor(scale * values)
                bad = ~(np.abs(scaled) < 2.0**31)
                square = np.bincount(row, np.where(bad, 0, scaled) ** 2, len(lengths))
            whole = (np.bincount(row, bad, len(lengths)) == 0) & (square < LONGEST)
            taken = pc.and_(pc.and_(pc.is_valid(vectors), pc.and_(pc.is_valid(ids), pc.is_valid(labels))), pa.array(whole))
            data = np.where(bad, 0, scaled).astype("<i4").tobytes()
            offsets = np.concatenate([[0], np.cumsum(4 * lengths)]).astype(np.int32)
            packed = pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data)])
            yield pa.RecordBatch.from_arrays([ids, labels, packed, pa.array(square, pa.float64())], ["id", "label", "v", "square"]).filter(taken)

    return run


def integer_vectors(rows: DataFrame, scale: float = 256) -> tuple[DataFrame, str]:
    """(id, label, v, square) of the rows (vec_id, label, embedding) that take part, as a written table, and its path.

    A component x becomes floor(scale * x). Rows with a null id, label or vector, a null or non-finite component, one of 2^31 or more, or a squared length of 2^57 or more take no part. Of several rows of an id
    one takes part: the least by label, then by the bytes of its vector. Other columns are not read.
    """
    part = rows.select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("v"))
    clean, path = written(in_arrow(part, _quantised(scale), "id long, label long, v binary, square double"), "vectors")
    if clean.groupBy("id").count().where("count > 1").limit(1).count():  # only then do vectors move
        one, at = written(clean.groupBy("id").agg(F.min(F.struct("label", "v", "square")).alias("r")).select("id", "r.*"), "vectors")
        drop_table(rows.sparkSession, path)
        return one, at
    return clean, path


@dataclass
class Windows:
    """Score windows [low, high] of a wave's anchors, `slots` of each, and how far their k-th best score is known: it is base or up to 2^shift * 256 - 1 more, and `need` rows of those scores are wanted."""

    ids: np.ndarray
    labels: np.ndarray
    groups: list[tuple[int, np.ndarray, np.ndarray]]  # vectors by their length: (length, numbers of the anchors, matrix)
    exact: bool
    same: bool
    k: int
    low: np.ndarray
    high: np.ndarray

    def __post_init__(self) -> None:
        self.slots = self.low.shape[1]
        self.base = self.low.copy()
        self.need = np.full(self.low.shape, self.k, np.int64)
        most = int((self.high - self.low).max(initial=0))
        self.shift = max(0, -(-most.bit_length() // DIGIT) - 1) * DIGIT

    def scores(self, batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For each block of anchors: numbers of the anchors, ids of the rows, scores (rows x anchors), and which of them count."""
        ids, labels = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        sizes = pc.binary_length(batch.column(2)).to_numpy()
        for length, at, matrix in self.groups:
            rows = np.flatnonzero(sizes == 4 * length)
            if not len(rows):
                continue
            x = np.frombuffer(b"".join(batch.column(2).take(pa.array(rows)).to_pylist()), "<i4").reshape(len(rows), length).astype(matrix.dtype)
            for b in range(0, len(at), BLOCK):
                anchors = at[b : b + BLOCK]
                s = (x @ matrix[b : b + BLOCK].T).astype(np.int64)
                alike = labels[rows][:, None] == self.labels[anchors][None, :]
                yield anchors, ids[rows], s, alike & (ids[rows][:, None] != self.ids[anchors][None, :]) if self.same else ~alike


def _counted(shared):
    """Rows to (win, digit, n): of each window the task's highest digits that hold k rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w: Windows = shared.value
        width = 1 << DIGIT
        counts = np.zeros((len(w.ids) * w.slots, width), np.int32)
        for batch in batches:
            for anchors, _, s, counted in w.scores(batch):
                for j in range(w.slots):
                    digit = (s - w.base[anchors, j]) >> w.shift
                    inside = counted & (s >= w.base[anchors, j]) & (s <= w.high[anchors, j]) & (digit < width)
                    at = (np.arange(len(anchors)) * width + digit)[inside]
                    counts[anchors * w.slots + j] += np.bincount(at, minlength=len(anchors) * width).reshape(-1, width).astype(np.int32)
        above = counts[:, ::-1].cumsum(axis=1, dtype=np.int64)[:, ::-1] - counts
        win, digit = np.nonzero((counts > 0) & (above < w.k))
        yield pa.RecordBatch.from_arrays([pa.array(win, pa.int64()), pa.array(digit, pa.int32()), pa.array(counts[win, digit], pa.int64())], ["win", "digit", "n"])

    return run


def _least(parts: list[np.ndarray], need: np.ndarray) -> np.ndarray:
    """Of rows (win, id) the ones with the `need[win]` least ids of each window."""
    found = np.concatenate(parts)
    found = found[np.lexsort((found[:, 1], found[:, 0]))]
    first = np.concatenate([[True], found[1:, 0] != found[:-1, 0]]) if len(found) else np.zeros(0, bool)
    start = np.flatnonzero(first)
    place = np.arange(len(found)) - np.repeat(start, np.diff(np.append(start, len(found))))
    return found[place < need[found[:, 0]]]


def _gathered(shared):
    """Rows to (win, id, score): all that are above their window's k-th score, and of those at it the ones that may be wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w: Windows = shared.value
        need = w.need.reshape(-1)
        above, at_it, held = [np.zeros((0, 3), np.int64)], [np.zeros((0, 2), np.int64)], 0
        for batch in batches:
            for anchors, ids, s, counted in w.scores(batch):
                for j in range(w.slots):
                    kth = w.base[anchors, j]
                    row, a = np.nonzero(counted & (s >= kth) & (s <= w.high[anchors, j]))
                    win, score = anchors[a] * w.slots + j, s[row, a]
                    more = score > kth[a]
                    above.append(np.stack([win[more], ids[row[more]], score[more]], 1))
                    at_it.append(_least([np.stack([win[~more], ids[row[~more]]], 1)], need))
                    held += len(at_it[-1])
            if held > 500_000:
                at_it = [_least(at_it, need)]
                held = 0
        ties = _least(at_it, need)
        found = np.concatenate([*above, np.stack([*ties.T, w.base.reshape(-1)[ties[:, 0]]], 1)])
        yield pa.RecordBatch.from_arrays([pa.array(found[:, i], pa.int64()) for i in range(3)], ["win", "id", "score"])

    return run


def _select(rows: DataFrame, w: Windows) -> DataFrame:
    """(win, rank, id, score): the k best rows of each window, all where it has fewer; higher scores first, ties by smaller ids."""
    context = rows.sparkSession.sparkContext
    down = Window.partitionBy("win").orderBy(F.desc("digit")).rowsBetween(Window.unboundedPreceding, -1)
    while True:
        found: set[int] = set()
        counts = in_arrow(rows, _counted(context.broadcast(w)), "win long, digit int, n long").groupBy("win", "digit").agg(F.sum("n").alias("n"))
        highest = counts.withColumn("above", F.coalesce(F.sum("n").over(down), F.lit(0))).where(F.col("above") < w.k).collect()  # k digits of a window at most
        for r in sorted(highest, key=lambda r: (r["win"], -r["digit"])):
            win, above, n = r["win"], r["above"], r["n"]
            if win not in found and above + n >= w.need.flat[win]:
                found.add(win)
                w.base.flat[win] += r["digit"] << w.shift
                w.need.flat[win] -= above
        if w.shift == 0:
            break
        w.shift -= DIGIT
    best = in_arrow(rows, _gathered(context.broadcast(w)), "win long, id long, score long")
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("win").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= w.k)


def mine(rows: DataFrame, anchors: Column | str, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: float = 256, wave: int = WAVE) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    rows: (vec_id, label, embedding); anchors: a condition on `id`. A score is the integer inner product of two vectors of integer_vectors(), which says what rows take part. The positives of an anchor are its `positives`
    best other rows of the same label, and the negatives of a positive with score p the `negatives` best rows of another label with p * low <= 100 * score <= p * high. Higher scores come first, ties by
    smaller ids. Vectors of different lengths have no score and never meet; those without components score 0. Anchors without positives, and positives without negatives, give no row; neither does an empty table.
    """
    spark = rows.sparkSession
    clean, path = integer_vectors(rows, scale)
    asked = clean.where(anchors)
    n, widest = asked.agg(F.count("*"), F.max(F.length("v"))).first()
    longest = clean.agg(F.max("square")).first()[0]
    per = max(1, min(wave, WAVE_BYTES // max(1, 2 * (widest or 0))))
    waves, out = -(-4 * n // (3 * per)), new_path(spark, "negatives")
    for turn in range(waves):
        got = asked.where(F.pmod(F.xxhash64("id"), F.lit(waves)) == turn).collect()
        if not got:
            continue
        got.sort(key=lambda r: r["id"])
        exact = longest < _EXACT
        kind = np.float64 if exact else np.int64
        groups = []
        for length in sorted({len(r["v"]) // 4 for r in got}):
            at = [i for i, r in enumerate(got) if len(r["v"]) == 4 * length]
            groups.append((length, np.array(at), np.frombuffer(b"".join(bytes(got[i]["v"]) for i in at), "<i4").reshape(len(at), length).astype(kind)))
        ids, labels = (np.array([r[c] for r in got], np.int64) for c in ("id", "label"))
        # no score is further from 0, as |a.b| <= |a||b|
        reach = np.array([[int(np.sqrt(longest * r["square"])) + 1] for r in got], np.int64)
        first = _select(clean, Windows(ids, labels, groups, exact, True, positives, -reach, reach)).collect()  # `positives` rows of an anchor at most
        score, other = np.zeros((len(got), positives), np.int64), np.full((len(got), positives), -1, np.int64)
        bottom, top = np.ones_like(score), np.zeros_like(score)  # an empty window, where there is no such positive
        for r in first:
            at = r["win"], r["rank"] - 1
            score[at], other[at] = r["score"], r["id"]
            bottom[at], top[at] = -(-r["score"] * low // 100), r["score"] * high // 100
        best = _select(clean, Windows(ids, labels, groups, exact, False, negatives, bottom, top))
        names = spark.createDataFrame([(int(i * positives + j), int(ids[i]), int(other[i, j]), int(score[i, j])) for i, j in zip(*np.nonzero(bottom <= top), strict=True)], "win long, anchor_id long, positive_id long, positive_score long")
        best.join(F.broadcast(names), "win").selectExpr("anchor_id", "positive_id", "cast(rank as int) as rank", "id as negative_id", "positive_score", "score as negative_score").write.mode("append").parquet(out)
    drop_table(spark, path)
    return spark.read.schema(_RESULT).parquet(out) if _exists(rows, out) else spark.createDataFrame([], _RESULT)


def _exists(rows: DataFrame, path: str) -> bool:
    spark = rows.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
