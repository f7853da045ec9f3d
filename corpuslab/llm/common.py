"""What the operators share: word hashes, connected components, and the tables of the shared folder, passed on from corpuslab.tables."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.tables import drop_table, free_names, new_path, partitions, written

__all__ = ["drop_table", "free_names", "new_path", "partitions", "written"]

#: White space between words; bytes.split() without arguments splits at the same six bytes.
WORD = r"[^\x20\x09-\x0D]+"
#: Distinct words that a Python worker remembers before it starts anew.
CACHE_WORDS = 200_000

# ---------------------------------------------------------------- hashes

M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * M2
    x = (x ^ (x >> np.uint64(27))) * M3
    return x ^ (x >> np.uint64(31))


def join_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The hash of two neighbouring sequences from theirs; the order counts."""
    return mix(a * M1 + b + np.uint64(0x632BE59BD9B4E019))


class WordHashes(dict):
    """Word (bytes) to 64-bit hash; forgets all when it is full, so its memory is bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def utf8(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def text_rows(batch: pa.RecordBatch, column: str = "text") -> Iterator[str | None]:
    for value in batch.column(batch.schema.get_field_index(column)):
        yield value.as_py()


# ---------------------------------------------------------------- components


class Forest:
    """Union-find whose roots are the smallest members."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        root = x
        while (y := up.setdefault(root, root)) != root:
            root = y
        while up[x] != root:
            up[x], x = root, up[x]
        return root

    def union(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True

    def edges(self) -> Iterable[tuple[int, int]]:
        return ((self.find(x), x) for x in list(self.up) if self.find(x) != x)


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One large-star or small-star step over edges (a < b)."""
    if large:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        both = edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    low = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
    met = both.join(low, "u")
    if large:
        out = met.where("v > u").select(F.col("low").alias("a"), F.col("v").alias("b"))
    else:
        out = met.select(F.col("low").alias("a"), F.col("v").alias("b")).union(low.select(F.col("low").alias("a"), F.col("u").alias("b")))
    return out.where("a < b").distinct()


def components(edges: DataFrame) -> tuple[DataFrame, str]:
    """(id, component): the smallest id reachable over edges (a, b), for every id with an edge.

    Large-star and small-star alternate (Kiveris et al. 2014), each round a written table; joins are on
    ids, so that a centre with many edges can be split by the adaptive skew join. Returns the table and its path.
    """
    spark = edges.sparkSession
    now, path = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "edges")
    before = None
    while True:
        stamp = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if tuple(stamp) == before or not stamp["n"]:
            break
        before = tuple(stamp)
        new, new_at = written(_star(_star(now, True), False), "edges")
        drop_table(spark, path)
        now, path = new, new_at
    out, at = written(now.select(F.col("b").alias("id"), F.col("a").alias("component")).union(now.select(F.col("a").alias("id"), F.col("a").alias("component")).distinct()), "components")
    drop_table(spark, path)
    return out, at
