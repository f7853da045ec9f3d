"""Removal of repeated passages by level-wise doubling.

A window is a run of words of one document. Windows of the least length come first, a quarter of the wanted one or so: of each stretch of starts that a
wanted window covers only the one with the least hash is looked up (two equal windows choose the same one), so that a
small share of all windows is dealt out. Those that stand in one document alone go; the others are extended to twice their length,
looked up again, and so on up to the wanted length or until none survives. A window is made of two of the level below, which overlap by a word where its length is odd, and survives only if both
did. Windows are told apart by 64 bits on the way, where a chance meeting costs work and nothing else, and by 128 bits of hashes of their words at the wanted length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.llm.common import CACHE_WORDS, WordHashes, drop_table, free_names, join_hash, mix, text_rows, utf8, written
from corpuslab.session import in_arrow

#: The shortest window that is looked up on its own.
LEAST = 13


def levels(window: int) -> list[int]:
    """The lengths looked up: the wanted one, and its halves (rounded up) while they are not too short."""
    out = [window]
    while (out[0] + 1) // 2 >= LEAST:
        out.insert(0, (out[0] + 1) // 2)
    return out


def window_hashes(w: np.ndarray, length: int) -> np.ndarray:
    """The hash of each run of `length` words, by doubling: from those of two halves, which overlap by a word where the length is odd."""
    if len(w) < length:
        return np.empty(0, np.uint64)
    if length == 1:
        return mix(w)
    half = window_hashes(w, (length + 1) // 2)
    n = len(w) - length + 1
    return join_hash(half[:n], half[length // 2 :][:n])


def least_starts(h: np.ndarray, width: int) -> np.ndarray:
    """For each run of `width` hashes its least."""
    out, size = h, 1
    while size * 2 <= width:
        out = np.minimum(out[: len(out) - size], out[size:])
        size *= 2
    return out if size == width else np.minimum(out[: len(h) - width + 1], out[width - size :][: len(h) - width + 1])


def _words(window: int):
    first = levels(window)[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            n, digests, found = [], [], []
            for text in text_rows(batch):
                words = utf8(text).split()
                n.append(len(words))
                digests.append(hashlib.sha256(b" ".join(words)).hexdigest())
                if len(words) < window:
                    found.append(np.empty(0, np.int64))
                else:
                    found.append(np.unique(least_starts(window_hashes(hashes.array(words), first), window - first + 1)).view(np.int64))
            offsets = np.cumsum([0, *map(len, found)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found) if found else np.empty(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array(n, pa.int64()), pa.array(digests, pa.string()), lists], ["doc_id", "key", "n_words", "whole_sha256", "anchors"])

    return run


class SecondHashes(WordHashes):
    """The words' hashes by another function, so that words and windows that share one hash do not share both."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word, 7)
        return value


def _list_at(batch: pa.RecordBatch, name: str):
    column = batch.column(batch.schema.get_field_index(name))
    flat, offsets = column.values.to_numpy().view(np.uint64), column.offsets.to_numpy()
    return [flat[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def _extended(window: int, length: int, below: int):
    """Documents with the hashes of their surviving windows one level below, to those of the windows of this length that they allow; both hashes at the wanted length."""
    first, last = levels(window)[0], length == window

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, others = WordHashes(), SecondHashes()
        for batch in batches:
            found, second = [], []
            for text, alive in zip(text_rows(batch), _list_at(batch, "alive"), strict=True):
                words = utf8(text).split()
                w = hashes.array(words)
                small = window_hashes(w, below)
                n = max(0, len(w) - length + 1)
                if below == first:
                    ok = np.isin(least_starts(small, window - first + 1), alive)
                    if not last:  # a longer window is wanted: each start that one of its allowed windows covers
                        ok = np.convolve(ok, np.ones(window - length + 1, int))[:n] > 0
                else:
                    alive_at = np.isin(small, alive)
                    ok = alive_at[:n] & alive_at[length - below : length - below + n]
                h = window_hashes(w, length)[ok]
                if last:
                    h, at = np.unique(h, return_index=True)
                    second.append(window_hashes(others.array(words), length)[ok][at] if len(h) else h)
                else:
                    h = np.unique(h)
                found.append(h)
            columns = [found, second] if last else [found]
            flat = [np.concatenate(x).view(np.int64) if x else np.empty(0, np.int64) for x in columns]
            ids = np.repeat(batch.column("doc_id").to_numpy(), [len(x) for x in found])
            yield pa.RecordBatch.from_arrays([*map(pa.array, flat), pa.array(ids)], ["h", "g", "doc_id"] if last else ["h", "doc_id"])

    return run


def _spans(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, others = WordHashes(), SecondHashes()
        for batch in batches:
            spans, removed, digests = [], [], []
            for text, gone, too in zip(text_rows(batch), _list_at(batch, "gone"), _list_at(batch, "gone_too"), strict=True):
                words = utf8(text).split()
                starts = np.isin(window_hashes(hashes.array(words), window), gone)
                if starts.any():
                    starts &= np.isin(window_hashes(others.array(words), window), too)
                cover = np.zeros(len(words) + 1, np.int64)
                cover[: len(starts)] += starts
                cover[window : window + len(starts)] -= starts[: len(words) + 1 - window]
                covered = np.cumsum(cover)[: len(words)] > 0
                edge = np.flatnonzero(np.diff(np.concatenate([[0], covered.astype(np.int8), [0]])))
                spans.append(edge.tolist())
                removed.append(int(covered.sum()))
                digests.append(hashlib.sha256(b" ".join([x for x, c in zip(words, covered.tolist(), strict=True) if not c])).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array(spans, pa.list_(pa.int64())), pa.array(removed, pa.int64()), pa.array(digests, pa.string())], ["doc_id", "key", "spans", "n_removed", "kept_sha256"])

    return run


EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()


def repeated_spans(docs: DataFrame, window: int = 50) -> tuple[DataFrame, DataFrame]:
    """What to remove from docs (doc_id, text): a row per input row with (doc_id, key, n_words, n_removed, kept_sha256, copy), and the
    word spans (doc_id, key, spans) of the rows that lose a part of their text; spans lists start, end, start, end, ...

    key is the SHA-1 of the text. copy marks rows whose whole text also stands at a smaller doc_id: such a row loses every word, or
    none if it is shorter than a window. Null texts have no words. Rows with the same doc_id do not take words from each other.
    Rows with a null doc_id neither lose words nor take any. An empty table gives no rows.
    """
    spark, steps = docs.sparkSession, levels(window)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    keyed = rows.withColumn("key", F.coalesce(F.unhex(F.sha1("text")), F.lit(b"")))
    base, base_at = written(in_arrow(keyed, _words(window), "doc_id long, key binary, n_words long, whole_sha256 string, anchors array<long>"), "words")
    first, first_at = written(base.where(F.col("doc_id").isNotNull() & (F.col("n_words") >= window)).groupBy("key").agg(F.min("doc_id").alias("first")), "first")
    # one document of each text is looked at; the others lose all or nothing
    own = base.join(first, "key").where("doc_id = first").dropDuplicates(["key", "doc_id"])
    alive, alive_at = _repeated(own.select(F.explode("anchors").alias("h"), "doc_id"))
    chosen = own.select("doc_id", "key").join(alive, "doc_id")
    held, held_at = written(keyed.join(chosen, ["doc_id", "key"]).select("doc_id", "key", "text", "alive"), "held")
    paths, texts = [alive_at], held.select("doc_id", "key", "text")
    # a window that is wanted at its first length is looked up once more, by both hashes
    for below, length in zip(steps, steps[1:]) if len(steps) > 1 else [(window, window)]:
        last = length == window
        at, at_path = written(in_arrow(held, _extended(window, length, below), "h long, g long, doc_id long" if last else "h long, doc_id long"), "windows")
        alive, path = _started(at) if last else _repeated(at)
        drop_table(spark, at_path, *paths)
        paths, held = [path], texts.join(alive, "doc_id")
    cut, _ = written(in_arrow(texts.join(alive, "doc_id"), _spans(window), "doc_id long, key binary, spans array<long>, n_removed long, kept_sha256 string").where("n_removed > 0").dropDuplicates(["doc_id", "key"]), "spans")
    drop_table(spark, held_at, *paths)
    parts = cut.select("doc_id", "key", F.col("n_removed").alias("part"), F.col("kept_sha256").alias("part_sha256"))
    out = base.drop("anchors").join(first, "key", "left").join(parts, ["doc_id", "key"], "left")
    copy = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    out = out.select("doc_id", "key", "n_words", F.when(copy, F.col("n_words")).otherwise(F.coalesce("part", F.lit(0))).cast("long").alias("n_removed"), F.when(copy, F.lit(EMPTY_SHA256)).otherwise(F.coalesce("part_sha256", "whole_sha256")).alias("kept_sha256"), copy.alias("copy"))
    result, _ = written(out, "removed")
    drop_table(spark, base_at, first_at)
    return result, cut.select("doc_id", "key", "spans")


def _repeated(windows: DataFrame) -> tuple[DataFrame, str]:
    """Per doc_id the hashes that stand in another document too."""
    low = windows.groupBy("h").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("h")
    return written(windows.join(low, "h").groupBy("doc_id").agg(F.collect_set("h").alias("alive")), "alive")


def _started(windows: DataFrame) -> tuple[DataFrame, str]:
    """Per doc_id the pairs of hashes that start in a document with a smaller id too, as two lists."""
    low = windows.groupBy("h", "g").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("h", "g", "low")
    met = windows.join(low, ["h", "g"]).where("doc_id > low")
    return written(met.groupBy("doc_id").agg(F.collect_list("h").alias("gone"), F.collect_list("g").alias("gone_too")), "gone")


def _cut(names: list[str], text_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, spans in zip(batch.column(text_at).to_pylist(), batch.column(len(names)).to_pylist(), strict=True):
                if spans:
                    words, kept, at = utf8(text).split(), [], 0
                    for a, b in zip(spans[::2], spans[1::2], strict=True):
                        kept += words[at:a]
                        at = b
                    text = b" ".join(kept + words[at:]).decode("utf-8", "surrogatepass")
                texts.append(text)
            columns = [batch.column(i) for i in range(len(names))]
            columns[text_at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def remove_repeats(docs: DataFrame, window: int = 50) -> DataFrame:
    """docs with the repeated words taken out of text (the words left are joined by one space); rows that lose none keep
    their text as it is, rows that lose all keep an empty one. n_chars, where there is such a column, is counted anew.
    Null and empty texts and rows with a null doc_id stay as they are; rows that repeat a doc_id are judged each by its own text; an empty table gives none."""
    names = docs.columns
    of_id, of_key, of_spans = free_names(names, "_id", "_key", "_spans")
    result, cut = repeated_spans(docs, window)
    gone = result.where("copy and n_removed > 0").select("doc_id", "key", F.array(F.lit(0).cast("long"), F.col("n_words")).alias("spans"))
    spans = cut.union(gone).groupBy("doc_id", "key").agg(F.first("spans").alias(of_spans)).select(F.col("doc_id").alias(of_id), F.col("key").alias(of_key), of_spans)
    met = docs.join(spans, (docs["doc_id"].cast("long") == F.col(of_id)) & (F.unhex(F.sha1(docs["text"].cast("string"))) == F.col(of_key)), "left").select(*(docs[c] for c in names), of_spans)
    out = in_arrow(met, _cut(names, names.index("text")), docs.schema)
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out
