"""What an evaluation set shares with its training set, and baselines that need no reasoning.

Examples: (id, split, attribute, entities array<string>, premises array<struct<s,rel,o>>, query struct<x,y>, answer_rel, text).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslab.session import in_arrow, spread
from corpuslab.tables import drop_table, written


def relation(answer_rel: Column) -> Column:
    return F.get(F.split(answer_rel, " "), F.lit(1))


def structure(premises: Column, query: Column, attribute: Column) -> Column:
    """Premises, query and attribute with the entities numbered by their first appearance, as a text to compare by."""
    order = F.array_distinct(F.concat(F.flatten(F.transform(premises, lambda p: F.array(p["s"], p["o"]))), F.array(query["x"], query["y"])))

    def number(e: Column) -> Column:
        return (F.array_position(order, e) - 1).cast("string")

    body = F.array_join(F.transform(premises, lambda p: F.concat(number(p["s"]), p["rel"], number(p["o"]))), ",")
    return F.concat_ws("|", body, number(query["x"]), number(query["y"]), attribute)


def majority_by(df: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """The most frequent value of each key; of several the one that came first."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("c"), F.min(order).alias("first"))
    best = F.max_by(F.col(value), F.struct(F.col("c"), -F.col("first")))
    return counts.groupBy(*keys).agg(best.alias("majority"))


def name_overlap(train: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """keys with name_overlap: distinct names of other's rows (name) that train has."""
    return other.select(*keys, "name").distinct().join(train.select("name").distinct(), "name").groupBy(*keys).agg(F.count("*").alias("name_overlap"))


def report(train: DataFrame, others: DataFrame) -> DataFrame:
    """A row for each split of others: n, name_overlap, exact_text_dup, structure_seen, structure_lookup_acc, majority_acc (shares to four places).

    train, others: (ord, split, name array<string>, text, structure, relation).
    """
    known = majority_by(train, ["structure"], "relation", "ord").withColumnRenamed("majority", "looked_up")
    overall = majority_by(train.withColumn("one", F.lit(1)), ["one"], "relation", "ord").select(F.col("majority").alias("overall"))
    texts = train.select(F.col("text").alias("_t")).distinct()
    met = others.join(known, "structure", "left").join(F.broadcast(overall)).join(texts, F.col("text") == F.col("_t"), "left")  # overall: one row
    right = F.coalesce("looked_up", "overall") == F.col("relation")
    out = met.groupBy("split").agg(
        F.count("*").alias("n"),
        F.count("_t").alias("exact_text_dup"),
        F.round(F.avg(F.col("looked_up").isNotNull().cast("int")), 4).alias("structure_seen"),
        F.round(F.avg(right.cast("int")), 4).alias("structure_lookup_acc"),
        F.round(F.avg((F.col("relation") == F.col("overall")).cast("int")), 4).alias("majority_acc"),
    )
    shared = name_overlap(train.select(F.explode("name").alias("name")), others.select("split", F.explode("name").alias("name")), ["split"])
    return out.join(shared, "split", "left").withColumn("name_overlap", F.coalesce("name_overlap", F.lit(0)))


#: Lengths of the runs of characters by which items are looked up, and bits of the map that says which runs items begin with: 2 MB, however many items there are.
RUNS, MAP_BITS = (1, 2, 4, 8, 16, 32, 64), 1 << 24
_ODD, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(32))


def _run_hashes(text: str, longest: int) -> Iterator[tuple[int, np.ndarray]]:
    """(length, hash of the run that begins at each character) for the lengths of RUNS up to `longest`, each from the one of half the length."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    hashes, n = _mixed(codes + _ODD), 1
    while n <= longest and len(hashes):
        yield n, hashes
        hashes = _mixed(hashes[:-n] * _ODD + hashes[n:] + np.uint64(n)) if n < len(hashes) else hashes[:0]
        n *= 2


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Items (item_id, item) to the hash of the longest run that they begin with, and its length."""
    for batch in batches:
        keys = [list(_run_hashes(text[: RUNS[-1]], RUNS[-1]))[-1] for text in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([n for n, _ in keys], pa.int32()), pa.array([int(h[0].astype(np.int64)) for _, h in keys], pa.int64())], ["item_id", "item", "run", "h"])


def _hits(shared, lengths: frozenset[int]):
    """Documents (doc_id, text) to the distinct hashes of their runs that the map has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            found = []
            for text in batch.column(1).to_pylist():
                mine = []
                for n, hashes in _run_hashes(text, max(lengths)):
                    if n in lengths:
                        at = hashes & np.uint64(MAP_BITS - 1)
                        mine.append(np.unique(hashes[(bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1]))
                found.append(np.concatenate([np.empty(0, np.uint64), *mine]).astype(np.int64))
            sizes = np.array([0, *map(len, found)])
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum(sizes).astype(np.int32)), pa.array(np.concatenate([np.empty(0, np.int64), *found])))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["doc_id", "hs"])

    return run


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(item_id, doc_id): the documents (doc_id, text) in which the text of an item (item_id, text) stands, character for character, wherever it begins and ends.

    An item is looked up by the longest run of 1, 2, 4 ... 64 characters that it begins with. One pass over documents rolls the hashes of all their runs, and those that a broadcast map of fixed size lets through are dealt
    out; texts meet the pairs that share one, and the whole item is compared. With more than some million items the map lets more through, and nothing else changes. Null and empty items stand nowhere; other columns are not read.
    """
    spark = docs.sparkSession
    texts = items.select("item_id", F.col("text").alias("item")).where("item <> ''")
    keyed, path = written(in_arrow(texts, _keyed, f"item_id {dict(texts.dtypes)['item_id']}, item string, run int, h long"), "items")
    rows = spread(docs.select("doc_id", "text")).where("doc_id is not null and text is not null")
    lengths = frozenset(r["run"] for r in keyed.select("run").distinct().collect())
    if not lengths:
        drop_table(spark, path)
        return spark.createDataFrame([], f"item_id {dict(texts.dtypes)['item_id']}, doc_id {dict(rows.dtypes)['doc_id']}")
    place = F.col("h").bitwiseAND(MAP_BITS - 1)
    words = keyed.select(F.shiftright(place, 3).alias("at"), F.pow(F.lit(2), F.pmod(place, F.lit(8))).cast("int").alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bits")).collect()  # MAP_BITS / 8 rows at most
    bits = np.zeros(MAP_BITS // 8, np.uint8)
    for r in words:
        bits[r["at"]] = r["bits"]
    kind = dict(rows.dtypes)["doc_id"]
    found = in_arrow(rows, _hits(spark.sparkContext.broadcast(bits), lengths), f"doc_id {kind}, hs array<long>").select("doc_id", F.explode("hs").alias("h"))
    pairs = found.join(keyed.select("item_id", "h"), "h").select("item_id", "doc_id").distinct()
    return pairs.join(rows, "doc_id").join(keyed.select("item_id", "item"), "item_id").where(F.contains("text", F.col("item"))).select("item_id", "doc_id").distinct()


def relation_metrics(rows: DataFrame, group: list[str] | None = None) -> DataFrame:
    """Of rows (gold, pred): accuracy, recall of each relation (null without gold), and macro F1 over the relations that gold has; to six places."""
    keys, cells = list(group or []), []
    for name, rel in (("lt", "<"), ("eq", "="), ("gt", ">")):
        g, p = F.col("gold") == rel, F.coalesce(F.col("pred") == rel, F.lit(False))
        cells += [F.count_if(g & p).alias(f"tp_{name}"), F.count_if(g).alias(f"n_{name}"), F.count_if(p).alias(f"p_{name}")]
    counts = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(F.coalesce(F.col("gold") == F.col("pred"), F.lit(False))).alias("hits"), *cells)
    recall, f1s, some = {}, F.lit(0.0), F.lit(0)
    for name in ("lt", "eq", "gt"):
        tp, gold, pred = (F.col(f"{c}_{name}") for c in ("tp", "n", "p"))
        recall[name] = F.when(gold > 0, F.round(tp / gold, 6))
        f1s = f1s + F.when(tp > 0, 2.0 * tp / (gold + pred)).otherwise(0.0)
        some = some + (gold > 0).cast("int")
    return counts.select(*keys, F.round(F.col("hits") / F.greatest("n", F.lit(1)), 6).alias("accuracy"), *(recall[n].alias(f"recall_{n}") for n in recall), F.round(f1s / F.greatest(some, F.lit(1)), 6).alias("macro_f1"), *(F.col(f"n_{n}") for n in recall))


def relation_shares(rows: DataFrame) -> DataFrame:
    """(relation, n, share) of rows (relation): their distribution, shares to six places, in the order of relations."""
    counts = rows.groupBy("relation").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("t"))
    return counts.join(F.broadcast(total)).select("relation", "n", F.round(F.col("n") / F.col("t"), 6).alias("share")).orderBy("relation")  # one row


def chance_baseline(rows: DataFrame) -> DataFrame:
    """One row: the most frequent relation (of several the first in order) and its share of rows (relation) to six places."""
    counts = rows.groupBy("relation").agg(F.count("*").alias("c"))
    total = counts.agg(F.sum("c").alias("t"))
    shares = counts.join(F.broadcast(total)).withColumn("share", F.round(F.col("c") / F.col("t"), 6))  # one row
    return shares.orderBy(F.desc("share"), "relation").limit(1).select(F.col("relation").alias("majority_relation"), F.col("share").alias("majority_accuracy"))
