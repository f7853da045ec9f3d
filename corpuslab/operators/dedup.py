"""Duplicates: exact ones, those of earlier runs, and near ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslab.functions.minhash import signature
from corpuslab.functions.scores import jaccard_estimate
from corpuslab.session import ship, spread
from corpuslab.tables import written


def first_of(df: DataFrame, key: Column, order: list[Column]) -> DataFrame:
    """The first row of each key in the given order. Aggregates before it shuffles: only one row of a key leaves a task."""
    names = df.columns
    least = df.groupBy(key.alias("_key")).agg(F.min_by(F.struct(*names), F.struct(*order)).alias("_row"))
    return least.select(*(F.col("_row")[n].alias(n) for n in names))


def exact_dedup(docs: DataFrame, text: str = "text", order: str = "doc_id") -> DataFrame:
    """Of equal texts the first row stays."""
    return first_of(docs, F.sha2(text, 256), [F.col(order)])


def not_seen(docs: DataFrame, seen: DataFrame, hash_column: str = "hash") -> DataFrame:
    """docs whose hash no earlier run has recorded; seen: (hash)."""
    return docs.join(seen.select(hash_column).distinct(), hash_column, "left_anti")


def near_pairs(docs: DataFrame, threshold: float = 0.6, hashes: int = 16, k: int = 8, bands: int = 4, most: int = 200, all_pairs_below: int = 100) -> DataFrame:
    """(id_a, id_b, similarity), id_a < id_b: documents (doc_id, text) whose signatures agree in a share of at least the threshold.

    Fewer than all_pairs_below documents are all compared. Otherwise those are that share a band of their signatures, in buckets of 2 to `most` documents;
    the limit is part of what is computed: fuller buckets give no pairs. Signatures are made once, in a written table; only ids and bands are dealt out by band, and a
    signature joins each pair last. Repeated doc_ids are documents of their own, and pairs of one id with itself are left out.
    """
    ship(docs.sparkSession)
    signed, _ = written(spread(docs).select("doc_id", signature(F.col("text"), hashes, k).alias("sig")), "signatures")
    if signed.limit(all_pairs_below).count() < all_pairs_below:
        keyed = signed.select("doc_id", F.lit("all").alias("band"))
    else:
        width = max(1, hashes // bands)
        keys = F.array(*(F.concat_ws(":", F.lit(str(i)), F.slice("sig", i * width + 1, width)) for i in range(bands)))
        every = signed.select("doc_id", F.explode(keys).alias("band"))
        fit = every.groupBy("band").agg(F.count("*").alias("n")).where(F.col("n").between(2, most)).select("band")
        keyed = every.join(fit, "band")
    a, b = (keyed.select("band", F.col("doc_id").alias(f"id_{x}")) for x in "ab")
    met = a.join(b, "band").where("id_a < id_b").select("id_a", "id_b").distinct()
    ends = [signed.select(F.col("doc_id").alias(f"id_{x}"), F.col("sig").alias(f"sig_{x}")) for x in "ab"]
    scored = met.join(ends[0], "id_a").join(ends[1], "id_b").withColumn("similarity", jaccard_estimate(F.col("sig_a"), F.col("sig_b")))
    return scored.where(F.col("similarity") >= threshold).select("id_a", "id_b", "similarity").distinct()


def drop_later(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Without the later document of each pair, even where the earlier one goes too."""
    return docs.join(pairs.select(F.col("id_b").alias("doc_id")).distinct(), "doc_id", "left_anti")
