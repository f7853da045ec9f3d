"""The corpus pipeline: toxic documents go, near-duplicates go, repeated passages go, sources are mixed, texts become tokens."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from corpuslab.llm import bpe, minhash, mixing, substring, toxicity
from corpuslab.llm.queries import domains
from corpuslab.session import spread
from corpuslab.tables import drop_table, scratch, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the multiple-instance model, trained on the labels that are not held out, scores at 0.7 or more go."""
    return toxicity.drop_toxic(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a similarity of 0.8 or more stays: the one with the smallest doc_id."""
    return minhash.drop_near_duplicates(docs, shingle=5, percent=80)


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of 50 words that also stand in a document with a smaller doc_id are cut out of the text."""
    return substring.remove_repeats(docs, window=50)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeat so that the expected tokens of language and quality domains meet tempered targets; each stays at least once."""
    model = mixing.fit_classifier(docs, domains(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return mixing.mix(docs, model, keep_all=True)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, ids, n_tokens: the texts in the ids of the word BPE."""
    rows = bpe.encode(docs.select("doc_id", "lang", "source", "text"), public_tokenizers.path("word_bpe_49k.json"))
    return rows.selectExpr("doc_id", "lang", "source", "ids", "cast(size(ids) as bigint) as n_tokens")


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash near-dedup", drop_near_duplicates),
    ("substring dedup", remove_repeats),
    ("mixing to target weights", mix_sources),
    ("bpe encoding", encode_tokens),
]

#: Training and near-duplicate links are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another on documents; what a stage has made on its way goes when it is written, and its table when the next one is."""
    docs, before = spread(spark.read.parquet(f"{sf_dir}/documents.parquet")), None
    for name, stage in STAGES:
        with scratch(spark) as made:
            docs, path = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
            made.discard(path)
        if before:
            drop_table(spark, before)
        before = path
    return docs
