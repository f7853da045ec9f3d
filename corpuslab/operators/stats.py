"""Counts of corpora by source, kind and split, and the reports made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslab.functions import text as T
from corpuslab.profiles import ScriptProfile
from corpuslab.session import spread

#: Parts of the names of sources that were gathered by hand.
MANUAL_NAMES = (
    "crawler", "kavitakosh", "gadyakosh", "amarujala", "bbc", "nenow", "pratidin", "agradoot", "xahitya", "wiki", "wikipedia", "ncert", "scert", "seba", "dump",
    "niyomiya", "cc100", "jansatta", "prabhatkhabar", "news18", "ndtv", "webdunia", "vikaspedia", "sangraha_manual", "literature",
)
#: Kinds of the sources that a report knows by name.
SOURCE_KINDS = {
    "hindi": {
        "manual": ("crawler_amarujala", "crawler_bbc_hi", "crawler_gadyakosh", "crawler_kavitakosh", "crawler_vikaspedia_hi", "ncert_pdfs"),
        "downloaded": ("crawler_cc100_hi", "oscar_hindi", "sangraha_verified", "sangraha_unverified", "wikipedia_hindi"),
        "excluded": ("generated_samples",),
    },
    "assamese": {
        "manual": ("crawler_agradoot", "crawler_asomiya_pratidin", "crawler_nenow_asm", "crawler_niyomiya_barta", "crawler_vikaspedia_as", "crawler_xahitya_literary", "ncert_assamese_pdfs", "scert_pdfs", "seba_pdfs"),
        "downloaded": ("asm_corpus", "crawler_cc100_as", "indiccorp_v2", "news_portals", "sangraha_verified", "sangraha_unverified", "wikipedia_assamese", "wikipedia_dump_manual"),
        "excluded": ("generated_samples",),
    },
}
BENGALI_RA, ASSAMESE_RA = "র", "ৰ"


def is_manual(source: Column, any_manual: Column) -> Column:
    return any_manual | F.lower(source).rlike("|".join(MANUAL_NAMES))


def source_stats(docs: DataFrame, per_word: float = 1.2) -> DataFrame:
    """(source, type, doc_count, token_estimate) of docs (source, text, source_type)."""
    rows = docs.select("source", T.tokens_estimate(F.col("text"), per_word).cast("long").alias("t"), F.coalesce(F.col("source_type") == "manual", F.lit(False)).alias("m"))
    by = rows.groupBy("source").agg(F.count("*").alias("doc_count"), F.sum("t").alias("token_estimate"), F.bool_or("m").alias("m"))
    return by.select("source", F.when(is_manual(F.col("source"), F.col("m")), "manual").otherwise("downloaded").alias("type"), "doc_count", "token_estimate")


def totals(by_source: DataFrame) -> DataFrame:
    """One row: total, manual and downloaded tokens, and the manual share to six places (0 for an empty corpus)."""
    one = by_source.agg(*(F.coalesce(F.sum(F.when(test, F.col("token_estimate"))), F.lit(0)).alias(n) for n, test in (("total_tokens", F.lit(True)), ("manual_tokens", F.col("type") == "manual"), ("downloaded_tokens", F.col("type") != "manual"))))
    return one.withColumn("manual_fraction", F.when(F.col("total_tokens") == 0, 0.0).otherwise(F.round(F.col("manual_tokens") / F.col("total_tokens"), 6)))


def report(by_source: DataFrame) -> DataFrame:
    """A row with the Markdown report of source_stats()."""
    line = F.format_string("| %s | %s | %,d | %,d |", "source", "type", "doc_count", "token_estimate")
    rows = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("source", line.alias("line")))), lambda x: x["line"]), "\n")
    head = F.format_string("# Dataset statistics\n\n- Total tokens (estimate): **%,d**\n\n| source | type | docs | tokens |\n|---|---|---|---|\n", F.sum("token_estimate"))
    return by_source.agg(F.concat(head, rows).alias("report"))


def report_json(by_source: DataFrame, removed_docs: int = 0, removed_chars: int = 0, failed: list[str] | None = None) -> DataFrame:
    """A row with the statistics of source_stats() as JSON: totals, the manual share, the sources in order, and what cleaning removed."""
    one = totals(by_source)
    listed = by_source.agg(F.sort_array(F.collect_list(F.struct(F.col("source").alias("name"), "type", "doc_count", "token_estimate"))).alias("sources"))  # a row for each source
    row = one.join(F.broadcast(listed)).select(
        F.col("total_tokens").alias("total_tokens_estimate"), "manual_tokens", "downloaded_tokens", "manual_fraction", "sources", F.lit(removed_docs).alias("dedup_removed_docs"),
        F.lit(removed_chars).alias("script_filter_removed_chars"), F.array(*map(F.lit, failed or [])).cast("array<string>").alias("failed_sources"),
    )
    return row.select(F.to_json(F.struct(*row.columns)).alias("json"))


def crawl_stats(pages: DataFrame, per_word: float = 1.35) -> DataFrame:
    """(source, docs, tokens, bytes) of what a crawler has kept (source, text)."""
    tokens = T.tokens_estimate(F.col("text"), per_word, rounded=False).cast("long")
    return pages.groupBy("source").agg(F.count("*").alias("docs"), F.sum(tokens).alias("tokens"), F.sum(F.octet_length("text").cast("long")).alias("bytes"))


def bin_tokens(files: DataFrame, width: int = 2) -> DataFrame:
    """files (path, length) with tokens: bytes by the width of an id."""
    return files.withColumn("tokens", F.floor(F.col("length") / width).cast("long"))


def kind_table(spark: SparkSession, language: str) -> DataFrame:
    return spark.createDataFrame([(n, k) for k, names in SOURCE_KINDS[language].items() for n in names], "source string, kind string")


def with_kind(df: DataFrame, kinds: DataFrame) -> DataFrame:
    """df (source) with kind; sources that no one has named are unclassified."""
    return df.join(F.broadcast(kinds), "source", "left").withColumn("kind", F.coalesce("kind", F.lit("unclassified")))  # a few names


def purity(letters: Column, inside: Column) -> Column:
    """Share to four places, null without letters."""
    return F.round(F.sum(inside) / F.nullif(F.sum(letters), F.lit(0)), 4)


def source_scan(docs: DataFrame, profile: ScriptProfile) -> DataFrame:
    """A row for each source of docs (source, text, split, and tokens if there are any): documents, words, characters, bytes, tokens, documents and
    tokens by split, the share of the Bengali ra, the script's purity in val, and tokens for each word."""
    tokens = F.col("tokens").cast("long") if "tokens" in docs.columns else T.tokens_estimate(F.col("text")).cast("long")
    text, val = F.col("text"), F.col("split") == "val"
    rows = spread(docs).select("source", "split", text, tokens.alias("tokens"))
    by = rows.groupBy("source").agg(
        F.count("*").alias("docs"), F.sum(T.word_count(text)).alias("words"), F.sum(F.char_length(text)).alias("chars"), F.sum(F.octet_length(text)).alias("utf8_bytes"), F.sum("tokens").alias("tokens"),
        *(F.count_if(F.col("split") == s).alias(f"docs_{s}") for s in ("train", "val", "test")),
        *(F.coalesce(F.sum(F.when(F.col("split") == s, F.col("tokens"))), F.lit(0)).alias(f"tokens_{s}") for s in ("train", "val", "test")),
        F.sum(T.count_of(text, BENGALI_RA)).alias("bengali_ra"), F.sum(T.count_of(text, ASSAMESE_RA)).alias("assamese_ra"),
        purity(F.when(val, T.letters(text)), F.when(val, T.letters_in(text, profile))).alias("purity_val"),
    )
    ra = F.col("bengali_ra") + F.col("assamese_ra")
    return by.withColumn("bengali_ra_share", F.round(F.col("bengali_ra") / F.nullif(ra, F.lit(0)), 4)).withColumn("tokens_per_word", F.round(F.col("tokens") / F.nullif(F.col("words"), F.lit(0)), 4))


def kind_shares(scan: DataFrame, kinds: DataFrame) -> DataFrame:
    """(kind, docs, tokens, share) of source_scan(); share of all tokens to six places."""
    by = with_kind(scan.select("source", "docs", "tokens"), kinds).groupBy("kind").agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
    total = by.agg(F.sum("tokens").alias("_all"))
    return by.join(F.broadcast(total)).select("kind", "docs", "tokens", F.round(F.col("tokens") / F.nullif(F.col("_all"), F.lit(0)), 6).alias("share"))  # one row


def replay_check(stored: DataFrame, docs: DataFrame) -> DataFrame:
    """(split, stored_tokens, stored_docs, replayed_tokens, replayed_docs, equal). stored: (split, tokens, docs) read from files; docs: (split, tokens), to each of which an end was added."""
    again = docs.groupBy("split").agg(F.sum(F.col("tokens") + 1).alias("replayed_tokens"), F.count("*").alias("replayed_docs"))
    met = stored.withColumnsRenamed({"tokens": "stored_tokens", "docs": "stored_docs"}).join(again, "split", "full")
    return met.withColumn("equal", F.coalesce((F.col("stored_tokens") == F.col("replayed_tokens")) & (F.col("stored_docs") == F.col("replayed_docs")), F.lit(False)))


def registry(sources: DataFrame, done: DataFrame, failed: DataFrame) -> DataFrame:
    """sources (name, type, priority) in order of priority, with completed and failed."""
    met = sources.join(done.select(F.col("source").alias("_d")).distinct(), F.col("name") == F.col("_d"), "left").join(failed.select(F.col("source").alias("_f")).distinct(), F.col("name") == F.col("_f"), "left")
    return met.select("name", "type", "priority", F.col("_d").isNotNull().alias("completed"), F.col("_f").isNotNull().alias("failed")).orderBy("priority", "name")
