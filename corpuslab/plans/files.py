"""Queries of files that are written and read back, and of what is made from them, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslab.functions import text as T
from corpuslab.operators import reasoning, select, stats, tokens
from corpuslab.plans.queries import _CHAIN, _names, _orders, NW, WT, query, t
from corpuslab.plans.round_trips import kept
from corpuslab.profiles import LATIN
from corpuslab.sources import formats, registry, scan, sinks
from corpuslab.tables import drop_table, new_path


def _records(rows: DataFrame, folder: str, name: str) -> None:
    """JSON lines in one file of a given name, written by one task; only for a part of a table whose file's name is what matters."""
    at = f"{folder}-{name}"
    formats.write_parts(rows.coalesce(1).select(F.concat(F.to_json(F.struct(*rows.columns)), F.lit("\n")).cast("binary").alias("data")), at, ".jsonl")
    system, top = formats.system_of(folder)
    system.create_dir(top)
    for part, _ in formats.listed(f"{at}/part-*"):
        system.move(part, f"{top}/{name}.jsonl")
    drop_table(rows.sparkSession, at)


@query("""WITH l AS (SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS x FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, trim(text, E' \\n') FROM documents WHERE doc_id % 3 <> 0)
SELECT sha256(x) AS sha, count(*) AS n FROM l WHERE x <> '' GROUP BY 1""")
def mixed_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of documents as lines, a third as JSON lines and a third as CSV, read as one corpus with a prefix."""
    at, d = new_path(spark, "mixed"), t(spark, sf_dir, "documents")
    part = lambda k: d.where(F.col("doc_id") % 3 == k)
    part(0).select("text").write.text(f"{at}/txt")
    part(1).select("text").write.json(f"{at}/jsonl")
    part(2).select("text").write.option("header", True).option("escape", '"').option("quoteAll", True).csv(f"{at}/csv")
    rows = scan.mixed(spark, f"{at}/txt/*.txt", f"{at}/jsonl/*.json", f"{at}/csv/*.csv", prefix="m/")
    return kept(rows.where(F.col("doc_id").startswith("m/")).groupBy(F.sha2("text", 256).alias("sha")).agg(F.count_distinct("doc_id").alias("n")), at)


@query("""SELECT lang, count(*) AS docs FROM (SELECT lang, unnest(string_split(text, chr(10))) AS l FROM documents WHERE lang IN (SELECT lang FROM documents GROUP BY 1 ORDER BY 1 LIMIT 2 OFFSET 1)) WHERE trim(l) <> '' GROUP BY 1""")
def file_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the second and third of the files in their order, a file for each language, of those that are not too large."""
    at = new_path(spark, "files")
    t(spark, sf_dir, "documents").select("lang", "text").repartition("lang").write.partitionBy("lang").text(at)
    files = scan.shards(scan.small_files(spark, f"{at}/lang=*/*.txt"), 1, 3)
    rows = spark.read.option("basePath", at).text(files).where(F.trim("value") != "")
    return kept(rows.groupBy("lang").agg(F.count("*").alias("docs")), at)


_LINKED = "replace(replace(html, 'href=\"/t', 'href=\"https://h.example/tag/t'), 'href=\"/', 'href=\"https://h.example/')"


@query(f"""WITH l AS (SELECT page_id, list_distinct(regexp_extract_all({_LINKED}, 'href=["''](https?://h\\.example/[^"''#?]+)', 1)) AS l FROM pages)
SELECT page_id, sha256(array_to_string(list_sort(list_filter(l, lambda x: NOT regexp_matches(x, '/category/|/page/|/tag/|/author/|/feed/|/wp-json/'))), chr(10))) AS sha FROM l""")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles that pages link to, their addresses on one site; those that begin with a t lie under /tag/."""
    html = F.replace(F.replace("html", F.lit('href="/t'), F.lit('href="https://h.example/tag/t')), F.lit('href="/'), F.lit('href="https://h.example/'))
    return t(spark, sf_dir, "pages").select("page_id", F.sha2(F.array_join(F.sort_array(scan.page_links(html, r"h\.example")), "\n"), 256).alias("sha"))


@query("SELECT doc_id, sha256(text) AS sha FROM documents WHERE doc_id % 3 = 2 AND trim(text, E' \\n') <> ''")
def clean_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of a folder whose manifest and statistics, a third of documents each, are no sources."""
    at, d = new_path(spark, "clean"), t(spark, sf_dir, "documents").select("doc_id", "source", "text")
    for k, name in enumerate(("manifest_1", "dataset_stats", "src")):
        _records(d.where(F.col("doc_id") % 3 == k), at, name)
    return kept(scan.clean_records(spark, at).select("doc_id", F.sha2("text", 256).alias("sha")), at)


@query("SELECT doc_id::VARCHAR AS doc_id, sha256(text) AS sha FROM documents WHERE source = 'src1' AND trim(text, E' \\n') <> ''")
def crawled_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a crawler has left for one of two sources."""
    at, d = new_path(spark, "crawled"), t(spark, sf_dir, "documents")
    for name in ("src1", "src2"):
        _records(d.where(F.col("source") == name).select(F.col("doc_id").cast("string").alias("doc_id"), F.lit("u").alias("url"), "text"), at, f"crawler_{name}")
    return kept(scan.crawled(spark, at, "src1").select("doc_id", F.sha2("text", 256).alias("sha")), at)


@query("""WITH s AS (SELECT source AS name, CASE WHEN min(lang) = 'de' THEN 'manual' ELSE 'downloaded' END AS type, min(doc_id)::BIGINT AS priority FROM documents GROUP BY source)
SELECT name, type, priority, priority % 3 = 0 AS completed, priority % 5 = 1 AS failed FROM s""")
def source_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registry of sources as JSON lines, read back."""
    at = new_path(spark, "sources")
    by = t(spark, sf_dir, "documents").groupBy("source").agg(F.min("lang").alias("lang"), F.min("doc_id").alias("priority")).collect()  # a few sources
    sources = [registry.Source(r["source"], "manual" if r["lang"] == "de" else "downloaded", int(r["priority"]), lambda s: s.range(0)) for r in by]
    table = registry.table(spark, sources)
    sinks.write_sources(stats.registry(table, table.where("priority % 3 = 0").select(F.col("name").alias("source")), table.where("priority % 5 = 1").select(F.col("name").alias("source"))), at)
    return kept(spark.read.json(at).select("name", "type", "priority", "completed", "failed"), at)


_EXAMPLES = f"WITH {_CHAIN}, g AS (SELECT id, string_agg('n' || i || r || 'n' || (i + 1), ',' ORDER BY i) AS premises FROM d GROUP BY id)"


def _examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = F.struct(*(F.lit("").alias(c) for c in ("s", "rel", "o", "attr")))
    text = F.concat(F.lit("t"), F.col("id").cast("string"))
    return _orders(spark, sf_dir).select(
        F.col("id").cast("string").alias("id"), F.lit("transitive").alias("paradigm"), F.lit("a").alias("attribute"), F.array(F.lit("n0"), F.lit("n3")).alias("entities"), "premises", "query",
        F.lit("n0 < n3").alias("answer_rel"), F.concat(F.lit("ans"), F.col("id").cast("string")).alias("answer_text"), F.lit(None).cast("string").alias("cot_text"), text.alias("text"), F.filter(F.array(row), lambda x: x["s"] != "").alias("distractors"),
    )


@query(f"{_EXAMPLES} SELECT CASE WHEN id % 4 = 0 THEN 'val' ELSE 'train' END AS split, id::VARCHAR AS id, premises, 'n0?n3' AS query, 't' || id AS text, (SELECT count(*) FROM g h WHERE (h.id % 4 = 0) = (g.id % 4 = 0)) AS n FROM g")
def example_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Examples written by split with their manifest, and read back."""
    at, e = new_path(spark, "examples"), _examples(spark, sf_dir)
    even = F.col("id").cast("long") % 4 == 0
    counts = sinks.write_examples({"train": e.where(~even), "val": e.where(even)}, {"train": ["n0"], "val": ["n1"]}, at)
    back = None
    for split in ("train", "val"):
        one = scan.examples(spark, f"{at}/split={split}").select(F.lit(split).alias("split"), "id", "premises", "query", "text")
        back = one if back is None else back.unionByName(one)
    said = F.array_join(F.transform("premises", lambda p: F.concat(p["s"], p["rel"], p["o"])), ",")
    return kept(back.join(counts, "split").select("split", "id", said.alias("premises"), F.concat_ws("?", "query.x", "query.y").alias("query"), "text", "n"), at)


@query(f"{_EXAMPLES} SELECT 'test' AS split, 't' || id AS text, 'ans' || id AS gold_answer, CASE WHEN id % 2 = 0 THEN 'p' || id END AS prediction, id % 2 = 1 AS stated FROM g")
def prediction_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions as JSON lines, in which nulls are written."""
    at, e = new_path(spark, "predictions"), _examples(spark, sf_dir)
    n = F.col("id").cast("long")
    none = F.lit(None).cast("string")
    rows = e.select(F.lit("test").alias("split"), "text", F.col("answer_text").alias("gold_answer"), none.alias("gold_cot"), none.alias("gold_rel"), F.when(n % 2 == 0, F.concat(F.lit("p"), "id")).alias("prediction"), none.alias("pred_rel"))
    sinks.write_predictions(rows, at)
    line = spark.read.text(at).select("value", F.from_json("value", "split string, text string, gold_answer string, prediction string").alias("r"))
    return kept(line.select("r.*", F.contains("value", F.lit('"prediction":null')).alias("stated")), at)


def _byte_vocabulary(spark: SparkSession) -> DataFrame:
    """Special tokens and bytes alone, so that every letter is as many ids as bytes."""
    rows = [("<pad>", 0), ("<unk>", 1), ("<s>", 2), ("</s>", 3), *((f"<0x{b:02X}>", b + 4) for b in range(256))]
    return spark.createDataFrame([(p, i, 0.0, 6 if i > 3 else 3) for p, i in rows], "piece string, id int, score double, type int")


#: Bytes of a text's words, each behind the three bytes of the word mark. Lines are stripped, and have spaces alone between words.
_BYTES = "list_sum(list_transform(list_filter(string_split(trim({0}), ' '), lambda x: x <> ''), lambda x: strlen(x) + 3))"


@query(f"{_EXAMPLES} SELECT sum(least(256, 3 + strlen('t' || id) + 3 + strlen('ans' || id)))::BIGINT AS tokens, count(*) AS rows FROM g")
def fine_tune_bin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Examples with their answers as ids, written as a token file without ends and counted."""
    at = new_path(spark, "sft")
    ids = tokens.sft_ids(_examples(spark, sf_dir), _byte_vocabulary(spark))
    index = sinks.write_tokens(ids, at, "id", end=None)
    return kept(scan.token_counts(spark, f"{at}/*.bin").agg(F.sum("tokens").alias("tokens")).crossJoin(index.agg(F.sum("docs").alias("rows"))), at)  # one row each


@query(f"SELECT sum({_BYTES.format('l')} + 1)::BIGINT AS tokens, count(*) AS docs FROM (SELECT unnest(string_split(text, chr(10))) AS l FROM documents) WHERE trim(l) <> ''")
def corpus_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain lines of a corpus as token files by split; a file of a split's name beside them is no source."""
    at, bins = new_path(spark, "corpus"), new_path(spark, "bins")
    formats.write_parts(t(spark, sf_dir, "documents").select(F.concat("text", F.lit("\n")).cast("binary").alias("data")), at, ".txt")
    formats.write_parts(spark.createDataFrame([(b"not a source\n",)], "data binary"), f"{at}-other", ".txt")
    system, top = formats.system_of(at)
    system.move(formats.listed(f"{at}-other/part-*")[0][0], f"{top}/train.txt")
    index = sinks.corpus_to_tokens(spark, at, _byte_vocabulary(spark), bins)
    return kept(index.agg(F.sum("tokens").alias("tokens"), F.sum("docs").alias("docs")), at, bins, f"{at}-other")


@query("SELECT name FROM (SELECT n_name AS name FROM nation UNION SELECT r_name FROM region UNION SELECT c_mktsegment FROM customer)")
def all_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of three pools, each once."""
    return reasoning.all_names(*(t(spark, sf_dir, name).select(F.col(c).alias("name")) for name, c in (("nation", "n_name"), ("region", "r_name"), ("customer", "c_mktsegment"))))


@query(f"SELECT doc_id, least(5, greatest(0, {NW} - 8))::BIGINT AS windows, true AS apart, true AS inside, true AS shifted FROM documents WHERE {NW} > 8")
def window_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five windows of eight ids at random places of each document, with what follows them."""
    docs = t(spark, sf_dir, "documents").select("doc_id", F.transform(T.words(F.col("text")), lambda w: F.char_length(w)).alias("ids"))
    w = tokens.random_windows(docs, 8, 5, 11).withColumn("shifted", (F.slice("x", 2, 7) == F.slice("y", 1, 7)) & (F.size("y") == 8))
    sizes = docs.select("doc_id", F.size("ids").alias("n"))
    return w.join(sizes, "doc_id").groupBy("doc_id").agg(F.count("*").alias("windows"), (F.count("*") == F.count_distinct("start")).alias("apart"), F.bool_and((F.col("start") >= 0) & (F.col("start") + 9 <= F.col("n"))).alias("inside"), F.bool_and("shifted").alias("shifted"))


@query(f"""WITH w AS (SELECT DISTINCT unnest({WT}) AS word FROM benchmark), r AS (SELECT word, row_number() OVER (ORDER BY word) - 1 AS id FROM w)
SELECT id::BIGINT AS id, word AS piece, -id / 2.0::DOUBLE AS score, 0::BIGINT AS unk_id, 2::BIGINT AS eos_id FROM r""")
def vocabulary_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the benchmark as a vocabulary in JSON, taken apart again."""
    words = tokens.word_ids(t(spark, sf_dir, "benchmark")).select(F.col("word").alias("piece"), "id", (-F.col("id") / 2.0).alias("score"), F.lit(1).alias("type"))
    r = tokens.vocabulary_json(words, 0, 2).select(F.from_json("json", "pieces array<array<string>>, unk_id long, eos_id long").alias("r"))
    return r.select(F.posexplode("r.pieces").alias("id", "p"), "r.unk_id", "r.eos_id").select(F.col("id").cast("long").alias("id"), F.col("p")[0].alias("piece"), F.col("p")[1].cast("double").alias("score"), "unk_id", "eos_id")


@query("SELECT source, sum(length(text) - length(replace(text, 'r', '')))::BIGINT AS bengali_ra, sum(length(text) - length(replace(text, 'e', '')))::BIGINT AS assamese_ra, round(sum(length(text) - length(replace(text, 'r', '')))::DOUBLE / nullif(sum(length(text) - length(replace(text, 'r', ''))) + sum(length(text) - length(replace(text, 'e', ''))), 0), 4) AS bengali_ra_share FROM documents GROUP BY 1")
def bengali_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each r as the Bengali letter, and each e as the Assamese one."""
    docs = t(spark, sf_dir, "documents").withColumn("text", F.translate("text", "re", "রৰ")).withColumn("split", select.split_of(F.col("doc_id")))
    return stats.source_scan(docs, LATIN).select("source", F.col("bengali_ra").cast("long").alias("bengali_ra"), F.col("assamese_ra").cast("long").alias("assamese_ra"), "bengali_ra_share")


@query("WITH k AS (SELECT 1 + count(*) // 60 AS k FROM labels) SELECT split, CASE split WHEN 'train' THEN 3 * k ELSE k END::BIGINT AS n, 0::BIGINT AS foreign_names, 0::BIGINT AS twice FROM k, (SELECT unnest(['train', 'val', 'test']) AS split)")
def generated_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A data set about frequent words of documents, each split with names of its own: sizes, names of other splits, texts that stand twice."""
    k, words = 1 + t(spark, sf_dir, "labels").count() // 60, _names(spark, sf_dir, 90)
    names = {s: words[i::3] for i, s in enumerate(("train", "val", "test"))}
    made = reasoning.dataset(spark, {"train": 3 * k, "val": k, "test": k}, names, 5)
    out = None
    for split, own in names.items():
        outside = F.size(F.array_except("entities", F.array(*map(F.lit, own)))).cast("long")
        one = made[split].agg(F.lit(split).alias("split"), F.count("*").alias("n"), F.coalesce(F.sum(outside), F.lit(0)).alias("foreign_names"), (F.count("*") - F.count_distinct("text")).alias("twice"))
        out = one if out is None else out.unionByName(one)
    return out
