"""Queries of readers, writers and texts that the tables have to be made into first, and the SQL that each is held against."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslab.functions import scores as S
from corpuslab.functions import text as T
from corpuslab.operators import evaluation, leakage, quality, reasoning, replay, stats, tokens, training
from corpuslab.plans.queries import _H, _R, BLOCK, CHANCE, NW, PAIRS, SPLIT, W, WT, _CHAIN, _bleu_sql, _chrf_sql, _ROUGE, _ROUGE_L, _orders, _pairs, query, r6, t
from corpuslab.profiles import HINDI, LATIN
from corpuslab.sources import formats, scan, sinks
from corpuslab.streaming.incremental import keep_new
from corpuslab.tables import drop_table, new_path, written

#: Small letters as letters of Devanagari, so that texts of the tables can stand for Hindi ones.
LATIN_LETTERS, HINDI_LETTERS = "abcdefghijklmnopqrstuvwxyz", "".join(chr(c) for c in range(0x091C, 0x091C + 26))
_HINDI = f"translate(regexp_replace(lower(text), '[^a-z\\s]', '', 'g'), '{LATIN_LETTERS}', '{HINDI_LETTERS}')"


def hindi(text: Column) -> Column:
    return F.translate(F.regexp_replace(F.lower(text), r"[^a-z\s]", ""), LATIN_LETTERS, HINDI_LETTERS)


def kept(df: DataFrame, *paths: str) -> DataFrame:
    """The rows as a table, after which the files that they were read from can go."""
    out, _ = written(df, "read")
    drop_table(df.sparkSession, *paths)
    return out


# ---------------------------------------------------------------- readers and writers

_LINES = "SELECT trim(l) AS line FROM (SELECT unnest(string_split(text, chr(10))) AS l FROM documents) WHERE trim(l) <> ''"


@query(f"SELECT sha256(line) AS sha, count(*) AS n FROM ({_LINES}) GROUP BY 1")
def line_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts written as lines and read as documents, each with a name of its own."""
    at = new_path(spark, "lines")
    t(spark, sf_dir, "documents").select("text").write.text(at)
    rows = scan.texts(spark, at)
    read = rows.groupBy(F.sha2("text", 256).alias("sha")).agg(F.count_distinct("doc_id").alias("n"))
    return kept(read, at)


@query("SELECT sha256(trim(text, E' \\n')) AS sha, count(*) AS n FROM documents GROUP BY 1")
def json_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of which every other one has its text under another name."""
    at = f"{new_path(spark, 'records')}.jsonl"
    odd = F.col("doc_id") % 2 == 1
    t(spark, sf_dir, "documents").select("doc_id", F.when(odd, F.lit(" ")).otherwise(F.col("text")).alias("text"), F.when(odd, F.col("text")).alias("sentence")).write.json(at)
    rows = scan.texts(spark, at)
    return kept(rows.groupBy(F.sha2("text", 256).alias("sha")).agg(F.count_distinct("doc_id").alias("n")), at)


@query("SELECT sha256(trim(text, E' \\n')) AS sha, count(*) AS n FROM documents GROUP BY 1")
def csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of quoted fields with line ends inside, read in ranges of a few kilobytes."""
    at = f"{new_path(spark, 'rows')}.csv"
    t(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("article")).write.option("header", True).option("escape", '"').option("quoteAll", True).csv(at)
    size = 1 << 18
    rows = scan.csv(spark, f"{at}/*.csv", size)
    return kept(rows.groupBy(F.sha2("text", 256).alias("sha")).agg(F.count_distinct("doc_id").alias("n")), at)


@query("SELECT sha256(trim(l)) AS sha, count(*) AS n FROM (SELECT unnest(string_split(text, chr(10))) AS l FROM documents) WHERE trim(l) <> '' AND contains(l, 'the') GROUP BY 1")
def corpus_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines by the data source of that name: one column of three is made, and a filter on it runs in the readers."""
    at = new_path(spark, "lines")
    t(spark, sf_dir, "documents").select("text").write.text(at)
    formats.register(spark)
    rows = spark.read.format("corpus").option("range_bytes", 1 << 20).schema("text string").load(f"{at}/*.txt").where(F.contains("text", F.lit("the")))
    lines = rows.select(F.trim("text").alias("text")).where("text <> ''")
    return kept(lines.groupBy(F.sha2("text", 256).alias("sha")).agg(F.count("*").alias("n")), at)


@query(f"""SELECT 'wiki/' || doc_id AS doc_id, sha256(x) AS sha FROM (SELECT doc_id, trim(regexp_replace({_HINDI}, '\\s+', ' ', 'g')) AS x FROM documents WHERE doc_id % 7 <> 3 AND doc_id % 11 <> 5) WHERE x <> ''""")
def wiki_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a dump of bz2 streams of some 20 records, one of 7 in another namespace and one of 11 moved, read back by more tasks than there are files."""
    import bz2

    x = F.concat(
        F.lit("  <page>\n    <title>t&amp;"), F.col("doc_id").cast("string"), F.lit("</title>\n    <ns>"), F.when(F.col("doc_id") % 7 == 3, "1").otherwise("0"), F.lit("</ns>\n    <id>"), F.col("doc_id").cast("string"), F.lit("</id>\n"),
        F.when(F.col("doc_id") % 11 == 5, '    <redirect title="other" />\n').otherwise(""), F.lit('    <revision>\n      <id>1</id>\n      <text bytes="1" xml:space="preserve">'), hindi(F.col("text")), F.lit("</text>\n    </revision>\n  </page>\n"),
    )

    def streams(batches):
        import pandas as pd

        yield pd.DataFrame({"data": [bz2.compress(b"<mediawiki>\n  <siteinfo/>\n")]})
        for batch in batches:
            texts = [v.encode() for v in batch["x"]]
            yield pd.DataFrame({"data": [bz2.compress(b"".join(texts[i : i + 20])) for i in range(0, len(texts), 20)]})
        yield pd.DataFrame({"data": [bz2.compress(b"</mediawiki>\n")]})

    at = new_path(spark, "dump")
    formats.write_parts(t(spark, sf_dir, "documents").select(x.alias("x")).mapInPandas(streams, "data binary"), at, ".xml.bz2")
    rows = scan.wiki_dump(spark, f"{at}/*.bz2", HINDI, range_bytes=1 << 16)
    return kept(rows.select("doc_id", F.sha2("text", 256).alias("sha")), at)


@query("SELECT count(*) AS docs, sum(length(d))::BIGINT AS chars FROM (SELECT trim(unnest(string_split(string_agg(text, chr(10) || chr(10) ORDER BY doc_id), chr(10) || chr(10))), E' \\n') AS d FROM documents) WHERE length(d) >= 120")
def blank_line_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with blank lines between them, read as documents that are numbered in a row."""
    at = new_path(spark, "blank")
    t(spark, sf_dir, "documents").select(F.concat("text", F.lit("\n"))).write.text(at)
    rows = scan.blank_line_documents(spark, at, "x")
    number = F.regexp_extract("doc_id", r"(\d+)$", 1).cast("long")
    return kept(rows.agg(F.count("*").alias("docs"), F.sum(F.char_length("text").cast("long")).alias("chars"), (F.max(number) + 1 - F.count_distinct(number)).alias("gaps")).where("gaps = 0").drop("gaps"), at)


@query(f"SELECT source, {SPLIT} AS split, count(*) AS docs, sum(length(text))::BIGINT AS chars, count(*) AS lines FROM documents WHERE trim(text, E' \\n') <> '' GROUP BY ALL")
def clean_and_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean records written by source, read back, written by split, and read back as records and as plain lines."""
    clean, parts = new_path(spark, "clean"), new_path(spark, "splits")
    docs = t(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "source", "text", F.lit("manual").alias("source_type"), F.sha2("text", 256).alias("hash"))
    sinks.write_clean(docs, clean)
    from corpuslab.operators.select import split_of

    back = spark.read.schema(docs.schema).json(f"{clean}/jsonl").where(T.strip(F.col("text")) != "")
    sinks.write_splits(back.withColumn("split", split_of(F.col("doc_id"))), parts)
    records = spark.read.json(f"{parts}/jsonl").groupBy("source", "split").agg(F.count("*").alias("docs"), F.sum(F.char_length("text").cast("long")).alias("chars"))
    plain = spark.read.text(f"{parts}/txt").groupBy("value", "split").agg(F.count("*").alias("c"))
    own = back.select("source", split_of(F.col("doc_id")).alias("split"), F.translate("text", "\n", " ").alias("value")).join(plain, ["value", "split"]).groupBy("source", "split").agg(F.count("*").alias("lines"))
    return kept(records.join(own, ["source", "split"]), clean, parts)


@query()
def replayed_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The split of each document as Python's random.Random(1337) draws it, one document after another; tests hold the draws against Python's."""
    return replay.replayed(t(spark, sf_dir, "documents").select("doc_id"), [F.col("doc_id")], 1337).withColumn("split", replay.split_by(F.col("chance")))


@query("SELECT source, count(*) AS docs, count(DISTINCT sha256(text)) AS hashes, true AS done FROM documents GROUP BY 1")
def manifest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifests of sources that are done, read back."""
    at = new_path(spark, "manifest")
    docs = t(spark, sf_dir, "documents").select("doc_id", "source", F.sha2("text", 256).alias("hash"))
    for row in docs.select("source").distinct().orderBy("source").collect():  # a few sources
        sinks.append_manifest(docs.where(F.col("source") == row["source"]), at, row["source"])
    rows = spark.read.parquet(at)
    return kept(rows.groupBy("source").agg(F.count_if(F.col("kind") == "doc").alias("docs"), F.count_distinct("hash").alias("hashes"), (F.count_if(F.col("kind") == "source_done") == 1).alias("done")), at)


@query("SELECT url FROM pages")
def sitemap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index that names one page of a hundred itself, and the others in maps of up to 500 pages."""
    number = F.when(F.col("page_id") % 100 == 1, -1).otherwise(F.floor(F.col("page_id") / 500)).cast("long")
    p = t(spark, sf_dir, "pages").select(number.alias("map"), F.concat(F.lit("<loc> "), "url", F.lit(" </loc>")).alias("loc"))
    of = lambda c: F.concat(F.lit("http://x/sitemap-"), c.cast("string"), F.lit(".xml"))
    own, below = (p.where(test).groupBy("map").agg(F.array_join(F.collect_list("loc"), "\n").alias("xml")) for test in ("map < 0", "map >= 0"))
    named = p.where("map >= 0").select(F.concat(F.lit("<loc>"), of(F.col("map")), F.lit("</loc>")).alias("loc")).distinct().agg(F.array_join(F.collect_list("loc"), "\n").alias("maps"))
    index = named.join(F.broadcast(own.select("xml")), F.lit(True), "left").select(F.lit("http://x/index").alias("url"), F.concat_ws("\n", "xml", "maps").alias("xml"))  # one row each
    return scan.sitemap_pages(index.union(below.select(of(F.col("map")), "xml")), "http://x/index", (1 << 31) - 1)


@query(f"""WITH d AS (SELECT doc_id, lang, text FROM documents WHERE length(text) >= 120 AND length(regexp_replace(text, '{BLOCK}', '', 'g'))::DOUBLE / length(regexp_replace(text, '\\s', '', 'g')) >= 0.65::DOUBLE),
u AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY doc_id // 3 ORDER BY doc_id) = 1) SELECT doc_id FROM u QUALIFY row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) = 1""")
def crawl_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three documents in a row share an address."""
    pages = t(spark, sf_dir, "documents").select("doc_id", "text", F.floor(F.col("doc_id") / 3).cast("string").alias("url"))
    return quality.crawl_gate(pages, LATIN, [F.col("doc_id")]).select("doc_id")


@query("SELECT source, count(*) AS docs, sum(greatest(1, floor(" + NW + " * 1.35::DOUBLE)))::BIGINT AS tokens, sum(strlen(text))::BIGINT AS bytes FROM documents GROUP BY 1")
def crawl_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.crawl_stats(t(spark, sf_dir, "documents"))


@query("""WITH a AS (SELECT sha256(text) AS h, min(doc_id) AS doc_id FROM documents WHERE doc_id % 2 = 1 GROUP BY 1) SELECT doc_id FROM a WHERE h NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 2 = 0)""")
def ingestion_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a micro-batch of the odd documents keeps after the even ones."""
    docs = t(spark, sf_dir, "documents").select("doc_id", "text")
    return keep_new(docs.where("doc_id % 2 = 1"), docs.where("doc_id % 2 = 0").select(F.sha2("text", 256).alias("hash"))).select("doc_id")


# ---------------------------------------------------------------- texts in other scripts


@query(f"""SELECT doc_id, sha256(translate(regexp_replace(lower(text), '[^a-z\\s]', '', 'g'), '{LATIN_LETTERS}', '{"".join({0x930: chr(0x9F0), 0x935: chr(0x9F1)}.get(ord(c), chr(ord(c) + 0x80)) for c in HINDI_LETTERS)}')) AS sha,
regexp_matches(lower(text), '[{"".join(a for a, h in zip(LATIN_LETTERS, HINDI_LETTERS, strict=True) if h in "रव")}]') AS own FROM documents""")
def other_script(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters of Devanagari as Assamese ones, and whether the text has one that Bengali lacks."""
    x = T.to_assamese(hindi(F.col("text")))
    return t(spark, sf_dir, "documents").select("doc_id", F.sha2(x, 256).alias("sha"), T.distinctive(x).alias("own"))


@query(f"""WITH w AS (SELECT doc_id, list_filter(string_split_regex({_HINDI}, '\\s+'), lambda x: length(x) >= 2) AS w FROM documents)
SELECT doc_id, sha256(array_to_string(list_transform(w, lambda x: x || 'ा'), ' ')) AS sha FROM w""")
def repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of Devanagari letters with a sign at their end that stands apart, twice over: repair brings it back, once."""
    words = F.filter(T.words(hindi(F.col("text"))), lambda x: F.char_length(x) >= 2)
    damaged = F.array_join(F.transform(words, lambda x, i: F.concat(x, F.when(i % 3 == 0, " ाा").when(i % 3 == 1, "​ ा").otherwise("ा"))), "  ")
    from corpuslab.session import ship

    ship(spark)
    return t(spark, sf_dir, "documents").select("doc_id", F.sha2(T.repair(damaged, HINDI), 256).alias("sha"))


# ---------------------------------------------------------------- answers and rationales


_SAID = "string_agg('n' || i || ' ' || r || ' n' || (i + 1), ' {} ' ORDER BY i)"


@query(f"""WITH {_CHAIN}, g AS (SELECT id, {_SAID.format('|')} AS steps, {_SAID.format('और')} AS hindi, {_SAID.format('আৰু')} AS assamese FROM d GROUP BY id),
x AS (SELECT *, CASE WHEN id % 10 = 9 THEN 'none' WHEN id % 4 = 0 THEN 'closed' WHEN id % 4 = 1 THEN 'open' WHEN id % 4 = 2 THEN 'plain' ELSE 'other' END AS kind FROM g)
SELECT id, CASE kind WHEN 'none' THEN NULL WHEN 'plain' THEN '' ELSE steps END AS steps, CASE WHEN kind NOT IN ('none', 'plain') AND id % 3 <> 0 THEN 'n0 < n3' END AS conclusion,
CASE WHEN kind = 'none' THEN NULL WHEN kind = 'other' THEN 'হয়। ' || id ELSE 'हाँ। ' || id END AS answer, CASE WHEN kind <> 'none' THEN kind <> 'open' END AS closed,
CASE kind WHEN 'none' THEN NULL WHEN 'closed' THEN hindi || CASE WHEN id % 3 <> 0 THEN ' इसलिए n0 < n3' ELSE '' END ELSE '' END AS rationale,
CASE WHEN kind IN ('closed', 'plain') THEN 'हाँ। ' || id WHEN kind = 'open' THEN 'हाँ। ' || id || ' [कारण: ' || hindi || CASE WHEN id % 3 <> 0 THEN ' इसलिए n0 < n3' ELSE '' END END AS scored FROM x""")
def rationale_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bracketed rationales taken apart: closed before an answer, open behind one, in Assamese with either spelling, with and without a conclusion; plain answers, and nulls."""
    said = F.transform("premises", lambda p: F.concat_ws(" ", p["s"], p["rel"], p["o"]))
    id_, part = F.col("id"), lambda n, k: F.col("id") % n == k
    so = lambda word: F.when(part(3, 0), "").otherwise(f" {word} n0 < n3")
    spelt = F.when(part(8, 3), so("সে\u09dfে")).otherwise(so("সে\u09af\u09bcে"))
    inner, other = F.concat(F.array_join(said, " और "), so("इसलिए")), F.concat(F.array_join(said, " আৰু "), spelt)
    hindi_answer, other_answer = F.concat(F.lit("हाँ। "), id_.cast("string")), F.concat(F.lit("হয়। "), id_.cast("string"))
    reason = F.when(part(8, 3), F.lit("[কাৰণ: ")).otherwise(F.lit("[কারণ:"))
    x = F.when(part(4, 0), F.concat(F.lit("[कारण: "), inner, F.lit("] "), hindi_answer)).when(part(4, 1), F.concat(hindi_answer, F.lit(" [कारण: "), inner)).when(part(4, 2), F.concat(F.lit("  "), hindi_answer, F.lit("\n")))
    e = _orders(spark, sf_dir).select("id", F.when(~part(10, 9), x.otherwise(F.concat(other_answer, F.lit(" "), reason, other, F.lit("]")))).alias("x"))
    scored = F.when(~F.contains("x", F.lit("হয়")), T.answer(F.col("x")))
    return e.select("id", T.rationale_parts(F.col("x")).alias("p"), T.rationale(F.col("x")).alias("rationale"), scored.alias("scored")).select("id", F.array_join("p.steps", " | ").alias("steps"), "p.conclusion", "p.answer", "p.closed", "rationale", "scored")


@query(f"""WITH {PAIRS} SELECT id, 0.4::DOUBLE * ((length(hypothesis) % 5) / 4.0::DOUBLE) + 0.6::DOUBLE * ((length(reference) % 3) / 2.0::DOUBLE) AS combined, list_has_all({_H}, [({_R})[1]]) OR contains(hypothesis, ({_R})[1]) AS copies FROM pairs""")
def name_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    h, first = F.col("hypothesis"), F.get(T.words(F.col("reference")), F.lit(0))
    return _pairs(spark, sf_dir).select("id", S.combined_score(F.char_length(h) % 5 / 4.0, F.char_length("reference") % 3 / 2.0).alias("combined"), S.copies_names(h, F.array(first)).alias("copies"))


@query(f"WITH {PAIRS}, p AS (SELECT trim(regexp_replace(hypothesis, '\\s+', ' ', 'g')) AS h, trim(regexp_replace(reference, '\\s+', ' ', 'g')) AS r FROM pairs) SELECT avg((contains(h, r) OR contains(r, h))::INTEGER) AS accuracy FROM p")
def match_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.accuracy(_pairs(spark, sf_dir), "hypothesis", "reference")


def _generation_sql() -> str:
    kinds = []
    for n in (1, 2, 3, 4):
        gram = f"list_transform(generate_series(1, len(w) - {n - 1}), lambda i: array_to_string(w[i:i + {n - 1}], ' '))"
        kinds.append(f"(SELECT count(DISTINCT g)::DOUBLE / count(*) FROM (SELECT unnest({gram}) AS g FROM (SELECT {_H} AS w FROM pairs) WHERE len(w) >= {n})) AS d{n}")
    return f"""WITH {PAIRS}, b AS ({_bleu_sql()}), c AS ({_chrf_sql()}), k AS (SELECT {', '.join(kinds)}), {_ROUGE}, g AS (SELECT round(avg({_ROUGE_L}), 6) AS rouge_l FROM l)
SELECT 'all' AS label, bleu, chrf, rouge_l, round(1 - d3, 6) AS repetition_rate_3, round(d1, 6) AS distinct_1, round(d2, 6) AS distinct_2, round(d4, 6) AS distinct_4 FROM b, c, k, g"""


@query(_generation_sql())
def generation_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = written(_pairs(spark, sf_dir).withColumn("label", F.lit("all")), "pairs")
    s = evaluation.generation_scores(rows, ["all"])
    return s.select("label", *(r6(F.col(c)).alias(c) for c in ("bleu", "chrf", "rouge_l", "repetition_rate_3", "distinct_1", "distinct_2", "distinct_4")))


@query("SELECT doc_id // 50 AS id, count(*) AS n FROM documents WHERE doc_id // 50 % 3 <> 1 GROUP BY 1")
def curriculum_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of one to three premises up to two: each document is a chain as long as its group's rest says."""
    name = lambda i: F.concat(F.lit("e"), i.cast("string"))
    long = F.when(F.floor(F.col("doc_id") / 50) % 3 == 1, 3).when(F.floor(F.col("doc_id") / 50) % 3 == 2, 2).otherwise(1)
    premises = F.transform(F.sequence(F.lit(1), F.col("k")), lambda i: F.struct(name(i).alias("s"), F.lit(">").alias("rel"), name(i + 1).alias("o")))
    e = t(spark, sf_dir, "documents").select("doc_id", long.alias("k")).withColumn("premises", premises).withColumn("query", F.struct(F.lit("e1").alias("x"), name(F.col("k") + 1).alias("y")))
    return reasoning.up_to_hops(e, 2).groupBy(F.floor(F.col("doc_id") / 50).cast("long").alias("id")).agg(F.count("*").alias("n"))


@query("""WITH p AS (SELECT DISTINCT lower(n_name[1:2]) AS x, lower(n_name[-2:]) AS z FROM nation), n AS (SELECT DISTINCT a.x || y || b.z AS name FROM p a, (SELECT DISTINCT lower(r_name[1]) AS y FROM region UNION ALL SELECT '') r, p b)
SELECT name FROM n WHERE name NOT IN (SELECT unnest(string_split_regex(lower(text), '[^a-z]+')) FROM documents)""")
def name_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beginnings and ends of nations' names, with regions' initials between them, less the words of documents."""
    part = lambda name, x: [r[0] for r in t(spark, sf_dir, name).select(F.lower(x)).distinct().collect()]  # noqa: E731  25 and 5 rows at any scale
    words = t(spark, sf_dir, "documents").select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("name"))
    n = F.col("n_name")
    return reasoning.synthetic_names(spark, part("nation", F.substring(n, 1, 2)), [*part("region", F.substring("r_name", 1, 1)), ""], part("nation", F.substring(n, -2, 2)), words)


# ---------------------------------------------------------------- tokens and logs


@query(f"SELECT lang, round(sum(length(text))::DOUBLE / sum(greatest(1, {NW})), 4) AS fertility, round(sum((doc_id % 3 = 0)::INTEGER)::DOUBLE / sum(length(text)), 6) AS unk_rate, 1.0::DOUBLE AS chars_per_token, round(sum(strlen(text))::DOUBLE / sum(length(text)), 4) AS bytes_per_token, round(avg((doc_id % 2 = 0)::INTEGER), 4) AS roundtrip FROM documents GROUP BY 1")
def tokenizer_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters as tokens; every third document has an unknown one, every other one does not come back."""
    d = t(spark, sf_dir, "documents").select("lang", "text", F.char_length("text").alias("n_tokens"), (F.col("doc_id") % 3 == 0).cast("int").alias("n_unknown"), F.when(F.col("doc_id") % 2 == 0, F.col("text")).otherwise("").alias("decoded"))
    return tokens.tokenizer_scores(d, ["lang"])


@query(f"SELECT batch, list_sum(x)::BIGINT AS total, len(x) AS n, x[len(x)] AS last FROM (SELECT doc_id // 32 AS batch, flatten(list(list_append({WT}.list_transform(lambda w: length(w)::BIGINT), 3) ORDER BY doc_id)) AS x FROM documents GROUP BY 1)")
def batch_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of 32 documents, each one row of ids."""
    d = t(spark, sf_dir, "documents").select("doc_id", F.floor(F.col("doc_id") / 32).cast("long").alias("batch"), F.transform(T.words(F.col("text")), lambda w: F.char_length(w)).alias("ids"))
    one = tokens.joined_ids(d, "doc_id", within=["batch"]).select("batch", F.transform("ids", lambda x: x.cast("long")).alias("ids"))
    return one.select("batch", F.aggregate("ids", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), F.size("ids").cast("long").alias("n"), F.element_at("ids", -1).alias("last"))


@query("SELECT event_id AS step, CASE WHEN event_id < 300 THEN 'old' ELSE 'new' END AS which, value FROM events")
def merged_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log up to 500 and one from 300 on."""
    e = t(spark, sf_dir, "events").select(F.col("event_id").alias("step"), "value")
    old, new = (e.where(test).select("step", F.lit(w).alias("which"), "value") for test, w in (("step < 500", "old"), ("step >= 300", "new")))
    return training.merged_log(old, new)


@query(f"WITH w AS (SELECT doc_id, {WT} AS w FROM documents) SELECT doc_id, coalesce(array_to_string(w[1:3], ' '), '') AS prefix, coalesce(array_to_string(w[4:5], ' '), '') AS target FROM w WHERE len(w) >= 5")
def prefix_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = t(spark, sf_dir, "documents").select("doc_id", T.words(F.col("text")).alias("ids"))
    p = w.select("doc_id", F.explode(tokens.prefixes(F.col("ids"), F.array(F.lit(0)), 3, 2)).alias("p"))
    return p.select("doc_id", F.array_join("p.prefix", " ").alias("prefix"), F.array_join("p.target", " ").alias("target"))


@query(f"SELECT doc_id, len(w) AS words, coalesce(list_sum(list_transform(w, lambda x: CASE WHEN length(x) BETWEEN 4 AND 6 AND x LIKE 'the%' THEN 2 ELSE 1 END)), 0)::BIGINT AS parts FROM (SELECT doc_id, {WT} AS w FROM documents)")
def names_apart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """"the" as a name: words that start with it and go on for up to three letters are two."""
    x = F.col("text")
    return t(spark, sf_dir, "documents").select("doc_id", T.word_count(x).cast("long").alias("words"), F.size(tokens.name_split(x, F.array(F.lit("the")))).cast("long").alias("parts"))


@query(f"WITH w AS (SELECT doc_id, {WT} AS w FROM documents) SELECT doc_id, list_position(w, 'the') - 1 AS first FROM w WHERE list_contains(w, 'the') AND NOT contains(array_to_string(w[:list_position(w, 'the') - 1], ' '), 'the')")
def name_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The piece at which "the" stands first, where it is a word of its own there."""
    w = t(spark, sf_dir, "documents").select("doc_id", T.words(F.col("text")).alias("w")).where(F.array_contains("w", "the"))
    at = F.array_position("w", "the").cast("int")
    w = w.withColumn("at", at).where(~F.contains(F.array_join(F.slice("w", F.lit(1), F.col("at") - 1), " "), F.lit("the")))
    pieces = F.transform(F.slice("w", F.lit(1), F.col("at")), lambda x: F.concat(F.lit(" "), x))
    return w.select("doc_id", F.get(tokens.positions_of(pieces, F.lit("the")), F.lit(0)).cast("long").alias("first"))


@query(f"SELECT doc_id, replace(w[1], 'e', ' ') AS shown, chr(65 + (doc_id % 26)::INTEGER) AS byte FROM (SELECT doc_id, {W.format('text')} AS w FROM documents)")
def shown_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.replace(F.get(T.words(F.col("text")), F.lit(0)), F.lit("e"), F.lit("▁"))
    code = F.concat(F.lit("<0x"), F.hex(65 + F.col("doc_id") % 26), F.lit(">"))
    return t(spark, sf_dir, "documents").select("doc_id", T.shown_piece(first).alias("shown"), T.shown_piece(code).alias("byte"))


@query(f"SELECT {CHANCE.format('relation', chr(39) + '5' + chr(39))} AS chance, relation FROM (SELECT CASE WHEN quality = 1 THEN '>' ELSE '<' END AS relation FROM labels GROUP BY 1)")
def stated_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpuslab.operators.select import chance

    rel = leakage.relation(F.concat(F.lit("a "), F.when(F.col("quality") == 1, ">").otherwise("<"), F.lit(" b")))
    return t(spark, sf_dir, "labels").select(rel.alias("relation")).distinct().select(chance(F.col("relation"), 5).alias("chance"), "relation")


@query(f"WITH g AS (SELECT string_split(text, chr(10))[1] AS prompt, min(doc_id) AS doc_id FROM documents GROUP BY 1) SELECT doc_id, {NW.replace('text', 'prompt')} AS words FROM g")
def distinct_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpuslab.operators.dedup import first_of

    d = t(spark, sf_dir, "documents").select("doc_id", F.get(F.split("text", "\n"), F.lit(0)).alias("prompt"))
    return first_of(d, F.col("prompt"), [F.col("doc_id")]).select("doc_id", T.word_count(F.col("prompt")).cast("long").alias("words"))
