"""The queries over whole tables, one for each operator of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslab.llm import bpe, dialogue, discriminant, html_cut, media, minhash, mixing, negatives, paragraphs, substring, token_orc, toxicity, warc
from corpuslab.session import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def op1_toxicity_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.scored(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op2_warc_seekable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def domains(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, domain) of labelled documents: language and quality class."""
    return docs.select("doc_id", "lang").join(labels.select("doc_id", "quality"), "doc_id").select("doc_id", F.concat_ws("-", "lang", F.col("quality").cast("string")).alias("domain"))


def op3_mixing_soft(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = mixing.fit_classifier(docs, domains(docs, table(spark, sf_dir, "labels")))
    return mixing.mixing_rates(docs, model)


def op4_html_mincut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_cut.extract(table(spark, sf_dir, "pages"))


def op5_paragraph_iblt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs.fingerprints(table(spark, sf_dir, "documents"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    result, _ = substring.repeated_spans(table(spark, sf_dir, "documents"), window=50)
    return result.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op7_bpe_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_orc.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)


def op9_media_descriptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.copies_of_vectors(table(spark, sf_dir, "embeddings"))


def op10_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=2, percent=80)


def op11_radix_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return negatives.mine(rows.withColumn("label", F.expr("CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END")), anchors="id % 50 = 0", positives=5, negatives=3, low=50, high=95)


def op12_dialogue_dijkstra(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialogue.repair(dialogue.damaged(table(spark, sf_dir, "conversations")))


def op13_quality_qda(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return discriminant.scored(docs, discriminant.fit(docs, table(spark, sf_dir, "labels")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity_mil": op1_toxicity_mil,
    "op2_warc_seekable": op2_warc_seekable,
    "op3_mixing_soft": op3_mixing_soft,
    "op4_html_mincut": op4_html_mincut,
    "op5_paragraph_iblt": op5_paragraph_iblt,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_bpe_trie": op7_bpe_trie,
    "op8_token_orc": op8_token_orc,
    "op9_media_descriptors": op9_media_descriptors,
    "op10_minhash_forest": op10_minhash_forest,
    "op11_radix_negatives": op11_radix_negatives,
    "op12_dialogue_dijkstra": op12_dialogue_dijkstra,
    "op13_quality_qda": op13_quality_qda,
}

_WORDS = r"list_filter(string_split_regex({0}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"

#: crc32 of an ASCII string, bit by bit.
_CRC32 = """xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split({0}, ''), lambda c: [ord(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, CASE WHEN (c & 1) = 1 THEN 3988292384 ELSE 0 END) END), 4294967295::BIGINT)"""


def _edit(state: str, cost: str, letter: str, turn: str = "''") -> str:
    """A state is a string: nine digits of cost, the audit, chr(1), and each repaired turn behind a line end. This is the state after one more edit."""
    return f"lpad(CAST(CAST(substr({state}, 1, 9) AS BIGINT) + {cost} AS VARCHAR), 9, '0') || substr({state}, 10, instr({state}, chr(1)) - 10) || '{letter}' || substr({state}, instr({state}, chr(1))) || {turn}"


def _inserted(rows: str) -> str:
    """States s0 to s3 with what insertions alone reach."""
    user, assistant = "chr(10) || 'user:'", "chr(10) || 'assistant:'"
    users = f"SELECT * REPLACE (least(s2, {', '.join(_edit(s, '2', 'I', user) for s in ('s0', 's1', 's3'))}) AS s2) FROM ({rows})"
    return f"SELECT * REPLACE (least(s3, {_edit('s2', '2', 'I', assistant)}) AS s3) FROM ({users})"


def _row(state: str, ways: list[str], initial: str, role: str) -> str:
    """The state after a row: deleted from itself; kept, or with another role, from the states in ways."""
    kept = [f"CASE WHEN token <> '-' AND token = '{initial}' THEN {_edit(s, 'more', 'K', "chr(10) || role || ':' || text")} END" for s in ways]
    other = [f"CASE WHEN token <> '-' THEN {_edit(s, '2 + more', 'R', f"chr(10) || '{role}:' || text")} END" for s in ways] if role else []
    return f"least({', '.join([_edit(state, '3', 'D'), *kept, *other])})"


ORACLES: dict[str, str] = {
    "op11_radix_negatives": """WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: isfinite(x))) = len(embedding)),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS alike, list_inner_product(a.v, b.v)::BIGINT AS score FROM r a JOIN r b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE alike QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, (row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT alike AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) <= 3""",
    "op12_dialogue_dijkstra": f"""WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_CRC32.format("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS k FROM conversations),
d AS (SELECT conv_id, turn, role AS r0, md5(text) AS t0, n, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM k, unnest([0, 1]) AS u(n) WHERE k <> 0 AND (n = 0 OR k = 3)),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, r0, t0, n) AS i FROM d),
f AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd'
  WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\\z') THEN 't' ELSE '' END AS fault, coalesce(lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) || role[1] NOT IN ('su', 'ua', 'au'), false) AS illegal FROM o),
t AS (SELECT conv_id, i, role, text, CASE WHEN fault IN ('b', 'd') THEN '-' WHEN role[1] IN ('s', 'u', 'a') THEN role[1] ELSE '?' END AS token, CASE WHEN fault = 't' THEN 1 ELSE 0 END AS more FROM f),
c AS (SELECT conv_id, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (illegal) AS illegal FROM f GROUP BY 1),
w AS (SELECT conv_id, 0::BIGINT AS i, '000000000' || chr(1) AS s0, NULL::VARCHAR AS s1, NULL::VARCHAR AS s2, NULL::VARCHAR AS s3 FROM c
  UNION ALL SELECT conv_id, i + 1, {_row("s0", [], "", "")}, {_row("s1", ["s0"], "s", "")}, {_row("s2", ["s0", "s1", "s3"], "u", "user")}, {_row("s3", ["s2"], "a", "assistant")}
  FROM ({_inserted("SELECT w.*, role, text, token, more FROM w JOIN t ON t.conv_id = w.conv_id AND t.i = w.i + 1")})),
e AS (SELECT conv_id, gaps, blank, duplicate, truncated, illegal, least(s0, s3) AS s FROM ({_inserted("SELECT w.*, gaps, blank, duplicate, truncated, illegal FROM w JOIN c USING (conv_id) WHERE w.i = c.n")}))
SELECT a.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
coalesce(substr(s, 1, 9)::BIGINT, 0) AS cost, coalesce(substr(s, 10, instr(s, chr(1)) - 10), '') AS audit, sha256(coalesce(substr(s, instr(s, chr(1)) + 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN e USING (conv_id)""",
    "op2_warc_seekable": """WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), k AS (SELECT h, max(page_id) AS keeper FROM p WHERE strlen(h) >= 1000 GROUP BY h)
SELECT page_id, strlen(p.h)::BIGINT AS payload_bytes, sha1(p.h) AS payload_digest, CASE WHEN keeper <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN keeper <> page_id THEN keeper END AS refers_to
FROM p LEFT JOIN k ON k.h = p.h""",
    "op6_substring_dedup": f"""WITH w AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
p AS (SELECT doc_id, w, unnest(generate_series(1, len(w))) AS i FROM w),
k AS (SELECT doc_id, i, w[i] AS word, CASE WHEN i + 49 <= len(w) THEN array_to_string(w[i:i + 49], ' ') END AS win FROM p),
f AS (SELECT doc_id, i, word, CASE WHEN win IS NOT NULL AND min(doc_id) OVER (PARTITION BY win) < doc_id THEN 1 ELSE 0 END AS gone FROM k),
c AS (SELECT doc_id, i, word, max(gone) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS cover FROM f),
r AS (SELECT doc_id, sum(cover)::BIGINT AS n_removed, coalesce(string_agg(word, ' ' ORDER BY i) FILTER (cover = 0), '') AS kept FROM c GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN r USING (doc_id)""",
    "op10_minhash_forest": f"""WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 2 THEN w ELSE list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1]) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1), t AS (SELECT s.doc_id, g, n FROM s JOIN n USING (doc_id)),
m AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c, min(a.n + b.n) AS total FROM t a JOIN t b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY 1, 2),
e AS (SELECT a, b FROM m WHERE 100 * c >= 80 * (total - c)), both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach AS (SELECT doc_id AS x, doc_id AS y FROM w UNION SELECT reach.x, both_ways.b FROM reach JOIN both_ways ON reach.y = both_ways.a),
c AS (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY 1)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)""",
}
