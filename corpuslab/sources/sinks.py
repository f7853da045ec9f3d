"""What is written: clean corpora, manifests, splits, token files, reports."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuslab.session import ship
from corpuslab.sources.formats import system_of, write_parts
from corpuslab.tables import written


def write_clean(docs: DataFrame, folder: str) -> None:
    """JSON lines and plain lines of docs (doc_id, source, text, source_type, hash), a folder for each source."""
    docs.write.mode("append").partitionBy("source").json(f"{folder}/jsonl")
    docs.select("source", F.translate("text", "\n", " ").alias("value")).write.mode("append").partitionBy("source").text(f"{folder}/txt")


def append_manifest(docs: DataFrame, path: str, source: str) -> None:
    """Rows of what was kept (doc_id, hash), and then, in a write of its own, the mark that the source is done."""
    rows = docs.select(F.lit("doc").alias("kind"), F.col("doc_id").cast("string").alias("doc_id"), F.lit(source).alias("source"), "hash")
    rows.write.mode("append").parquet(path)
    done = docs.sparkSession.createDataFrame([("source_done", None, source, None)], "kind string, doc_id string, source string, hash string")
    done.write.mode("append").parquet(path)


def write_splits(docs: DataFrame, folder: str, text_only: bool = False) -> DataFrame:
    """A folder for each split (docs has split); returns (split, n). In the plain lines a text's line ends are spaces."""
    if not text_only:
        docs.write.mode("overwrite").partitionBy("split").json(f"{folder}/jsonl")
    docs.where(F.trim("text") != "").select("split", F.translate("text", "\n", " ").alias("value")).write.mode("overwrite").partitionBy("split").text(f"{folder}/txt")
    return docs.groupBy("split").agg(F.count("*").alias("n"))


def opened(path: str, write: bool = False):
    """A file of a file system that pyarrow knows (local or shared folders, hdfs, s3, gs), for reading, or for writing from its start."""
    system, name = system_of(path)
    return system.open_output_stream(name) if write else system.open_input_file(name)


def _uri(path: str) -> str:
    return path if "://" in path or path.startswith("file:") else f"file://{path}"


def write_tokens(docs: DataFrame, folder: str, order: str, end: int | None = 3, wide: bool = False) -> DataFrame:
    """Writes the ids of docs (order, ids), an end after each (none for None), as little-endian integers, and returns (part, path, tokens, docs, start), start the tokens of the parts before.

    Each task writes the file of a range of the order; formats.write_parts() publishes them as part-<n>.bin in `folder` when all have ended, so that a failed write leaves what was there before. The parts in
    their order are the token file; no ids come to the driver. Raises if there are no documents, and for an id that does not fit.
    """
    spark, kind, width = docs.sparkSession, "<u4" if wide else "<u2", 4 if wide else 2
    ship(spark)

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for ids in batch["ids"]:
                raw = np.asarray(ids, np.int64) if end is None else np.append(np.asarray(ids, np.int64), end)
                if len(raw) and (raw.max() >= 2 ** (8 * width) or raw.min() < 0):
                    raise ValueError("an id does not fit the file's integers")
                out.append(raw.astype(kind).tobytes())
            yield pd.DataFrame({"data": out})

    size = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = docs.select(order, "ids").repartitionByRange(size, order).sortWithinPartitions(order)
    index = write_parts(dealt.select("ids").mapInPandas(packed, "data binary"), _uri(folder.rstrip("/")), ".bin")
    if not index.limit(1).count():
        raise ValueError("no documents to write")
    parts = index.select("part", "path", (F.col("bytes") / width).cast("long").alias("tokens"), F.col("rows").alias("docs"))
    # a row for each part
    return parts.withColumn("start", F.coalesce(F.sum("tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


def join_parts(index: DataFrame, path: str) -> int:
    """Puts the parts of write_tokens() together as one file, some megabytes at a time, for programs that want one; returns its tokens. The driver reads and writes, but holds no part whole."""
    total = 0
    with opened(_uri(path), write=True) as out:
        for row in index.orderBy("part").collect():  # a row for each part
            with opened(row["path"]) as part:
                while block := part.read(8 << 20):
                    out.write(block)
            total += row["tokens"]
    return total


def corpus_to_tokens(spark: SparkSession, folder: str, vocabulary: DataFrame, out: str, seed: int = 1337, end: int = 3) -> DataFrame:
    """The plain lines of a clean corpus (folder/*.txt, but not files of splits or of reasoning) as token files by split, out/<split>; returns (split, part, path, tokens, docs, start)."""
    from corpuslab.operators import select, tokens
    from corpuslab.sources import scan

    rows = scan.lines(spark, f"{folder.rstrip('/')}/*.txt")
    rows = rows.where(scan.is_source(F.regexp_extract("doc_id", r"^(.*)\.txt#\d+$", 1)))
    coded, _ = written(tokens.encoded(rows.withColumn("split", select.split_of(F.col("doc_id"), seed)), vocabulary).select("doc_id", "split", "ids"), "ids")
    parts = None
    for split in ("train", "val", "test"):
        own = coded.where(F.col("split") == split)
        if own.limit(1).count():
            part = write_tokens(own, f"{out.rstrip('/')}/{split}", "doc_id", end).withColumn("split", F.lit(split))
            parts = part if parts is None else parts.unionByName(part)
    if parts is None:
        raise ValueError("no documents to write")
    return parts


def write_text(row: DataFrame, path: str) -> None:
    """A report: one row with one string column, as a folder with one text file."""
    row.select(F.col(row.columns[0]).cast("string").alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_sources(registry: DataFrame, path: str) -> None:
    """A JSON line for each source (name, type, priority, completed, failed)."""
    registry.write.mode("overwrite").json(path)


def write_predictions(rows: DataFrame, path: str) -> None:
    """JSON lines of predictions: split, text, gold_answer, gold_cot, gold_rel, prediction, pred_rel; nulls are written."""
    names = ("split", "text", "gold_answer", "gold_cot", "gold_rel", "prediction", "pred_rel")
    rows.select(*names).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_evaluation(folder: str, scores: DataFrame, losses: DataFrame, by_context: DataFrame, samples: DataFrame) -> None:
    """What an evaluation leaves: scores of generated texts, losses, losses by context, and samples with a row for each prompt and a column for each setting."""
    for name, rows in (("generation_metrics", scores), ("ppl_bpb_table", losses), ("full_context_ppl", by_context), ("generated_samples", samples)):
        rows.write.mode("overwrite").json(f"{folder.rstrip('/')}/{name}")


def write_examples(splits: dict[str, DataFrame], names: dict[str, list[str]], folder: str) -> DataFrame:
    """Examples by split as JSON lines, folder/split=<name>, premises and query as lists, and folder/manifest.json with their numbers and names; returns (split, n). Raises if a split is empty."""
    out, spark = None, next(iter(splits.values())).sparkSession
    for name, df in splits.items():
        lists = df.withColumn("premises", F.transform("premises", lambda p: F.array(p["s"], p["rel"], p["o"]))).withColumn("query", F.array("query.x", "query.y"))
        lists = lists.withColumn("distractors", F.transform("distractors", lambda p: F.array(p["s"], p["rel"], p["o"], p["attr"])))
        at = f"{folder.rstrip('/')}/split={name}"
        lists.select("id", "paradigm", "attribute", "entities", "premises", "query", "answer_rel", "answer_text", "cot_text", "text", "distractors").write.mode("overwrite").json(at)
        n = spark.read.text(at).agg(F.lit(name).alias("split"), F.count("*").alias("n"))
        out = n if out is None else out.unionByName(n)
    counts = {r["split"]: r["n"] for r in out.collect()}
    if not all(counts.values()):
        raise ValueError(f"empty splits: {counts}")
    manifest = {"counts": counts, "entities": names, "reserved_paradigms": ["multi_hop"]}
    write_text(spark.createDataFrame([(json.dumps(manifest, ensure_ascii=False),)], "json string"), f"{folder.rstrip('/')}/manifest.json")
    return out
