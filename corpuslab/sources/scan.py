"""Texts from files: (doc_id, text) from Parquet, lines, JSON lines, CSV, dumps, sitemaps and token files.

A doc_id is the file's name and the row's number in it. Texts are stripped; rows without a text go.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as t

from corpuslab.functions import text as T
from corpuslab.operators.select import before_stretches, with_offsets
from corpuslab.profiles import SPACE, ScriptProfile
from corpuslab.session import ship

#: Names of text columns in the order in which they are looked for; files that are no sources.
TEXT_COLUMNS = ("text", "sentence", "content", "article", "body")
NOT_SOURCES = ("train", "val", "test")


def text_column(schema: t.StructType, any_column: bool = False) -> str:
    """The text column of a schema: the first known name, else the first string column (or, if asked, the first column)."""
    if known := next((n for n in TEXT_COLUMNS if n in schema.names), None):
        return known
    strings = [f.name for f in schema.fields if isinstance(f.dataType, t.StringType)]
    if any_column and schema.names:
        return schema.names[0]
    if not strings:
        raise ValueError(f"no text column in {schema.names}")
    return strings[0]


def text_name(names: list[str]) -> str:
    """The text column of names without types: the first known one, else the first."""
    return next((n for n in TEXT_COLUMNS if n in names), names[0])


def _documents(rows: DataFrame, text: Column, file: Column, number: Column) -> DataFrame:
    out = rows.select(F.concat_ws("#", file, number.cast("string")).alias("doc_id"), T.strip(text.cast("string")).alias("text"))
    return out.where("text <> ''")


def parquet(spark: SparkSession, path: str, text: str | None = None) -> DataFrame:
    """Reads the text column alone."""
    rows = spark.read.parquet(path)
    return _documents(rows, F.col(text or text_column(rows.schema)), F.col("_metadata.file_name"), F.col("_metadata.row_index"))


def table(spark: SparkSession, path: str, text: str | None = None) -> DataFrame:
    """(doc_id, text) of every row of a Parquet table, however many files it is dealt over: the table's name and the row's number over its files in the order of their names. Texts are as they are, and none goes."""
    rows = spark.read.parquet(path)
    placed = rows.select(F.col(text or text_column(rows.schema)).cast("string").alias("text"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    files = before_stretches(rows.select(F.col("_metadata.file_path").alias("file")), [], {"before": F.lit(1)}, "file")
    met = with_offsets(placed, F.broadcast(files), [], "file")  # a row for each file
    return met.select(F.concat_ws("#", F.lit(path.rstrip("/").rsplit("/", 1)[-1]), (F.col("before") + F.col("row")).cast("string")).alias("doc_id"), "text")


def _numbered(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """Lines of text files with their file and number. The number counts a file's lines from the stretches in which it is read, and those from their sizes."""
    lines = spark.read.options(**options).text(path).select("value", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"))
    from pyspark.sql import Window

    sizes = lines.groupBy("file", "start").agg(F.count("*").alias("n"))
    before = sizes.select("file", "start", F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = lines.withColumn("i", F.row_number().over(Window.partitionBy("file", "start").orderBy("at")) - 1)
    return inside.join(before, ["file", "start"]).select("value", "file", (F.col("i") + F.col("before")).alias("number"))


def lines(spark: SparkSession, path: str) -> DataFrame:
    """A document for each line that is not blank."""
    rows = _numbered(spark, path)
    return _documents(rows, F.col("value"), F.col("file"), F.col("number"))


def json_lines(spark: SparkSession, path: str) -> DataFrame:
    """A document for each line's text, or else its sentence; lines that are not JSON go."""
    rows = _numbered(spark, path)
    record = F.from_json("value", "text string, sentence string")
    rows = rows.where(F.is_valid_utf8(F.col("value"))).withColumn("r", record)
    return _documents(rows, F.coalesce(F.nullif(T.strip(F.col("r.text")), F.lit("")), F.col("r.sentence")), F.col("file"), F.col("number"))


def _ranges(spark: SparkSession, path: str, size: int) -> DataFrame:
    """(path, start, size, length) of the byte ranges of files; their contents are not read."""
    step = F.lit(size).cast("long")
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0).cast("long")), step))
    return file_list(spark, path).select("path", "length", starts.alias("start")).select("path", "start", F.least(step, F.col("length") - F.col("start")).alias("size"), "length")


def _line_ends(data: bytes, state: int) -> np.ndarray:
    """Places of the line ends outside quotes, in bytes that begin inside quotes (1) or not (0)."""
    raw = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(raw == 10)
    quotes = np.flatnonzero(raw == 34)
    return ends[(np.searchsorted(quotes, ends) + state) % 2 == 0]


def _quotes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Ranges to what the two states outside and inside quotes become behind them: `odd` quotes change a state, and the lines that end in the range from either."""
    from corpuslab.sources.sinks import opened

    for batch in batches:
        out = []
        for row in batch.itertuples(index=False):
            with opened(row.path) as file:
                file.seek(int(row.start))
                data = file.read(int(row.size))
            out.append((*row, data.count(b'"') % 2, len(_line_ends(data, 0)), len(_line_ends(data, 1))))
        yield pd.DataFrame(out, columns=[*batch.columns, "odd", "ends_outside", "ends_inside"])


def _first_record(file, length: int) -> bytes:
    data = b""
    while not len(ends := _line_ends(data, 0)) and len(data) < length:
        data += file.read(1 << 16)
    return data[: ends[0] + 1] if len(ends) else data


def _records():
    """Ranges with their state to the records that begin in them, (file, number, text): complete ones, however far they go on behind the range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import csv
        import io

        from corpuslab.sources.sinks import opened

        csv.field_size_limit((1 << 31) - 1)
        for batch in batches:
            for row in batch.to_pylist():
                path, start, size, length, state = (row[c] for c in ("path", "start", "size", "length", "state"))
                with opened(path) as file:
                    names = next(csv.reader(io.StringIO(_first_record(file, length).decode("utf-8-sig", "replace"), newline="")), [])
                    at = max(0, start - 1)  # with the byte before: a record begins behind its line end
                    file.seek(at)
                    data = file.read(start + size - at)
                    if start and data[:1] == b'"':
                        state ^= 1
                    begins = _line_ends(data, state) + 1
                    begins = begins[begins < len(data)] if not start else begins[(begins >= 1) & (begins < len(data))]
                    first = 0 if not start else int(begins[0]) if len(begins) else None
                    if first is None:
                        continue
                    inside = data.count(b'"', first) % 2  # a record begins outside quotes
                    while at + len(data) < length and (inside or data[-1:] != b"\n"):
                        more = file.read(1 << 16)
                        ends = _line_ends(more, inside)
                        more = more[: ends[0] + 1] if len(ends) else more
                        inside ^= more.count(b'"') % 2
                        data += more
                        if len(ends):
                            break
                k = names.index(text_name(names)) if names else 0
                out, number = [], row["number"] + (start > 0 and first > 1) - 1  # the file's first row has the names
                text = data[first:].decode("utf-8-sig" if not start else "utf-8", "replace")
                reader = csv.reader(io.StringIO(text, newline=""))
                for r in reader:
                    if r and number >= 0:
                        out.append((path.rsplit("/", 1)[-1], number, r[k] if k < len(r) else None))
                    number += 1
                yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], kind) for i, kind in enumerate((pa.string(), pa.int64(), pa.string()))], ["file", "number", "text"])

    return run


def csv(spark: SparkSession, path: str, range_bytes: int | None = None) -> DataFrame:
    """A document for each row's text column, which is looked for in each file's first row; quoted fields may hold line ends.

    Files are read in ranges, so that a large one is many tasks' work. Whether a range begins inside quotes is told by the quotes before it: each range says what it makes of either state, and these are composed in order. Quotes stand around
    fields, and double inside them. A row's number counts the records before it, blank ones too, without the names.
    path: of a file system that driver and executors share and pyarrow can open.
    """
    from pyspark.sql import Window

    ship(spark)
    ranges = _ranges(spark, path, range_bytes or RANGE)
    told = ranges.repartition(spark.sparkContext.defaultParallelism).mapInPandas(_quotes, "path string, start long, size long, length long, odd int, ends_outside long, ends_inside long")
    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    known = told.withColumn("state", F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2)
    known = known.withColumn("number", F.coalesce(F.sum(F.when(F.col("state") == 0, F.col("ends_outside")).otherwise(F.col("ends_inside"))).over(before), F.lit(0)))
    dealt = known.select("path", "start", "size", "length", "state", "number").repartition(spark.sparkContext.defaultParallelism)
    rows = dealt.mapInArrow(_records(), "file string, number long, text string")
    return _documents(rows, F.col("text"), F.col("file"), F.col("number"))


def mixed(spark: SparkSession, txt: str | None = None, jsonl: str | None = None, csvs: str | None = None, prefix: str = "", most: int | None = None) -> DataFrame:
    """Lines, then JSON lines, then CSV rows, in the order of their ids, with a prefix, up to a limit."""
    parts = [(i, read(spark, path)) for i, (read, path) in enumerate(((lines, txt), (json_lines, jsonl), (csv, csvs))) if path]
    out = None
    for i, df in parts:
        df = df.withColumn("_kind", F.lit(i))
        out = df if out is None else out.unionByName(df)
    if most is not None:
        number = F.regexp_extract("doc_id", r"#(\d+)$", 1).cast("long")
        out = out.orderBy("_kind", F.regexp_extract("doc_id", r"^(.*)#", 1), number).limit(most)
    return out.select(F.concat(F.lit(prefix), F.col("doc_id")).alias("doc_id"), "text")


def blank_line_documents(spark: SparkSession, path: str, name: str, least: int = 120) -> DataFrame:
    """Documents between blank lines with at least `least` characters, numbered in order among those kept."""
    rows = _numbered(spark, path, lineSep="\n\n").withColumn("text", T.strip(F.col("value"))).where(F.char_length("text") >= least)
    from corpuslab.operators.select import ranked

    return ranked(rows, [F.col("file"), F.col("number")], "n").select(F.concat(F.lit(f"{name}/doc_"), F.col("n").cast("string")).alias("doc_id"), "text")


def shards(files: list[str], start: int, end: int) -> list[str]:
    """Files from start up to end (not a number of files), in order."""
    return sorted(files)[start:end]


def small_files(spark: SparkSession, path: str, most_bytes: int = 2_000_000_000) -> list[str]:
    """Names of files up to a size; the listing alone is read."""
    rows = spark.read.format("binaryFile").load(path).select("path", "length").where(F.col("length") <= most_bytes)
    return sorted(r["path"] for r in rows.collect())  # as many as there are files


#: How a stream of a bz2 file begins, and the marks of a record in a dump.
_STREAM, _PAGE, _PAGE_END = re.compile(rb"BZh[1-9]1AY&SY"), b"<page>", b"</page>"


def _unpacked(file, at: int) -> Iterator[tuple[bytes, int]]:
    """(text, where the next stream begins, or -1 inside this one): the text of the stream that begins at a place of an open file, some at a time."""
    import bz2

    file.seek(at)
    stream = bz2.BZ2Decompressor()
    while not stream.eof:
        data = b"" if not stream.needs_input else file.read(1 << 18)
        if stream.needs_input and not data:
            return  # a file that is cut off
        at += len(data)
        text = stream.decompress(data, 1 << 20)
        yield text, at - len(stream.unused_data) if stream.eof else -1


def _pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranges of compressed files to the records (xml) whose streams begin in them. A record that its stream does not end goes on in the next ones, which leave out what stands before their first mark."""
    from corpuslab.sources.sinks import opened

    for batch in batches:
        for path, start, size in zip(*(batch.column(c).to_pylist() for c in ("path", "start", "size")), strict=True):
            out: list[str] = []
            with opened(path) as file:
                file.seek(int(start))
                marks = [int(start) + m.start() for m in _STREAM.finditer(file.read(int(size) + 9)) if m.start() < size]
                for mark in marks:
                    held, at, own, ended = b"", mark, True, False
                    while at >= 0 and not ended:
                        following = -1
                        for text, following in _unpacked(file, at):
                            held += text
                            while not ended and (a := held.find(_PAGE)) >= 0 and (b := held.find(_PAGE_END, a)) >= 0:
                                out.append(held[a : b + len(_PAGE_END)].decode("utf-8", "replace"))
                                held = held[b + len(_PAGE_END) :]
                                ended = not own  # the record that went on into another range's stream
                            if ended:
                                break
                            a = held.find(_PAGE)
                            held = held[a:] if a >= 0 else held[-len(_PAGE) :]
                        ended = ended or _PAGE not in held
                        at, own = following, False
                    if len(out) >= 500:
                        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["xml"])
                        out = []
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["xml"])


def dump_pages(spark: SparkSession, path: str, range_bytes: int | None = None) -> DataFrame:
    """(xml) of the records of bz2 dumps. A file of many streams is many tasks' work: each reads the streams that begin in its range, whose first bytes say so; a file of one stream is one task's."""
    ship(spark)
    return _ranges(spark, path, range_bytes or RANGE).repartition(spark.sparkContext.defaultParallelism * 4).mapInArrow(_pages, "xml string")


_DUMP = "title string, ns int, id long, redirect struct<_title: string>, revision struct<text: struct<_VALUE: string>>"


def wiki_dump(spark: SparkSession, path: str, profile: ScriptProfile, least_share: float = 0.2, name: str = "wiki", range_bytes: int | None = None) -> DataFrame:
    """Articles of an XML dump, plain or in bz2 streams (.bz2): no other namespaces, no redirects, markup out, enough of the script."""
    if path.endswith(".bz2"):
        text = "title string, ns int, id long, redirect string, revision struct<text: string>"
        pages = dump_pages(spark, path, range_bytes).select(F.col("xml").contains("<redirect").alias("moved"), F.from_xml("xml", text).alias("p")).select("moved", "p.*")
        rows = pages.where("ns = 0 and not moved").select("id", F.col("revision.text").alias("text"))
    else:
        rows = spark.read.format("xml").option("rowTag", "page").schema(_DUMP).load(path).where("ns = 0 and redirect is null").select("id", F.col("revision.text._VALUE").alias("text"))
    rows = rows.select(F.concat(F.lit(f"{name}/"), F.col("id").cast("string")).alias("doc_id"), T.wiki_markup(F.col("text")).alias("text"))
    return rows.where((F.col("text") != "") & (T.script_fraction(F.col("text"), profile) >= least_share))


def clean_records(spark: SparkSession, folder: str) -> DataFrame:
    """Records of a folder of JSON lines, but not its manifest or statistics, with a text."""
    rows = spark.read.option("pathGlobFilter", "*.jsonl").json(folder).withColumn("_file", F.col("_metadata.file_name"))
    return rows.where(~F.col("_file").rlike("^(manifest|dataset_stats)") & (T.strip(F.col("text")) != "")).drop("_file")


def is_source(name: Column) -> Column:
    """Whether a file's name (without its ending) is that of a source."""
    return ~name.isin(*NOT_SOURCES) & ~F.contains(F.lower(name), F.lit("reasoning"))


def sitemap_urls(xml: Column) -> Column:
    return F.regexp_extract_all(xml, F.lit(rf"(?i)<loc>[{SPACE}]*(https?://[^{SPACE}<]+)[{SPACE}]*</loc>"), F.lit(1))


def is_sitemap(url: Column) -> Column:
    return F.contains(F.lower(url), F.lit("sitemap")) & url.rlike(r"\.xml(\.gz)?$")


def sitemap_pages(maps: DataFrame, index: str, most: int) -> DataFrame:
    """(url) of pages that a sitemap (url, xml) names, itself or through maps one level below that are in the table, in order, up to `most`."""
    top = maps.where(F.col("url") == index).select(F.posexplode(sitemap_urls(F.col("xml"))).alias("i", "loc"))
    below = top.where(is_sitemap(F.col("loc"))).join(maps.select(F.col("url").alias("loc"), "xml"), "loc").select("i", F.posexplode(sitemap_urls(F.col("xml"))).alias("j", "url"))
    own = top.where(~is_sitemap(F.col("loc"))).select(F.lit(-1).alias("i"), F.col("i").alias("j"), F.col("loc").alias("url"))
    below = below.where(~(F.contains(F.lower("url"), F.lit("sitemap")) & F.col("url").endswith(".xml")))
    return own.union(below).orderBy("i", "j").limit(most).select("url")


#: Parts of addresses that are not articles.
NOT_ARTICLES = ("/category/", "/page/", "/tag/", "/author/", "/feed/", "/wp-json/")


def page_links(html: Column, host: str) -> Column:
    """Distinct addresses of a site that a page links to, in order, without those that are no articles."""
    found = F.array_distinct(F.regexp_extract_all(html, F.lit(rf"href=[\"'](https?://{host}/[^\"'#?]+)"), F.lit(1)))
    return F.filter(found, lambda u: ~u.rlike("|".join(NOT_ARTICLES)))


#: Bytes of a token file that a task reads at a time.
RANGE = 32 << 20


def file_list(spark: SparkSession, path: str) -> DataFrame:
    """(path, length) of the files that a path names; their contents are not read."""
    return spark.read.format("binaryFile").load(path).select("path", "length")


def token_counts(spark: SparkSession, path: str, end: int = 3, wide: bool = False) -> DataFrame:
    """(file, tokens, docs) of files of little-endian ids, 16 or (wide) 32 bits each: documents by their end ids. Files are read in ranges, so that a large one is many tasks' work.

    path: of a file system that driver and executors share and pyarrow can open.
    """
    from corpuslab.sources.sinks import opened

    ship(spark)
    kind = "<u4" if wide else "<u2"

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for name, start, size in zip(batch["path"], batch["start"], batch["size"], strict=True):
                with opened(name) as file:
                    file.seek(int(start))
                    ids = np.frombuffer(file.read(int(size)), kind)
                out.append((name.rsplit("/", 1)[-1], len(ids), int((ids == end).sum())))
            yield pd.DataFrame(out, columns=["file", "tokens", "docs"])

    ranges = _ranges(spark, path, RANGE).select("path", "start", "size")
    parts = ranges.repartition(spark.sparkContext.defaultParallelism).mapInPandas(count, "file string, tokens long, docs long")
    return parts.groupBy("file").agg(F.sum("tokens").alias("tokens"), F.sum("docs").alias("docs"))


#: The schema of examples in JSON lines: premises and query are lists there.
EXAMPLE = (
    "id string, split string, paradigm string, attribute string, entities array<string>, premises array<array<string>>, query array<string>, answer_rel string, answer_text string, cot_text string, "
    "text string, distractors array<array<string>>"
)


def examples(spark: SparkSession, path: str) -> DataFrame:
    """Reasoning examples of JSON lines, blank lines left out, with premises as structs (s, rel, o) and the query as (x, y)."""
    rows = spark.read.schema(EXAMPLE).json(path).where("id is not null or text is not null")
    premise = lambda p: F.struct(F.get(p, F.lit(0)).alias("s"), F.get(p, F.lit(1)).alias("rel"), F.get(p, F.lit(2)).alias("o"))
    return rows.withColumn("premises", F.transform("premises", premise)).withColumn("query", F.struct(F.get("query", F.lit(0)).alias("x"), F.get("query", F.lit(1)).alias("y")))


#: The reader of files by their ending; others are read as lines.
READERS = {"jsonl": json_lines, "json": json_lines, "csv": csv, "parquet": parquet}


def texts(spark: SparkSession, *paths: str) -> DataFrame:
    """(doc_id, text) of files of any kind, by their endings (.txt, .jsonl, .csv, .parquet)."""
    out = None
    for path in paths:
        part = READERS.get(path.rstrip("/").rsplit(".", 1)[-1].lower(), lines)(spark, path)
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no files")
    return out


def crawled(spark: SparkSession, folder: str, source: str, most: int | None = None) -> DataFrame:
    """(doc_id, text) of what a crawler has written for a source, crawler_<source>.jsonl, in order, up to a limit; nothing where there is no such file."""
    rows = spark.read.schema("doc_id string, url string, text string").option("pathGlobFilter", f"crawler_{source}.jsonl").json(folder)
    rows = rows.where(T.strip(F.col("text")) != "").select("doc_id", "text")
    return rows if most is None else rows.orderBy("doc_id").limit(most)
