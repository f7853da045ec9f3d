"""Data sources: ranges, pruned columns, pushed filters, and writes that end whole or not at all."""

import csv
import io
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from corpuslab.sources import formats


def load(spark, path, schema=None, **options):
    formats.register(spark)
    reader = spark.read.format("corpus").options(**{k: str(v) for k, v in options.items()})
    return (reader.schema(schema) if schema else reader).load(str(path))


@pytest.mark.parametrize("range_bytes", [1, 2, 7, 64, 10_000])
def test_lines_by_ranges(spark, tmp_path, range_bytes):
    rng = random.Random(range_bytes)
    texts = ["".join(rng.choice("abé \t") for _ in range(rng.randint(0, 12))) for _ in range(20)]
    (tmp_path / "a.txt").write_bytes("\n".join(texts).encode())
    (tmp_path / "b.txt").write_bytes(b"x\r\ny\n\n")
    (tmp_path / "_c.txt").write_bytes(b"hidden\n")
    df = load(spark, tmp_path / "*.txt", range_bytes=range_bytes)
    assert df.columns == ["file", "offset", "text"]
    got = [tuple(r) for r in df.orderBy("file", "offset").collect()]
    at, want = 0, []
    for x in texts:
        want.append(("a.txt", at, x))
        at += len(x.encode()) + 1
    if not texts[-1]:
        want.pop()
    assert got == [*want, ("b.txt", 0, "x"), ("b.txt", 3, "y"), ("b.txt", 5, "")]


def test_kinds_schemas_and_pruned_columns(spark, tmp_path):
    rows = [{"id": i, "text": f"text {i}", "share": i / 2, "list": [i], "ok": i % 2 == 0, "odd": i if i % 2 else "x"} for i in range(40)]
    (tmp_path / "a.jsonl").write_text("".join(json.dumps(r) + "\n" for r in rows) + "not json\n\n", encoding="utf-8")
    df = load(spark, tmp_path / "a.jsonl", range_bytes=100)
    assert dict(df.dtypes) == {"file": "string", "offset": "bigint", "id": "bigint", "text": "string", "share": "double", "list": "string", "ok": "boolean", "odd": "string"}
    assert [r["id"] for r in df.orderBy("offset").collect()] == list(range(40)) and df.rdd.getNumPartitions() > 10
    assert sorted(r["text"] for r in load(spark, tmp_path / "a.jsonl", "text string", range_bytes=100).collect()) == sorted(r["text"] for r in rows)
    spark.createDataFrame([(i, f"t{i}") for i in range(30)], "k long, text string").coalesce(1).write.parquet(str(tmp_path / "p"))
    stored = load(spark, tmp_path / "p")
    assert stored.columns == ["file", "offset", "k", "text"] and sorted((r["offset"], r["k"]) for r in stored.collect()) == [(i, i) for i in range(30)]
    assert sorted(r["k"] for r in load(spark, tmp_path / "p", "k long").collect()) == list(range(30))
    out = io.StringIO(newline="")
    csv.writer(out).writerows([["k", "text"], [1, 'a "b"\nc'], [2, ""]])
    (tmp_path / "c.csv").write_text(out.getvalue(), encoding="utf-8", newline="")
    assert [tuple(r) for r in load(spark, tmp_path / "c.csv").select("k", "text").collect()] == [("1", 'a "b"\nc'), ("2", "")]
    (tmp_path / "none").mkdir()
    assert load(spark, tmp_path / "none").collect() == []


def test_filters_reach_the_source(spark, tmp_path):
    for name in "ab":
        (tmp_path / f"{name}.txt").write_text("".join(f"{name}{i:03d}\n" for i in range(100)), encoding="utf-8")
    df = load(spark, tmp_path / "*.txt", range_bytes=50).where("file = 'b.txt' and offset >= 100 and text like '%7%'")
    assert sorted(r["text"] for r in df.collect()) == sorted(x for x in (f"b{i:03d}" for i in range(20, 100)) if "7" in x)
    assert df.rdd.getNumPartitions() == 8
    reader = formats.CorpusReader(str(tmp_path / "*.txt"), "lines", df.schema, 50)
    from pyspark.sql import datasource as D

    left = list(reader.pushFilters([D.EqualTo(("file",), "a.txt"), D.IsNotNull(("text",)), D.LessThan(("offset",), 50)]))
    assert [type(f) for f in left] == [D.IsNotNull] and len(reader.partitions()) == 2


def test_parts_are_published_whole(spark, tmp_path):
    rows = spark.range(40).repartitionByRange(4, "id").sortWithinPartitions("id").select(F.concat(F.col("id").cast("string"), F.lit(";")).cast("binary").alias("data"))
    index = sorted(map(tuple, formats.write_parts(rows, str(tmp_path / "out"), ".bin").collect()))
    assert "".join(open(p, encoding="utf-8").read() for _, p, *_ in index) == "".join(f"{i};" for i in range(40)) and sum(r[3] for r in index) == 40
    assert sorted(os.listdir(tmp_path / "out")) == ["index.jsonl", *(f"part-{i:05d}.bin" for i in range(4))]
    rows.write.format("byte_parts").mode("append").option("suffix", ".bin").save(str(tmp_path / "out"))
    assert spark.read.format("byte_parts").load(str(tmp_path / "out")).agg(F.sum("rows")).first()[0] == 80
    again = formats.write_parts(rows.limit(0), str(tmp_path / "out"), ".bin")
    assert again.count() == 0 and os.listdir(tmp_path / "out") == ["index.jsonl"]


def test_a_failed_task_leaves_no_part(spark, tmp_path):
    rows = spark.range(0, 40, 1, 4).select(F.when(F.col("id") == 35, F.raise_error(F.lit("lost"))).otherwise(F.lit("x")).cast("binary").alias("data"))
    formats.write_parts(spark.range(3).select(F.lit(b"old").alias("data")), str(tmp_path / "out"))
    shown = lambda: {p: (tmp_path / "out" / p).read_bytes() for p in os.listdir(tmp_path / "out") if p[0] != "."}
    before = shown()
    with pytest.raises(Exception, match="lost"):
        rows.write.format("byte_parts").mode("overwrite").save(str(tmp_path / "out"))
    assert shown() == before
    formats.write_parts(spark.range(2).select(F.lit(b"new").alias("data")), str(tmp_path / "out"))
    assert all(p[0] != "." for p in os.listdir(tmp_path / "out"))
    with pytest.raises(Exception, match="binary"):
        spark.range(3).write.format("byte_parts").mode("append").save(str(tmp_path / "other"))


@pytest.mark.parametrize("range_bytes", [1, 2, 3, 5, 11, 64, 100_000])
def test_quoted_csv_by_ranges(spark, tmp_path, range_bytes):
    """Line ends and doubled quotes in fields, at every range's edge, against the serial reader."""
    from corpuslab.sources import scan

    rng = random.Random(7)
    field = lambda: "".join(rng.choice(["a", "b", '"', "\n", ",", "é", " x", "\r\n"]) for _ in range(rng.randint(0, 9)))
    for name, rows, names in (("a.csv", 14, ["id", "text"]), ("b.csv", 6, ["article", "id"]), ("c.csv", 0, ["id", "text"])):
        out = io.StringIO(newline="")
        w = csv.writer(out, quoting=csv.QUOTE_ALL if name == "a.csv" else csv.QUOTE_MINIMAL, lineterminator="\r\n" if name == "b.csv" else "\n")
        w.writerow(names)
        w.writerows([[field(), field()] for _ in range(rows)])
        (tmp_path / name).write_bytes(out.getvalue().encode().removesuffix(b"\n" if name == "a.csv" else b""))
    got = {r["doc_id"]: r["text"] for r in scan.csv(spark, f"file://{tmp_path}/*.csv", range_bytes).collect()}
    want = {}
    for name in ("a.csv", "b.csv", "c.csv"):
        rows = list(csv.reader(io.StringIO((tmp_path / name).read_bytes().decode(), newline="")))
        at = rows[0].index("text" if "text" in rows[0] else "article")
        want |= {f"{name}#{i}": r[at].strip() for i, r in enumerate(rows[1:]) if r and r[at].strip()}
    assert got == want


@pytest.mark.parametrize("range_bytes", [7, 40, 300, 100_000])
def test_dumps_of_streams_by_ranges(spark, tmp_path, range_bytes):
    """Records that end in a later stream are read once, by the range where they begin."""
    import bz2

    from corpuslab.profiles import HINDI
    from corpuslab.sources import scan

    page = lambda i: f"<page><title>t</title><ns>{int(i % 5 == 4)}</ns><id>{i}</id>{'<redirect title=\"x\" />' if i % 7 == 6 else ''}<revision><text>राम &amp; [[x|घर]] {i}</text></revision></page>\n"
    for f in (0, 1):
        text = ("<mediawiki>\n" + "".join(page(f * 100 + i) for i in range(30)) + "</mediawiki>\n").encode()
        rng, data, at = random.Random(f), b"", 0
        while at < len(text):
            size = rng.choice([5000, 40, 900, 300])
            while b"<page>" in (edge := text[max(0, at + size - 5) : at + size + 5]) and not edge.endswith(b"<page>") and at + size < len(text):
                size += 1  # no mark is cut in two
            data += bz2.compress(text[at : at + size])
            at += size
        (tmp_path / f"{f}.xml.bz2").write_bytes(data)
    got = sorted(r["text"] for r in scan.wiki_dump(spark, f"{tmp_path}/*.bz2", HINDI, range_bytes=range_bytes).collect())
    assert got == sorted(f"राम & घर {f * 100 + i}" for f in (0, 1) for i in range(30) if (f * 100 + i) % 5 != 4 and (f * 100 + i) % 7 != 6)
    if range_bytes == 300:
        assert scan.dump_pages(spark, f"{tmp_path}/*.bz2", 300).rdd.getNumPartitions() > 2
