"""Data sources for spark.read and spark.write: corpora by byte ranges, and files that are published when all tasks have ended.

    formats.register(spark)
    spark.read.format("corpus").load("texts/*.jsonl")                   # file, offset, and the fields of the first records
    spark.read.format("corpus").schema("text string").load("texts")     # that column alone is made
    rows.write.format("byte_parts").mode("overwrite").option("suffix", ".bin").save("out")   # rows (data binary)

Paths are of file systems that the driver and the executors share and pyarrow can open.
"""

from __future__ import annotations

import csv
import io
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatch
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as D
from pyspark.sql import functions as F
from pyspark.sql import types as t

from corpuslab.session import ship

#: Bytes of a file that a task reads at a time, and bytes from a first file's beginning by which columns are found.
RANGE, HEAD = 32 << 20, 1 << 20
#: What a row of a corpus is named by: its file, and where in it the row begins (in Parquet files its number).
PLACE = [t.StructField("file", t.StringType()), t.StructField("offset", t.LongType())]


def system_of(path: str) -> tuple[Any, str]:
    """pyarrow's file system of a path, and the path's name there. A path without a scheme is local."""
    from pyarrow import fs

    if "://" not in path:
        path = "file://" + path.removeprefix("file:")
    return fs.FileSystem.from_uri(path)


def listed(path: str) -> list[tuple[str, int]]:
    """(name, bytes) of the files that a path names: one, those of a folder, or those whose names fit a pattern in the last part; names that begin with a dot or an underscore do not count."""
    from pyarrow import fs

    folder, _, last = path.rstrip("/").rpartition("/")
    if any(c in last for c in "*?["):
        system, top = system_of(folder)
        found = [i for i in system.get_file_info(fs.FileSelector(top)) if fnmatch(i.base_name, last)]
    else:
        system, top = system_of(path)
        info = system.get_file_info(top)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(path)
        found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(top, recursive=True))
    return sorted((i.path, i.size) for i in found if i.type == fs.FileType.File and i.base_name[0] not in "._")


def whole_lines(file, start: int, end: int, size: int) -> Iterator[tuple[int, bytes]]:
    """(offset, line) of the lines that begin in a range of an open file, without their ends; the last one goes on to its end."""
    file.seek(max(0, start - 1))
    held, at = file.read(end - max(0, start - 1)), max(0, start - 1)
    if start:  # the line that the range begins in is another one's, unless it ended just before
        first = held.find(b"\n")
        if first < 0 or at + first + 1 >= end:
            return
        held, at = held[first + 1 :], at + first + 1
    while not held.endswith(b"\n") and at + len(held) < size:
        more = file.read(HEAD)
        line_end = more.find(b"\n")
        held += more if line_end < 0 else more[: line_end + 1]
    for line in held.splitlines(keepends=True) if b"\r" not in held else (x + b"\n" for x in held.split(b"\n")):
        if at < min(end, size):
            yield at, line.rstrip(b"\r\n")
        at += len(line)


_KINDS = {"txt": "lines", "jsonl": "jsonl", "json": "jsonl", "csv": "csv", "parquet": "parquet"}


@dataclass
class Part(D.InputPartition):
    file: str
    start: int
    end: int
    size: int


class CorpusReader(D.DataSourceReader):
    """Reads ranges of lines and JSON lines, row groups of Parquet files, and whole CSV files (scan.csv() splits these). Filters on file and offset leave files and ranges out, and those on text leave rows out before they are made."""

    def __init__(self, path: str, kind: str, schema: t.StructType, range_bytes: int) -> None:
        self.path, self.kind, self.schema, self.range_bytes = path, kind, schema, range_bytes
        self.pushed: list[tuple[str, str, Any]] = []

    _TESTS = {
        D.EqualTo: lambda a, b: a == b, D.GreaterThan: lambda a, b: a > b, D.GreaterThanOrEqual: lambda a, b: a >= b, D.LessThan: lambda a, b: a < b, D.LessThanOrEqual: lambda a, b: a <= b,
        D.In: lambda a, b: a in b, D.StringStartsWith: lambda a, b: a.startswith(b), D.StringEndsWith: lambda a, b: a.endswith(b), D.StringContains: lambda a, b: b in a,
    }

    def pushFilters(self, filters):
        for f in filters:
            name, column = type(f).__name__, ".".join(getattr(f, "attribute", ()))
            if type(f) in self._TESTS and column in ("file", "offset", "text"):
                self.pushed.append((name, column, f.value))
            else:
                yield f

    def _fits(self, column: str, value: Any) -> bool:
        by_name = {kind.__name__: test for kind, test in self._TESTS.items()}
        return all(value is not None and by_name[name](value, wanted) for name, c, wanted in self.pushed if c == column)

    def partitions(self) -> list[Part]:
        lowest = max([0, *(v for name, c, v in self.pushed if c == "offset" and name in ("GreaterThan", "GreaterThanOrEqual", "EqualTo"))])
        highest = min([1 << 62, *(v for name, c, v in self.pushed if c == "offset" and name in ("LessThan", "LessThanOrEqual", "EqualTo"))])
        out = []
        for file, size in listed(self.path):
            if not self._fits("file", file.rsplit("/", 1)[-1]):
                continue
            if self.kind == "parquet":
                import pyarrow.parquet as pq

                meta, row = pq.read_metadata(file, filesystem=system_of(self.path)[0]), 0
                for g in range(meta.num_row_groups):
                    out.append(Part(file, row, row + meta.row_group(g).num_rows, g))
                    row += meta.row_group(g).num_rows
            else:
                step = size if self.kind == "csv" else self.range_bytes
                out += [Part(file, a, min(size, a + step), size) for a in range(0, size, max(1, step))]
        return [p for p in out if p.start <= highest and p.end > lowest] or [Part("", 0, 0, 0)]

    def read(self, part: Part) -> Iterator[tuple]:
        if not part.file:
            return
        name = part.file.rsplit("/", 1)[-1]
        at = {f.name: f for f in self.schema.fields}
        for offset, row in self._rows(part):
            if self._fits("offset", offset) and ("text" not in row or self._fits("text", row["text"])):
                yield tuple(name if c == "file" else offset if c == "offset" else _as(row.get(c), at[c].dataType) for c in at)

    def _rows(self, part: Part) -> Iterator[tuple[int, dict]]:
        system = system_of(self.path)[0]
        if self.kind == "parquet":
            import pyarrow.parquet as pq

            wanted = [f.name for f in self.schema.fields if f.name not in ("file", "offset")] + [c for _, c, _ in self.pushed if c == "text"]
            with system.open_input_file(part.file) as file:
                stored = pq.ParquetFile(file)
                row = part.start
                for batch in stored.iter_batches(1000, row_groups=[part.size], columns=sorted(set(wanted) & set(stored.schema_arrow.names))):
                    for values in batch.to_pylist() if batch.num_columns else [{}] * batch.num_rows:
                        yield row, values
                        row += 1
            return
        with system.open_input_file(part.file) as file:
            if self.kind == "csv":
                csv.field_size_limit((1 << 31) - 1)
                rows = csv.reader(io.TextIOWrapper(file, "utf-8", "replace", newline=""))
                names = next(rows, [])
                yield from ((i, dict(zip(names, r, strict=False))) for i, r in enumerate(rows) if r)
                return
            for offset, line in whole_lines(file, part.start, part.end, part.size):
                if self.kind == "lines":
                    yield offset, {"text": line.decode("utf-8", "replace")}
                    continue
                try:
                    record = json.loads(line) if line.strip() else None
                except ValueError:
                    continue
                if isinstance(record, dict):
                    yield offset, record


def _as(value: Any, kind: t.DataType) -> Any:
    """A value as a column's type, null where it does not fit."""
    if value is None or isinstance(kind, (t.ArrayType, t.StructType, t.MapType, t.BinaryType)):
        return value
    try:
        if isinstance(kind, t.StringType):
            return value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)
        if isinstance(kind, t.BooleanType):
            return value if isinstance(value, bool) else None
        if isinstance(kind, t.IntegralType):
            return int(value)
        return float(value) if isinstance(kind, (t.DoubleType, t.FloatType)) else value
    except (TypeError, ValueError):
        return None


class CorpusSource(D.DataSource):
    """Options: path; kind (lines, jsonl, csv, parquet; else by the first file's ending); range_bytes."""

    @classmethod
    def name(cls) -> str:
        return "corpus"

    def _kind(self) -> str:
        files = listed(self.options["path"])
        ending = files[0][0].rsplit(".", 1)[-1].lower() if files else "txt"
        return self.options.get("kind") or _KINDS.get(ending, "lines")

    def schema(self) -> t.StructType:
        files, kind = listed(self.options["path"]), self._kind()
        if kind == "lines" or not files:
            return t.StructType([*PLACE, t.StructField("text", t.StringType())])
        system = system_of(self.options["path"])[0]
        if kind == "parquet":
            import pyarrow.parquet as pq
            from pyspark.sql.pandas.types import from_arrow_schema

            found = from_arrow_schema(pq.read_schema(files[0][0], filesystem=system)).fields
        else:
            with system.open_input_file(files[0][0]) as file:
                head = file.read(HEAD)
            if kind == "csv":
                found = [t.StructField(c, t.StringType()) for c in next(csv.reader(io.StringIO(head.decode("utf-8", "replace"), newline="")), [])]
            else:
                found = _fields(head, files[0][1] > HEAD)
        return t.StructType([*PLACE, *(f for f in found if f.name not in ("file", "offset"))])

    def reader(self, schema: t.StructType) -> CorpusReader:
        return CorpusReader(self.options["path"], self._kind(), schema, int(self.options.get("range_bytes", RANGE)))


def _fields(head: bytes, cut: bool) -> list[t.StructField]:
    """Fields of the JSON records at a file's beginning: numbers, truth values and strings as they are; of mixed kinds, lists and objects as strings."""
    kinds: dict[str, set] = {}
    for line in head.split(b"\n")[: -1 if cut else None]:
        try:
            record = json.loads(line) if line.strip() else None
        except ValueError:
            continue
        for k, v in record.items() if isinstance(record, dict) else ():
            kinds.setdefault(k, set()).update(() if v is None else (type(v),))
    known = {frozenset((bool,)): t.BooleanType(), frozenset((int,)): t.LongType(), frozenset((float,)): t.DoubleType(), frozenset((int, float)): t.DoubleType()}
    return [t.StructField(k, known.get(frozenset(v), t.StringType())) for k, v in kinds.items()]


# ---------------------------------------------------------------- writing


@dataclass
class Staged(D.WriterCommitMessage):
    part: int
    path: str
    bytes: int
    rows: int


class PartsWriter(D.DataSourceArrowWriter):
    """Each task writes its rows' bytes, in their order, to a file of its own in a hidden folder. Only when all have ended are the files of those that count moved to part-<n>, and index.jsonl says last what there is.

    A task that fails, or runs twice, leaves nothing but hidden files. They go when the write ends; those of tasks that are killed later than that go with the next write that replaces the folder's.
    """

    def __init__(self, path: str, suffix: str, overwrite: bool) -> None:
        self.system_path, self.suffix, self.overwrite = path.rstrip("/"), suffix, overwrite
        self.hidden = f".staged-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        from pyspark import TaskContext

        system, top = system_of(self.system_path)
        name, size, rows, file = f"{top}/{self.hidden}/{uuid.uuid4().hex}", 0, 0, None
        try:
            for batch in iterator:
                for value in batch.column(0):
                    if file is None:
                        system.create_dir(f"{top}/{self.hidden}")
                        file = system.open_output_stream(name)
                    data = value.as_py() or b""
                    file.write(data)
                    size, rows = size + len(data), rows + 1
        finally:
            if file is not None:
                file.close()
        return Staged(TaskContext.get().partitionId(), name if file is not None else "", size, rows)

    def commit(self, messages: list[Staged | None]) -> None:
        from pyarrow import fs

        system, top = system_of(self.system_path)
        system.create_dir(top)
        kept: list[dict] = []
        old = [i.path for i in system.get_file_info(fs.FileSelector(top)) if i.type == fs.FileType.File and (i.base_name.startswith("part-") or i.base_name == "index.jsonl")]
        index = f"{top}/index.jsonl"
        if self.overwrite:
            for path in sorted(old, key=lambda p: p != index):  # the index goes first, so that it never names what is not there
                system.delete_file(path)
        elif index in old:
            with system.open_input_file(index) as file:
                kept = [json.loads(line) for line in file.read().splitlines()]
        first = 1 + max((r["part"] for r in kept), default=-1)
        for number, m in enumerate(sorted((m for m in messages if m is not None and m.path), key=lambda m: m.part)):
            path = f"part-{first + number:05d}{self.suffix}"
            system.move(m.path, f"{top}/{path}")
            kept.append({"part": first + number, "path": path, "bytes": m.bytes, "rows": m.rows})
        with system.open_output_stream(f"{top}/{self.hidden}.index") as file:
            file.write("".join(json.dumps(r) + "\n" for r in kept).encode())
        system.move(f"{top}/{self.hidden}.index", index)
        self._clear(system, top)

    def abort(self, messages: list[Staged | None]) -> None:
        self._clear(*system_of(self.system_path))

    def _clear(self, system, top: str) -> None:
        from pyarrow import fs

        for info in system.get_file_info(fs.FileSelector(top, allow_not_found=True)):
            if info.type == fs.FileType.Directory and (info.base_name == self.hidden or self.overwrite and info.base_name.startswith(".staged-")):
                system.delete_dir(info.path)


class PartsSource(D.DataSource):
    """Options: path; suffix of the files. Rows have one column, data (binary); what is read back is the index: part, path, bytes, rows."""

    @classmethod
    def name(cls) -> str:
        return "byte_parts"

    def schema(self) -> str:
        return "part long, path string, bytes long, rows long"

    def reader(self, schema: t.StructType) -> IndexReader:
        return IndexReader(self.options["path"])

    def writer(self, schema: t.StructType, overwrite: bool) -> PartsWriter:
        if len(schema.fields) != 1 or not isinstance(schema.fields[0].dataType, t.BinaryType):
            raise ValueError("rows need one binary column")
        return PartsWriter(self.options["path"], self.options.get("suffix", ""), overwrite)


class IndexReader(D.DataSourceReader):
    """The index of a folder of parts; nothing where no write has ended."""

    def __init__(self, path: str) -> None:
        self.path = path.rstrip("/")

    def read(self, partition) -> Iterator[tuple]:
        system, top = system_of(self.path)
        try:
            with system.open_input_file(f"{top}/index.jsonl") as file:
                rows = [json.loads(line) for line in file.read().splitlines()]
        except FileNotFoundError:
            return
        for r in rows:
            yield r["part"], f"{self.path}/{r['path']}", r["bytes"], r["rows"]


def register(spark: SparkSession) -> None:
    """Makes the formats known to a session, and lets filters reach them."""
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (CorpusSource, PartsSource):
        spark.dataSource.register(source)


def write_parts(rows: DataFrame, path: str, suffix: str = "") -> DataFrame:
    """Writes rows (data binary), a file for each partition that has any, and returns the index (part, path, bytes, rows)."""
    spark = rows.sparkSession
    register(spark)
    rows.select(F.col("data")).write.format("byte_parts").mode("overwrite").option("suffix", suffix).save(path)
    return spark.read.format("byte_parts").load(path)
