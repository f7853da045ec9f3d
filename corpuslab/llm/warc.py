"""WARC archives in seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each with some records, and a skippable frame with a seek table at its end
(compressed and decompressed size of each frame, as the seekable format lays down). An index maps a record's id to its
bundle, its frame, and its offset and length in the decompressed frame, so that one record costs one frame. Equal payloads of at least
SMALL bytes are kept once: the others are revisit records that refer to it.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuslab.llm.common import drop_table, utf8, written
from corpuslab.session import in_arrow

#: Payloads of fewer bytes are always written in full.
SMALL = 1000
#: Decompressed bytes from which a frame ends, and compressed bytes from which a bundle ends.
FRAME_BYTES, BUNDLE_BYTES = 256 << 10, 4 << 20
#: Fixed values of the seekable format and of WARC.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"

BUNDLES = "bundle string, content binary, records array<struct<record_id: string, frame: int, offset: long, length: long>>"


def record_id(page_id: int | None, copy: int = 0) -> str:
    """The name of a page's record; rows that share a page_id (or have none) are told apart by their number among them, from 0."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}' if not copy else f'page:{page_id}:{copy}')}>"


def seek_table(sizes: list[tuple[int, int]]) -> bytes:
    body = b"".join(struct.pack("<II", c, d) for c, d in sizes) + struct.pack("<IBI", len(sizes), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def read_seek_table(content: bytes) -> list[tuple[int, int, int]]:
    """Of each frame: where it starts, its compressed and its decompressed size."""
    n, flags, magic = struct.unpack("<IBI", content[-9:])
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    entry = 12 if flags & 0x80 else 8
    at, table, out = len(content) - 9 - n * entry, 0, []
    for i in range(n):
        c, d = struct.unpack("<II", content[at + i * entry : at + i * entry + 8])
        out.append((table, c, d))
        table += c
    return out


def frame_of(content: bytes, table: list[tuple[int, int, int]], frame: int) -> bytes:
    start, size, raw = table[frame]
    return zstandard.ZstdDecompressor().decompress(content[start : start + size], max_output_size=max(raw, 1))


def warc_record(page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: int | None, kind: str, copy: int = 0) -> bytes:
    head = [b"WARC/1.1", b"WARC-Type: " + kind.encode(), b"WARC-Record-ID: " + record_id(page_id, copy).encode(), b"WARC-Date: " + DATE.encode()]
    if url:
        head.append(b"WARC-Target-URI: " + utf8("".join(url.split())))
    if page_id is not None:
        head.append(b"X-Page-ID: " + str(page_id).encode())
    head += [b"WARC-Payload-Digest: sha1:" + digest.encode(), b"X-Payload-Bytes: " + str(size).encode()]
    if kind == "revisit":
        head += [b"WARC-Profile: " + PROFILE.encode(), b"WARC-Refers-To: " + record_id(refers_to).encode(), b"X-Refers-To-Page-ID: " + str(refers_to).encode()]
        payload = b""
    head += [b"Content-Type: text/html; charset=utf-8", b"Content-Length: " + str(len(payload)).encode()]
    return b"\r\n".join(head) + b"\r\n\r\n" + payload + b"\r\n\r\n"


def parse_records(data: bytes) -> Iterator[tuple[dict[bytes, bytes], bytes]]:
    """Headers and body of each record of decompressed bytes."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].split(b"\r\n")
        if not lines[0].startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        head = dict(x.split(b": ", 1) for x in lines[1:])
        body = end + 4
        size = int(head[b"Content-Length"])
        yield head, data[body : body + size]
        at = body + size + 4


class _Bundle:
    def __init__(self) -> None:
        self.packer = zstandard.ZstdCompressor(level=3)
        self.frames, self.sizes, self.records, self.now, self.held = [], [], [], [], 0

    def add(self, key: str, record: bytes) -> None:
        self.records.append((key, len(self.frames), self.held, len(record)))
        self.now.append(record)
        self.held += len(record)
        if self.held >= FRAME_BYTES:
            self.end_frame()

    def end_frame(self) -> None:
        if self.now:
            frame = self.packer.compress(b"".join(self.now))
            self.frames.append(frame)
            self.sizes.append((len(frame), self.held))
            self.now, self.held = [], 0

    def row(self) -> dict:
        self.end_frame()
        content = b"".join(self.frames) + seek_table(self.sizes)
        return {"bundle": hashlib.md5(content).hexdigest(), "content": content, "records": [{"record_id": k, "frame": f, "offset": o, "length": n} for k, f, o, n in self.records]}

    def full(self) -> bool:
        return sum(map(len, self.frames)) >= BUNDLE_BYTES


_ROW = pa.schema([("bundle", pa.string()), ("content", pa.binary()), ("records", pa.list_(pa.struct([("record_id", pa.string()), ("frame", pa.int32()), ("offset", pa.int64()), ("length", pa.int64())])))])


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bundle = _Bundle()
    for batch in batches:
        columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("page_id", "url", "html", "digest", "size", "refers_to", "copy")]
        for page_id, url, html, digest, size, refers_to, copy in zip(*columns, strict=True):
            kind = "response" if refers_to is None else "revisit"
            bundle.add(record_id(page_id, copy), warc_record(page_id, url, html or b"", digest, size, refers_to, kind, copy))
            if bundle.full():
                yield pa.RecordBatch.from_pylist([bundle.row()], _ROW)
                bundle = _Bundle()
    if bundle.records:
        yield pa.RecordBatch.from_pylist([bundle.row()], _ROW)


def planned(pages: DataFrame, small: int = SMALL) -> DataFrame:
    """pages with digest, size, refers_to (null for a response) and copy: of equal payloads of at least `small` bytes the row with the largest
    page_id is the response. Rows that repeat its page_id are responses too; a payload that stands on rows without page_id alone is always one. copy numbers rows of one page_id."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string").cast("binary"), F.lit(b"")).alias("html"))
    rows = rows.withColumn("digest", F.unhex(F.sha1("html"))).withColumn("size", F.octet_length("html").cast("long"))
    # what is shared is told on narrow rows, of which each task sends one for a payload; a payload that no other row has is not among them
    kept = rows.where(F.col("size") >= small).groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count("*").alias("rows")).where("rows > 1").select(F.col("digest").alias("_digest"), "keeper")
    met = rows.join(kept, F.col("digest") == F.col("_digest"), "left")
    whole = F.coalesce(F.col("page_id") == F.col("keeper"), F.col("keeper").isNull())
    out = met.select("page_id", "url", F.when(whole, F.col("html")).otherwise(F.lit(b"")).alias("html"), F.lower(F.hex("digest")).alias("digest"), "size", F.when(F.col("page_id").eqNullSafe(F.col("keeper")), F.lit(None)).otherwise(F.col("keeper")).alias("refers_to"))
    # page_ids that repeat are looked for on narrow rows; pages are dealt out for their numbers only where there are some
    twice, _ = written(rows.groupBy("page_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("page_id").alias("_page")), "repeated")
    if not twice.limit(1).count():
        return out.withColumn("copy", F.lit(0).cast("long"))
    marked = out.join(twice, F.col("page_id").eqNullSafe(F.col("_page")), "left_semi")
    copies = marked.withColumn("copy", (F.row_number().over(Window.partitionBy("page_id").orderBy("digest", "url")) - 1).cast("long"))
    return out.join(twice, F.col("page_id").eqNullSafe(F.col("_page")), "left_anti").withColumn("copy", F.lit(0).cast("long")).unionByName(copies)


def write_bundles(pages: DataFrame, small: int = SMALL) -> tuple[DataFrame, str]:
    """A row for each bundle, its name, its bytes, and the index of its records, as a written table and its path: what names a bundle is written once with what it holds.

    Null html is an empty payload; repeated rows are records of their own; an empty table has no bundles.
    """
    return written(in_arrow(planned(pages, small), _write, BUNDLES), "warc")


def _archived(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            paths = []
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                path, held = f"{folder}/{name}.warc.zst", f"{folder}/.{uuid.uuid4().hex}"
                system, at = fs.FileSystem.from_uri(held)
                with system.open_output_stream(at) as file:
                    file.write(content.as_buffer())
                system.move(at, fs.FileSystem.from_uri(path)[1])
                paths.append(path)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(paths, pa.string())], ["bundle", "path"])

    return run


def write_files(bundles: DataFrame, folder: str) -> DataFrame:
    """Bundles as files <name>.warc.zst in a folder that executors and driver share (a URI that pyarrow can write to): seekable, and whole for any reader of Zstandard. Returns the index of
    records with each file's path. A task that runs again writes the same names with the same bytes."""
    spark = bundles.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(at)
    paths, _ = written(in_arrow(bundles.select("bundle", "content"), _archived(folder.rstrip("/")), "bundle string, path string"), "archives")
    return record_index(bundles).join(paths, "bundle")


def fetch_from(path: str, frame: int, offset: int, length: int) -> tuple[dict[bytes, bytes], bytes]:
    """One record of a file by its place in the index: reads the seek table at the file's end and one frame."""
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(path)
    with system.open_input_file(name) as file:
        size = file.size()
        frames = struct.unpack("<I", file.read_at(4, size - 9))[0]
        table = read_seek_table(file.read_at(frames * 12 + 17, max(0, size - frames * 12 - 17)))
        start, packed, raw = table[frame]
        data = zstandard.ZstdDecompressor().decompress(file.read_at(packed, start), max_output_size=max(raw, 1))
    return next(parse_records(data[offset : offset + length]))


def record_index(bundles: DataFrame) -> DataFrame:
    return bundles.select("bundle", F.explode("records").alias("r")).select("r.record_id", "bundle", "r.frame", "r.offset", "r.length")


def fetch(content: bytes, frame: int, offset: int, length: int) -> tuple[dict[bytes, bytes], bytes]:
    """One record by its place in the index: decompresses its frame alone."""
    return next(parse_records(frame_of(content, read_seek_table(content), frame)[offset : offset + length]))


_RECORD = "record_id string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
_TYPES = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())


def _row(head: dict[bytes, bytes], body: bytes) -> tuple:
    page, refers, kind = head.get(b"X-Page-ID"), head.get(b"X-Refers-To-Page-ID"), head[b"WARC-Type"].decode()
    own = kind == "response"
    size = len(body) if own else int(head[b"X-Payload-Bytes"])
    return head[b"WARC-Record-ID"].decode(), None if page is None else int(page), size, head[b"WARC-Payload-Digest"].decode().removeprefix("sha1:"), kind, None if refers is None else int(refers), body if own else None


def _rows(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(_TYPES)], [c.split()[0] for c in _RECORD.split(", ")])


def _fetched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bundles with the places that are wanted of them, sorted by frame: a frame is decompressed once, and frames without a wanted record are not."""
    for batch in batches:
        for content, places in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            content = content.as_py()
            table, held, data, out = read_seek_table(content), -1, b"", []
            for place in places:
                if place["frame"] != held:
                    held, data = place["frame"], frame_of(content, table, place["frame"])
                    if out:
                        yield _rows(out)
                        out = []
                out.append(_row(*next(parse_records(data[place["offset"] : place["offset"] + place["length"]]))))
            if out:
                yield _rows(out)


def fetch_records(bundles: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """The records of wanted (record_id), or of all, by the index: places are found and sorted by bundle, and each bundle's frames are read at those places alone. Ids that no record has give none."""
    places = record_index(bundles)
    if wanted is not None:
        places = places.join(wanted.select("record_id").distinct(), "record_id", "left_semi")
    grouped = places.groupBy("bundle").agg(F.array_sort(F.collect_list(F.struct("frame", "offset", "length"))).alias("places"))  # as many as a bundle has records, which its size bounds
    return in_arrow(bundles.select("bundle", "content").join(grouped, "bundle").select("content", "places"), _fetched, _RECORD)


def read_bundles(bundles: DataFrame) -> DataFrame:
    """A row for each record: record_id, page_id, payload_bytes, payload_digest (of the full payload), record_type, refers_to, payload (null for a revisit), found by the index that stands with each bundle."""
    return in_arrow(bundles.select("content", F.array_sort(F.transform("records", lambda r: F.struct(r["frame"], r["offset"], r["length"]))).alias("places")), _fetched, _RECORD)


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes the archives to the shared folder and reads them back by their index: digests of responses are taken anew from what was read. An empty table gives no rows."""
    bundles, path = write_bundles(pages)
    rows = read_bundles(bundles)
    out = rows.select("page_id", "payload_bytes", F.when(F.col("payload").isNotNull(), F.sha1("payload")).otherwise(F.col("payload_digest")).alias("payload_digest"), "record_type", "refers_to")
    result, _ = written(out, "records")
    drop_table(pages.sparkSession, path)
    return result
