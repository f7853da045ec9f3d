"""Token ids as ORC files.

Documents are dealt out by ranges of doc_id and written in ascending order, a row each: position in the file, doc_id, ids. ORC keeps
integers run-length encoded, an index entry for each INDEX_ROWS rows, and Bloom filters of doc_id, so that stripes are read
in parallel and those without a wanted document are passed over. Part numbers ascend with doc_id: what stands before a file is
a sum over files, and what stands before a row a sum within its file.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpuslab.llm.bpe import AT_ONCE, Pieces, flat_ids, uncollected
from corpuslab.llm.common import drop_table, new_path, partitions, written
from corpuslab.session import in_arrow

INDEX_ROWS = 1000
#: Pieces whose ids a worker keeps in each half of its memory, and pieces in one call of the library.
KNOWN_PIECES, PIECES = 250_000, 100
OPTIONS = {"compression": "lz4", "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.row.index.stride": str(INDEX_ROWS), "orc.create.index": "true", "orc.encoding.strategy": "COMPRESSION", "orc.stripe.size": str(32 << 20)}


_PIECES: dict[str, Pieces] = {}


def library_pieces(path: str) -> Pieces:
    """The worker's memory of what the library makes of pieces: the bytes of their ids.

    This tokenizer drops white space and never looks across it, so runs without any encode on their own.
    """
    if path not in _PIECES:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        library = Tokenizer.from_file(path)
        library.no_truncation()
        library.no_padding()
        mark = next((t for t in library.get_added_tokens_decoder().values() if t.special and not t.normalized), None)
        mark_id = None if mark is None else library.token_to_id(mark.content)
        specials = [t.content for t in library.get_added_tokens_decoder().values()]

        def encode(new: list[str]) -> dict[str, bytes]:
            """Many pieces to a call, with a special token between them, which the library never joins to its neighbours."""
            every = "\n".join(new)
            odd = set(new) if mark is None else {x for s in specials if s in every for x in new if s in x}
            plain = [x for x in new if x not in odd] if odd else new
            out = {x: np.array(library.encode(x, add_special_tokens=False).ids, np.int32).tobytes() for x in odd}
            groups = [plain[i : i + PIECES] for i in range(0, len(plain), PIECES)]
            for group, e in zip(groups, library.encode_batch_fast([mark.content.join(g) for g in groups], add_special_tokens=False) if groups else [], strict=True):
                ids = np.array(e.ids, np.int32)
                ends = (np.flatnonzero(ids == mark_id) * 4).tolist()
                raw = ids.tobytes()
                out.update(zip(group, [raw[a:b] for a, b in zip([0, *[x + 4 for x in ends]], [*ends, len(raw)], strict=True)], strict=True))
            return out

        _PIECES[path] = Pieces(encode, KNOWN_PIECES)
    return _PIECES[path]


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches put together until they hold enough text to be worth a turn."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= AT_ONCE:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _encode(path: str, end_id: int | None):
    @uncollected
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, position = library_pieces(path), 0
        for batch in gathered(batches):
            at = 0
            for values, runs, ends in known.texts(batch.column(1)):
                ids, offsets = flat_ids(values, runs, ends, end_id)
                n = len(ends) - 1
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(position, position + n)), batch.column(0).slice(at, n), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))], ["position", "doc_id", "ids"])
                position += n
                at += n
            pa.default_memory_pool().release_unused()

    return run


def write_orc(docs: DataFrame, path: str, out: str, end_id: int | None = 2) -> None:
    """Encodes docs (doc_id, text) and writes the files to the folder `out`. Null texts are empty; rows with a null doc_id come first,
    and rows with the same doc_id in the order of their texts. An empty table gives files without rows."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    dealt = rows.repartitionByRange(partitions(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id", "text")
    in_arrow(dealt, _encode(path, end_id), "position long, doc_id long, ids array<int>").write.options(**OPTIONS).orc(out)


def read_orc(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema("position long, doc_id long, ids array<int>").orc(out)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(3)
        flat, offsets = lists.values.to_numpy().astype("<i4", copy=False), lists.offsets.to_numpy()
        crcs = [zlib.crc32(flat[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(np.diff(offsets).astype(np.int64)), pa.array(crcs, pa.int64())], ["file", "position", "doc_id", "n_tokens", "ids_crc32"])


def token_index(spark: SparkSession, out: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every row of the files, read back from them."""
    rows = read_orc(spark, out).select(F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("int").alias("file"), "position", "doc_id", "ids")
    read, read_at = written(in_arrow(rows, _sums, "file int, position long, doc_id long, n_tokens long, ids_crc32 long"), "sums")
    # a row per file, of which there are as many as partitions
    files = read.groupBy("file").agg(F.sum("n_tokens").alias("total"))
    before = files.select("file", (F.sum("total").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, 0)) - F.col("total")).alias("before"))
    inside = F.sum("n_tokens").over(Window.partitionBy("file").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_tokens")
    out_rows = read.withColumn("inside", inside).join(F.broadcast(before), "file").select("doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")
    result, _ = written(out_rows, "index")
    drop_table(spark, read_at)
    return result


def round_trip(docs: DataFrame, path: str, end_id: int = 2) -> DataFrame:
    """Writes the files to the shared folder, reads them back into token_index(), and removes them."""
    out = new_path(docs.sparkSession, "orc")
    write_orc(docs, path, out, end_id)
    result = token_index(docs.sparkSession, out)
    drop_table(docs.sparkSession, out)
    return result
