"""MinHash near-duplicates with an LSH forest.

A document's set holds the hashes of its distinct word shingles. Documents with equal sets form one class. A forest
of TREES signature orders is made for one member of each class: a tree's label is a sequence of minima. A region holds
all classes with the same first DEPTH minima; those of a region that agree in most of the deeper minima make loose
clusters. In a small region each is compared with each; a larger one is sorted by every three of the deeper minima that
such a pair may share, and where a run of these is long too, all of it is joined. Inside a loose cluster full sets are
compared exactly, in blocks of bounded size, and only the links of a spanning forest are kept.

At a similarity of 0.8 a pair shares a region in 0.41 and passes the deeper test in 0.94 of 32 trees. Trees share their
minima, so that they do not miss a pair independently: of 20 million simulated pairs of that similarity 27 meet in no
tree, however many others are in their regions.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.llm.common import M1, Forest, WordHashes, components, drop_table, free_names, join_hash, mix, partitions, text_rows, utf8, written
from corpuslab.session import in_arrow

TREES, DEPTH = 32, 4
#: Deeper minima in a label, how many of them neighbours must share, and rows of a region up to which each is compared with each.
DEEP, AGREE, SMALL = 8, 5, 32
#: Of any five of the eight deeper minima three are in the same half, so one of these is among them.
TRIPLES = [t for half in (range(4), range(4, 8)) for t in itertools.combinations(half, 3)]
#: Shingles of the documents in one block of a cluster; a task holds two blocks.
BLOCK_SHINGLES = 1_000_000

_rng = np.random.default_rng(20240229)
_A = _rng.integers(1, 2**32, TREES * DEPTH, dtype=np.uint32) | np.uint32(1)
_B = _rng.integers(0, 2**32, TREES * DEPTH, dtype=np.uint32)


def shingle_set(text: str | None, size: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; of the whole sequence if there are fewer words; empty without words."""
    words = utf8(text).lower().split()  # bytes.lower changes A-Z alone
    if not words:
        return np.empty(0, np.uint64)
    w = hashes.array(words)
    n = max(len(w) - size + 1, 1)
    out = w[:n] if len(w) >= size else mix(w[:1] + np.uint64(len(w)))
    for j in range(1, min(size, len(w))):
        out = join_hash(out, w[j : j + n])
    return np.unique(out)


def signature(x: np.ndarray) -> np.ndarray:
    x32 = (x ^ (x >> np.uint64(32))).astype(np.uint32)
    out = np.full(len(_A), 2**32 - 1, np.uint32)
    for i in range(0, len(x32), 1024):
        np.minimum(out, (x32[i : i + 1024, None] * _A + _B).min(axis=0), out=out)
    return out


def labels(sigs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per signature and tree: the region (a hash of the tree and its first DEPTH minima) and a byte of each deeper minimum."""
    n = len(sigs)
    parts = sigs.reshape(n, TREES, DEPTH).astype(np.uint64)
    region = np.broadcast_to(np.arange(1, TREES + 1, dtype=np.uint64) * M1, (n, TREES)).copy()
    for j in range(DEPTH):
        region = join_hash(region, parts[:, :, j])
    low = ((sigs * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint64)
    rest = np.zeros((n, TREES), np.uint64)
    for j in range(DEEP):
        at = (np.arange(TREES) * DEPTH + DEPTH + j) % (TREES * DEPTH)
        rest = (rest << np.uint64(8)) | low[:, at]
    return region.view(np.int64), rest.view(np.int64)


def _lists(values: np.ndarray, width: int) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, values.size + 1, width, dtype=np.int32)), pa.array(values.reshape(-1)))


def _sketches(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            n, keys, sigs = [], [], []
            for text in text_rows(batch):
                x = shingle_set(text, size, hashes)
                n.append(len(x))
                keys.append(xxhash.xxh3_128_digest(x.tobytes()) if len(x) else None)
                sigs.append(signature(x))
            region, rest = labels(np.array(sigs, np.uint32).reshape(-1, TREES * DEPTH))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), _lists(region, TREES), _lists(rest, TREES)], ["doc_id", "n_shingles", "key", "region", "rest"])

    return run


def _near(keys: np.ndarray, rest: np.ndarray, rep: np.ndarray, forest: Forest) -> np.ndarray:
    """Joins all pairs in runs of equal keys, of at most SMALL rows, that agree in AGREE deeper minima; returns the rows of longer runs."""
    if not len(keys):
        return np.empty(0, np.int64)
    start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    size = np.diff(np.append(start, len(keys)))
    size, end = np.repeat(size, size), np.repeat(start + size, size)
    at = np.flatnonzero((size > 1) & (size <= SMALL))
    for lag in range(1, SMALL):
        at = at[at + lag < end[at]]
        if not len(at):
            break
        equal = ((rest[at + lag] ^ rest[at]).view(np.uint8).reshape(-1, 8) == 0).sum(1)
        hit = at[equal >= AGREE]
        for a, b in zip(rep[hit].tolist(), rep[hit + lag].tolist(), strict=True):
            forest.union(a, b)
    return np.flatnonzero(size > SMALL)


def _dense(rest: np.ndarray, rep: np.ndarray, forest: Forest) -> None:
    """The same for one region of any size: pairs that agree in AGREE of DEEP minima agree in one of TRIPLES, by which the region is sorted; long runs are joined whole."""
    parts = rest.view(np.uint8).reshape(-1, 8).astype(np.int64)
    for x, y, z in TRIPLES:
        key = parts[:, x] << 16 | parts[:, y] << 8 | parts[:, z]
        order = np.argsort(key, kind="stable")
        key, ids = key[order], rep[order]
        at = _near(key, rest[order], ids, forest)
        at = at[:-1][(np.diff(at) == 1) & (key[at[1:]] == key[at[:-1]])]
        for a, b in zip(ids[at].tolist(), ids[at + 1].tolist(), strict=True):
            forest.union(a, b)


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Labels sorted by region, each region whole, to the edges of a forest: all pairs of a region that agree in AGREE deeper minima are joined."""
    forest, held = Forest(), []

    def end(region: np.ndarray, rest: np.ndarray, rep: np.ndarray) -> None:
        at = _near(region, rest, rep, forest)
        for part in np.split(at, np.flatnonzero(np.diff(region[at])) + 1):
            if len(part):
                _dense(rest[part], rep[part], forest)

    for batch in batches:
        now = [batch.column(i).to_numpy() for i in range(3)]
        if not len(now[0]):
            continue
        if now[0][0] == now[0][-1] and (not held or held[-1][0][-1] == now[0][0]):
            held.append(now)  # the same region goes on
            continue
        # what is behind the last change of region waits for the next batch
        cut = np.searchsorted(now[0], now[0][-1])
        held.append([x[:cut] for x in now])
        end(*(np.concatenate([h[i] for h in held]) for i in range(3)))
        held = [[x[cut:] for x in now]]
    if held:
        end(*(np.concatenate([h[i] for h in held]) for i in range(3)))
    edges = list(forest.edges())
    for i in range(0, len(edges), 100_000):
        part = edges[i : i + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array([e[0] for e in part], pa.int64()), pa.array([e[1] for e in part], pa.int64())], ["a", "b"])


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            sets = [shingle_set(t, size, hashes).view(np.int64) for t in text_rows(batch)]
            offsets = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            flat = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets) if sets else np.empty(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("rep"), batch.column("cluster"), batch.column("block"), batch.column("blocks"), flat], ["rep", "cluster", "block", "blocks", "items"])

    return run


def linked_forest(reps: list[int], side: list[int], sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Spanning links among the sets: each pair that may still join two trees is compared, smallest sets first, by an inverted index.

    side: pairs of the same block are left to that block's own task when two blocks meet here.
    """
    forest, two = Forest(), len(set(side)) > 1
    order = np.argsort([len(s) for s in sets], kind="stable")
    sizes = np.array([len(sets[i]) for i in order])
    ids, where = [reps[i] for i in order], np.array([side[i] for i in order])
    flat = np.concatenate([sets[i] for i in order])
    owner = np.repeat(np.arange(len(order)), sizes)
    _, token = np.unique(flat, return_inverse=True)
    by = np.argsort(token, kind="stable")
    start = np.concatenate([[0], np.cumsum(np.bincount(token))])
    owners = owner[by]
    df = np.diff(start)
    at = np.concatenate([[0], np.cumsum(sizes)])
    out = []
    for i in range(1, len(order)):
        mine = token[at[i] : at[i + 1]]
        mine = mine[df[mine] > 1]
        if not len(mine):
            continue
        # a set that shares enough with this one shares one of its rarest items, so those alone name candidates
        wanted = sizes[i] - (percent * sizes[i] + 99) // 100 + 1 - (sizes[i] - len(mine))
        if wanted <= 0:
            continue
        rare = mine[np.argsort(df[mine], kind="stable")][:wanted]
        met = np.unique(np.concatenate([owners[start[t] : start[t + 1]] for t in rare]))
        met = met[met < i]
        met = met[sizes[met] * 100 >= percent * sizes[i]]
        if two:
            met = met[where[met] != where[i]]
        if not len(met):
            continue
        if len(met) > 8:
            every = np.concatenate([owners[start[t] : start[t + 1]] for t in mine])
            counts = np.bincount(every[every < i], minlength=i)[met]
        else:
            counts = np.array([len(np.intersect1d(sets[order[i]], sets[order[j]], assume_unique=True)) for j in met])
        for j in met[100 * counts >= percent * (sizes[i] + sizes[met] - counts)].tolist():
            if forest.union(ids[i], ids[j]):
                out.append((min(ids[i], ids[j]), max(ids[i], ids[j])))
    return out


def _links(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by (cluster, low, high): one group is one block of a cluster, or two."""
        key, group, out = None, [], []

        def end() -> None:
            if len(group) > 1:
                out.extend(linked_forest([g[0] for g in group], [g[1] for g in group], [g[2] for g in group], percent))

        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("cluster", "low", "high")), strict=True))
            reps, blocks = batch.column("rep").to_pylist(), batch.column("block").to_pylist()
            items = batch.column("items")
            flat, offsets = items.values.to_numpy(), items.offsets.to_numpy()
            for i, k in enumerate(keys):
                if k != key:
                    end()
                    key, group = k, []
                group.append((reps[i], blocks[i], flat[offsets[i] : offsets[i + 1]].copy()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([e[0] for e in out], pa.int64()), pa.array([e[1] for e in out], pa.int64())], ["a", "b"])
                out = []
        end()
        yield pa.RecordBatch.from_arrays([pa.array([e[0] for e in out], pa.int64()), pa.array([e[1] for e in out], pa.int64())], ["a", "b"])

    return run


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs (doc_id, text; further columns are ignored).

    Rows link if 100 * intersection >= percent * union of their shingle sets; component_id is the smallest doc_id
    reachable. Null and empty texts and texts of white space have empty sets and link with nothing. Rows with the same
    doc_id are one node. A row with a null doc_id links with nothing and is kept; its component_id is null. Equal texts are
    one class, however many; an empty table gives no rows.
    """
    spark, n = docs.sparkSession, partitions(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    base, base_at = written(in_arrow(texts, _sketches(shingle), "doc_id long, n_shingles long, key binary, region array<long>, rest array<long>"), "sketches")
    known = base.where("doc_id is not null and key is not null")
    classes, classes_at = written(known.groupBy("key").agg(F.min("doc_id").alias("rep"), F.first("region").alias("region"), F.first("rest").alias("rest"), F.first("n_shingles").alias("n")), "classes")
    rows = classes.select("rep", F.explode(F.arrays_zip("region", "rest")).alias("x")).select("x.region", "x.rest", "rep")
    # a region lies in one partition, so that no edge of a partition parts neighbours
    order = rows.repartition(n, "region").sortWithinPartitions("region", "rest", "rep")
    loose, loose_at = components(in_arrow(order, _neighbours, "a long, b long"))
    sized = loose.join(classes.groupBy("rep").agg(F.max("n").alias("n")), F.col("id") == F.col("rep"))
    blocks = sized.groupBy("component").agg(F.ceil(F.sum("n") / block_shingles).cast("int").alias("blocks"))
    member = sized.join(blocks, "component").select("rep", F.col("component").alias("cluster"), "blocks", F.pmod(F.xxhash64("rep"), "blocks").cast("int").alias("block"))
    # a doc_id that stands on rows with different texts is a node with several sets
    inside = texts.join(member, F.col("doc_id") == F.col("rep")).select("rep", "cluster", "block", "blocks", "text")
    sets = in_arrow(inside, _sets(shingle), "rep long, cluster long, block int, blocks int, items array<long>")
    met = sets.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)"))).select("cluster", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "rep", "block", "items")
    grouped = met.repartition(n, "cluster", "low", "high").sortWithinPartitions("cluster", "low", "high")
    same = known.join(classes.select("key", "rep"), "key").where("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    found, found_at = components(in_arrow(grouped, _links(percent), "a long, b long"))
    # ids repeated on rows with other texts tie those texts' classes together
    twice = known.groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1").select("doc_id")
    tied = same.join(twice, F.col("b") == F.col("doc_id")).select("a", "b")
    if tied.limit(1).count():
        final, final_at = components(found.select(F.col("component").alias("a"), F.col("id").alias("b")).union(tied))
        drop_table(spark, found_at)
    else:
        final, final_at = found, found_at
    classed = base.select("doc_id", "n_shingles", "key").join(classes.select("key", "rep"), "key", "left").join(final, F.col("rep") == F.col("id"), "left")
    out = classed.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("component", "rep", "doc_id")).alias("component_id"))
    result, _ = written(out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))), "near")
    drop_table(spark, base_at, classes_at, loose_at, final_at)
    return result


def drop_near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs without near-duplicates: of each group the smallest doc_id stays, and of rows that repeat a doc_id the one with the least text (nulls first; of equal texts the least hash of the other columns).

    Rows with a null doc_id stay; null and empty texts are near nothing; an empty table gives none.
    """
    near = near_duplicates(docs, shingle, percent)
    names = docs.columns
    kept_id, rows, row = free_names(names, "_kept_id", "_rows", "_row")
    keep = near.where("kept and doc_id is not null").groupBy(F.col("doc_id").alias(kept_id)).agg(F.count("*").alias(rows))
    met = docs.join(keep, docs["doc_id"].cast("long") == F.col(kept_id))
    one = met.where(F.col(rows) == 1).select(*names)
    hashed = [c for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]  # Spark has no hash for these
    least = met.where(F.col(rows) > 1).groupBy(kept_id).agg(F.min_by(F.struct(*names), F.struct(F.col("text").cast("string"), F.xxhash64(*hashed))).alias(row))
    many = least.select(*(F.col(row)[n].alias(n) for n in names))
    return one.unionByName(many).unionByName(docs.where(F.col("doc_id").cast("long").isNull()))
