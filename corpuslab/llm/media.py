"""Copies of images by local descriptors.

An image is a row with its width, its height and its grey pixels. Corners are found on a pyramid of scales; around each, an orientation is taken from
the centre of brightness, and 256 pairs of smoothed pixels, turned by it, are compared: a binary descriptor that brightness and contrast leave alone.
Images meet through Hamming tables of their descriptors: each table is a sample of bits, and samples that are equal are candidates, kept if all bits are close, and
images with a few such matches are compared whole, each descriptor with each. There are more tables the wider the samples, so that images with just enough matches, all as far apart as may be, meet in all but one of a
thousand cases, whatever the number of descriptors. Between two images the matches vote for a similarity transform; those that agree with the best one are the evidence that one is a cropped or edited copy of the other.
Equal images are one class, so that a picture that stands on many rows is described and met once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.llm.common import drop_table, mix, partitions, written
from corpuslab.session import in_arrow

#: Bits that two descriptors may differ in, and matches that must agree. Of 60 pictures and five kinds of edits no true match that counted was beyond 16 bits; of descriptors of different pictures a
#: few in ten million are within 24, and 150 times as many within 36.
DISTANCE, AGREEING = 24, 10
#: A corner counts if fewer than CROWD stronger ones are within AROUND pixels of it at its scale: corners grow with the area, and a crop keeps those that it shows.
CROWD, AROUND = 13, 20
EDGE, TURNS = 9, 32
#: Transforms of a pair of images that are tried whole, those first whose surroundings have the most matches; and cells of that search: log2 of scale, angle, and pixels.
TRIED, CELL = 512, (0.5, 0.5, 16.0)
#: Matches that must meet before two images are compared whole, and the chance for a match at DISTANCE to meet: of AGREEING such matches fewer than SEEN meet in one of a thousand cases.
SEEN, MET = 3, 0.72
#: Tables that are joined at once: their shuffle files are deleted before the next ones are made.
ROUND = 5
#: Bits of the map of keys that queries ask for. It has one size whatever there is to ask, so that it can go to every task.
MAP_BITS = 1 << 24
#: Pixels by which a match may miss the transform.
SLACK = 3.0

_rng = np.random.default_rng(4711)
# the two ends are about as far along the direction of brightness (x), along which one end would nearly always be the brighter one
_ENDS = _rng.normal(0, 3.2, (256, 2, 2))
_ENDS[:, 1, 0] = _ENDS[:, 0, 0] + _rng.normal(0, 0.5, 256)
_PAIRS = np.clip(np.rint(_ENDS), -6, 6)


def _turned() -> np.ndarray:
    out = np.empty((TURNS, 256, 2, 2), np.int64)
    for t in range(TURNS):
        a = 2 * math.pi * t / TURNS
        out[t] = np.rint(_PAIRS @ np.array([[math.cos(a), math.sin(a)], [-math.sin(a), math.cos(a)]]))
    return np.clip(out, -EDGE + 1, EDGE - 1)


_PATTERN = _turned()
_DISC = [(y, x) for y in range(-7, 8) for x in range(-7, 8) if y * y + x * x <= 49]
_DY, _DX = (np.array([d[i] for d in _DISC]) for i in (0, 1))


def _box(a: np.ndarray, r: int) -> np.ndarray:
    """Sums over squares of radius r, edges repeated."""
    for axis in (0, 1):
        pad = [(r + 1, r) if i == axis else (0, 0) for i in (0, 1)]
        c = np.cumsum(np.pad(a, pad, mode="edge"), axis=axis)
        a = c[2 * r + 1 :] - c[: -2 * r - 1] if axis == 0 else c[:, 2 * r + 1 :] - c[:, : -2 * r - 1]
    return a


def uncrowded(ys: np.ndarray, xs: np.ndarray, strength: np.ndarray) -> np.ndarray:
    """Which corners, sorted by y, have fewer than CROWD stronger ones (of equal ones the earlier) within AROUND pixels: each is held against those of its own rows' stretch alone."""
    out, n = np.zeros(len(ys), bool), len(ys)
    first, last = np.searchsorted(ys, ys - AROUND), np.searchsorted(ys, ys + AROUND, side="right")
    at = 0
    while at < n:
        # as many corners as make a table of bounded size with all that are near them
        end = at + 1
        while end < n and (end + 1 - at) * (last[end] - first[at]) <= 500_000:
            end += 1
        near = slice(first[at], last[end - 1])
        me = np.arange(at, end)
        close = (np.abs(xs[near][None] - xs[me][:, None]) <= AROUND) & (np.abs(ys[near][None] - ys[me][:, None]) <= AROUND)
        stronger = (strength[near][None] > strength[me][:, None]) | ((strength[near][None] == strength[me][:, None]) & (np.arange(n)[near][None] < me[:, None]))
        out[at:end] = (close & stronger).sum(1) < CROWD
        at = end
    return out


def describe_image(pixels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (x, y, scale, angle; in pixels of the given image) and packed descriptors (32 bytes each) of a grey image, at as many scales, each half as large, as it has room for."""
    places, bits, image, scale = [], [], pixels.astype(float), 1
    while min(image.shape) >= 2 * EDGE + 3:
        h, w = image.shape
        smooth = _box(image, 1) / 9
        gy, gx = np.gradient(smooth)
        xx, yy, xy = _box(gx * gx, 2), _box(gy * gy, 2), _box(gx * gy, 2)
        response = xx * yy - xy * xy - 0.05 * (xx + yy) ** 2
        inner = response[EDGE : h - EDGE, EDGE : w - EDGE]
        peak = inner > max(1e-6, 1e-4 * response.max())
        for dy in (-1, 0, 1):
            for dx in (-1, 0, 1):
                if dy or dx:
                    peak &= inner >= response[EDGE + dy : h - EDGE + dy, EDGE + dx : w - EDGE + dx]
        ys, xs = np.nonzero(peak)
        if len(ys):
            kept = uncrowded(ys, xs, inner[ys, xs])
            ys, xs = ys[kept] + EDGE, xs[kept] + EDGE
            for i in range(0, len(ys), 2000):  # a few megabytes at a time
                y, x = ys[i : i + 2000], xs[i : i + 2000]
                disc = smooth[y[:, None] + _DY, x[:, None] + _DX]
                angle = np.arctan2((disc * _DY).sum(1), (disc * _DX).sum(1))
                turn = np.rint(angle / (2 * math.pi) * TURNS).astype(int) % TURNS
                at = _PATTERN[turn]
                a = smooth[y[:, None] + at[:, :, 0, 1], x[:, None] + at[:, :, 0, 0]]
                b = smooth[y[:, None] + at[:, :, 1, 1], x[:, None] + at[:, :, 1, 0]]
                bits.append(np.packbits(a < b, axis=1))
                places.append(np.stack([(x + 0.5) * scale, (y + 0.5) * scale, np.full(len(x), float(scale)), angle], 1))
        image = image[: h // 2 * 2, : w // 2 * 2].reshape(h // 2, 2, w // 2, 2).mean((1, 3))
        scale *= 2
    if not places:
        return np.empty((0, 4)), np.empty((0, 32), np.uint8)
    return np.concatenate(places), np.concatenate(bits)


def table_bits(descriptors: int) -> int:
    """Bits in a table's key: a few more than it takes to number the descriptors, so that chance meetings stay in proportion to them."""
    return min(60, max(12, math.ceil(math.log2(max(2, descriptors))) + 2))


def meeting(width: int) -> float:
    """The chance that two descriptors DISTANCE bits apart have the same key of so many bits, drawn from 256."""
    return math.comb(256 - DISTANCE, width) / math.comb(256, width)


def table_count(width: int) -> int:
    """Tables by which two descriptors DISTANCE bits apart meet with the chance MET: the wider the keys, the more."""
    return math.ceil(math.log1p(-MET) / math.log1p(-meeting(width)))


def _keys(packed: np.ndarray, width: int, tables: range) -> np.ndarray:
    """A key of each descriptor in each of the tables; the table's number is mixed in."""
    bits = np.unpackbits(packed, axis=1)
    out = np.empty((len(bits), len(tables)), np.uint64)
    for j, k in enumerate(tables):
        padded = np.zeros((len(bits), 64), np.uint8)
        padded[:, :width] = bits[:, np.random.default_rng([99, k]).permutation(256)[:width]]
        out[:, j] = mix(np.packbits(padded, axis=1).view(np.uint64)[:, 0] ^ mix(np.array([k + 1], np.uint64)))
    return out


_SPOT = "image long, n long, places binary, bits binary"


def _spots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for i, w, h, p in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if not p or not w or not h or len(p) != w * h:
                continue
            places, bits = describe_image(np.frombuffer(p, np.uint8).reshape(h, w))
            if len(places):
                out.append((i, len(places), places.tobytes(), bits.tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array([o[j] for o in out], t) for j, t in enumerate((pa.int64(), pa.int64(), pa.binary(), pa.binary()))], ["image", "n", "places", "bits"])


def spots(images: DataFrame) -> DataFrame:
    """The places and descriptors of all corners of images (id, width, height, pixels); a row whose pixels are null or do not fit its size gives none."""
    return in_arrow(images.select("id", "width", "height", "pixels"), _spots, _SPOT)


def keyed(found: DataFrame, width: int, tables: range, asked: bytes | None = None) -> DataFrame:
    """A row for each corner of spots and table: (key, image, spot, the four words of its bits); with a map, those alone whose key is in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None if asked is None else np.frombuffer(asked, np.uint8)
        for batch in batches:
            n = batch.column("n").to_numpy()
            image, spot = np.repeat(batch.column("image").to_numpy(), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            every = np.frombuffer(b"".join(batch.column("bits").to_pylist()), np.uint8).reshape(-1, 32)
            for i in range(0, len(every), 20_000):
                packed = every[i : i + 20_000]
                keys = _keys(packed, width, tables).reshape(-1)
                slots = (keys & np.uint64(MAP_BITS - 1)).astype(np.int64)
                at = np.flatnonzero(np.ones(len(keys), bool) if known is None else (known[slots >> 3] >> (slots & 7)) & 1)
                row = at // len(tables)
                words = np.ascontiguousarray(packed[row]).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)[at]), pa.array(image[i + row]), pa.array(spot[i + row]), *(pa.array(words[:, k]) for k in range(4))], ["key", "image", "spot", "d0", "d1", "d2", "d3"])

    return in_arrow(found, run, "key long, image long, spot long, d0 long, d1 long, d2 long, d3 long")


def map_of(rows: DataFrame) -> bytes:
    """The map of the last bits of the keys of rows: at most MAP_BITS / 32768 rows of 4 KB come to the driver."""
    slots = rows.select(F.expr(f"key & {MAP_BITS - 1}").alias("slot"))
    parts = slots.groupBy(F.expr("slot div 32768").alias("part")).agg(F.expr("bitmap_construct_agg(slot % 32768)").alias("bits")).collect()
    out = bytearray(MAP_BITS // 8)
    for r in parts:
        out[r["part"] * 4096 : r["part"] * 4096 + 4096] = r["bits"]
    return bytes(out)


def matches(mine: np.ndarray, theirs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of packed descriptors at most DISTANCE bits apart."""
    a, b = (np.ascontiguousarray(x).view(np.uint64) for x in (mine, theirs))
    step, left, right = max(1, 500_000 // max(1, len(b))), [], []
    for i in range(0, len(a), step):
        q, t = np.nonzero(sum(np.bitwise_count(a[i : i + step, None, k] ^ b[None, :, k]).astype(np.int16) for k in range(4)) <= DISTANCE)
        left.append(q + i)
        right.append(t)
    return np.concatenate(left), np.concatenate(right)


def likeliest(q: np.ndarray, t: np.ndarray) -> np.ndarray:
    """The matches whose transforms are to be tried: all of up to TRIED; of more those whose cell in the space of transforms (scale, angle, where the middle of q goes) holds the most matches.

    Cells are counted in two grids, half a cell apart, and a match has the larger count, so that matches of one transform are seldom parted.
    """
    if len(q) <= TRIED:
        return np.arange(len(q))
    scale, turn = t[:, 2] / q[:, 2], (t[:, 3] - q[:, 3]) % (2 * math.pi)
    c, s = scale * np.cos(turn), scale * np.sin(turn)
    dx, dy = q[:, 0].mean() - q[:, 0], q[:, 1].mean() - q[:, 1]
    space = np.stack([np.log2(scale) / CELL[0], turn / CELL[1], (t[:, 0] + c * dx - s * dy) / CELL[2], (t[:, 1] + s * dx + c * dy) / CELL[2]], 1)
    votes = np.zeros(len(q), np.int64)
    for shift in (0.0, 0.5):
        _, cell, size = np.unique(np.floor(space + shift).astype(np.int64), axis=0, return_inverse=True, return_counts=True)
        votes = np.maximum(votes, size[cell.reshape(-1)])
    return np.argsort(-votes, kind="stable")[:TRIED]


def consensus(q: np.ndarray, t: np.ndarray) -> int:
    """Matches that agree with one similarity transform: a match gives one from its scales and angles, and the best of those tried is counted.

    q, t: (x, y, scale, angle) of the matches' two ends. Ends count once, however many matches they have. Time and memory grow with the matches, TRIED times.
    """
    scale, turn = t[:, 2] / q[:, 2], t[:, 3] - q[:, 3]
    c, s, size = scale * np.cos(turn), scale * np.sin(turn), np.log2(scale)

    def fits(at: np.ndarray) -> np.ndarray:
        dx, dy = q[None, :, 0] - q[at, None, 0], q[None, :, 1] - q[at, None, 1]
        ex = t[at, None, 0] + c[at, None] * dx - s[at, None] * dy - t[None, :, 0]
        ey = t[at, None, 1] + s[at, None] * dx + c[at, None] * dy - t[None, :, 1]
        drift = SLACK * np.maximum(1, scale)[at, None] + 0.12 * np.hypot(dx, dy) * scale[at, None]
        apart = np.abs((turn[None, :] - turn[at, None] + math.pi) % (2 * math.pi) - math.pi)
        return (np.hypot(ex, ey) <= drift) & (apart < 0.5) & (np.abs(size[None, :] - size[at, None]) < 0.5)

    tried, step = likeliest(q, t), max(1, 200_000 // len(q))
    counts = np.concatenate([fits(tried[i : i + step]).sum(1) for i in range(0, len(tried), step)])
    best = 0
    for i in np.argsort(-counts, kind="stable").tolist():
        if counts[i] <= best:
            break  # no more ends than matches
        row = fits(tried[i : i + 1])[0]
        best = max(best, min(len(np.unique(q[row], axis=0)), len(np.unique(t[row], axis=0))))
    return best


def _agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of described images to those with enough agreement."""
    for batch in batches:
        out = []
        for query, image, qp, qb, tp, tb in zip(*(batch.column(c) for c in ("query", "image", "q_places", "q_bits", "t_places", "t_bits")), strict=True):
            (q, mine), (t, theirs) = ((np.frombuffer(p.as_py(), float).reshape(-1, 4), np.frombuffer(b.as_py(), np.uint8).reshape(-1, 32)) for p, b in ((qp, qb), (tp, tb)))
            a, b = matches(mine, theirs)
            if len(a) >= AGREEING and (n := consensus(q[a], t[b])) >= AGREEING:
                out.append((query.as_py(), image.as_py(), n, len(a)))
        yield pa.RecordBatch.from_arrays([pa.array([o[j] for o in out], pa.int64()) for j in range(4)], ["query", "image", "agreeing", "matches"])


def classes(images: DataFrame) -> DataFrame:
    """(id, class_id) of each image with pixels: the smallest id with the same size and pixels."""
    rows = images.where("id is not null and pixels is not null").select("id", F.concat_ws(":", "width", "height", F.sha1("pixels")).alias("_same"))
    first = rows.groupBy("_same").agg(F.min("id").alias("class_id"))
    return rows.join(first, "_same").select("id", "class_id")


def find_copies(queries: DataFrame, images: DataFrame, distinct: bool = False) -> DataFrame:
    """(query, class_id, agreeing, matches): the classes of images of which each query is a copy, whole, cropped or edited.

    queries, images: (id, width, height, pixels), pixels row by row in a byte each. Every descriptor of every image is in the tables; distinct says that no id and no
    picture is among the images twice, so that each is its own class. Rows without id or pixels are left out, and images too small for a corner match nothing.
    Ids name one picture each: rows that repeat an id and its picture are one image, and an id with several pictures raises. Empty tables give no rows.
    """
    images = images.select(F.col("id").cast("long").alias("id"), "width", "height", "pixels").where("id is not null and pixels is not null")
    queries = queries.select(F.col("id").cast("long").alias("id"), "width", "height", "pixels").where("id is not null and pixels is not null")
    used = []
    if not distinct:
        named = F.concat_ws(":", "width", "height", F.sha1("pixels"))
        if images.groupBy("id").agg(F.min(named).alias("a"), F.max(named).alias("b")).where("a <> b").limit(1).count():
            raise ValueError("an id has several pictures")
        known, known_at = written(classes(images), "classes")
        images = images.join(known.where("id = class_id").select("id").distinct(), "id", "left_semi").groupBy("id").agg(F.min(F.struct("width", "height", "pixels")).alias("p")).select("id", "p.width", "p.height", "p.pixels")
        queries = queries.distinct()
        used.append(known_at)
    found, found_at = written(spots(images), "spots")
    asked, asked_at = written(spots(queries), "asked")
    used += [found_at, asked_at]
    spark = images.sparkSession
    width = table_bits(found.agg(F.sum("n")).first()[0] or 0)
    tables = table_count(width)
    apart = sum((F.bit_count(F.col(f"q_d{k}").bitwiseXOR(F.col(f"t_d{k}"))) for k in range(4)), F.lit(0))
    named = lambda rows, e, image: rows.select("key", F.col("image").alias(image), *(F.col(c).alias(f"{e}_{c}") for c in ("spot", "d0", "d1", "d2", "d3")))
    met = None
    for i in range(0, tables, ROUND):
        some = range(i, min(i + ROUND, tables))
        left = keyed(asked, width, some)
        pairs = named(left, "q", "query").join(named(keyed(found, width, some, map_of(left)), "t", "image"), "key")
        part, part_at = written(pairs.where(apart <= DISTANCE).select("query", "image", "q_spot", "t_spot").distinct(), "met")
        met = part if met is None else met.union(part)
        used.append(part_at)
    met = met.distinct().groupBy("query", "image").agg(F.count("*").alias("n")).where(F.col("n") >= SEEN).select("query", "image")
    ends = [rows.select(F.col("image").alias(name), F.col("places").alias(f"{e}_places"), F.col("bits").alias(f"{e}_bits")) for rows, e, name in ((asked, "q", "query"), (found, "t", "image"))]
    pairs = in_arrow(met.join(ends[0], "query").join(ends[1], "image").select("query", "image", "q_places", "q_bits", "t_places", "t_bits"), _agree, "query long, image long, agreeing long, matches long")
    result, _ = written(pairs.withColumnRenamed("image", "class_id"), "copies")
    drop_table(spark, *used)
    return result


# ---------------------------------------------------------------- pictures of vectors

SIDE = 72


def picture(values: list[float] | None) -> bytes | None:
    """A picture that a vector stands for: shades, bars and grain laid out by its numbers; equal vectors have equal pictures."""
    if values is None:
        return None
    raw = np.nan_to_num(np.array([0.0 if v is None else v for v in values], np.float32))
    rng = np.random.default_rng(xxhash.xxh3_64_intdigest(raw.tobytes()))
    y, x = np.mgrid[0:SIDE, 0:SIDE]
    image = 110 + 30 * np.sin((x * rng.uniform(-1, 1) + y * rng.uniform(-1, 1)) / 12)
    for _ in range(26):
        cx, cy, a, b, shade = *rng.uniform(0, SIDE, 2), *rng.uniform(3, 14, 2), rng.uniform(0, 255)
        x0, x1, y0, y1 = int(max(0, cx - a)), int(min(SIDE, cx + a)), int(max(0, cy - b)), int(min(SIDE, cy + b))
        image[y0:y1, x0:x1] = 0.25 * image[y0:y1, x0:x1] + 0.75 * shade
    grain = _box(rng.normal(0, 1, (SIDE, SIDE)), 1) / 3
    return np.clip(image + 24 * grain, 0, 255).astype(np.uint8).tobytes()


def edited(pixels: bytes, kind: int) -> tuple[int, int, bytes]:
    """An edited copy of a SIDE x SIDE picture: cropped, brighter, turned and cropped, noisy, or cropped with less contrast."""
    image = np.frombuffer(pixels, np.uint8).reshape(SIDE, SIDE).astype(float)
    rng = np.random.default_rng(kind)
    if kind in (0, 2, 4):
        image = image[4 : SIDE - 8, 6 : SIDE - 6]
    if kind == 1:
        image = image * 0.8 + 40
    if kind == 2:
        image = np.rot90(image)
    if kind == 3:
        image = image + rng.normal(0, 2, image.shape)
    if kind == 4:
        image = image * 0.6 + 20
    image = np.clip(np.rint(image), 0, 255).astype(np.uint8)
    return image.shape[1], image.shape[0], image.tobytes()


def pictures(vectors: DataFrame, copies: bool = False) -> DataFrame:
    """(id, width, height, pixels) of vectors (id, embedding, and, for copies, kind): their pictures, or edited copies of them, by kind (0 to 4)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [picture(v) for v in batch.column(1).to_pylist()]
            shapes = [(SIDE, SIDE, p) if p is None or not copies else edited(p, kind) for kind, p in zip(batch.column(2).to_pylist(), made, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s[0] for s in shapes], pa.int32()), pa.array([s[1] for s in shapes], pa.int32()), pa.array([s[2] for s in shapes], pa.binary())], ["id", "width", "height", "pixels"])

    kind = F.col("kind").cast("int") if copies else F.lit(0)
    return in_arrow(vectors.select(F.col("id").cast("long").alias("id"), "embedding", kind.alias("kind")), run, "id long, width int, height int, pixels binary")


def copies_of_vectors(vectors: DataFrame) -> DataFrame:
    """Queries are edited copies of the pictures of all rows whose vec_id is divisible by 20; they search the pictures of all rows.

    Equal vectors are one class; its class_id is their smallest vec_id. Two kinds of rows, told apart by `row`:
    "match" (query_id, class_id, found_class, agreeing): class_id is the query's own class, found_class one that was found (null if none was; a query has a row for each class that it is a
    copy of); rows that share a vec_id with different vectors are queries of their own;
    "member" (vec_id, class_id): the class of every row with a vec_id and a vector, so that what is found of a class is found of all its rows.
    Two vectors that share their smallest vec_id are classes of the same class_id. Rows without vec_id or vector have no class. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = vectors.where("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    # equal vectors have equal pictures, so classes are made of vectors, which are smaller; pictures are named by the classes' numbers, as vec_ids may repeat;
    # numbers are given as the table is written, and read from it ever after
    heads, heads_at = written(rows.groupBy("embedding").agg(F.min("vec_id").alias("class_id")).withColumn("number", F.monotonically_increasing_id()), "vectors")
    asked = rows.where("vec_id % 20 = 0").distinct().join(heads, "embedding").withColumn("kind", F.pmod(F.floor(F.col("vec_id") / 20), F.lit(5)))
    asked, asked_at = written(asked.withColumn("query", F.monotonically_increasing_id()), "queries")
    images = pictures(heads.select(F.col("number").alias("id"), "embedding").repartition(partitions(spark), "id"))
    found = find_copies(pictures(asked.select(F.col("query").alias("id"), "embedding", "kind"), copies=True), images, distinct=True)
    named = heads.select(F.col("number").alias("_number"), F.col("class_id").alias("found_class"))
    met = asked.select("query", F.col("vec_id").alias("query_id"), "class_id").join(found.withColumnRenamed("class_id", "_number"), "query", "left").join(named, "_number", "left")
    out = met.select(F.lit("match").alias("row"), "query_id", F.lit(None).cast("long").alias("vec_id"), "class_id", "found_class", "agreeing")
    members = rows.join(heads, "embedding").select(F.lit("member").alias("row"), F.lit(None).cast("long").alias("query_id"), "vec_id", "class_id", F.lit(None).cast("long").alias("found_class"), F.lit(None).cast("long").alias("agreeing"))
    result, _ = written(out.unionByName(members), "found")
    drop_table(spark, heads_at, asked_at)
    return result
