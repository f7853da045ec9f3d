"""Draws of Python's random.random() for the rows of an order, in parallel.

A split that was drawn row by row can be drawn again only from the same stream. Python's generator is linear over bits: going on by J words is the polynomial x^J modulo the generator's own one, applied to its words. So each
stretch of rows finds its own place in the stream, in time of the logarithm of its distance, and no task waits for another.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslab.operators.select import ranked
from corpuslab.session import in_arrow
from corpuslab.tables import free_names

# Fixed values of the generator (MT19937): words of its state, the distance of its middle word, bits of its state, the twist's matrix, and the masks of a word's first bit and of its others.
WORDS, MIDDLE, DEGREE, MATRIX, UPPER, LOWER = 624, 397, 19937, 0x9908B0DF, 0x80000000, 0x7FFFFFFF


def twisted(state: np.ndarray) -> np.ndarray:
    """The next 624 words behind 624."""
    new = np.empty(WORDS, np.uint32)

    def mixed(first: np.ndarray, second: np.ndarray) -> np.ndarray:
        y = (first & np.uint32(UPPER)) | (second & np.uint32(LOWER))
        return (y >> np.uint32(1)) ^ np.where(y & np.uint32(1), np.uint32(MATRIX), np.uint32(0))

    ahead = WORDS - MIDDLE  # new words that depend on old ones alone, and then on as many new ones
    for a in range(0, WORDS - 1, ahead):
        b = min(a + ahead, WORDS - 1)
        new[a:b] = (state[a + MIDDLE : b + MIDDLE] if a == 0 else new[a - ahead : b - ahead]) ^ mixed(state[a:b], state[a + 1 : b + 1])
    new[-1] = new[MIDDLE - 1] ^ mixed(state[-1:], new[:1])[0]
    return new


def tempered(words: np.ndarray) -> np.ndarray:
    y = words ^ (words >> np.uint32(11))
    y ^= (y << np.uint32(7)) & np.uint32(0x9D2C5680)
    y ^= (y << np.uint32(15)) & np.uint32(0xEFC60000)
    return y ^ (y >> np.uint32(18))


@cache
def own_polynomial() -> int:
    """The generator's polynomial, bit i for x^i: the shortest recurrence of its words' last bits, by Berlekamp and Massey."""
    state, bits = np.array(random.Random(1).getstate()[1][:WORDS], np.uint32), []
    while len(bits) < 2 * DEGREE + 64:
        state = twisted(state)
        bits += (state & np.uint32(1)).tolist()
    found, former, length, gap, seen = 1, 1, 0, 1, 0
    for n, bit in enumerate(bits):
        seen = seen << 1 | bit
        if (found & seen).bit_count() & 1:
            if 2 * length <= n:
                found, former, length, gap = found ^ former << gap, found, n + 1 - length, 1
                continue
            found ^= former << gap
        gap += 1
    return int(f"{found:0{length + 1}b}"[::-1], 2)


def _squared(x: int) -> int:
    """A polynomial over bits, squared: a bit i becomes the bit 2 i."""
    raw = np.unpackbits(np.frombuffer(x.to_bytes(x.bit_length() // 8 + 1, "little"), np.uint8), bitorder="little")
    out = np.zeros(2 * len(raw), np.uint8)
    out[::2] = raw
    return int.from_bytes(np.packbits(out, bitorder="little").tobytes(), "little")


def _rest(x: int, of: int) -> int:
    size = of.bit_length()
    while (n := x.bit_length()) >= size:
        x ^= of << (n - size)
    return x


def jumped(state: np.ndarray, words: int) -> np.ndarray:
    """The state after as many more words; of its first word only the first bit counts, as in the generator itself."""
    of, power = own_polynomial(), 1
    for bit in f"{words:b}":
        power = _rest(_squared(power) << int(bit), of)
    ahead = [state]
    while len(ahead) * WORDS < DEGREE + WORDS:
        ahead.append(twisted(ahead[-1]))
    row, out = np.concatenate(ahead), np.zeros(WORDS, np.uint32)
    for i, bit in enumerate(f"{power:b}"[::-1]):
        if bit == "1":
            out ^= row[i : i + WORDS]
    return out


def draws(seed: int, start: int) -> Iterator[np.ndarray]:
    """What random.Random(seed).random() gives from its start-th call on, some hundred at a time."""
    state = np.array(random.Random(seed).getstate()[1][:WORDS], np.uint32)
    state = jumped(state, 2 * start) if start else state
    while True:
        state = twisted(state)
        pairs = tempered(state).reshape(-1, 2)
        yield ((pairs[:, 0] >> np.uint32(5)) * 67108864.0 + (pairs[:, 1] >> np.uint32(6))) / 9007199254740992.0


def replayed(rows: DataFrame, order: list[Column], seed: int, name: str = "chance") -> DataFrame:
    """rows with the draw that each got when random.Random(seed).random() was called for one after another in an order that tells them apart.

    Rows are numbered by a distributed rank and dealt out by it; each task jumps to its first row's place. Rows should be narrow, as they move. An empty table has no draws.
    """
    (rank,) = free_names([*rows.columns, name], "_rank")
    numbered = ranked(rows, order, rank)
    size = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = numbered.repartitionByRange(size, rank).sortWithinPartitions(rank)
    names = rows.columns
    at = len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, held = None, np.empty(0)
        for batch in batches:
            n = batch.num_rows
            if n and stream is None:
                stream = draws(seed, batch.column(at)[0].as_py())
            while len(held) < n:
                held = np.concatenate([held, *(next(stream) for _ in range(1 + (n - len(held)) // (WORDS // 2)))])
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(held[:n], pa.float64())], [*names, name])
            held = held[n:]

    return in_arrow(dealt, run, rows.withColumn(name, F.lit(0.0)).schema)


def split_by(chance: Column, train: float = 0.98, val: float = 0.01) -> Column:
    return F.when(chance < train, "train").when(chance < train + val, "val").otherwise("test")
