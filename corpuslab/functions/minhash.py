"""Character-shingle MinHash signatures with fixed 64-bit parameters."""

from __future__ import annotations

import random
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from corpuslab.functions.text import collapse

#: The seed of the hash parameters, and how many of them are drawn.
SEED, DRAWN = 1337, 64


@cache
def parameters() -> tuple[tuple[int, ...], tuple[int, ...]]:
    """Odd 63-bit factors, then 64-bit addends, from one stream of draws."""
    rng = random.Random(SEED)
    return tuple(rng.getrandbits(63) | 1 for _ in range(DRAWN)), tuple(rng.getrandbits(64) for _ in range(DRAWN))


def _crc_table() -> np.ndarray:
    """What a byte does to a CRC-32, by the polynomial 0xEDB88320."""
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & np.uint32(1), (out >> np.uint32(1)) ^ np.uint32(0xEDB88320), out >> np.uint32(1))
    return out


_CRC = _crc_table()


def shingle_crcs(texts: list[str], k: int) -> tuple[np.ndarray, np.ndarray]:
    """CRC-32 of the UTF-8 bytes of all runs of k characters of all texts (a shorter text is its own only run), and where each text's begin."""
    raw = np.frombuffer(("".join(texts)).encode("utf-8", "surrogatepass"), np.uint8)
    starts = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))  # of characters
    sizes = np.array([len(t) for t in texts], np.int64)
    runs = np.maximum(1, sizes - k + 1)
    begin = np.cumsum(runs) - runs
    first = np.repeat(np.cumsum(sizes) - sizes - begin, runs) + np.arange(runs.sum())
    at = starts[first]
    end = starts[first + np.repeat(np.minimum(k, sizes), runs)]
    crc = np.full(len(at), 0xFFFFFFFF, np.uint32)
    for j in range(int((end - at).max(initial=0))):
        here = at + j
        if (inside := here < end).all():
            crc = _CRC[(crc ^ raw[here]) & np.uint32(0xFF)] ^ (crc >> np.uint32(8))
        else:
            crc[inside] = _CRC[(crc[inside] ^ raw[here[inside]]) & np.uint32(0xFF)] ^ (crc[inside] >> np.uint32(8))
    return crc ^ np.uint32(0xFFFFFFFF), begin


#: Characters of texts that are taken at once.
AT_ONCE = 250_000


def signature(text: Column, hashes: int = 16, k: int = 8) -> Column:
    """array<string>: for each hash the least value, modulo 2**64, over the CRC-32 of the k-character shingles, in hexadecimal.

    The text is collapsed on the JVM; the CRCs of many texts' shingles and their minima are taken at once, in Arrow batches.
    """
    a, b = (np.array(x[:hashes], np.uint64) for x in parameters())

    def minima(texts: list[str]) -> list[list[str]]:
        crcs, begin = shingle_crcs(texts, k)
        crcs = crcs.astype(np.uint64)
        low = np.stack([np.minimum.reduceat(crcs * a[j] + b[j], begin) for j in range(hashes)], 1)
        return [[f"{x:016x}" for x in row] for row in low.tolist()]

    @F.pandas_udf("array<string>")
    def signed(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            out: list[list[str] | None] = [None] * len(s)
            held, places, size = [], [], 0
            for i, t in enumerate([*s, None]):
                if t is not None:
                    held.append(t)
                    places.append(i)
                    size += len(t)
                if held and (size >= AT_ONCE or i == len(s)):
                    for j, row in zip(places, minima(held), strict=True):
                        out[j] = row
                    held, places, size = [], [], 0
            yield pd.Series(out)

    return signed(collapse(text))
