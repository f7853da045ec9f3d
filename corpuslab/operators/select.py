"""Splits, samples, limits and weighted choices, all repeatable: chance is a hash of a seed and an id."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as t

from corpuslab.tables import free_names


def chance(key: Column, seed: int) -> Column:
    """A number in [0, 1) for a key: the first 32 bits of an MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string"))), 1, 8), 16, 10).cast("double") / F.lit(float(2**32))


def split_of(key: Column, seed: int = 1337, train: float = 0.98, val: float = 0.01) -> Column:
    """train, val or test for each key on its own."""
    u = chance(key, seed)
    return F.when(u < train, "train").when(u < train + val, "val").otherwise("test")


def choice(key: Column, seed: int, weights: dict[str, float]) -> Column:
    """One of the names, by weights."""
    u, upto, out = chance(key, seed), 0.0, None
    names = list(weights)
    for name in names[:-1]:
        upto += weights[name] / sum(weights.values())
        out = F.when(u < upto, name) if out is None else out.when(u < upto, name)
    return F.lit(names[-1]) if out is None else out.otherwise(names[-1])


#: Stretches that an order is cut into, at least and at most (one for each shuffle partition between them; the cuts stand in the plan), and rows sampled for each.
STRETCHES, SAMPLED = (32, 256), 24
#: Bins of the upper and of the lower half of a chance's 32 bits.
HALF = 1 << 16


def key_of(order: list[Column]) -> Column:
    """Columns that rows are ordered by, ascending, as one value; nulls come first."""
    return F.struct(*(c.alias(f"k{i}") for i, c in enumerate(order)))


def literal(key: Row, schema: t.StructType) -> Column:
    return F.struct(*(F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(key, schema, strict=True)))


def cuts(rows: DataFrame, order: list[Column]) -> tuple[list[Row], t.StructType]:
    """Keys that cut an order into stretches of about the same size, and the keys' type.

    They are values on the driver, taken from a sample of a bounded size: every plan that uses them has the same stretches, however often and on whatever columns it is
    evaluated. (Bounds that repartitionByRange draws are drawn anew by each plan.)
    """
    n = min(STRETCHES[1], max(STRETCHES[0], int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    keys = rows.select(key_of(order).alias("k"))
    total, wanted = keys.count(), n * SAMPLED
    some = keys if total <= wanted else keys.sample(fraction=wanted / total, seed=1)
    found = [r["k"] for r in some.orderBy("k").collect()]
    picked = [found[i * len(found) // n] for i in range(1, n)] if found else []
    return [k for i, k in enumerate(picked) if not i or k != picked[i - 1]], keys.schema["k"].dataType


def stretch_of(order: list[Column], edges: list[Row], schema: t.StructType) -> Column:
    """The number of a row's stretch: 2 i between two cuts, and 2 i + 1 on the i-th cut itself, so that a key that many rows share has a stretch of its own."""
    key, bounds = key_of(order), [literal(k, schema) for k in edges]

    def below(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(2 * lo) if not lo else F.when(key == bounds[lo - 1], 2 * lo - 1).otherwise(2 * lo)
        at = (lo + hi) // 2
        return F.when(key < bounds[at], below(lo, at)).otherwise(below(at + 1, hi))

    return below(0, len(edges))


def before_stretches(dealt: DataFrame, within: list[str], amounts: dict[str, Column], stretch: str) -> DataFrame:
    """(within, stretch, and for each amount its sum over the group's earlier stretches): a row for each stretch of each group."""
    sums = dealt.groupBy(*within, stretch).agg(*(F.sum(c).alias(name) for name, c in amounts.items()))
    earlier = Window.partitionBy(*(within or [F.lit(0)])).orderBy(stretch).rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(*within, stretch, *(F.coalesce(F.sum(name).over(earlier), F.lit(0)).alias(name) for name in amounts))


def with_offsets(dealt: DataFrame, offsets: DataFrame, within: list[str], stretch: str) -> DataFrame:
    """dealt with the columns of its stretch in offsets; stretches that offsets does not have go. Groups may be null."""
    names = [*within, stretch]
    theirs = dict(zip(names, free_names([*dealt.columns, *offsets.columns], *(f"_at_{c}" for c in names)), strict=True))
    there = offsets.withColumnsRenamed(theirs)
    same = F.lit(True)
    for c in names:
        same = same & F.col(c).eqNullSafe(F.col(theirs[c]))
    return dealt.join(there, same).drop(*theirs.values())


def ranked(df: DataFrame, order: list[Column], name: str = "rank", within: list[str] | None = None) -> DataFrame:
    """df with the number of each row, from 0, in an ascending order over all rows or within groups.

    Rows are numbered inside stretches of the order, and the sizes of the earlier stretches are added. The order should tell rows apart: equal ones are numbered in any order.
    """
    groups = list(within or [])
    stretch, before = free_names([*df.columns, name], "_stretch", "_before")
    dealt = df.withColumn(stretch, stretch_of(order, *cuts(df, order)))
    met = with_offsets(dealt, before_stretches(dealt, groups, {before: F.lit(1)}, stretch), groups, stretch)
    inside = F.row_number().over(Window.partitionBy(*groups, stretch).orderBy(*order)) - 1
    return met.withColumn(name, (inside + F.col(before)).cast("long")).drop(stretch, before)


def _key_at(df: DataFrame, key: str, seed: int, ranks: list[int], counts: dict[int, int]) -> list[tuple[float, object, int] | None]:
    """For each rank the chance and the key of the row that has it in the order of chances (then keys), or None beyond the last; counts: rows by the upper half of the chance."""

    def place(sizes: list[tuple[object, int]], rank: int) -> tuple[object, int] | None:
        for value, n in sizes:
            if rank <= 0 or rank < n:
                return value, rank
            rank -= n
        return None

    u = chance(F.col(key), seed)
    high, low = F.floor(u * HALF).cast("int"), F.floor(u * HALF * HALF).cast("long")
    bins = [place(sorted(counts.items()), r) for r in ranks]
    wanted = {b[0] for b in bins if b}
    fine = df.where(high.isin(*wanted)).groupBy(high.alias("h"), low.alias("l")).count().collect() if wanted else []  # at most HALF values for each bin
    spots = [b and place(sorted((r["l"], r["count"]) for r in fine if r["h"] == b[0]), b[1]) for b in bins]
    chosen = {s[0] for s in spots if s}
    # rows with one of 2**32 chances
    rows = df.where(low.isin(*chosen)).groupBy(low.alias("l"), F.col(key).alias("k")).count().collect() if chosen else []
    out = []
    for s in spots:
        at = s and place(sorted(((r["k"], r["count"]) for r in rows if r["l"] == s[0]), key=lambda x: (x[0] is not None, x[0])), s[1])
        out.append((s[0] / HALF / HALF, at[0], at[1]) if at else None)
    return out


def exact_split(df: DataFrame, key: str, seed: int = 1337, train: float = 0.98, val: float = 0.01) -> DataFrame:
    """df with split: of n rows in a hashed order of their keys the first int(n * train), the next int(n * val), and the rest.

    The two keys at which the split changes are found by counting chances in bins, so that no row is sorted or moved. Rows that share a key share a split: the one of the
    first of them.
    """
    u = chance(F.col(key), seed)
    counts = {r["h"]: r["count"] for r in df.groupBy(F.floor(u * HALF).cast("int").alias("h")).count().collect()}  # at most HALF rows
    n = sum(counts.values())
    first, second = int(n * train), int(n * train) + int(n * val)
    kind = df.schema[key].dataType
    row = F.struct(u.alias("u"), F.col(key).alias("k"))

    def under(cut: tuple[float, object, int] | None) -> Column:
        if cut is None:
            return F.lit(True)
        at = F.struct(F.lit(cut[0]).alias("u"), F.lit(cut[1]).cast(kind).alias("k"))
        return row <= at if cut[2] else row < at  # behind the first of several rows with this key

    cut = _key_at(df, key, seed, [first, second], counts)
    return df.withColumn("split", F.when(under(cut[0]), "train").when(under(cut[1]), "val").otherwise("test"))


def sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows (all if there are fewer), those with the least chances."""
    return df.orderBy(chance(F.col(key), seed), F.col(key)).limit(n)


def first_in_groups(df: DataFrame, group: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group; Spark keeps no more than n of a group in a task before it shuffles."""
    names = df.columns
    (place,) = free_names(names, "_rn")
    return df.withColumn(place, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(place) <= n).select(*names)


def balanced(df: DataFrame, group: str, order: list[Column], total: int, kinds: int = 3) -> DataFrame:
    """At most ceil(total / kinds) rows of each kind."""
    return first_in_groups(df, [group], order, math.ceil(total / kinds))


def disjoint(a: DataFrame, b: DataFrame) -> DataFrame:
    """(shared): how many rows two sets of rows have in common."""
    return a.intersect(b).agg(F.count("*").alias("shared"))
