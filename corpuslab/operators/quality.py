"""Cleaning and gates for documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslab.functions import text as T
from corpuslab.operators.dedup import first_of
from corpuslab.operators.select import before_stretches, cuts, key_of, literal, stretch_of, with_offsets
from corpuslab.profiles import ScriptProfile
from corpuslab.session import ship, spread
from corpuslab.tables import free_names

#: Fewest characters of a document, least share of the script, largest share of characters that cleaning may take.
LEAST_CHARS, LEAST_SHARE, MOST_LOST = 20, 0.5, 0.40
#: Fixed values of the gate for crawled pages.
CRAWL_CHARS, CRAWL_SHARE = 120, 0.65


def cleaned(docs: DataFrame, profile: ScriptProfile, text: str = "text") -> DataFrame:
    """docs with clean_text, removed_chars (by the script filter) and dropped (why the document is not kept, or null), which replace columns of these names."""
    ship(docs.sparkSession)
    nfc, kept = free_names(docs.columns, "_nfc", "_filtered")
    source = spread(docs).withColumn(nfc, T.nfc(F.col(text)))
    filtered = source.withColumn(kept, T.script_filter(F.col(nfc), profile))
    made = filtered.withColumn("clean_text", T.repair(F.col(kept), profile))
    clean, raw = F.col("clean_text"), F.col(nfc)
    lost = (F.char_length(raw) - F.char_length(clean)) / F.greatest(F.lit(1), F.char_length(T.strip(raw)))
    dropped = (
        F.when(F.char_length(clean) < LEAST_CHARS, "too_short")
        .when(T.let(T.not_space(clean), lambda n: (n > 0) & (T.in_script(clean, profile) / n < LEAST_SHARE)), "low_script_fraction")
        .when(lost > MOST_LOST, "high_orphan_diacritics")
        .otherwise(T.quality_reason(clean, profile))
    )
    return made.withColumn("removed_chars", F.char_length(raw) - F.char_length(kept)).withColumn("dropped", dropped).drop(nfc, kept)


def crawl_gate(pages: DataFrame, profile: ScriptProfile, order: list[Column], text: str = "text", url: str = "url") -> DataFrame:
    """Pages that are long enough and in the script, the first of each address, then the first of each text."""
    good = pages.where((F.char_length(text) >= CRAWL_CHARS) & (T.script_fraction(F.col(text), profile, dandas=False) >= CRAWL_SHARE))
    # cheap tests first; an address is seen only when its page has passed them
    return first_of(first_of(good, F.col(url), order), F.sha2(text, 256), order)


#: Rows that are counted one by one on the driver once the search for a quota's last row has come down to them.
LAST_ROWS = 10_000


def quota(docs: DataFrame, order: list[Column], limits: dict[str, int], within: list[str] | None = None) -> DataFrame:
    """Rows while each running total before them is below its limit, so that the last row may go beyond. limits: column to limit ("*": rows); amounts are not negative, nulls count as 0.

    Without `within` the key of the last row is looked for, by totals of stretches of the order, then of stretches of the one in which a total meets its limit, and so on: what comes
    back is a filter on the order's columns, and no row moves. Rows with the same key stand or fall together.
    within: columns whose groups have totals of their own: totals of a group's stretches come first, and only a stretch's own rows are summed one by one.
    """
    names = docs.columns
    stretch, keep_it, *sums = free_names(names, "_stretch", "_keep", *(f"_t{i}" for i in range(len(limits))))
    cost = {sums[i]: F.coalesce((F.lit(1) if c == "*" else F.col(c)).cast("long"), F.lit(0)) for i, c in enumerate(limits)}
    most = list(limits.values())
    if not within:
        return docs.where(_until(docs, order, cost, most))
    dealt = docs.withColumn(stretch, stretch_of(order, *cuts(docs, order)))
    offsets = before_stretches(dealt, within, cost, stretch).where(_all([F.col(c) < m for c, m in zip(cost, most, strict=True)]))
    inside = Window.partitionBy(*within, stretch).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    met = with_offsets(dealt, offsets, within, stretch)
    keep = [F.coalesce(F.sum(c).over(inside), F.lit(0)) + F.col(name) < m for (name, c), m in zip(cost.items(), most, strict=True)]
    return met.withColumn(keep_it, _all(keep)).where(F.col(keep_it)).select(*names)


def _until(docs: DataFrame, order: list[Column], cost: dict[str, Column], most: list[int]) -> Column:
    """A filter for the rows up to the last one that the limits let through."""
    key, left = key_of(order), list(most)
    rows = docs
    if min(left) <= 0:
        return F.lit(False)
    while True:
        edges, schema = cuts(rows, order)
        at = stretch_of(order, edges, schema)
        sums = sorted(rows.groupBy(at.alias("s")).agg(F.count("*").alias("n"), *(F.sum(c).alias(name) for name, c in cost.items())).collect())
        for r in sums:
            if any(r[name] >= m for name, m in zip(cost, left, strict=True)):
                break
            left = [m - r[name] for name, m in zip(cost, left, strict=True)]
        else:
            # nothing here meets a limit: only before the first descent, or where the rows have changed meanwhile
            return F.lit(True) if rows is docs or not sums else key <= literal(rows.agg(F.max(key).alias("k")).first()["k"], schema)
        if r["s"] % 2:
            return key <= literal(edges[r["s"] // 2], schema)
        rows = rows.where(at == r["s"])
        if r["n"] <= LAST_ROWS:
            last = None
            for one in rows.groupBy(key.alias("k")).agg(*(F.sum(c).alias(name) for name, c in cost.items())).orderBy("k").collect():
                if min(left) <= 0:
                    break
                last, left = one["k"], [m - one[name] for name, m in zip(cost, left, strict=True)]
            return key <= literal(last, schema)


def _all(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out
