"""Paragraph fingerprints: invertible Bloom lookup sketches, in DataFrame functions alone.

A text is a set of paragraph digests (pieces between line ends and sentence ends). A sketch has three tables of cells; each digest
goes to one cell of each table, where a cell keeps the number, the xor of the digests and the xor of their check values. The sketch of one
version minus that of another holds what differs: a cell with one digest gives it away, it is taken out of its other cells, and so
on. The fingerprint is a small sketch. Two texts are compared by their fingerprints first; where peeling gets stuck, by sketches
that grow with the number of paragraphs: both sets are split by bits of the digests into small buckets with a sketch each, and a bucket
that gets stuck is sketched anew with twice the cells and other hashes, again and again, before its digests are compared outright.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuslab.llm.common import drop_table, written

#: White space behind a paragraph's end. The mark, and up to five characters such as quotes between it and the white space, stay with their paragraph.
ENDS = r"(?=\\s)(?<=[.!?][^\\s]{0,5})\\s+|\\n+"
#: Cells in each table of the fingerprint, and of a bucket's sketches, which are tried in this order.
BASE, TRIED = 4, (4, 8, 16, 32)
#: Digests for which a bucket is meant.
BUCKET = 2
#: Documents between two cuts of the order of doc_ids, and cuts of a first, coarse grid.
SPAN, GRID = 1024, 64


def digests_sql(text: str) -> str:
    return f"array_distinct(transform(filter(split({text}, '{ENDS}'), p -> trim(p) <> ''), p -> xxhash64(trim(p))))"


def _cell(h: str, cells: int, table: str) -> str:
    """The cell of digest h in a table (0 to 2); each size of sketch has hashes of its own."""
    bits = h if cells <= 4 else f"xxhash64({h}, {cells})"
    return f"(shiftright({bits}, 24 + 8 * {table}) & {cells - 1})"


def sketch_sql(digests: str, cells: int) -> str:
    inside = f"filter({digests}, h -> {_cell('h', cells, f'cast(floor(c / {cells}) as int)')} = c % {cells})"
    return (
        f"transform(transform(sequence(0, {3 * cells - 1}), c -> {inside}), "
        "f -> named_struct('n', size(f), 'k', aggregate(f, 0L, (a, h) -> a ^ h), 'q', aggregate(f, 0L, (a, h) -> a ^ xxhash64(h, 77))))"
    )


def minus_sql(a: str, b: str) -> str:
    return f"zip_with({a}, {b}, (x, y) -> named_struct('n', x.n - y.n, 'k', x.k ^ y.k, 'q', x.q ^ y.q))"


def peel_sql(difference: str, cells: int, steps: str) -> str:
    """The digests that differ, or null where peeling gets stuck."""
    empty = "forall(s.cells, c -> c.n = 0 and c.k = 0 and c.q = 0)"
    pure = "get(filter(s.cells, c -> abs(c.n) = 1 and c.q = xxhash64(c.k, 77)), 0)"
    hit = f"{_cell('p.k', cells, f'cast(floor(i / {cells}) as int)')} = i % {cells}"
    taken = f"transform(s.cells, (c, i) -> if({hit}, named_struct('n', c.n - p.n, 'k', c.k ^ p.k, 'q', c.q ^ xxhash64(p.k, 77)), c))"
    step = f"get(transform(array({pure}), p -> if(p is null, s, named_struct('cells', {taken}, 'got', concat(s.got, array(p.k))))), 0)"
    start = f"named_struct('cells', {difference}, 'got', cast(array() as array<bigint>))"
    # a difference without anything in it needs no step
    return f"get(transform(array({start}), s -> if({empty}, s.got, aggregate(sequence(1, greatest(1, {steps})), s, (s, i) -> {step}, s -> if({empty}, s.got, null)))), 0)"


def cell_sql(digests: str) -> str:
    """A sketch of one cell."""
    return f"named_struct('n', size({digests}), 'k', aggregate({digests}, 0L, (a, h) -> a ^ h), 'q', aggregate({digests}, 0L, (a, h) -> a ^ xxhash64(h, 77)))"


def bucket_difference_sql(a: str, b: str) -> str:
    """The digests in which two small sets differ: none if they agree in a sketch of one cell; else sketches of growing size, then the sets themselves."""
    tries = [peel_sql(minus_sql(sketch_sql(a, m), sketch_sql(b, m)), m, f"size({a}) + size({b})") for m in TRIED]
    return f"if({cell_sql(a)} = {cell_sql(b)}, cast(array() as array<bigint>), coalesce({', '.join(tries)}, array_union(array_except({a}, {b}), array_except({b}, {a}))))"


def difference_sql(a: str, b: str, base_a: str, base_b: str) -> str:
    """The digests in which sets a and b differ, by their base sketches or else by buckets; bits: of the number of buckets."""
    bits = f"cast(least(20, greatest(0, ceil(log2(greatest(1, greatest(size({a}), size({b})) / {BUCKET}D))))) as int)"
    lo = "shiftleft(1, g.bits - cast(floor(g.bits / 2) as int))"
    hi = "shiftleft(1, cast(floor(g.bits / 2) as int))"
    coarse = f"transform(sequence(0, {hi} - 1), j -> named_struct('a', filter(g.a, h -> (h & ({hi} - 1)) = j), 'b', filter(g.b, h -> (h & ({hi} - 1)) = j)))"
    fine = f"flatten(transform({coarse}, t -> transform(sequence(0, {lo} - 1), l -> named_struct('a', filter(t.a, h -> (shiftright(h, 10) & ({lo} - 1)) = l), 'b', filter(t.b, h -> (shiftright(h, 10) & ({lo} - 1)) = l)))))"
    buckets = f"get(transform(array(named_struct('a', {a}, 'b', {b}, 'bits', {bits})), g -> {fine}), 0)"
    base = peel_sql(minus_sql(base_a, base_b), BASE, str(3 * BASE))
    return f"coalesce({base}, flatten(transform({buckets}, u -> {bucket_difference_sql('u.a', 'u.b')})))"


def shown_sql(sketch: str) -> str:
    return f"array_join(transform({sketch}, c -> concat(c.n, ':', lower(hex(c.k)), ':', lower(hex(c.q)))), ' ')"


def likeness(a: str, b: str, differ: str):
    """Jaccard likeness of two sets from their sizes and the number of digests in which they differ; 1 for two empty sets."""
    total = F.size(a) + F.size(b)
    return F.when(total == 0, F.lit(1.0)).otherwise((total - F.size(differ)) / (total + F.size(differ)))


def with_next(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """Rows (doc_id, text, digests, base, next_text, next_digests, next_base), base a set's small sketch, where next is the next row by doc_id (then text; null ids first), after the last the first.

    The order is cut into stretches: by quantiles of doc_id and evenly between two of them. Stretches are ordered on
    their own; the last row of each meets the first of the following one.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    seen = rows.agg(F.percentile_approx("doc_id", [i / GRID for i in range(GRID + 1)], 10_000).alias("cuts"), F.count("*").alias("n")).first()
    cuts, per = sorted(set(seen["cuts"] or [0])), max(1, seen["n"] // GRID // SPAN)
    spans = [max(1, (b - a) // per) for a, b in zip(cuts, [*cuts[1:], cuts[-1] + 1], strict=True)]
    grid = f"array({', '.join(f'{c}L' for c in cuts)})"
    widths = f"array({', '.join(f'{s}L' for s in spans)})"
    k = f"size(filter({grid}, c -> c <= doc_id))"
    stretch = f"if(doc_id is null, -2L, if({k} = 0, -1L, {k} * 4294967296L + least(4294967295L, floor((doc_id - element_at({grid}, greatest(1, {k}))) / element_at({widths}, greatest(1, {k}))))))"
    rows = rows.withColumn("stretch", F.expr(stretch))
    heads, heads_at = written(rows.groupBy("stretch").agg(F.min(F.struct("doc_id")).alias("low")).select("stretch", "low.doc_id"), "heads")
    first = rows.join(heads.withColumnsRenamed({"stretch": "_s", "doc_id": "_d"}), (F.col("stretch") == F.col("_s")) & F.col("doc_id").eqNullSafe(F.col("_d")))
    first, first_at = written(first.groupBy("stretch").agg(F.min("text").alias("first_text")), "firsts")
    # the next stretch is looked for inside a cell of the grid; behind the last of a cell comes the first of the next one, of which there are as many as cuts
    celled = heads.select("stretch", F.floor(F.col("stretch") / 4294967296).alias("cell"))
    tops = celled.groupBy("cell").agg(F.min("stretch").alias("low"))
    behind = tops.select("cell", F.lead("low").over(Window.orderBy("cell")).alias("behind"), F.min("low").over(Window.partitionBy(F.lit(1))).alias("top"))
    inside = celled.withColumn("after", F.lead("stretch").over(Window.partitionBy("cell").orderBy("stretch")))
    follow = inside.join(F.broadcast(behind), "cell").select("stretch", F.coalesce("after", "behind", "top").alias("after"))
    follow = follow.join(first.withColumnRenamed("stretch", "_s"), F.col("after") == F.col("_s")).select("stretch", "first_text", F.expr(digests_sql("first_text")).alias("first_digests"))
    follow = follow.withColumn("first_base", F.expr(sketch_sql("first_digests", BASE)))
    order = Window.partitionBy("stretch").orderBy("doc_id", "text")
    rows = rows.withColumn("digests", F.expr(digests_sql("text"))).withColumn("base", F.expr(sketch_sql("digests", BASE)))
    met = rows.withColumns({f"lead_{c}": F.lead(c).over(order) for c in ("text", "digests", "base")}).join(follow, "stretch", "left")
    last = F.col("lead_text").isNull()
    following = (F.when(last, F.col(f"first_{c}")).otherwise(F.col(f"lead_{c}")).alias(f"next_{c}") for c in ("text", "digests", "base"))
    return met.select("doc_id", "text", "digests", "base", *following), [heads_at, first_at]


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, changed) of every row of docs (doc_id, text).

    A shown fingerprint is the small sketch of a text. The likenesses are those of the sets of digests, exact: the small sketches give them where their difference peels, larger
    sketches of the digests, which the row carries for this, where it does not.

    The edited text has its last quarter of code points (rounded down) replaced by as many from the start of the next document, or all of it
    if it is shorter. changed: the paragraphs in which the two differ. Null texts count as empty: an empty text has no paragraphs, is like itself
    (1) and unlike any other (0). Repeated doc_ids follow each other in the order of their texts; a lone row is its own next one.
    """
    rows, used = with_next(docs)
    n = F.char_length("text")
    rows = rows.withColumn("edited", F.concat(F.expr("substring(text, 1, char_length(text) - cast(floor(char_length(text) / 4) as int))"), F.expr("substring(next_text, 1, cast(floor(char_length(text) / 4) as int))")))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "digests", "base", "next_digests", "next_base", F.expr(digests_sql("edited")).alias("edited_digests"))
    rows = rows.withColumn("edited_base", F.expr(sketch_sql("edited_digests", BASE)))
    rows = rows.withColumns({"changed": F.expr(difference_sql("digests", "edited_digests", "base", "edited_base")), "apart": F.expr(difference_sql("digests", "next_digests", "base", "next_base"))})
    out = rows.select("doc_id", "n_chars", "edited_sha256", F.expr(shown_sql("base")).alias("fingerprint"), F.expr(shown_sql("edited_base")).alias("edited_fingerprint"), likeness("digests", "edited_digests", "changed").alias("near_edited"), likeness("digests", "next_digests", "apart").alias("near_next"), F.size("changed").alias("changed"))
    result, _ = written(out, "fingerprints")
    drop_table(docs.sparkSession, *used)
    return result
