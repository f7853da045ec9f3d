"""Repair of conversations by their cheapest edits.

A conversation's rows and the grammar (s?(ua)+)? of role initials span a lattice whose nodes are (turn index, grammar state). Keeping, re-roling, deleting and inserting are its edges. Dijkstra's search with the
priority (cost, audit), where audit is the string of the edits' initials, explores it without building it, and the first accepting end node that it pops carries the cheapest edits, ties by their ASCII order.

Long conversations are cut into stretches of rows. What a stretch costs from each state to each other is found by the same search in whatever task; the tables of a conversation's stretches are then composed in order.
Texts move once, to be hashed in the order of turns: a task reads them as a stream and holds no conversation.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpuslab.llm.common import drop_table, partitions, written
from corpuslab.session import in_arrow

#: Rows of a stretch.
STRETCH = 512
#: Grammar states: 0 start, 1 after the system turn, 2 after a user turn, 3 after an assistant turn.
_NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
#: The role that a new or re-roled turn gets in each state.
_WANTED = ("u", "u", "a", "u")
_ROLE = {"u": "user", "a": "assistant"}
ACCEPTING = (0, 3)
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1


def search(tokens: str, start: int = 0, ends: tuple[int, ...] = ACCEPTING, every: bool = False) -> dict[int, tuple[int, str]]:
    """The cheapest edits (cost, audit) of a stretch from a state to the first end state popped, or to every one that can be reached.

    tokens: a letter for each row: its role's initial if it may stay, the initial in upper case if it is truncated besides, '-' if it must go, '?' and '!' for any other role, whole and truncated.
    """
    heap, done, found = [(0, "", 0, start)], set(), {}
    n = len(tokens)
    while heap:
        cost, audit, i, state = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == n and state in ends:
            found[state] = cost, audit
            if not every or len(found) == len(ends):
                break
        wanted = _NEXT[state, _WANTED[state]]
        if (i, wanted) not in done:
            heapq.heappush(heap, (cost + INSERT, audit + "I", i, wanted))
        if i == n:
            continue
        token = tokens[i]
        if (i + 1, state) not in done:
            heapq.heappush(heap, (cost + DELETE, audit + "D", i + 1, state))
        if token == "-":
            continue
        initial, more = token.lower(), TRUNCATED if token.isupper() or token == "!" else 0
        if (at := _NEXT.get((state, initial))) is not None and (i + 1, at) not in done:
            heapq.heappush(heap, (cost + more, audit + "K", i + 1, at))
        if (i + 1, wanted) not in done:
            heapq.heappush(heap, (cost + REROLE + more, audit + "R", i + 1, wanted))
    return found


def compose(first: dict[int, tuple[int, str]], table: dict[int, dict[int, tuple[int, str]]]) -> dict[int, tuple[int, str]]:
    """The cheapest edits to each state after one more stretch, from those before it and the stretch's table."""
    out: dict[int, tuple[int, str]] = {}
    for p, (cost, audit) in first.items():
        for q, (more, rest) in table.get(p, {}).items():
            if q not in out or cost + more < out[q][0] or cost + more == out[q][0] and audit + rest < out[q][1]:
                out[q] = cost + more, audit + rest
    return out


def _order(first: str) -> list:
    """Turns in order, nulls first; rows of one turn by role and text digest as they came, a repeated row after the first. `first`: the conversation."""
    return [F.col(first), F.col("turn").asc_nulls_first(), F.col("_r"), F.col("_d"), F.col("_n")]


def faults(rows: DataFrame) -> DataFrame:
    """(conv, turn, role, text) rows with null roles and texts as one space, blank and truncated, the keys of their order, and gone = false."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    df = rows.select(F.col("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    return df.withColumns({"_r": F.col("role"), "_d": F.md5("text"), "_n": F.lit(0), "gone": F.lit(False)})


def damaged(rows: DataFrame) -> DataFrame:
    """faults() of rows, each damaged by the crc32 of `conv_id:turn` modulo 20: 0 marks it gone, 1 empties its text, 2 takes out `[.!?]`, 3 repeats it, 4 makes it the user's."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text("conv"), F.lit(":"), text("turn"))) % 20
    df = faults(rows).withColumn("_k", kind)
    df = df.withColumns(
        {
            "gone": F.col("_k") == 0,
            "text": F.when(F.col("_k") == 1, "").when(F.col("_k") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")),
            "role": F.when(F.col("_k") == 4, "user").otherwise(F.col("role")),
            "_n": F.explode(F.when(F.col("_k") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))),
        }
    )
    return df.drop("_k")


def _tokens(df: DataFrame) -> DataFrame:
    """conv, the keys of the order, initial, token and fault of each row; rows that are gone stay, so that no conversation is lost."""
    shown = r"[^\x20\x09-\x0D]"
    blank = ~F.col("text").rlike(shown)
    cut = ~F.col("text").rlike(rf"[.!?][\x20\x09-\x0D]*\z")
    narrow = df.select("conv", "turn", "_r", "_d", "_n", "gone", F.substring("role", 1, 1).alias("initial"), F.md5(F.concat_ws("\0", F.length("role").cast("string"), "role", "text")).alias("_same"), blank.alias("blank"), cut.alias("cut"))
    again = F.row_number().over(Window.partitionBy("conv", "_same", "gone").orderBy(*_order("gone")[1:])) > 1
    fault = F.when(F.col("gone"), "g").when(F.col("blank"), "b").when(again, "d").when(F.col("cut"), "t").otherwise("")
    known = F.col("initial").isin("s", "u", "a")
    token = F.when(F.col("fault").isin("b", "d"), "-").when(~known, F.when(F.col("fault") == "t", "!").otherwise("?")).when(F.col("fault") == "t", F.upper("initial")).otherwise(F.col("initial"))
    return narrow.withColumn("fault", fault).withColumn("token", token).select("conv", "turn", "_r", "_d", "_n", "initial", "fault", "token")


_COUNTS = ("low", "high", "turns", "blank", "duplicate", "truncated", "illegal")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order to stretches (conv, part, last, tokens) with the counts of the conversation up to the stretch's end."""
    conv, part, tokens, seen = None, 0, [], False
    low = high = last_turn = before = None
    turns = blank = duplicate = truncated = illegal = 0
    kinds = None
    for batch in batches:
        kinds = batch.schema.field(0).type
        out: list[tuple] = []
        for c, turn, initial, fault, token in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            if not seen or c != conv:
                if seen:
                    out.append((conv, part, True, "".join(tokens), low, high, turns, blank, duplicate, truncated, illegal))
                conv, part, tokens, seen = c, 0, [], True
                low = high = last_turn = before = None
                turns = blank = duplicate = truncated = illegal = 0
            if fault == "g":
                continue
            if len(tokens) == STRETCH:
                out.append((conv, part, False, "".join(tokens), low, high, turns, blank, duplicate, truncated, illegal))
                part, tokens = part + 1, []
            tokens.append(token)
            if turn is not None:
                low, high = turn if low is None else low, turn
                turns += turn != last_turn
                last_turn = turn
            blank += fault == "b"
            duplicate += fault == "d"
            truncated += fault == "t"
            illegal += before is not None and before + initial not in ("su", "ua", "au")
            before = initial
        yield _stretches(out, kinds)
    if seen:
        yield _stretches([(conv, part, True, "".join(tokens), low, high, turns, blank, duplicate, truncated, illegal)], kinds)


def _stretches(rows: list[tuple], kind) -> pa.RecordBatch:
    types = [kind, pa.int64(), pa.bool_(), pa.string(), *[pa.int64()] * len(_COUNTS)]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], ["conv", "part", "last", "tokens", *_COUNTS])


def _searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches with the ways through them: (from, to, cost, audit); of a conversation's only stretch the cheapest edits alone."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
    for batch in batches:
        ways = []
        for part, last, tokens in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
            alone = last and part == 0
            tables = {0: search(tokens)} if alone else {p: search(tokens, p, (0, 1, 2, 3), every=True) for p in ((0,) if part == 0 else (0, 1, 2, 3))}
            ways.append([{"start": p, "end": q, "cost": c, "audit": a} for p, t in tables.items() for q, (c, a) in t.items()])
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in (0, 1, 2)), *(batch.column(i) for i in range(4, 4 + len(_COUNTS))), pa.array(ways, kind)], ["conv", "part", "last", *_COUNTS, "ways"])


def _composed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Searched stretches in order to a row for each conversation."""
    now: dict[int, tuple[int, str]] = {0: (0, "")}
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            if r["part"] == 0:
                now = {0: (0, "")}
            table: dict[int, dict[int, tuple[int, str]]] = {}
            for way in r["ways"]:
                table.setdefault(way["start"], {})[way["end"]] = way["cost"], way["audit"]
            now = compose(now, table)
            if r["last"]:
                gaps = 0 if r["low"] is None else r["high"] - r["low"] + 1 - r["turns"]
                out.append((r["conv"], gaps, r["blank"], r["duplicate"], r["truncated"], r["illegal"], *min(now[q] for q in ACCEPTING if q in now)))
        types = [batch.schema.field(0).type, *[pa.int64()] * 6, pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(types)], ["conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"])


def plans(rows: DataFrame) -> tuple[DataFrame, str]:
    """conv, gaps, blank, duplicate, truncated, illegal, cost and audit of each conversation of faults() or damaged(), as a written table, and its path."""
    spark, kind = rows.sparkSession, dict(rows.dtypes)["conv"]
    counts = ", ".join(f"{c} long" for c in _COUNTS)
    ordered = _tokens(rows).repartition(partitions(spark), "conv").sortWithinPartitions(*_order("conv"))
    cut, at = written(in_arrow(ordered.select("conv", "turn", "initial", "fault", "token"), _cut, f"conv {kind}, part long, last boolean, tokens string, {counts}"), "stretches")
    ways = "array<struct<start:int,end:int,cost:bigint,audit:string>>"
    searched = in_arrow(cut.repartition(partitions(spark), "conv", "part"), _searched, f"conv {kind}, part long, last boolean, {counts}, ways {ways}")
    whole = searched.repartition(partitions(spark), "conv").sortWithinPartitions("conv", "part")
    out, path = written(in_arrow(whole, _composed, f"conv {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"), "plans")
    drop_table(spark, at)
    return out, path


class _Turns:
    """The repaired turns of a conversation, as its rows come."""

    def __init__(self, audit: str) -> None:
        self.audit, self.at, self.state = audit, 0, 0

    def _step(self, initial: str) -> None:
        self.state = _NEXT[self.state, initial]

    def inserted(self) -> Iterator[tuple[str, str, str]]:
        """The new turns that stand before the next row, or at the end."""
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            wanted = _WANTED[self.state]
            self.at += 1
            self._step(wanted)
            yield _ROLE[wanted], "", "I"

    def row(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        yield from self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self._step(role[0])
            yield role, text, edit
        elif edit == "R":
            wanted = _WANTED[self.state]
            self._step(wanted)
            yield _ROLE[wanted], text, edit


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows in order, each conversation's plan before its rows, to (conv, turns) events: (conv, None) where one begins, (conv, (role, text, edit)), and (conv, ()) where it ends."""
    conv, turns = None, None
    for batch in batches:
        for c, role, text, audit in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if audit is not None:
                if turns is not None:
                    for t in turns.inserted():
                        yield conv, t
                    yield conv, ()
                conv, turns = c, _Turns(audit)
                yield conv, None
            else:
                for t in turns.row(role, text):
                    yield conv, t
    if turns is not None:
        for t in turns.inserted():
            yield conv, t
        yield conv, ()


def _in_turn(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """conv, role, text, audit: each conversation's rows in order behind its plan."""
    kept = rows.where(~F.col("gone")).select("conv", F.lit(1).alias("_p"), "turn", "_r", "_d", "_n", "role", "text", F.lit(None).cast("string").alias("audit"))
    none = [F.lit(None).cast(t).alias(c) for c, t in (("turn", "long"), ("_r", "string"), ("_d", "string"), ("_n", "int"), ("role", "string"), ("text", "string"))]
    both = kept.unionByName(plan.select("conv", F.lit(0).alias("_p"), *none, "audit"))
    first, *rest = _order("conv")
    return both.repartition(partitions(rows.sparkSession), "conv").sortWithinPartitions(first, "_p", *rest).select("conv", "role", "text", "audit")


def _batches(rows: Iterator[tuple], types: list, names: list[str], size: int = 2000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for r in rows:
        held.append(r)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array([h[i] for h in held], t) for i, t in enumerate(types)], names)
            held = []
    yield pa.RecordBatch.from_arrays([pa.array([h[i] for h in held], t) for i, t in enumerate(types)], names)


def _kind(batches: Iterator[pa.RecordBatch]) -> tuple[pa.DataType | None, Iterator[pa.RecordBatch]]:
    """The type of the first column, and the batches; None where there are none."""
    batches = iter(batches)
    first = next(batches, None)
    return (None, batches) if first is None else (first.schema.field(0).type, chain([first], batches))


def repaired(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """(conv, place, role, text, edit) of the repaired turns: K kept, R with another role, I new."""
    kind = dict(rows.dtypes)["conv"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def turns() -> Iterator[tuple]:
            place = 0
            for conv, turn in _edited(batches):
                if turn is None:
                    place = 0
                elif turn:
                    yield conv, place, *turn
                    place += 1

        arrow, batches = _kind(batches)
        if arrow is not None:
            yield from _batches(turns(), [arrow, pa.int64(), pa.string(), pa.string(), pa.string()], ["conv", "place", "role", "text", "edit"])

    return in_arrow(_in_turn(rows, plan), run, f"conv {kind}, place long, role string, text string, edit string")


def digests(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """(conv, repaired_sha256): the SHA-256 of the repaired turns, `role:text` each, joined by line ends."""
    kind = dict(rows.dtypes)["conv"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def hashes() -> Iterator[tuple]:
            digest, some = hashlib.sha256(), False
            for conv, turn in _edited(batches):
                if turn is None:
                    digest, some = hashlib.sha256(), False
                elif turn:
                    digest.update((("\n" if some else "") + f"{turn[0]}:{turn[1]}").encode("utf-8", "surrogatepass"))
                    some = True
                else:
                    yield conv, digest.hexdigest()

        arrow, batches = _kind(batches)
        if arrow is not None:
            yield from _batches(hashes(), [arrow, pa.string()], ["conv", "repaired_sha256"])

    return in_arrow(_in_turn(rows, plan), run, f"conv {kind}, repaired_sha256 string")


def repair(rows: DataFrame) -> DataFrame:
    """A row for each conversation of faults() or damaged(): conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Rows are taken by turn, nulls first; rows of one turn by role, then by the MD5 of their text, as both were before any damage. Null roles and texts are one space, a null conv_id is a conversation of its own,
    and of other columns nothing is read. A role whose initial is not s, u or a cannot be kept. A conversation without rows has zeros, an empty audit and the hash of the empty string; an empty table gives no row.
    The sort behind a conversation is Spark's, which spills; its hash goes over its texts in their order, in one task, and holds one batch of them.
    """
    plan, _ = plans(rows)
    hashes = digests(rows, plan)
    out = plan.join(hashes.withColumnRenamed("conv", "_conv"), F.col("conv").eqNullSafe(F.col("_conv")))
    return out.select(F.col("conv").alias("conv_id"), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
