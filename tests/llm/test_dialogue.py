"""Repair of conversations against plain dynamic programming."""

import hashlib
import random
import re
import zlib

from corpuslab.llm import dialogue

NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
BLANK = re.compile(r"[^\x20\x09-\x0D]")
SCHEMA = "conv_id long, turn long, role string, text string, conv int, gone string, token long, _n int"


def cheapest(rows):
    """rows: (role, text, must go, truncated). The least (cost, audit, turns) by a full table, states by rows."""
    now = {0: (0, "", ())}

    def inserted(now):
        for _ in range(2):
            for s, (c, a, t) in list(now.items()):
                for role in ("user", "assistant"):
                    if (q := NEXT.get((s, role[0]))) is not None:
                        now[q] = min(now.get(q, (9**9, "", ())), (c + 2, a + "I", (*t, (role, ""))))
        return now

    for role, text, gone, cut in rows:
        after = {}
        for s, (c, a, t) in inserted(now).items():
            ways = [(s, c + 3, a + "D", t)]
            if not gone:
                if role and (s, role[0]) in NEXT:
                    ways.append((NEXT[s, role[0]], c + cut, a + "K", (*t, (role, text))))
                ways += [(NEXT[s, to[0]], c + 2 + cut, a + "R", (*t, (to, text))) for to in ("user", "assistant") if (s, to[0]) in NEXT]
            for q, *way in ways:
                after[q] = min(after.get(q, (9**9, "", ())), tuple(way))
        now = after
    return min(v for s, v in inserted(now).items() if s in (0, 3))


def expected(rows, damage=True):
    out = {}
    for c in {r[0] for r in rows}:
        mine = []
        for _, turn, role, text in (r for r in rows if r[0] == c):
            role, text = " " if role is None else role, " " if text is None else text
            kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20 if damage else 19
            key = (turn is not None, turn, role, hashlib.md5(text.encode()).hexdigest())
            new = ("user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)
            mine += [(key, i, turn, *new) for i in range(0 if kind == 0 else 2 if kind == 3 else 1)]
        mine.sort(key=lambda m: (m[0][0], m[0][1] or 0, m[0][2:], m[1]))
        seen, judged, counts = set(), [], {"b": 0, "d": 0, "t": 0}
        for *_, role, text in mine:
            fault = "b" if not BLANK.search(text) else "d" if (role, text) in seen else "t" if BLANK.findall(text)[-1] not in ".!?" else ""
            seen.add((role, text))
            judged.append((role, text, fault in ("b", "d"), int(fault == "t")))
            counts[fault] = counts.get(fault, 0) + 1
        turns = [m[2] for m in mine if m[2] is not None]
        initials = [m[3][:1] for m in mine]
        cost, audit, repaired = cheapest(judged)
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in repaired).encode()).hexdigest()
        out[c] = (c, gaps, counts["b"], counts["d"], counts["t"], illegal, cost, audit, digest)
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, -1, "x", -2, -3) for r in rows], SCHEMA).repartition(3)


def conversations(seed, count, longest, roles=("system", "user", "assistant", "tool", "", None)):
    r = random.Random(seed)
    texts = ["Yes.", "No!", "What is it?", "cut off", "", " \t", "a.b", "Ende. ", "ähm", None]
    return [(c, r.choice([None, t, t, t, r.randrange(6)]), r.choice(roles), r.choice(texts)) for c in [*range(count), None] for t in range(r.randrange(1, longest))]


def test_against_plain_dynamic_programming(spark):
    rows = conversations(1, 150, 9) + conversations(2, 40, 5)  # ids that come twice, with turns of their own
    found = dialogue.repair(dialogue.damaged(frame(spark, rows)))
    assert found.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert {r["conv_id"]: tuple(r) for r in found.collect()} == expected(rows)


def test_undamaged(spark):
    rows = conversations(3, 60, 7)
    assert {r["conv_id"]: tuple(r) for r in dialogue.repair(dialogue.faults(frame(spark, rows))).collect()} == expected(rows, damage=False)


def test_conversations_of_several_stretches(spark):
    """1,700 rows are four stretches, whose tables are composed; ties between edits go on across their borders."""
    r = random.Random(5)
    rows = [(c, t, r.choice(["user", "user", "assistant", "tool"]), f"{r.randrange(10**9)}{r.choice(['.', ''])}") for c, n in ((1, 1700), (2, 512), (3, 513), (4, 1025)) for t in range(n)]
    rows += [(5, t, "system", f"{t}.") for t in range(1100)]
    assert {r["conv_id"]: tuple(r) for r in dialogue.repair(dialogue.damaged(frame(spark, rows))).collect()} == expected(rows)


def test_all_rows_dropped_and_empty_table(spark):
    gone = [(c, t, "user", "Yes.") for c in range(40) for t in range(60) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0][:6]
    got = dialogue.repair(dialogue.damaged(frame(spark, gone))).collect()
    nothing = hashlib.sha256(b"").hexdigest()
    assert sorted(tuple(r) for r in got) == sorted({(c, 0, 0, 0, 0, 0, 0, "", nothing) for c, *_ in gone})
    assert dialogue.repair(dialogue.damaged(frame(spark, []))).collect() == []


def test_repaired_turns(spark):
    rows = [(1, 0, "assistant", "Hello."), (1, 1, "user", "Well?"), (1, 2, "user", "Well?"), (1, 3, "assistant", "cut"), (2, 0, "user", "Yes.")]
    df = dialogue.faults(frame(spark, rows))
    plan, _ = dialogue.plans(df)
    turns = sorted(tuple(r) for r in dialogue.repaired(df, plan).collect())
    assert turns == [
        (1, 0, "user", "", "I"), (1, 1, "assistant", "Hello.", "K"), (1, 2, "user", "Well?", "K"), (1, 3, "assistant", "cut", "K"),
        (2, 0, "user", "Yes.", "K"), (2, 1, "assistant", "", "I"),
    ]


def test_search_stops_at_the_first_accepting_end():
    assert dialogue.search("") == {0: (0, "")}
    assert dialogue.search("ua") == {3: (0, "KK")}
    assert dialogue.search("uA-") == {3: (4, "KKD")}
    assert set(dialogue.search("us", every=True, ends=(0, 1, 2, 3))) == {0, 1, 2, 3}
