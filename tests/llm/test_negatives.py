"""Hard negatives against brute force."""

import math
import random

import pytest

from corpuslab.llm import negatives

SCHEMA = "vec_id long, label int, embedding array<float>, id long, v string, square int, win int"


def brute(rows, every, positives=5, best=3, low=50, high=95):
    one = {}
    for i, label, vector in rows:
        if i is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        v = [math.floor(256 * float(x)) for x in vector]
        key = label, b"".join(int(x).to_bytes(4, "little", signed=True) for x in v)
        if i not in one or key < one[i][0]:
            one[i] = key, label, v
    out = []
    for a, (_, label, v) in one.items():
        if a % every:
            continue
        met = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), i, at) for i, (_, at, w) in one.items() if i != a and len(w) == len(v))
        for s, p, _ in [m for m in met if m[2] == label][:positives]:
            hard = [m for m in met if m[2] != label and -s * low <= 100 * -m[0] <= -s * high][:best]
            out += [(a, p, k + 1, i, -s, -score) for k, (score, i, _) in enumerate(hard)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(*r, -1, "x", -2, -3) for r in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize(("seed", "kinds"), [(1, 1000), (2, 4), (3, 40)])
def test_against_brute_force(spark, seed, kinds):
    """With 4 kinds of vectors nearly all scores are ties, and windows end inside them."""
    r = random.Random(seed)
    pool = [[r.uniform(-0.2, 1) for _ in range(6)] for _ in range(kinds)]
    rows = [(i, r.randrange(3), r.choice(pool)) for i in r.sample(range(3000), 300)]
    found = negatives.mine(frame(spark, rows), "id % 10 = 0", wave=16)  # several waves
    assert sorted(map(tuple, found.collect())) == brute(rows, 10)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def test_nulls_lengths_and_repeated_rows(spark):
    r = random.Random(4)
    some = lambda n=4: [r.uniform(0, 1) for _ in range(n)]
    rows = [(i, r.randrange(2), some()) for i in range(40)] + [(i, r.randrange(2), some(7)) for i in range(40, 60)]
    rows += rows[:9] + [(3, 1, some()), (3, 0, some())]  # repeated rows, and ids with several vectors
    rows += [(60, None, some()), (65, 1, None), (70, 1, [0.5, None, 0.5, 0.5]), (75, 0, [0.5, math.nan, 0.5, 0.5]), (80, 0, [0.5, math.inf, 0.5, 0.5]), (None, 1, some())]
    rows += [(85, 0, []), (90, 1, []), (95, 0, []), (-5, 1, some()), (-10, 0, some())]
    float32 = spark.createDataFrame([(x,) for *_, v in rows if v for x in v if x is not None], "x float").collect()
    assert len(float32) > 200
    rows = [tuple(x) for x in spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").collect()]  # components as floats hold them
    assert sorted(map(tuple, negatives.mine(frame(spark, rows), "id % 5 = 0").collect())) == brute(rows, 5)


def test_large_components_stay_exact(spark):
    r = random.Random(5)
    rows = [(i, r.randrange(2), [float(r.randrange(1, 1 << 17)) for _ in range(3)]) for i in range(60)]
    assert max(sum((256 * x) ** 2 for x in v) for *_, v in rows) > 2**50
    found = negatives.mine(frame(spark, rows), "id % 6 = 0")
    assert sorted(map(tuple, found.collect())) == brute(rows, 6)
    beyond = [*rows, (60, 0, [1e30, 0.0, 0.0]), (66, 1, [4e6, 4e6, 4e6])]  # too long for 64-bit scores: they take no part
    assert sorted(map(tuple, negatives.mine(frame(spark, beyond), "id % 6 = 0").collect())) == brute(rows, 6)


def test_empty_tables_and_no_anchor(spark):
    assert negatives.mine(frame(spark, []), "id % 5 = 0").collect() == []
    assert negatives.mine(frame(spark, [(1, 0, [1.0]), (2, 1, [0.5])]), "id % 5 = 0").collect() == []
    assert negatives.mine(frame(spark, [(5, 0, [1.0]), (2, 1, [0.5])]), "id % 5 = 0").collect() == []  # an anchor without positives
