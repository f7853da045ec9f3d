"""Python's own stream, in parallel."""

import random

import numpy as np
from pyspark.sql import functions as F

from corpuslab.operators import replay


def test_jumps():
    assert replay.own_polynomial().bit_length() == replay.DEGREE + 1
    rng = random.Random(77)
    own = np.array([rng.random() for _ in range(30_000)])
    for start in (0, 1, 2, 311, 312, 313, 9968, 9969, 25_000):
        stream = replay.draws(77, start)
        got = np.concatenate([next(stream) for _ in range(4)])
        assert got.tolist() == own[start : start + len(got)].tolist()
    far = np.array(random.Random(3).getstate()[1][:624], np.uint32)
    there = replay.jumped(replay.jumped(far, 10**12), 7 * 10**11)
    assert replay.twisted(there).tolist() == replay.twisted(replay.jumped(far, 17 * 10**11)).tolist()


def test_300_000_rows_in_eight_partitions(spark):
    n = 300_000
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    rows = spark.range(n).select((n - F.col("id")).alias("k"), F.lit(1).alias("_rank")).repartition(5)
    got = replay.replayed(rows, [F.col("k")], 1337)
    found = got.orderBy("k").select("chance").toPandas()["chance"].to_numpy()
    spark.conf.set("spark.sql.shuffle.partitions", before)
    rng = random.Random(1337)
    assert found.tolist() == [rng.random() for _ in range(n)]
    assert got.columns == ["k", "_rank", "chance"]
    assert replay.replayed(rows.limit(0), [F.col("k")], 1).count() == 0
