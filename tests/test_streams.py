"""Quotas in the state store against the same rule over all rows."""

import random

from pyspark.sql import functions as F

from corpuslab.streaming.incremental import quota_stream

SCHEMA = "source string, doc_id long, hash string, cost long"


def kept(batches, most_rows, most_cost):
    seen, rows, cost, out = set(), {}, {}, []
    for batch in batches:
        for source, i, h, c in sorted(batch, key=lambda r: (r[1], r[2])):
            if rows.get(source, 0) < most_rows and cost.get(source, 0) < most_cost and (source, h) not in seen:
                seen.add((source, h))
                out.append((source, i, h, rows.get(source, 0), cost.get(source, 0)))
                rows[source], cost[source] = rows.get(source, 0) + 1, cost.get(source, 0) + (c or 0)
    return sorted(out, key=str)


def test_quota_over_twenty_batches_and_a_restart(spark, tmp_path):
    r = random.Random(2)
    batches = [[(r.choice(["a", "b", "c", None]), 100 * k + i, f"h{r.randrange(60)}", r.choice([None, 3, 10])) for i in range(r.randrange(1, 16))] for k in range(20)]

    def write(some):
        for k in some:
            spark.createDataFrame(batches[k], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run():
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        query = quota_stream(stream, "source", "doc_id", 18, 90, "cost").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(tmp_path / "out"))
        assert query.awaitTermination(90), query.stop()
        return query

    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        write(range(11))
        assert len(run().recentProgress) >= 11
        write(range(11, 20))  # a new query goes on from the checkpoint
        run()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    rows = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(tuple, rows.collect()), key=str) == kept(batches, 18, 90)


def test_an_idle_source_is_closed(spark, tmp_path):
    def step(rows):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
        quota_stream(stream, "source", "doc_id", 100, 100, "cost", idle=1).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination(60)

    spark.conf.set("spark.sql.shuffle.partitions", "2")
    step([("a", 1, "x", 1)])
    step([("b", 2, "x", 1)])  # a's timer has gone off by the end of this one
    step([("a", 3, "y", 1), ("c", 4, "x", 1)])
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sorted(r["doc_id"] for r in spark.read.parquet(str(tmp_path / "out")).select(F.col("doc_id")).collect()) == [1, 2, 4]
