"""Ingestion in steps: a stream of documents against the hashes of all that came before."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from corpuslab.operators.dedup import first_of
from corpuslab.operators.quality import quota
from corpuslab.session import ship


def keep_new(batch: DataFrame, kept: DataFrame | None, order: str = "doc_id") -> DataFrame:
    """Rows of a batch (doc_id, text) whose text neither an earlier batch nor an earlier row has."""
    rows = first_of(batch.withColumn("hash", F.sha2("text", 256)), F.col("hash"), [F.col(order)])
    return rows if kept is None else rows.join(kept.select("hash"), "hash", "left_anti").select(*rows.columns)


def ingest(spark: SparkSession, stream: DataFrame, out: str, checkpoint: str, order: str = "doc_id", limits: dict[str, int] | None = None) -> StreamingQuery:
    """Writes the new documents of each micro-batch to out/docs/batch=<n>, and their hashes alone to out/hashes/batch=<n>, which is all that later batches read of them.

    A batch that is run again overwrites its own folders and reads only the earlier ones, so that a restart neither loses nor repeats rows.
    limits: column (or "*", for rows) to a quota over all batches, as in quality.quota(): documents are kept while what was kept before them is below it. The size of a
    micro-batch is the stream's own (maxFilesPerTrigger).
    """

    def table(session: SparkSession, name: str, schema: str, number: int) -> DataFrame | None:
        top = session._jvm.org.apache.hadoop.fs.Path(f"{out}/{name}")
        if not top.getFileSystem(session._jsc.hadoopConfiguration()).exists(top):
            return None
        return session.read.schema(f"{schema}, batch long").parquet(f"{out}/{name}").where(F.col("batch") < number)  # partitions of later batches are not read

    def step(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        rows = keep_new(batch, table(session, "hashes", "hash string", number), order)
        if limits:
            names = [f"t{i}" for i in range(len(limits))]
            kept = table(session, "totals", ", ".join(f"{n} long" for n in names), number)
            so_far = kept.agg(*(F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names)).first() if kept is not None else dict.fromkeys(names, 0)  # a row for each batch
            rows = quota(rows, [F.col(order)], {c: most - so_far[n] for n, (c, most) in zip(names, limits.items(), strict=True)})
        rows.write.mode("overwrite").parquet(f"{out}/docs/batch={number}")
        stored = session.read.schema(rows.schema).option("basePath", f"{out}/docs/batch={number}").parquet(f"{out}/docs/batch={number}")
        stored.select("hash").write.mode("overwrite").parquet(f"{out}/hashes/batch={number}")
        if limits:
            cost = [F.sum((F.lit(1) if c == "*" else F.col(c)).cast("long")) for c in limits]
            stored.agg(*(F.coalesce(c, F.lit(0)).cast("long").alias(n) for n, c in zip(names, cost, strict=True))).write.mode("overwrite").parquet(f"{out}/totals/batch={number}")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, time: str, delay: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Events by type in windows of time; rows later than the delay are left out of closed windows."""
    return events.withColumn("_at", F.col(time).cast("timestamp")).withWatermark("_at", delay).groupBy(F.window("_at", width), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


#: How long a source may bring nothing before it is closed, in milliseconds.
IDLE = 24 * 3600 * 1000
_KEPT = "{key} {kind}, {order} {order_kind}, hash string, rows_before long, cost_before long"


class _Quota(StatefulProcessor):
    """A source's totals and the hashes that it has brought, in the state store; a timer closes a source that has been idle, and its hashes go."""

    def __init__(self, key: str, order: str, most_rows: int, most_cost: int, idle: int) -> None:
        self.key, self.order, self.most_rows, self.most_cost, self.idle = key, order, most_rows, most_cost, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.totals = handle.getValueState("totals", "rows long, cost long, closed boolean")
        self.seen = handle.getMapState("seen", "hash string", "n int")

    def _open(self, rows: int, cost: int) -> bool:
        return rows < self.most_rows and cost < self.most_cost

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  Spark's names
        n, cost, closed = self.totals.get() if self.totals.exists() else (0, 0, False)
        if closed or not self._open(n, cost):
            return
        batch = pd.concat(list(rows)).sort_values([self.order, "hash"])  # a micro-batch's ids, hashes and numbers
        out = []
        for order, digest, own in zip(batch[self.order], batch["hash"], batch["cost"], strict=True):
            if self._open(n, cost) and not self.seen.containsKey((digest,)):
                out.append((key[0], order, digest, n, cost))
                n, cost = n + 1, cost + (0 if pd.isna(own) else int(own))
                self.seen.updateValue((digest,), (1,))
        full = not self._open(n, cost)
        if full:
            self.seen.clear()  # nothing is compared with them any more
        self.totals.update((n, cost, full))
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        if not full:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle)
        if out:
            yield pd.DataFrame(out, columns=[self.key, self.order, "hash", "rows_before", "cost_before"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        n, cost, _ = self.totals.get() if self.totals.exists() else (0, 0, False)
        self.totals.update((n, cost, True))
        self.seen.clear()
        return iter(())

    def close(self) -> None:
        pass


def quota_stream(stream: DataFrame, key: str, order: str, most_rows: int, most_cost: int, cost: str, idle: int = IDLE) -> DataFrame:
    """(key, order, hash, rows_before, cost_before) of the rows of a stream (key, order, hash, cost) that each key keeps: the first of each hash, in the order of micro-batches and in them of `order`, while fewer than
    `most_rows` were kept before it and their cost is below `most_cost`. Null costs count as 0; other columns, texts above all, are left to a join with what is kept.

    Totals and hashes are in the state store (RocksDB, which this sets for the session), so that a restart from the checkpoint goes on where it ended. A key that brings nothing for `idle` milliseconds is closed.
    A key's rows of one micro-batch are one task's; the stream says how large a micro-batch is. Timers go off with the next micro-batch: without data Spark would run empty ones for them without end, so that
    trigger(availableNow=True) would never be done, and spark.sql.streaming.noDataMicroBatches.enabled is set to false for the session as well.
    """
    spark = stream.sparkSession
    ship(spark)
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    kinds = dict(stream.dtypes)
    narrow = stream.select(key, order, "hash", F.col(cost).cast("long").alias("cost"))
    schema = _KEPT.format(key=key, kind=kinds[key], order=order, order_kind=kinds[order])
    return narrow.groupBy(key).transformWithStateInPandas(_Quota(key, order, most_rows, most_cost, idle), schema, "Append", "ProcessingTime")
