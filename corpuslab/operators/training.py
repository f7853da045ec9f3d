"""Numbers of training and evaluation runs: losses over windows, logs, alarms, stopping, attention rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslab.functions import scores as S

#: First and last position of the stretches of context that losses are averaged over.
CONTEXTS = ((0, 31), (31, 95), (95, 255), (255, 511))


def losses(windows: DataFrame, group: list[str] | None = None) -> DataFrame:
    """Of windows (loss, tokens, utf8_bytes): mean loss by token, perplexity and bits per byte (null without tokens)."""
    n = F.nullif(F.sum("tokens"), F.lit(0))
    one = windows.groupBy(*(group or [])).agg((F.sum(F.col("loss") * F.col("tokens")) / n).alias("loss"), F.sum("tokens").alias("tokens"), F.sum("utf8_bytes").alias("utf8_bytes"))
    return one.withColumn("ppl", S.perplexity(F.col("loss"))).withColumn("bpb", S.bits_per_byte(F.col("loss"), F.col("tokens"), F.col("utf8_bytes")))


def context_of(position: Column) -> Column:
    out = None
    for a, b in CONTEXTS:
        out = F.when(position < b, f"{a}-{b}") if out is None else out.when(position < b, f"{a}-{b}")
    return out


def by_context(positions: DataFrame) -> DataFrame:
    """(context, loss, ppl, positions) of rows (position, loss): means over windows by position, then over each stretch."""
    each = positions.groupBy("position").agg(F.avg("loss").alias("loss"))
    by = each.groupBy(context_of(F.col("position")).alias("context")).agg(F.avg("loss").alias("loss"), F.count("*").alias("positions"))
    return by.where("context is not null").withColumn("ppl", S.perplexity(F.col("loss")))


def rises(log: DataFrame, order: str, value: str, group: list[str] | None = None, times: int = 3) -> DataFrame:
    """log with alarm: the value has risen `times` times in a row."""
    w = Window.partitionBy(*(group or [F.lit(0)])).orderBy(order)
    at = [F.col(value), *(F.lag(value, i).over(w) for i in range(1, times + 1))]
    up = F.lit(True)
    for later, earlier in zip(at, at[1:], strict=False):
        up = up & (later > earlier)
    return log.withColumn("alarm", F.coalesce(up, F.lit(False)))


def best(log: DataFrame, order: str, value: str, group: list[str] | None = None) -> DataFrame:
    """The row with the least value (the earliest of several), of each group."""
    names = log.columns
    one = log.groupBy(*(group or [])).agg(F.min_by(F.struct(*names), F.struct(value, order)).alias("_row"))
    return one.select(*(F.col("_row")[n].alias(n) for n in names))


def early_stop(probes: DataFrame, order: str, score: str, onset: float, patience: int, group: list[str] | None = None) -> DataFrame:
    """probes with best (so far), improved and stop: the best has reached the onset and `patience` probes have not improved on it."""
    keys = group or [F.lit(0)]
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = probes.withColumn("improved", F.coalesce(F.col(score) > F.max(score).over(before), F.lit(True))).withColumn("best", F.max(score).over(upto))
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    out = out.withColumn("_n", n).withColumn("_last", F.max(F.when(F.col("improved"), F.col("_n"))).over(upto))
    return out.withColumn("stop", (F.col("best") >= onset) & (F.col("_n") - F.col("_last") >= patience)).drop("_n", "_last")


def merged_log(old: DataFrame, new: DataFrame, order: str = "step") -> DataFrame:
    """Old rows from before the first new one, and the new ones."""
    first = new.agg(F.min(order).alias("_first"))
    return old.join(F.broadcast(first)).where(F.col("_first").isNull() | (F.col(order) < F.col("_first"))).drop("_first").unionByName(new)  # one row


def sweep(runs: DataFrame, keys: list[str], value: str) -> DataFrame:
    return runs.groupBy(*keys).agg(F.avg(value).alias("mean"), F.min(value).alias("least"), F.max(value).alias("most"), F.count("*").alias("seeds"))


def entity_mass(weights: Column, pieces: Column, names: Column) -> Column:
    """The weight on the pieces that share a character with the first place of any of the names in the pieces' joined text; a piece counts once, and a null name has none."""
    from corpuslab.operators.tokens import positions_of

    places = F.array_distinct(F.flatten(F.transform(F.filter(names, lambda n: n.isNotNull() & (n != "")), lambda n: positions_of(pieces, n))))
    return F.aggregate(places, F.lit(0.0), lambda total, i: total + F.coalesce(F.get(weights, i), F.lit(0.0)))


def attention(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Means of entropy and distance of rows (weights array<double>, query) to four places, by keys; where rows have pieces and names, also entity_mass."""
    means = [F.round(F.avg(S.entropy(F.col("weights"))), 4).alias("entropy"), F.round(F.avg(S.mean_distance(F.col("weights"), F.col("query"))), 4).alias("distance")]
    if {"pieces", "names"} <= set(rows.columns):
        means.append(F.round(F.avg(entity_mass(F.col("weights"), F.col("pieces"), F.col("names"))), 4).alias("entity_mass"))
    return rows.groupBy(*keys).agg(*means)
