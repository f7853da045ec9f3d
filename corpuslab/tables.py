"""Tables in the folder that driver and executors share: lineage ends there, and a lost executor costs a task."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, the warehouse on a cluster, and a temporary folder only where driver and executors are one process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        return spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    if "dir" not in _OWN:
        _OWN["dir"] = "file://" + tempfile.mkdtemp(prefix="corpuslab-")
        atexit.register(_forget, spark, _OWN["dir"])
    return _OWN["dir"]


def drop_table(spark: SparkSession, *paths: str) -> None:
    """Deletes tables of this run that no later plan reads."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/corpuslab-{uuid.uuid4().hex}-{name}"
    atexit.register(_forget, spark, path)
    for made in _SCRATCH:
        made.add(path)
    return path


_SCRATCH: list[set[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[set[str]]:
    """Tables that are made inside go at its end, but for those that are taken out of the set that it gives: for steps whose result is written, so that nothing reads what they were made of."""
    made: set[str] = set()
    _SCRATCH.append(made)
    try:
        yield made
    finally:
        _SCRATCH[:] = [s for s in _SCRATCH if s is not made]
        drop_table(spark, *made)


def _forget(spark: SparkSession, path: str) -> None:
    try:
        drop_table(spark, path)
    except Exception:  # noqa: BLE001  the session has ended; the folder's owner clears it
        return


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """The rows as a Parquet table in the shared folder, and its path. The write's shuffle files go with it, as nothing reads them again."""
    spark = df.sparkSession
    path = new_path(spark, name)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path), path


def free_names(taken: Iterable[str], *wanted: str) -> list[str]:
    """The wanted names, each with as many underscores behind it as it takes to differ from those taken, whatever their case."""
    known, out = {n.lower() for n in taken}, []
    for name in wanted:
        while name.lower() in known:
            name += "_"
        known.add(name.lower())
        out.append(name)
    return out


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
