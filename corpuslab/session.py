"""What a Spark session needs before it runs Python functions of this package."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()
#: Rows in an Arrow batch where the session leaves Spark's default: documents are long, and a batch is held several times over.
BATCH_ROWS, _BATCH = 2000, "spark.sql.execution.arrow.maxRecordsPerBatch"


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once an application, so that they need no copy of their own."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    _SHIPPED.add(context.applicationId)
    top = Path(__file__).resolve().parent
    path = os.path.join(os.path.realpath(tempfile.mkdtemp()), "corpuslab.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive:
        for file in sorted(top.rglob("*.py")):
            archive.write(file, Path("corpuslab") / file.relative_to(top))
    context.addPyFile(path)


#: Bytes of a file that may be one row group, so that one task would read them alone.
ROW_GROUP = 128 << 20


def spread(df: DataFrame) -> DataFrame:
    """df, dealt out evenly where its files cannot feed all cores: where they are fewer, and together smaller than a row group for each core, so that a few tasks would read and work on all of it.

    Larger tables and those of many files are left as they are, so that nothing large is shuffled for this.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    files = df.inputFiles()
    return df.repartition(cores) if 0 < len(files) < cores and _bytes(spark, files) < cores * ROW_GROUP else df


def _bytes(spark: SparkSession, files: list[str]) -> int:
    conf = spark._jsc.hadoopConfiguration()
    paths = [spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(f)) for f in files]
    return sum(p.getFileSystem(conf).getFileStatus(p).getLen() for p in paths)


def _give_back() -> None:
    """Memory that a task no longer uses goes back to the system: workers live on, and caches of one task should not add to those of the next."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return


def in_arrow(df: DataFrame, function, schema) -> DataFrame:
    """mapInArrow by a function of this package.

    Where the session leaves Spark's default of rows in an Arrow batch, it is set to BATCH_ROWS for the session, as Spark has no option for one call; other values stay.
    """
    spark = df.sparkSession
    ship(spark)
    if spark.conf.get(_BATCH) == "10000":
        spark.conf.set(_BATCH, str(BATCH_ROWS))

    def run(batches):
        try:
            yield from function(batches)
        finally:
            _give_back()

    return df.mapInArrow(run, schema)
