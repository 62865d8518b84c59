"""Intermediate tables in the shared checkpoint folder, removed once their results are written."""

from __future__ import annotations

import gc
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

from sonolith.session import ensure_checkpoint_dir

_OPEN: dict[str, list[str]] = {}


#: Rows of text per Arrow batch; Spark's default of 10,000 is meant for rows of numbers.
BATCH_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Bound what a Python worker holds of long texts, unless the session sets a bound of its own."""
    if spark.conf.get(_BATCH) == "10000":
        spark.conf.set(_BATCH, str(BATCH_ROWS))


def save(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under ``spark.checkpoint.dir`` and read it back: cuts the lineage,
    survives lost executors, and keeps column pruning for the readers."""
    spark = df.sparkSession
    small_batches(spark)
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _OPEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def _remove(spark: SparkSession, paths: list[str]) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)


def drop(*tables: DataFrame) -> None:
    """Remove saved tables that nothing unwritten reads any more."""
    for t in tables:
        _OPEN[t.sparkSession.sparkContext.applicationId].remove(t.scratch_path)
        _remove(t.sparkSession, [t.scratch_path])


def saved(spark: SparkSession) -> list[str]:
    """Paths of the tables that are still there."""
    return list(_OPEN.get(spark.sparkContext.applicationId, []))


def release(spark: SparkSession, paths: list[str]) -> None:
    """Remove these tables. Call it only when every result that reads them is written."""
    still = _OPEN.get(spark.sparkContext.applicationId, [])
    for path in [p for p in paths if p in still]:
        still.remove(path)
        _remove(spark, [path])


def settle(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of jobs whose results are written: it does so when the
    driver collects what referred to them, which on a quiet driver may be hours later. The
    listeners let go of a finished job a moment after it, and files go in the background."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(1.0)
