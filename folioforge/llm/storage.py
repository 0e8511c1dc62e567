"""Intermediate tables in the shared folder, the only place where operators put them."""

from __future__ import annotations

import gc

from pyspark.sql import DataFrame, SparkSession

from folioforge.sources.scratch import scratch as fresh_path


def staged(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The reread table has no lineage: an executor lost later costs a reread,
    not a recomputation.
    """
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of :func:`staged` that nothing will read again: what came of them has been written."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t.staged_at)
        path.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner remove the shuffle files of finished stages now, not when the driver next collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
