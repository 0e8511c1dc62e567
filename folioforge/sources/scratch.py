"""The shared folder: the only place where operators and streams put intermediate data.

The cluster names a folder that the driver and all executors see in
``spark.checkpoint.dir``, or with ``setCheckpointDir``.  Only in a local session,
as in tests, and only where neither is set, a temporary folder is made and set.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder of the session that driver and executors share; raises on a cluster that names none."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if path:
        return path.rstrip("/")
    own = spark.sparkContext._jsc.sc().getCheckpointDir()
    if own.isDefined():
        return own.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors see")
    path = tempfile.mkdtemp(prefix="folioforge-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(f"file://{path}")
    return f"file://{path}"


def scratch(spark: SparkSession, tag: str) -> str:
    """A path in the shared folder that nothing has used yet."""
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written to the shared folder and read back: whatever reads it reads the same rows, and a lost executor costs a reread."""
    path = scratch(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete_inside(spark: SparkSession, root: str, name: str) -> bool:
    """Delete what ``name`` is below ``root``; raises for a name that leads elsewhere."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    base = path(root)
    fs = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if name.startswith("/") or ":" in name or any(part in ("", ".", "..") for part in name.split("/")):
        raise ValueError(f"{name!r} is not below the folder")
    return fs.delete(path(base, name), True)


def clear_old(spark: SparkSession, hours: float = 24) -> int:
    """Delete what lies in the shared folder for longer than ``hours``; how many entries.  For a time when no job runs that long."""
    root = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    before = time.time() * 1000 - hours * 3_600_000
    old = [s.getPath() for s in fs.listStatus(root) if s.getModificationTime() < before] if fs.exists(root) else []
    return sum(fs.delete(p, True) for p in old)
