"""Make this package importable in Python workers."""

from __future__ import annotations

import atexit
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()
#: Bytes of rows in an Arrow batch, where the session leaves it at Spark's 64 MB: a worker holds some batches at a time.
BATCH_BYTES, SPARKS_OWN = "8m", "67108864b"


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once for each application, and bound the batches that Python workers get."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) in (None, SPARKS_OWN, "64MB"):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    handle, path = tempfile.mkstemp(prefix="folioforge-", suffix=".zip")
    os.close(handle)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(path)
    atexit.register(Path(path).unlink, missing_ok=True)
    _shipped.add(app)
