"""Sending this package to the executors, and the size of the batches that Python gets."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


#: Texts are long: batches of Spark's default 10,000 rows would hold tens of megabytes several times over in each worker.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "8388608b")}


def ship(spark: SparkSession) -> None:
    """Make the package importable in Python workers, once for each Spark context; bound Arrow batches unless the session does so itself."""
    for key, (default, own) in BATCH.items():
        try:
            found = spark.conf.get(key)
        except Exception:  # not a setting of this version
            continue
        if found == default:
            spark.conf.set(key, own)
    context = spark.sparkContext
    if getattr(context, "_pairloom_shipped", False):
        return
    root = Path(__file__).resolve().parent
    handle, name = tempfile.mkstemp(suffix=".zip", prefix="pairloom-")
    os.close(handle)
    with zipfile.ZipFile(name, "w") as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, path.relative_to(root.parent))
    context.addPyFile(name)
    context._pairloom_shipped = True
