"""Make this package importable in the Python workers of a session."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


#: Bytes of an Arrow batch, unless the session says otherwise: bounds what a worker holds, however long texts are.
BATCH = 8 << 20


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once a Spark context.

    Functions are pickled by reference, so what their modules remember (parsed
    vocabularies, caches) lives as long as a worker does.
    """
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH))
    context = spark.sparkContext
    if getattr(context, "_loom_shipped", False):
        return
    root = Path(__file__).resolve().parent.parent
    path = os.path.join(tempfile.mkdtemp(prefix="loom-"), f"{root.name}.zip")
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    context.addPyFile(path)
    context._loom_shipped = True
