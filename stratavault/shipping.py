"""Makes this package importable in the Python workers of any cluster."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()

_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes of a batch sent to a Python worker in place of Spark's default; a session's own choice stays, and so does the bound on rows.
DEFAULT_BYTES, BATCH_BYTES = "67108864b", 8 << 20


def _bound_batches(spark: SparkSession) -> None:
    if spark.conf.get(_BYTES).lower() == DEFAULT_BYTES:
        spark.conf.set(_BYTES, str(BATCH_BYTES))


def ship(spark: SparkSession) -> SparkSession:
    """Sends the package's sources to the executors, once per application, and bounds the bytes of the session's Arrow batches."""
    _bound_batches(spark)
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        here = Path(__file__).resolve().parent
        path = os.path.join(tempfile.mkdtemp(prefix="stratavault-src-"), "stratavault_src.zip")
        with zipfile.ZipFile(path, "w") as z:
            for p in sorted(here.rglob("*.py")):
                z.write(p, p.relative_to(here.parent))
        spark.sparkContext.addPyFile(path)
        _SHIPPED.add(app)
    return spark
