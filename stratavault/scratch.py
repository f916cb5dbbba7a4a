"""Where tables between steps go: a folder that the driver and all executors share."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir.

    One is chosen only where it is unset and everything runs in this process; on a
    cluster executors would not see it, so there an unset folder is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="stratavault-")
        spark.sparkContext.setCheckpointDir(root)
    return root


def folder(spark: SparkSession, label: str) -> str:
    """A new folder's name there."""
    return f"{shared_root(spark)}/stratavault/{label}-{uuid.uuid4().hex}"


def settle(spark: SparkSession) -> None:
    """Lets Spark's cleaner free the shuffle files of steps that are over."""
    for _ in range(2):  # what the first pass lets go of, the cleaner sees after the second
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)
