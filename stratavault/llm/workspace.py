"""Tables between the steps of one operator, in the folder all executors share."""

from __future__ import annotations

import gc
import time

from pyspark.sql import DataFrame, SparkSession

from ..scratch import folder
from ..shipping import ship


class Workspace:
    """Named Parquet tables that cut lineage: a lost executor costs a re-read, not a re-run.

    ``put`` writes and reads back, ``drop`` deletes a table that no later step reads,
    ``keep_only`` all but those that the result reads, ``clear`` everything once the
    result has been used, ``settle`` frees shuffle files after a large step.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = ship(spark)
        self.root = folder(spark, label)
        self.tables: set[str] = set()

    def put(self, df: DataFrame, name: str) -> DataFrame:
        path, schema = f"{self.root}/{name}", df.schema
        df.write.option("compression", "zstd").parquet(path)
        self.tables.add(name)
        return self.spark.read.schema(schema).parquet(path)

    def drop(self, *names: str) -> None:
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(conf).delete(path, True)
            self.tables.discard(name)

    def keep_only(self, *names: str) -> None:
        self.drop(*sorted(self.tables - {*names}))

    def clear(self) -> None:
        self.drop("")
        self.tables.clear()

    def settle(self) -> None:
        """Lets Spark's cleaner free the shuffle files of steps that are over."""
        for _ in range(2):  # what the first pass lets go of, the cleaner sees after the second
            gc.collect()
            self.spark.sparkContext._jvm.System.gc()
            time.sleep(0.3)
