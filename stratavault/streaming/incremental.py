"""Deduplication as uploads arrive, and idle users."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..params import IDLE_SECONDS
from ..plans.vault import Vault


def start_dedup(shares: DataFrame, index_path: str, checkpoint: str):
    """A stream of share rows into an index table of first arrivals: each micro-batch adds what the index lacks.

    A batch that is run again finds its own rows by batch number and writes none twice.
    """

    def add(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.groupBy("fp").agg(F.min(F.struct("seq", "secret_id", "user_id", "share_size")).alias("x")).select("fp", "x.*").withColumn("batch", F.lit(number).cast("long"))
        try:
            known = spark.read.parquet(index_path).where(F.col("batch") < number).select("fp")
            new = new.join(known, "fp", "left_anti")
        except Exception as e:  # no index yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
        new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(index_path)

    return shares.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)


def start_upload(files: DataFrame, vault: Vault, checkpoint: str):
    """A stream of files (seq, user_id, path, data) into a vault: each micro-batch is one upload, chunked, encoded and packed as it comes.

    How much a micro-batch takes is the source's to say (``maxFilesPerTrigger``,
    ``maxBytesPerTrigger``), which is what holds a fast writer back.  A batch that is
    run again has the same number and replaces its own tables.
    """
    return files.writeStream.foreachBatch(lambda batch, number: vault.upload(batch, number)).option("checkpointLocation", checkpoint)


def idle_sessions(events: DataFrame, user: str = "user_id", ts: str = "ts", idle: int = IDLE_SECONDS) -> DataFrame:
    """Per user the stretches between pauses of ``idle`` seconds or more: when buffers would be flushed."""
    w = W.partitionBy(user).orderBy(ts)
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    gap = at - F.lag(at).over(w)
    marked = events.where(F.col(ts).isNotNull()).withColumn("__new", F.when(gap < idle * 1_000_000, 0).otherwise(1))
    run = marked.withColumn("session", F.sum("__new").over(w.rangeBetween(W.unboundedPreceding, 0)))
    return run.groupBy(user, "session").agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count("*").alias("n_events"))
