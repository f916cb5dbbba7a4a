"""Two-stage deduplication over fingerprints: first within a user, then across users.

Input rows: seq (order of uploads, one batch each), user_id, secret_id, fp, share_size.
Bytes never enter; join them back for the new shares only.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F, types as T


def intra_user(shares: DataFrame) -> DataFrame:
    """Adds dup: the user had the share before this batch.  Repeats within a batch aren't duplicates.

    One pass and one shuffle: a window has the first batch of each user's share, so
    chunks are cut and hashed once.  Rows hold no bytes, so a share that one user has
    very often spills like any sort.
    """
    first = F.min("seq").over(W.partitionBy("user_id", "fp"))
    return shares.withColumn("dup", (F.col("seq") > first).cast("int"))


def inter_user(shares: DataFrame) -> DataFrame:
    """The row of each share's first arrival: what is stored."""
    order = F.struct("seq", "secret_id", "user_id", "share_size")
    return shares.groupBy("fp").agg(F.min(order).alias("x")).select("fp", "x.*")


def transfer_set(shares: DataFrame) -> DataFrame:
    return intra_user(shares).where("dup = 0")


def ref_counts(shares: DataFrame) -> DataFrame:
    """(fp, user_id, ref_cnt); counts only grow."""
    return shares.groupBy("fp", "user_id").agg(F.count("*").alias("ref_cnt"))


def _by_owner(shares: DataFrame) -> DataFrame:
    """One row for each share and user: occurrences, their bytes, the first batch and what it brought, the first arrival."""
    order = F.struct("seq", "secret_id", "user_id", "share_size")
    per = shares.groupBy("fp", "user_id", "seq").agg(F.count("*").alias("n"), F.sum("secret_size").alias("bytes"), F.sum("share_size").alias("share_bytes"), F.min(order).alias("x"))
    return per.groupBy("fp", "user_id").agg(
        F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.sum("share_bytes").alias("share_bytes"),
        F.min(F.struct("seq", F.col("share_bytes").alias("sent"))).alias("first"), F.min("x").alias("x"),
    )


def share_index(shares: DataFrame) -> DataFrame:
    """Per share its size, owners and references; ``users`` maps user to references.  One aggregate by (share, user) serves all."""
    owned = F.col("user_id").isNotNull()
    per = _by_owner(shares.withColumn("secret_size", F.lit(0)))
    out = per.groupBy("fp").agg(
        F.min("x").alias("x"), F.array_sort(F.collect_list(F.when(owned, F.struct("user_id", F.col("n").alias("ref_cnt"))))).alias("u"),
        F.count("user_id").alias("num_users"), F.sum(F.when(owned, F.col("n"))).alias("refs"),
    )
    some = F.col("num_users") > 0
    return out.select("fp", "x.*", F.when(some, F.map_from_entries("u")).alias("users"), F.when(some, F.col("num_users")).alias("num_users"), "refs")


def transfer_stats(shares: DataFrame, clouds: int) -> DataFrame:
    """Per user: chunks, logical, share, transferred and (of shares it brought first) physical bytes, over all clouds.

    From one aggregate by (share, user): what the user's first batch with a share
    brought is transferred, and the share is stored for the user of its first arrival.
    """
    per = _by_owner(shares)
    brought = F.min("x").over(W.partitionBy("fp"))
    marked = per.withColumn("stored", F.when((brought == F.col("x")), F.col("x.share_size")).otherwise(0))
    return marked.groupBy("user_id").agg(
        F.sum("n").alias("n_chunks"), F.sum("bytes").alias("logical_bytes"), (F.sum("share_bytes") * clouds).alias("share_bytes"),
        (F.sum("first.sent") * clouds).alias("transferred_bytes"), (F.sum("stored") * clouds).alias("physical_bytes"),
    )


def upload_batches(shares: DataFrame, by: list[str], limit: int, size: str = "share_size", order: list[str] | None = None) -> DataFrame:
    """Adds batch and offset: in order, a batch closes when the next share would exceed ``limit``.

    The rule depends on all earlier shares of a group, so a group is one task's, but
    its rows stream through in sorted order and only (batch, bytes used) is kept.
    """
    order = order or ["secret_id"]
    schema = T.StructType([*shares.schema.fields, T.StructField("batch", T.LongType()), T.StructField("offset", T.LongType())])
    keys, weight = [shares.columns.index(c) for c in by], shares.columns.index(size)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, batch, used = None, 0, 0
        for rows in batches:
            groups = zip(*(rows.column(i).to_pylist() for i in keys), strict=True)
            numbers, offsets = [], []
            for group, n in zip(groups, rows.column(weight).to_pylist(), strict=True):
                if group != last:
                    last, batch, used = group, 0, 0
                elif used + n > limit and used:
                    batch, used = batch + 1, 0
                numbers.append(batch)
                offsets.append(used)
                used += n
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(numbers, pa.int64()), pa.array(offsets, pa.int64())], names=schema.names)

    return shares.repartition(*by).sortWithinPartitions(*by, *order).mapInArrow(fold, schema)


def batch_counts(batched: DataFrame, by: list[str]) -> DataFrame:
    """Per batch its own (coming) and all earlier (past) secrets and their bytes."""
    per = batched.groupBy(*by, "batch").agg(F.count("*").alias("coming_secrets"), F.sum("secret_size").alias("coming_bytes"))
    before = W.partitionBy(*by).orderBy("batch").rowsBetween(W.unboundedPreceding, -1)
    return per.withColumns({"past_secrets": F.coalesce(F.sum("coming_secrets").over(before), F.lit(0)), "past_bytes": F.coalesce(F.sum("coming_bytes").over(before), F.lit(0))})
