"""Shards by jump consistent hashing, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, Window as W

from .workspace import Workspace

#: Rows are numbered within (shard, bin), bins being told apart by one byte; the table of offsets has shards x BINS rows at most and is broadcast.
BINS = 256


def jump_draw(key: Column, at: Column, seed: int) -> Column:
    """In (0, 1): the draw that decides where a key jumps from shard ``at``; 48 bits of an MD5."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string"), at.cast("string")).cast("binary"))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("long") + 0.5) / float(1 << 48)


def jump_shard(key: Column, shards: int, seed: int = 0) -> Column:
    """The shard of a key: with ever more shards it would jump from b to floor((b + 1) / draw); the last jump below ``shards`` counts.

    A key's jumps don't depend on ``shards``, so one more shard takes keys only
    into itself.  About ln(shards) draws are made; after the last one the loop idles.
    """
    start = F.struct(F.lit(0).cast("long").alias("b"), F.floor(1 / jump_draw(key, F.lit(0), seed)).cast("long").alias("next"))
    done = lambda acc: acc["next"] >= shards
    hop = lambda acc: F.struct(acc["next"].alias("b"), F.floor((acc["next"] + 1) / jump_draw(key, acc["next"], seed)).cast("long").alias("next"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(max(1, shards - 1))), start, lambda acc, _: F.when(done(acc), acc).otherwise(hop(acc)), lambda acc: acc["b"].cast("int"))


def shard(spark: SparkSession, docs: DataFrame, ws: Workspace, shards: int = 16, doc_id: str = "doc_id", text: str = "text", seed: int = 0) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) per row of ``docs``.

    The law is ``key``: id and shard count alone decide.  size is UTF-8 bytes plus 1,
    a null text has none; slots are gapless from 0 in each shard, in the order of
    (bin, id, crc), the bin being the first byte of an MD5 of id and crc, so that one
    id's rows are in many bins.  Null ids hash as the empty string; repeated ids share
    a shard and take a slot each.  An empty table gives an empty result.
    """
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    slim = docs.select(F.col(doc_id).alias("doc_id"), (F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"))
    placed = slim.withColumns({"shard": jump_shard(key, shards, seed), "grown_shard": jump_shard(key, shards + 1, seed), "bin": F.conv(F.substring(F.md5(F.concat_ws(":", key, F.col("text_crc32").cast("string")).cast("binary")), 1, 2), 16, 10).cast("int")})
    placed = ws.put(placed, "placed")
    counts = placed.groupBy("shard", "bin").count()
    upto = W.partitionBy("shard").orderBy("bin").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("shard", "bin", F.coalesce(F.sum("count").over(upto), F.lit(0)).alias("offset"))
    offsets = ws.put(offsets, "offsets")
    offsets = F.broadcast(offsets) if shards * BINS <= 1_000_000 else offsets
    within = W.partitionBy("shard", "bin").orderBy("doc_id", "text_crc32")
    numbered = placed.withColumn("at", F.row_number().over(within)).join(offsets, ["shard", "bin"])
    return numbered.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("offset") + F.col("at") - 1).cast("long").alias("slot"), "grown_shard")
