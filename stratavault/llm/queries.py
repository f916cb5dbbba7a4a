"""The queries of this subpackage, with the contract's parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import classifier, embedding_dedup, mixing, near_dedup, packing, pii, quality_rules, sharding, sql, suffix_dedup
from .workspace import Workspace


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(spark, _docs(spark, sf_dir), Workspace(spark, "op1"), width=4, percent=80)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.score_quality(spark, _docs(spark, sf_dir), keep=["doc_id"], ws=Workspace(spark, "op2"))
    return out.select("doc_id", *[F.col(f"__{k}").alias(k) for k in quality_rules.BASE], F.col("__base_failed").alias("base_failed"), F.col("__kept").alias("kept"), F.col("__posterior").alias("posterior"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(spark, _docs(spark, sf_dir), Workspace(spark, "op3")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.classify(spark, _docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"), Workspace(spark, "op4"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(spark, _docs(spark, sf_dir), Workspace(spark, "op5"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(spark, _docs(spark, sf_dir), Workspace(spark, "op6"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(_docs(spark, sf_dir))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_docs(spark, sf_dir))


def op9_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, "op9")
    return packing.segments(packing.write_matrices(spark, _docs(spark, sf_dir), f"{ws.root}/matrices"))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(spark, spark.read.parquet(f"{sf_dir}/embeddings.parquet"), Workspace(spark, "op10"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_minhash_dedup, op2_quality_rules, op3_mixing, op4_quality_classifier, op5_suffix_dedup, op6_sharding, op7_pii, op8_packing, op9_token_output, op10_embedding_dedup]
    return {f.__name__: f for f in own} | {"pipeline": pipeline}


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def oracle_sql() -> dict[str, str]:
    """SQL of the queries that SQL can express; the others are held against brute force in tests/llm."""
    return {"op1_minhash_dedup": sql.OP1, "op3_mixing": sql.OP3, "op6_sharding": sql.OP6, "op7_pii": sql.OP7, "op5_suffix_dedup": sql.OP5, "op10_embedding_dedup": sql.OP10}
