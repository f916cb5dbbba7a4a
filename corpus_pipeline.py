"""From documents to packed training sequences, stage by stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from stratavault.llm import mixing, near_dedup, packing, pii, quality_rules
from stratavault.llm.workspace import Workspace
from stratavault.shipping import ship


_OPEN: list[Workspace] = []


def _workspace(spark: SparkSession, label: str) -> Workspace:
    """A workspace that ``run`` clears once the stage's result is written."""
    _OPEN.append(Workspace(spark, label))
    return _OPEN[-1]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose words are many and varied enough and whose posterior quality is at least a half."""
    scored = quality_rules.score_quality(spark, docs, ws=_workspace(spark, "quality"))
    return scored.where(F.col(f"{quality_rules.free_prefix(docs.columns)}kept")).select(*docs.columns)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates; of rows that repeat an id, the one whose text, then whole row as JSON, is least; rows without an id stay."""
    ws = _workspace(spark, "dedup")
    found = near_dedup.near_duplicates(spark, docs, ws, width=5, percent=80)
    kept = ws.put(found.where("kept and doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")), "kept")
    out = docs.join(kept.where("n = 1"), "doc_id", "left_semi").unionByName(docs.where("doc_id is null"))
    if not kept.where("n > 1").isEmpty():
        several = docs.join(kept.where("n > 1"), "doc_id", "left_semi")
        row = F.struct(*docs.columns)
        least = several.groupBy("doc_id").agg(F.min_by(row, F.struct(F.coalesce("text", F.lit("")).alias("text"), F.to_json(row).alias("row"))).alias("row"))
        out = out.unionByName(least.select("row.*"))
    return out


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data give way to the names of their kinds."""
    ship(spark)
    return pii.redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it."""
    taken = mixing.mix(spark, docs, _workspace(spark, "mix"), carry=True).where("copies > 0")
    return taken.select(F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"), "payload").select("payload.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences of at most 2048."""
    ship(spark)
    return packing.pack(docs)


STAGES = [("quality_rules", quality), ("minhash_dedup", dedup), ("pii", private_data), ("mixing", mixed), ("packing", packed)]

#: The stages are not expressible in SQL (EM, sketches, tokenizer); tests hold them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for (name, stage), (before, _) in zip(STAGES[:-1], [("", None), *STAGES], strict=False):
        _OPEN.clear()
        docs = ws.put(stage(spark, docs, sf_dir), name)
        for done in _OPEN:
            done.clear()
        if before:
            ws.drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
