"""Upload as one plan: files to chunks to share metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import binary as B
from ..operators import chunking
from ..params import Chunking, Coding


def spread(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` over all cores, for work that costs far more than moving them, where the input has fewer splits than cores; else as they are."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores, key) if rows.rdd.getNumPartitions() < cores else rows


def share_rows(files: DataFrame, size: int | None = 256, coding: Coding | None = None, variable: Chunking | None = None, with_data: bool = False) -> DataFrame:
    """Chunks with fp and share_size, from which the dedup stages go on.

    The fingerprint is of the secret up to its zero padding, which decides the
    shares of a deterministic codec; so nothing needs encoding here.
    """
    coding = coding or Coding()
    chunks = chunking.variable_chunks(files, variable) if variable else chunking.fixed_chunks(files, size)
    whole = B.pad_zero(F.col("chunk"), B.aligned_size(F.col("secret_size"), coding))
    out = chunks.withColumns({"fp": B.fingerprint(whole), "share_size": B.share_size(F.col("secret_size"), coding)})
    return out if with_data else out.drop("chunk")
