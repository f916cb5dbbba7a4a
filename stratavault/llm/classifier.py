"""Quality classifier: random Fourier features over document statistics, ridge scores, isotonic calibration."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .quality_rules import with_stats
from .textstats import STATS
from .workspace import Workspace

FOLDS = 3  # of the labelled rows, for calibration
FEATURES = ["log_words", "mean_word", "symbols", "symbol_words", "upper", "digits", "punct", "shout", "bars", "dup_lines", "repeats", "distinct", "line_words"]


def features_of(stats: np.ndarray) -> np.ndarray:
    """Rows of counts (in the order of STATS) to rows of bounded features; no language or source."""
    c = {k: stats[:, i].astype(float) for i, k in enumerate(STATS)}
    words, chars, letters = np.maximum(c["n_words"], 1), np.maximum(c["word_chars"], 1), np.maximum(c["n_letters"], 1)
    return np.stack([
        np.log1p(c["n_words"]) / 10, np.minimum(c["word_chars"] / words, 40) / 10, np.sqrt(c["n_symbols"] / chars), np.minimum(c["n_symbols"] / words, 5) / 5,
        c["n_upper"] / letters, np.sqrt(c["n_digits"] / chars), np.sqrt(c["n_punct"] / chars), np.minimum(c["n_shout"] / words, 3) / 3, np.minimum(c["n_bars"] / words, 2) / 2,
        c["n_dup_lines"] / np.maximum(c["n_lines"], 1), c["n_repeat_words"] / words, c["n_distinct"] / words, np.minimum(np.log1p(words / np.maximum(c["n_lines"], 1)), 8) / 8,
    ], 1)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    waves: np.ndarray
    phase: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    levels: np.ndarray

    def raw(self, x: np.ndarray) -> np.ndarray:
        return lift((x - self.mean) / self.scale, self.waves, self.phase) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated, with a trace of the raw score so that equal levels keep its order; strictly within 0 and 1."""
        raw = self.raw(x)
        level = np.interp(raw, self.knots, self.levels)
        return np.clip(0.998 * level + 0.002 / (1 + np.exp(-np.clip(raw, -30, 30))), 0.0, 1.0)


def lift(z: np.ndarray, waves: np.ndarray, phase: np.ndarray) -> np.ndarray:
    """Random Fourier features, whose inner products approximate a Gaussian kernel, and a constant."""
    return np.hstack([np.sqrt(2 / len(phase)) * np.cos(z @ waves + phase), np.ones((len(z), 1))])


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over points in the order of x; (block centres, block means), linear in between."""
    blocks: list[list[float]] = []  # weight, weighted y, weighted x
    for xi, yi, wi in zip(x, y, w, strict=True):
        blocks.append([wi, wi * yi, wi * xi])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][0] >= blocks[-1][1] / blocks[-1][0]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    return np.array([b[2] / b[0] for b in blocks]), np.array([b[1] / b[0] for b in blocks])


def _sums(fn, width: int):
    """Partition sums of fn(X, y, fold), one row per partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for batch in batches:
            if batch.num_rows:
                *x, y, fold = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns))
                total += fn(features_of(np.stack(x, 1)), y, fold)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    return run


def fit(train: DataFrame, n_waves: int = 256, gamma: float = 0.15, ridge: float = 1e-3, seed: int = 4, bins: int = 2000) -> Model:
    """Fits on (counts in the order of STATS..., target, fold from 0 to FOLDS - 1).

    Three passes over the counts, each a sum per partition: means and spreads, normal
    equations of each fold, calibration histogram.  The score of a row in the
    histogram is by weights from the other folds, so the calibration is of rows that
    a score has not seen.  ``train`` has a fixed number of partitions (see
    ``classify``), which bounds what reaches the driver.  With no labelled rows every
    score is 0.5.
    """
    d = len(FEATURES)

    def total(fn, width: int) -> np.ndarray:
        rows = train.mapInArrow(_sums(fn, width), "sums binary").collect()
        return np.sum([np.frombuffer(r[0]) for r in rows], 0) if rows else np.zeros(width)

    m = total(lambda x, y, fold: np.concatenate([[len(y)], x.sum(0), (x**2).sum(0)]), 1 + 2 * d)
    n = max(m[0], 1.0)
    mean = m[1 : d + 1] / n
    scale = np.sqrt(np.maximum(m[d + 1 :] / n - mean**2, 0)) + 0.02
    rng = np.random.default_rng(seed)
    waves, phase = rng.normal(0, np.sqrt(2 * gamma), (d, n_waves)), rng.uniform(0, 2 * np.pi, n_waves)
    p = n_waves + 1

    def normal(x: np.ndarray, y: np.ndarray, fold: np.ndarray) -> np.ndarray:
        z = lift((x - mean) / scale, waves, phase)
        parts = [(z[fold == k], y[fold == k]) for k in range(FOLDS)]
        return np.concatenate([np.concatenate([(a.T @ a).ravel(), a.T @ b, [len(b)]]) for a, b in parts])

    s = total(normal, FOLDS * (p * p + p + 1)).reshape(FOLDS, -1)

    def solved(sums: np.ndarray) -> np.ndarray:
        return np.linalg.solve(sums[: p * p].reshape(p, p) + ridge * max(sums[-1], 1.0) * np.eye(p), sums[p * p : -1])

    model = Model(mean, scale, waves, phase, solved(s.sum(0)), np.array([0.0]), np.array([0.5]))
    others = np.stack([solved(s.sum(0) - s[k]) for k in range(FOLDS)], 1)
    edges = np.linspace(-0.5, 1.5, bins + 1)

    def histogram(x: np.ndarray, y: np.ndarray, fold: np.ndarray) -> np.ndarray:
        raw = (lift((x - mean) / scale, waves, phase) @ others)[np.arange(len(y)), fold]
        at = np.clip(np.searchsorted(edges, raw) - 1, 0, bins - 1)
        return np.concatenate([np.bincount(at, minlength=bins), np.bincount(at, y, minlength=bins)])

    h = total(histogram, 2 * bins)
    some = h[:bins] > 0
    if some.any():
        model.knots, model.levels = isotonic(((edges[:-1] + edges[1:]) / 2)[some], (h[bins:][some] / h[:bins][some]), h[:bins][some])
    return model


def classify(
    spark: SparkSession,
    docs: DataFrame,
    labels: DataFrame,
    ws: Workspace,
    doc_id: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    folds: int = 5,
    threshold: float = 0.3,
    max_train_rows: int = 1_000_000,
    train_partitions: int = 16,
) -> DataFrame:
    """(doc_id, held_out, score, predicted) per row of ``docs``.

    Learns from labelled rows whose crc32(doc_id as text) mod ``folds`` is not 0,
    at most about ``max_train_rows`` of them, chosen by hash.  Only counts of the
    text enter a score.  Null and empty texts get a score like any; null labels are
    no labels, several labels of one id are averaged; a null id is not held out and
    not learned from; empty tables give an empty result or, without labels, 0.5.
    """
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    stats = ws.put(with_stats(d, "text", ["doc_id"]), "stats")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds
    marks = labels.select(F.col(doc_id).alias("id"), F.col(label).cast("double").alias("mark")).where("id is not null and mark is not null")
    marks = marks.groupBy("id").agg(F.avg("mark").alias("mark"))
    n = marks.count()
    if n > max_train_rows:
        marks = marks.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(1e6 * max_train_rows / n))
    cols = [f"__{k}" for k in STATS]
    train = stats.where(fold != 0).join(marks, F.col("doc_id") == F.col("id")).select(*cols, "mark", F.pmod(F.xxhash64("id"), F.lit(FOLDS)).cast("int").alias("part"))
    train = ws.put(train.repartition(train_partitions), "train")
    model = fit(train)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([batch.column(i + 1).to_numpy(zero_copy_only=False) for i in range(len(STATS))], 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(features_of(x)))], names=["doc_id", "score"])

    out = stats.select("doc_id", *cols).mapInArrow(scored, T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("score", T.DoubleType())]))
    return out.select("doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
