"""A key-value store as a change log: rows of key, seq, op ('put' or 'del') and value."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F


def latest(log: DataFrame, snapshot: int | None = None) -> DataFrame:
    """State after all changes, or after those up to ``snapshot``: last change per key, deletions dropped."""
    seen = log if snapshot is None else log.where(F.col("seq") <= snapshot)
    top = seen.groupBy("key").agg(F.max(F.struct("seq", "op", "value")).alias("x"))
    return top.select("key", "x.seq", "x.op", "x.value").where("op <> 'del'").drop("op")


def write(log: DataFrame, batch: DataFrame) -> DataFrame:
    """Appends an ordered group of changes."""
    return log.unionByName(batch)


def get(log: DataFrame, keys: DataFrame) -> DataFrame:
    """Values of the keys asked for; null where there is none."""
    return keys.join(latest(log), "key", "left")


def scan(log: DataFrame, start=None, end=None, reverse: bool = False, comparator: Callable[[Column], Column] | None = None) -> DataFrame:
    """Keys in [start, end), in order.  ``comparator`` gives what keys are ordered by (by default the keys themselves), for bounds and order alike."""
    by = comparator or (lambda key: key)
    rows = latest(log)
    rows = rows if start is None else rows.where(by(F.col("key")) >= by(F.lit(start)))
    rows = rows if end is None else rows.where(by(F.col("key")) < by(F.lit(end)))
    return rows.orderBy(by(F.col("key")).desc() if reverse else by(F.col("key")).asc())


def seek(log: DataFrame, target, steps: int = 1, reverse: bool = False, comparator: Callable[[Column], Column] | None = None) -> DataFrame:
    """The first ``steps`` keys from ``target`` on (or from it back)."""
    if not reverse:
        return scan(log, target, None, False, comparator).limit(steps)
    by = comparator or (lambda key: key)
    return latest(log).where(by(F.col("key")) <= by(F.lit(target))).orderBy(by(F.col("key")).desc()).limit(steps)


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("key").unionByName(b.select("key")).distinct()


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("key").intersect(b.select("key"))


def subtract(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("key").subtract(b.select("key"))


def range_bytes(log: DataFrame, start, end) -> DataFrame:
    """(n_keys, n_bytes) of the keys in [start, end): 8 bytes a key and its value's bytes."""
    value = F.octet_length(F.encode(F.col("value").cast("string"), "UTF-8"))
    rows = latest(log).where((F.col("key") >= start) & (F.col("key") < end))
    return rows.agg(F.count("*").alias("n_keys"), F.coalesce(F.sum(F.coalesce(value, F.lit(0)) + 8), F.lit(0)).cast("long").alias("n_bytes"))


def histogram(rows: DataFrame, column: str, width: float) -> DataFrame:
    return rows.groupBy(F.floor(F.col(column) / width).cast("long").alias("bucket")).agg(F.count("*").alias("n"), F.min(column).alias("low"), F.max(column).alias("high"))


def summary(rows: DataFrame, column: str, shares: tuple[float, ...] = (0.5, 0.95, 0.99), digits: int = 6) -> DataFrame:
    """(n, low, high, mean, stddev, p50, ...): one row, the percentiles interpolated, all rounded to ``digits``."""
    x = F.col(column)
    at = [F.round(F.percentile(x, q), digits).alias(f"p{round(100 * q)}") for q in shares]
    return rows.agg(F.count(x).alias("n"), F.min(x).alias("low"), F.max(x).alias("high"), F.round(F.avg(x), digits).alias("mean"), F.round(F.stddev_pop(x), digits).alias("stddev"), *at)
