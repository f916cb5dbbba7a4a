"""Near-duplicate embeddings: Euclidean p-stable hashing in many tables, exact cosine in each bucket."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .components import connected_components
from .runs import each_run, in_block_pairs, spread_join
from .workspace import Workspace

MISS = 1e-4  # chance that a pair just at the threshold meets in no table
TOGETHER = 512  # rows of small buckets that are multiplied together
WIDTH = 7.0  # of a quantisation step, in distances of a pair just at the threshold


def collision(ratio: float) -> float:
    """Chance that one quantised projection agrees, for a step of ``ratio`` times the distance."""
    return math.erf(ratio / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * ratio) * (1 - math.exp(-ratio * ratio / 2))


def plan_tables(n: int, cosine: float) -> tuple[int, int, float]:
    """(tables, projections a table, step): projections grow with log n so that unrelated vectors seldom meet, tables so that near ones do."""
    near = math.sqrt(2 - 2 * cosine)
    step = WIDTH * near
    p_near, p_far = collision(WIDTH), collision(step / math.sqrt(2))
    k = max(4, math.ceil(math.log(max(n, 2)) / -math.log(p_far)))
    return math.ceil(math.log(MISS) / math.log1p(-(p_near**k))), k, step


def _hasher(tables: int, k: int, step: float, dim: int):
    rng = np.random.default_rng(10)
    planes, shift = rng.normal(size=(dim, tables * k)) / step, rng.uniform(size=tables * k)
    odd = rng.integers(1, 1 << 62, k, dtype=np.int64) | 1

    def keys(x: np.ndarray) -> np.ndarray:
        """A 64-bit key for each vector (unit rows) and table."""
        cells = np.floor(x @ planes + shift).astype(np.int64).reshape(len(x), tables, k)
        with np.errstate(over="ignore"):
            h = (cells * odd).sum(2)
            h = (h ^ (h >> 29)) * np.int64(0x3F58476D1CE4E5B9)
            return (h ^ (h >> 32)) + np.arange(tables)[None, :] * np.int64(0x1F123BB5159A55E5)

    return keys


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    x = x / np.abs(x).max(1, keepdims=True)  # squares then neither vanish nor overflow
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def near_vectors(spark: SparkSession, table: DataFrame, ws: Workspace, vec_id: str = "vec_id", embedding: str = "embedding", cosine: float = 0.95) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row of ``table``.

    Vectors whose cosine in double precision is at least ``cosine`` are linked, all
    copies counting.  Equal vectors are one class with a weight.  Each class has a
    key in every table; classes that share a bucket are compared by matrix product,
    block by block, and each sums the weights it is linked to: a pair counts only in
    the first table in which it meets.  No pairs are emitted, only sums and a
    spanning label per bucket.

    Null vectors, zero ones, those with null or non-finite components are linked
    with nothing; vectors of another length than the most common are compared among
    their own length; a null id is a row of its own; rows that repeat an id are
    vectors like others and share the id's component; an empty table gives an empty
    result.
    """
    kind = table.schema[embedding].dataType.elementType.typeName()
    # single-precision components travel as they are, at half the bytes, and are made double where they are compared
    t = table.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<float>" if kind == "float" else "array<double>").alias("x"))
    fine = F.col("x").isNotNull() & F.col("vec_id").isNotNull() & F.coalesce(F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False)) & F.coalesce(F.exists("x", lambda v: v != 0), F.lit(False))
    t = ws.put(t.withColumn("fine", F.coalesce(fine, F.lit(False))), "vectors")
    good = t.where("fine").withColumns({"h1": F.xxhash64("x"), "h2": F.xxhash64(F.lit(1), "x"), "dim": F.size("x")})
    classes = good.groupBy("h1", "h2").agg(F.min("vec_id").alias("cid"), F.count("*").alias("w"), F.first("x").alias("x"), F.first("dim").alias("dim"))
    classes = ws.put(classes, "classes")
    dims = [r[0] for r in classes.groupBy("dim").count().orderBy("dim").collect()]  # lengths of vectors, a handful
    n = classes.count()
    tables, k, step = plan_tables(n, cosine)

    sums, edges = [], []
    for dim in dims:
        keys_of = _hasher(tables, k, step, dim)

        def hashed(batches: Iterator[pa.RecordBatch], keys_of=keys_of, dim=dim) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 1000):
                    part = batch.slice(at, 1000)
                    keys = keys_of(_matrix(part.column(1), dim))
                    cid = np.repeat(part.column(0).to_numpy(), tables)
                    yield pa.RecordBatch.from_arrays([pa.array(cid), pa.array(np.tile(np.arange(tables, dtype=np.int32), part.num_rows)), pa.array(keys.ravel())], names=["cid", "t", "key"])

        def compared(batches: Iterator[pa.RecordBatch], keys_of=keys_of, dim=dim) -> Iterator[pa.RecordBatch]:
            def work(part: pa.Table) -> list[tuple]:
                cid, w, side, run, table = (part.column(c).to_numpy() for c in ("cid", "w", "side", "run", "t"))
                x = _matrix(part.column("x"), dim)
                near = (x @ x.T >= cosine) & (run[:, None] == run[None, :])
                np.fill_diagonal(near, False)
                near &= (side[:, None] != side[None, :]) | (side[:, None] == -1)
                some = np.flatnonzero(near.any(1))
                if not len(some):
                    return []
                near, cid, w, table = near[np.ix_(some, some)], cid[some], w[some], table[some]
                label = cid.copy()
                while True:
                    low = np.minimum(label, np.where(near, label[None, :], np.iinfo(np.int64).max).min(1))
                    if (low == label).all():
                        break
                    label = low
                keys = keys_of(x[some])
                for s in range(int(table.max())):  # a pair counts in the first table in which it meets
                    near &= (keys[:, s][:, None] != keys[:, s][None, :]) | (table <= s)[:, None]
                return list(zip(cid.tolist(), (near @ w).tolist(), label.tolist(), strict=True))

            for rows in each_run(batches, "run", work, TOGETHER):
                if rows:
                    a, b, c = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.int64())], names=["cid", "links", "label"])

        own = classes.where(F.col("dim") == dim).select("cid", "x", "w")
        keyed = ws.put(own.select("cid", "x").mapInArrow(hashed, "cid long, t int, key long"), f"keys-{dim}")
        shared = ws.put(keyed.groupBy("key").agg(F.count("*").alias("g")).where("g > 1"), f"shared-{dim}")
        dealt = in_block_pairs(keyed, shared, "key", "cid").select("run", "side", "t", "cid").join(own, "cid")
        runs = dealt.select("run", "side", "t", "cid", "w", "x").repartition("run").sortWithinPartitions("run")
        out = ws.put(runs.mapInArrow(compared, "cid long, links long, label long"), f"links-{dim}")
        sums.append(out.groupBy("cid").agg(F.sum("links").alias("links")))
        edges.append(out.select(F.col("cid").alias("a"), F.col("label").alias("b")).distinct())
    none = spark.range(0)
    links = sums[0] if sums else none.select(F.col("id").alias("cid"), F.col("id").alias("links"))
    pairs = edges[0] if edges else none.select(F.col("id").alias("a"), F.col("id").alias("b"))
    for more in sums[1:]:
        links = links.unionByName(more)
    for more in edges[1:]:
        pairs = pairs.unionByName(more)
    labels = connected_components(pairs, ws, "cc")
    per = classes.select("h1", "h2", "cid", "w").join(links, "cid", "left").join(labels.withColumnRenamed("node", "cid"), "cid", "left")
    per = per.select("h1", "h2", "w", (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.coalesce("component", "cid").alias("component_id"))
    per = ws.put(per, "of-class")
    ws.keep_only("vectors", "of-class")
    done = spread_join(good.select("vec_id", "h1", "h2"), per, ["h1", "h2"], "w", "vec_id").select("vec_id", "n_links", "component_id")
    alone = t.where("not fine").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return done.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
