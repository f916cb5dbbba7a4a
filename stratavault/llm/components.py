"""Connected components by alternating star contraction, all in joins and aggregates."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from .runs import spread_join
from .workspace import Workspace


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each batch's edges (u, v) as stars around the least node of each of its own components: u > v."""
    for batch in batches:
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while (up := root.get(x, x)) != x:
                root[x] = up_again = root.get(up, up)
                x = up_again
            return x

        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, y = find(a), find(b)
            root.setdefault(a, a), root.setdefault(b, b)
            root[max(x, y)] = min(x, y)
        stars = [(x, y) for x in root if (y := find(x)) != x]
        u, v = zip(*stars, strict=True) if stars else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def connected_components(edges: DataFrame, ws: Workspace, tag: str) -> DataFrame:
    """(node, component) for every node of ``edges`` (a long, b long).

    component is the smallest node reachable.  First each batch of edges becomes
    stars, so a node with very many smaller neighbours keeps one a batch.  Then each
    round points nodes at smaller neighbours (large star, small star), until every
    node that has a smaller neighbour has no other; rounds are logarithmic in the
    component size.  Minima are pre-aggregated and the edges of a hub meet its
    minimum in several places, so a hub is never gathered in one.  Self-loops and
    nulls are ignored; no edges give an empty result.
    """
    real = edges.where("a <> b").select(F.col("a").alias("u"), F.col("b").alias("v"))
    now = ws.put(real.mapInArrow(_contracted, "u long, v long").distinct(), f"{tag}-edges-0")
    turn = 0
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = ws.put(both.groupBy("u").agg(F.min("v").alias("s"), F.count("*").alias("n")), f"{tag}-low-{turn}")
        if not low.agg(F.count(F.when((F.col("s") < F.col("u")) & (F.col("n") > 1), 1))).first()[0]:
            break
        least = low.select("u", F.least("u", "s").alias("m"), "n")
        # large star: every larger neighbour of u goes to the least of u and its neighbours
        large = spread_join(both.where("v > u"), least, "u", "n", "v").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: of what a node was given, all goes to the least
        small = large.withColumn("m", F.min("v").over(W.partitionBy("u")))
        pairs = small.select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        turn += 1
        now = ws.put(pairs.where("u <> v").distinct(), f"{tag}-edges-{turn}")
        ws.drop(f"{tag}-edges-{turn - 1}", f"{tag}-low-{turn - 1}")
    # of a node with a smaller neighbour that is its component, the others are roots
    return low.select(F.col("u").alias("node"), F.least("u", "s").alias("component"))
