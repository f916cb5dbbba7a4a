import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stratavault.llm import components, runs
from stratavault.llm.workspace import Workspace


def brute(edges):
    comp = {x: x for e in edges for x in e}
    while True:
        new = dict(comp)
        for a, b in edges:
            new[a] = new[b] = min(new[a], new[b])
        if new == comp:
            return comp
        comp = new


def shapes():
    rng = random.Random(5)
    yield "none", []
    yield "path", [(i, i + 1) for i in range(60)]
    yield "star around the greatest", [(10_000, i) for i in range(3000)]
    yield "star around the least", [(0, i) for i in range(1, 3000)]
    yield "stars in a ring", [(1000 * k, 1000 * k + i) for k in range(5) for i in range(1, 400)] + [(1000 * k + 7, 1000 * ((k + 1) % 5) + 9) for k in range(5)]
    yield "random", [(rng.randrange(400), rng.randrange(400)) for _ in range(300)]
    yield "many small", [(3 * i, 3 * i + 1 + rng.randrange(2)) for i in range(500)]


@pytest.mark.parametrize("name, edges", list(shapes()), ids=[n for n, _ in shapes()])
def test_components_as_brute_force(spark, name, edges):
    df = spark.createDataFrame([*edges, (5, 5), (None, 3), (7, None)], "a long, b long").repartition(5)
    got = {r["node"]: r["component"] for r in components.connected_components(df, Workspace(spark, "t"), "cc").collect()}
    assert got == brute([e for e in edges if e[0] != e[1]])


def test_batches_become_stars():
    edges = [(i, i + 1) for i in range(50)] + [(90, 70), (80, 90)]
    batch = pa.RecordBatch.from_pydict({"u": [a for a, _ in edges], "v": [b for _, b in edges]})
    out = [tuple(r.values()) for b in components._contracted(iter([batch])) for r in b.to_pylist()]
    assert sorted(out) == [(i, 0) for i in range(1, 51)] + [(80, 70), (90, 70)]


def test_spread_joins_as_plain_ones(spark):
    rows = spark.range(5000).select(F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 50).alias("key"), F.col("id").alias("node"))
    per = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("low"))
    got = runs.spread_join(rows, per, "key", "n", "node")
    assert sorted(got.collect()) == sorted(rows.join(per, "key").select(got.columns).collect())
    # no place has more than a few hundred rows of the key that holds a third of all
    hot = runs.spread_join(rows, per, "key", "n", "node").where("key = 1").select(F.pmod(F.xxhash64("node", F.lit(11)), F.ceil(F.col("n") / runs.FEW)).alias("place"))
    assert hot.groupBy("place").count().agg(F.max("count")).first()[0] < 2 * runs.FEW


def test_block_pairs_cover_every_pair_once(spark, monkeypatch):
    monkeypatch.setattr(runs, "BLOCK", 8)
    rng = random.Random(3)
    rows = [(key, 100 * key + i, 0 if rng.random() < share else 1 + rng.randrange(3)) for key, n, share in ((1, 70, 0.9), (2, 5, 0.5), (3, 30, 0.1), (4, 2, 0.0)) for i in range(n)]
    df = spark.createDataFrame(rows, "key long, node long, part long")
    per = df.groupBy("key").agg(F.count("*").alias("g"))
    dealt = runs.in_block_pairs(df, per, "key", "node")
    assert set(dealt.columns) == {"key", "node", "part", "run", "side"}
    by: dict = {}
    for r in dealt.collect():
        by.setdefault(r["run"], []).append(r)
    met = []
    for run in by.values():
        assert len({r["key"] for r in run}) == 1 and len(run) <= 40
        met += [(a["node"], b["node"]) for a in run for b in run if a["node"] < b["node"] and (a["side"] == -1 or a["side"] != b["side"])]
    assert len(met) == len(set(met))
    assert set(met) == {(a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[1] < b[1]}


@pytest.mark.parametrize("rows", [1, 4, 1000])
def test_runs_come_whole(rows):
    rng = random.Random(rows)
    keys = sorted(rng.randrange(40) for _ in range(200))
    batches, at = [], 0
    while at < len(keys):
        n = rng.randrange(0, 9)
        batches.append(pa.RecordBatch.from_pydict({"run": pa.array(keys[at : at + n], pa.int64())}))
        at += n
    seen = list(runs.each_run(iter(batches), "run", lambda t: t.column("run").to_pylist(), rows))
    assert [k for s in seen for k in s] == keys
    assert len({k for s in seen for k in set(s)}) == sum(len(set(s)) for s in seen), "no run is cut"
    assert all(len(s) >= rows for s in seen[:-1]) and (rows > 1 or all(len(set(s)) == 1 for s in seen))
