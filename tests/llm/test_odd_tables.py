"""Operators that are no pipeline stage, on nulls, empty and very long texts, repeated rows, and columns named as their own."""

from collections import Counter

import pytest

from stratavault.llm import classifier, embedding_dedup, near_dedup, packing, pii, quality_rules, sharding, suffix_dedup
from stratavault.llm.workspace import Workspace

NAMES = "part h1 h2 n copy g key digits common kind around docs at".split()
LONG = " ".join(f"word{k}" for k in range(50_000))
TEXTS = [None, "", " ", "short", LONG, LONG[:3000], LONG[:3000], "y" * 400_000, "mail a@b.co"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(k, t, "s1" if k % 2 else None) for k, t in enumerate(TEXTS)] + [(None, None, None), (None, LONG[:500], "s2"), (6, LONG[:3000], None), (6, "another text", "s1")]
    return spark.createDataFrame([(*r, *range(len(NAMES))) for r in rows], "doc_id long, text string, source string, " + ", ".join(f"{n} int" for n in NAMES))


def runs_of(spark, odd):
    ws = lambda: Workspace(spark, "t")
    labels = spark.createDataFrame([(4, 1, 0), (3, 0, 1), (None, None, None), (6, None, 1)], "doc_id long, quality int, toxic int")
    yield "near_duplicates", lambda d: near_dedup.near_duplicates(spark, d, ws())
    yield "score_quality", lambda d: quality_rules.score_quality(spark, d).drop(*NAMES, "source", "text")
    yield "classify", lambda d: classifier.classify(spark, d, labels, ws()).drop("score")
    yield "remove_repeats", lambda d: suffix_dedup.remove_repeats(spark, d, ws(), with_text=True)
    yield "shard", lambda d: sharding.shard(spark, d, ws())
    yield "find_pii", lambda d: pii.find_pii(d)


@pytest.mark.parametrize("at", range(6), ids="near_duplicates score_quality classify remove_repeats shard find_pii".split())
def test_documents(spark, odd, at):
    _, run = list(runs_of(spark, odd))[at]
    rows = run(odd).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(r["doc_id"] for r in odd.collect())
    assert Counter(map(str, rows)) == Counter(map(str, run(odd.repartition(5)).collect())), "reruns agree"
    assert run(odd.limit(0)).count() == 0


def test_matrices(spark, odd):
    ws = Workspace(spark, "t")
    rows = packing.segments(packing.write_matrices(spark, odd, f"{ws.root}/m")).collect()
    assert sum(r["start"] == 0 for r in rows) == odd.count()
    assert packing.write_matrices(spark, odd.limit(0), f"{ws.root}/n").count() == 0


def test_vectors(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(1, v), (1, v), (2, [2.0, 4.0, 6.0]), (3, None), (4, []), (5, [0.0] * 3), (6, [None, 1.0, 1.0]), (7, [float("inf"), 1.0, 1.0]), (None, v), (8, [-1.0, -2.0, -3.0]), (9, [1e300, 2e300, 3e300]), (10, [1e-300] * 3)]
    t = spark.createDataFrame([(*r, 1, 2, 3, 4, 5) for r in rows], "vec_id long, embedding array<double>, cid int, run int, t int, x int, w int")
    got = Counter((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.near_vectors(spark, t, Workspace(spark, "t")).collect())
    linked = [(1, 3, 1, True)] * 2 + [(2, 3, 1, False), (9, 3, 1, False)]
    alone = [(i, 0, i, True) for i in (3, 4, 5, 6, 7, None, 8, 10)]
    assert got == Counter(linked + alone)
    assert embedding_dedup.near_vectors(spark, t.limit(0), Workspace(spark, "t")).count() == 0
