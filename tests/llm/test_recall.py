"""Operators that search by hashing, against every pair: documents of sf0.1, and its vectors with copies about the threshold."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq

from stratavault.llm import embedding_dedup, queries
from stratavault.llm.workspace import Workspace

SF = "/root/testdata/sf0.1"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def components(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def similar(sets: dict[int, frozenset], percent: int):
    """Every pair with 100 * intersection >= percent * union: such sets share one of their rarest elements, as many as leave fewer than percent."""
    often = Counter(g for s in sets.values() for g in s)
    rank = {g: k for k, (g, _) in enumerate(sorted(often.items(), key=lambda x: (x[1], x[0])))}
    buckets, links = defaultdict(list), set()
    for i, s in sets.items():
        rare = sorted(s, key=rank.__getitem__)[: len(s) - math.ceil(len(s) * percent / 100) + 1]
        for j in {j for g in rare for j in buckets[g]}:
            common = len(s & sets[j])
            if 100 * common >= percent * (len(s) + len(sets[j]) - common):
                links.add((i, j))
        for g in rare:
            buckets[g].append(i)
    return links


def test_near_duplicates_of_all_documents(spark):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for r in pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pylist():
        w = WORD.findall((r["text"] or "").translate(lower))
        sets[r["doc_id"]] = frozenset(hash(tuple(w[j : j + 4])) for j in range(len(w) - 3)) if len(w) >= 4 else frozenset([hash(tuple(w))] if w else [])
    # copies once: links among equal sets are known
    classes: dict[frozenset, int] = {}
    for i in sorted(sets):
        classes.setdefault(sets[i], i)
    classes.pop(frozenset(), None)
    links = similar({i: s for s, i in classes.items()}, 80)
    of = components(classes.values(), links)
    got = {r["doc_id"]: r for r in queries.queries()["op1_minhash_dedup"](spark, SF).collect()}
    assert len(links) > 100, "there are near copies that are not exact ones"
    assert all(got[i]["n_shingles"] == len(s) for i, s in sets.items())
    assert {i: r["component_id"] for i, r in got.items()} == {i: of[classes[s]] if s else i for i, s in sets.items()}


def test_links_of_vectors_about_the_threshold(spark):
    # the vectors of the table lie far apart; each gets a copy whose cosine is a little above or below the threshold, where a miss is likeliest
    rng = np.random.default_rng(11)
    table = pq.read_table(f"{SF}/embeddings.parquet", columns=["embedding"]).column("embedding").to_pylist()
    x = np.array([e for e in table if e and all(v is not None and math.isfinite(v) for v in e) and any(e)], np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    side = rng.normal(size=x.shape)
    side -= (side * x).sum(1, keepdims=True) * x
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    cosine = rng.uniform(0.945, 0.965, (len(x), 1))
    every = np.concatenate([x, cosine * x + np.sqrt(1 - cosine**2) * side]).astype(np.float32)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(every.tolist())], "vec_id long, embedding array<float>")
    got = {r["vec_id"]: r["n_links"] for r in embedding_dedup.near_vectors(spark, df, Workspace(spark, "t")).collect()}
    unit = every.astype(float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.95
    np.fill_diagonal(near, False)
    want = near.sum(1)
    assert want.sum() > 2000 and all(got[i] <= n for i, n in enumerate(want.tolist())), "no link below the threshold"
    assert sum(got.values()) >= 0.999 * want.sum(), f"recall {sum(got.values()) / want.sum()}"
