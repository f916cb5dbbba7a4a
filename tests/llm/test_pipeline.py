import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from stratavault.llm import mixing, near_dedup, pii, quality_rules
from stratavault.llm.workspace import Workspace

SF = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, __kept string, __n_words int, __id long, __digest string, copy int, payload string, count map<string,int>, n int"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in any column, empty and very long texts, repeated rows and ids, and columns with clashing names."""
    prose = " ".join(f"w{k * 37 % 101}" for k in range(120))
    texts = [prose, prose + " more", prose, None, "", " \n", prose[::-1], prose[:200], "x" * 300_000, " ".join(f"long{k}" for k in range(60_000)), "mail a@b.co and " + prose]
    rows = [(k, t, "en" if k % 3 else None, f"s{k % 4}" if k % 5 else None, len(t) if t else None) for k, t in enumerate(texts)]
    rows += [(0, prose, None, None, None)] * 2 + [(4, prose[::-1] + " y z", "en", "s1", 3), (None, prose, "de", None, None), (None, None, None, None, None), (6, "other text altogether " + prose[50:], None, "s2", 9)]
    return spark.createDataFrame([(*r, "clash", 1, 2, "d", 3, "p", {"a": 1}, 4) for r in rows], SCHEMA)


def as_rows(df) -> Counter:
    return Counter(json.dumps(r.asDict(), sort_keys=True) for r in df.collect())


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES[:-1]])
def test_stages_stand_odd_tables(spark, odd, name):
    out = STAGES[name](spark, odd, "")
    assert out.columns == odd.columns and [f.dataType for f in out.schema] == [f.dataType for f in odd.schema]
    got = as_rows(out)
    assert got == as_rows(STAGES[name](spark, odd.repartition(7), "")), "reruns agree"
    if name != "pii":
        every = as_rows(odd)
        assert set(got) <= set(every) and (name == "mixing" or all(got[r] <= every[r] for r in got))
    assert STAGES[name](spark, odd.limit(0), "").count() == 0


def test_packing_stands_odd_tables(spark, odd):
    assert STAGES["packing"](spark, odd, "").where("start = 0").count() == odd.count()
    assert STAGES["packing"](spark, odd.limit(0), "").count() == 0


def test_dedup_keeps_one_of_each_group(spark, odd):
    out = [r for r in STAGES["minhash_dedup"](spark, odd, "").collect()]
    groups = {(r["doc_id"], r["component_id"]) for r in near_dedup.near_duplicates(spark, odd, Workspace(spark, "t"), width=5).collect() if r["doc_id"] is not None}
    assert Counter(r["doc_id"] for r in out if r["doc_id"] is not None) == Counter({c for _, c in groups})
    assert sum(r["doc_id"] is None for r in out) == 2


def test_mixing_repeats_rows_as_the_mix_says(spark, odd):
    taken = mixing.mix(spark, odd, Workspace(spark, "t")).agg(F.sum("copies"), F.sum("taken")).first()
    out = STAGES["mixing"](spark, odd, "")
    words = out.select(F.sum(mixing.word_count(F.col("text")))).first()[0]
    assert (out.count(), words) == tuple(taken)


def test_quality_drops_what_the_operator_rejects(spark, odd):
    at = quality_rules.free_prefix(odd.columns)
    assert at == "___"
    scored = quality_rules.score_quality(spark, odd)
    want = as_rows(scored.where(F.col(f"{at}kept")).select(*odd.columns))
    assert as_rows(STAGES["quality_rules"](spark, odd, "")) == want


def test_pii_replaces_what_the_operator_finds(spark, odd):
    for r in STAGES["pii"](spark, odd, "").collect():
        assert not pii.find_all(r["text"])[0]
    texts = {r["text"] for r in STAGES["pii"](spark, odd, "").collect()}
    assert any(t and t.startswith("mail [EMAIL] and ") for t in texts)


def test_run_is_the_stages_one_after_another(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = Workspace(spark, "t").put(stage(spark, docs, SF), name)
    tokens = lambda df: Counter(tuple(r) for r in df.groupBy("doc_id", "doc_tokens").agg(F.sum("length").alias("n")).collect())
    assert tokens(corpus_pipeline.run(spark, SF)) == tokens(STAGES["packing"](spark, docs, SF))
