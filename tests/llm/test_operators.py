import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from stratavault.llm import classifier, embedding_dedup, mixing, near_dedup, packing, pii, quality_rules, sharding, suffix_dedup, tokens
from stratavault.llm.workspace import Workspace

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, component int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def table(spark, texts):
    rows = [(i, t, "en", s, None, "clash", 1) for i, t, s in texts]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    rng = np.random.default_rng(3)
    base = " ".join(f"w{x}" for x in rng.integers(0, 5000, 120))
    near = base.replace("w1", "v1", 1)
    texts = [base, near, base, "", None, " \n ", "one two", "one two", base[:300] + " tail of another kind", "Ünïcode text ✓ " * 20, "x " * 3000, near, "spam!! " * 80, "#$% " * 90]
    rows = [(k * 3, t, f"s{k % 3}" if k % 5 else None) for k, t in enumerate(texts)]
    return table(spark, [*rows, (None, base, "s1"), (0, base, None), (6, "other text altogether", "s2")])


def brute_components(rows, sets, linked):
    ids = list(range(len(rows)))
    comp = {i: i for i in ids}
    for i in ids:
        for j in ids:
            if rows[i][0] is not None and rows[j][0] is not None and (linked(sets[i], sets[j]) or rows[i][0] == rows[j][0]):
                a, b = comp[i], comp[j]
                for k in ids:
                    if comp[k] == b:
                        comp[k] = a
    return comp


def test_near_duplicates_as_brute_force(spark, odd):
    rows = [(r["doc_id"], r["text"]) for r in odd.where("not (doc_id = 6 and text like 'other%')").collect()]
    d = odd.where("not (doc_id = 6 and text like 'other%')")

    def shingles(t):
        w = WORD.findall((t or "").lower())
        return frozenset([tuple(w)] if 0 < len(w) < 4 else [tuple(w[j : j + 4]) for j in range(len(w) - 3)])

    sets = [shingles(t) for _, t in rows]
    comp = brute_components(rows, sets, lambda a, b: bool(a and b) and 100 * len(a & b) >= 80 * len(a | b))
    want = Counter((i, len(sets[k]), None if i is None else min(rows[m][0] for m in comp if comp[m] == comp[k])) for k, (i, _) in enumerate(rows))
    got = near_dedup.near_duplicates(spark, d, Workspace(spark, "t"), width=4).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    assert near_dedup.near_duplicates(spark, odd.limit(0), Workspace(spark, "t")).count() == 0


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(0)
    a = np.unique(rng.integers(0, 1 << 63, 3000, dtype=np.uint64))
    b = np.unique(np.concatenate([a[300:], rng.integers(0, 1 << 63, 300, dtype=np.uint64)]))
    ra, rb, both = near_dedup.sketch([a, b, np.union1d(a, b)])
    assert (np.maximum(ra, rb) == both).all()
    truth = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    est = near_dedup.likeliest(ra[None], rb[None], np.array([len(a)]), np.array([len(b)]))[0]
    assert abs(est - truth) < 0.1


def test_near_duplicates_of_ids_with_several_texts(spark, odd):
    rng = np.random.default_rng(8)
    p, q, s = (" ".join(f"{c}{x}" for x in rng.integers(0, 5000, 90)) for c in "pqs")
    more = [(6, p), (90, p.replace("p1", "v", 1)), (91, q), (92, p), (92, s), (6, q + " end"), (93, s + " end"), (94, s), (94, ""), (95, None), (95, q), (50, q), (50, p + " z")]
    d = odd.unionByName(table(spark, [(i, t, "s1") for i, t in more]))
    rows = [(r["doc_id"], r["text"]) for r in d.collect()]

    def shingles(t):
        w = WORD.findall((t or "").lower())
        return frozenset([tuple(w)] if 0 < len(w) < 4 else [tuple(w[j : j + 4]) for j in range(len(w) - 3)])

    sets = [shingles(t) for _, t in rows]
    comp = brute_components(rows, sets, lambda a, b: bool(a and b) and 100 * len(a & b) >= 80 * len(a | b))
    want = Counter((i, len(sets[k]), None if i is None else min(rows[m][0] for m in comp if comp[m] == comp[k])) for k, (i, _) in enumerate(rows))
    got = near_dedup.near_duplicates(spark, d, Workspace(spark, "t"), width=4).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == want


def test_cuts_before_the_exact_sets_are_seven_deviations_off():
    assert near_dedup.MARGIN >= 7 * (0.8 * 0.2 / near_dedup.REGISTERS) ** 0.5
    regs = np.full((2, near_dedup.REGISTERS), 9, "<u2")
    regs[1, 150:] = 7  # 0.595 of the registers agree
    short = np.arange(50, dtype="<u4").tobytes()
    run = pa.RecordBatch.from_pydict({"run": [1, 1], "side": [-1, -1], "t": [0, 0], "cid": [3, 4], "component": [3, 4], "n_shingles": [50, 50], "regs": [r.tobytes() for r in regs], "short": [short, short]})
    out = list(near_dedup._across(0.8 - near_dedup.MARGIN, 80)(iter([run])))
    assert [b.to_pylist() for b in out] == [[{"a": 3, "b": 4}]]


def test_quality_rules(spark, odd):
    got = quality_rules.score_quality(spark, odd, ws=Workspace(spark, "t")).collect()
    assert len(got) == odd.count() and "kept" in got[0].__fields__
    for r in got:
        words = WORD.findall(r["text"] or "")
        assert r["__n_words"] == len(words) and r["__word_chars"] == sum(map(len, words))
        c = Counter(zip(words, words[1:], words[2:], strict=False))
        hit = {k + d for k in range(len(words) - 2) if c[tuple(words[k : k + 3])] > 1 for d in range(3)}
        assert r["__n_repeat_words"] == len(hit)
        assert not (r["__base_failed"] and r["__kept"])
    assert quality_rules.score_quality(spark, odd.limit(0)).count() == 0
    assert quality_rules.em_posteriors([]) == {}


def test_mixing(spark, odd):
    rows = mixing.mix(spark, odd, Workspace(spark, "t")).collect()
    assert len(rows) == odd.count()
    total = sum(r["size"] for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r["source"], []).append(r)
        assert r["taken"] == r["size"] * r["copies"] <= 2 * r["size"]
    assert sum(v[0]["target"] for v in by.values()) <= 1.5 * total + 1e-6
    for v in by.values():
        assert v[0]["source_size"] == sum(r["size"] for r in v)
        assert abs(sum(r["taken"] for r in v) - v[0]["target"]) <= max(r["size"] for r in v)
    again = mixing.mix(spark, odd.repartition(7), Workspace(spark, "t")).collect()
    assert Counter(rows) == Counter(again)
    assert mixing.mix(spark, odd.limit(0), Workspace(spark, "t")).count() == 0


def test_classifier(spark):
    good = [(i, " ".join(f"word{(i * 7 + k) % 50}" for k in range(80)), None) for i in range(60)]
    bad = [(100 + i, "### $$$ " * 40, None) for i in range(60)]
    docs = table(spark, [*good, *bad, (None, None, None), (500, "", None)])
    labels = spark.createDataFrame([(i, int(i < 100), 0) for i, _, _ in good + bad] + [(None, 1, 0), (7, None, 0)], "doc_id long, quality int, toxic int")
    rows = classifier.classify(spark, docs, labels, Workspace(spark, "t")).collect()
    assert len(rows) == 122 and all(0 <= r["score"] <= 1 for r in rows)
    assert all(r["predicted"] == int(r["doc_id"] < 100) for r in rows if r["doc_id"] is not None and r["doc_id"] < 200 and r["held_out"])
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows if r["doc_id"] is not None)
    blind = classifier.classify(spark, docs, labels.limit(0), Workspace(spark, "t")).collect()
    assert all(abs(r["score"] - 0.5) < 0.01 for r in blind)


def test_repeats_as_brute_force(spark):
    rng = np.random.default_rng(1)
    passage = " ".join(f"p{x}" for x in rng.integers(0, 999, 30))
    own = lambda k: " ".join(f"é{x}" for x in rng.integers(0, 99999, k))
    texts = [own(40), passage, own(30) + passage[:60] + own(9), own(20) + passage + own(20) + passage, "ab" * 80, "ab" * 60 + "c", "", None, "short", own(5)]
    rows = [(k, t, None) for k, t in enumerate([*texts, texts[3], texts[0], "short"])]
    got = {r["doc_id"]: r for r in suffix_dedup.remove_repeats(spark, table(spark, [*rows, (None, passage, None)]), Workspace(spark, "t")).collect()}
    first = {}
    for i, t, _ in rows:
        b = (t or "").encode()
        for k in range(len(b) - 49):
            first.setdefault(b[k : k + 50], i)
    for i, t, _ in rows:
        b = (t or "").encode()
        cover = bytearray(len(b))
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < i:
                cover[k : k + 50] = b"\1" * 50
        kept = bytes(x for x, c in zip(b, cover, strict=True) if not c)
        spans = sum(1 for k in range(len(b)) if cover[k] and not (k and cover[k - 1]))
        r = got[i]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (len(b), sum(cover), spans, hashlib.sha256(kept).hexdigest()), i
    assert got[None]["n_removed"] == 0
    assert suffix_dedup.remove_repeats(spark, table(spark, rows).limit(0), Workspace(spark, "t")).count() == 0


def plain_jump(key: str, n: int) -> int:
    b, j = 0, 0
    while j < n:
        b = j
        u = (int(hashlib.md5(f"0:{key}:{b}".encode()).hexdigest()[:12], 16) + 0.5) / 2**48
        j = int((b + 1) / u)
    return b


def test_sharding(spark, odd):
    rows = sharding.shard(spark, odd, Workspace(spark, "t")).collect()
    assert len(rows) == odd.count()
    for r in rows:
        key = "" if r["doc_id"] is None else str(r["doc_id"])
        assert (r["shard"], r["grown_shard"]) == (plain_jump(key, 16), plain_jump(key, 17))
    for s in {r["shard"] for r in rows}:
        slots = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert slots == list(range(len(slots)))
    assert sharding.shard(spark, odd.limit(0), Workspace(spark, "t")).count() == 0


@pytest.mark.parametrize("text, want", [
    ("mail a.b@x-y.example.org now", "email:5:24"), ("10.0.0.256 and 10.0.0.25", "ip:15:24"), ("4111 1111 1111 1111", "card:0:19"), ("call +49 (30) 123456-78.", "phone:5:23"),
    ("@b.c@d.e", "email:1:8"), ("write to john [at] mail [dot] example.com", "email:9:41"), ("jоhn@example.com", "email:0:16,email:2:16"), ("four one one one one one one one one one one one one one one one", "card:0:64"),
    ("meet at noon. the dot is on it", ""), ("", ""), (None, ""),
])
def test_private_data(text, want):
    assert pii.join_spans(pii.find_all(text)[1]) == want


@pytest.mark.parametrize("text, want", [
    ("john ［at］ example ［dot］ com", "email:0:27"), ("john аt example dоt com", "email:0:23"), ("john (a\u200bt) example (d\u200bot) com", "email:0:29"),
    ("fоur" + " оne" * 15, "card:0:64"),
])
def test_private_data_behind_two_disguises(text, want):
    assert pii.join_spans(pii.find_all(text)[1]) == want


@pytest.mark.parametrize("text, want", [
    ("call +one (seven four three) five five five-three eight two four now", "phone"), ("+1 (seven four three) 555-3824", "phone"), ("plus one seven four three five five five three eight two four", "phone"),
    ("plus 1 (743) 555-3824", "phone"), ("+one (seven\nfour three)\nfive five five\nthree eight two four", "phone"),
    ("at one nine two.one six eight.zero.one it", "ip"), ("one five two dot one four three dot two one dot nine", "ip"), ("one 9 two (dot) 168 [.] zero\ndot oh", "ip"),
    ("10.0.0.1 five dollars", "ip"), ("one two three, four", ""), ("3 + 4 plus 5", ""), ("chapter one. Two of three.", ""),
])
def test_private_data_spelled(text, want):
    assert {pii.KINDS[k] for _, k, _ in pii.find_all(text)[1]} == ({want} if want else set())


@pytest.mark.parametrize("text, want", [
    ("call +1 (seven four three) 555-3824 now", "phone:5:35"), ("at one nine two.one six eight.zero.one it", "ip:3:38"), ("10.0.0.1 five dollars", "ip:0:8"),
    ("1 dot 2 dot 3 dot one two five six people", "ip:0:30"), ("12\nfour" + " one" * 15, "card:3:67"), ("plus 1 743 555 3824", "phone:0:19"),
])
def test_private_data_spelled_ends(text, want):
    assert pii.join_spans(pii.find_all(text)[1]) == want


@pytest.mark.parametrize("text, want", [
    ("192[.]168[.]0[.]1", "ip:0:17"), ("host 10 (dot) 0 (dot) 0 (dot) 1, port 80", "ip:5:31"), ("the server at 192 dot 168 dot 0 dot 1 is down", "ip:14:37"), ("192.168[dot]0.1", "ip:0:15"),
    ("192［．］168［．］0［．］1", "ip:0:17"), ("server at 192 dot 168 dot one two dot 3", "ip:10:39"), ("10[.]0[.]0[.]256", ""), ("10.0.0.1 and 10[.]0[.]0[.]2", "ip:0:8,ip:13:27"), ("version 1 dot 2 dot 3", ""),
    ("john at one dot com", "email:0:19"), ("john [at] 10 dot 0 dot 0 dot 1", "email:0:30"),
])
def test_private_data_disguised_ip(text, want):
    assert pii.join_spans(pii.find_all(text)[1]) == want


def test_disguised_ip_is_redacted():
    assert pii.redact_text("ask 192[.]168[.]0[.]1 or 10 dot 0 dot 0 dot 1.") == "ask [IP] or [IP]."


def test_private_data_rows(spark, odd):
    d = table(spark, [(1, "x a@b.co y", None), (None, None, None), (1, "x a@b.co y", None)])
    assert [r["text"] for r in pii.redact(d).orderBy("text").collect()] == [None, "x [EMAIL] y", "x [EMAIL] y"]
    assert pii.find_pii(odd).count() == odd.count() and pii.find_pii(odd.limit(0)).count() == 0
    assert max(len(s) for s in [pii.redact_text("1" * 30000)]) == 30000


ODD = ["", None, "it's don't WE'LL x'd", "<|endoftext|> a<|endoftext|>b", "ſ İstanbul ΣΑΣ ß", "日本語 テスト", "áb é", "12 345,67.8", "foo_bar __", "\x00 a\x1cb", "!!!'s", "a" * 300, " lead", "trail \n\n"]


def test_tokens_are_the_tokenizers():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.default_path())
    want = [t.encode(x or "", add_special_tokens=False).ids + [1] for x in ODD]
    assert [x.tolist() for x in tokens.document_ids(tokens.default_path(), pa.array(ODD))] == want
    assert [x.tolist() for x in tokens.document_ids(tokens.default_path(), pa.array(ODD).slice(3, 5))] == want[3:8]


@pytest.mark.parametrize("pack", [packing.pack_tiers, packing.pack_best_fit])
def test_packs_hold_every_token_once(pack):
    rng = np.random.default_rng(2)
    for lengths in ([], [1], [2048], [5000, 1, 1], rng.integers(1, 3000, 400).tolist(), [1500] * 50):
        seen = [np.zeros(n, int) for n in lengths]
        for seq in pack(lengths):
            assert 0 < sum(n for _, _, n in seq) <= 2048
            for d, a, n in seq:
                seen[d][a : a + n] += 1
        assert all((s == 1).all() for s in seen)


def test_pack_and_matrices(spark, odd, tmp_path):
    n = odd.count()
    for rows in (packing.pack(odd), packing.segments(packing.write_matrices(spark, odd, str(tmp_path / "m")))):
        assert rows.groupBy("sequence_id").agg({"length": "sum"}).where("`sum(length)` > 2048").count() == 0
        assert rows.where("start = 0").count() == n
    assert packing.pack(odd.limit(0)).count() == 0
    assert packing.positions([0, 2, 5]).tolist() == [0, 1, 0, 1, 2]


def test_near_vectors_as_brute_force(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(8, 16))
    x = np.concatenate([base, base[:4] + rng.normal(0, 0.05, (4, 16)), base[:3] * 2.5, base[:2] + rng.normal(0, 0.09, (2, 16))]).astype(np.float32)
    rows = [(k, v.tolist(), 0) for k, v in enumerate(x)] + [(90, None, 0), (91, [0.0] * 16, 0), (92, [float("nan")] * 16, 0), (93, [None] * 16, 0), (94, [1.0, 2.0], 0)]
    t = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r["vec_id"]: r for r in embedding_dedup.near_vectors(spark, t, Workspace(spark, "t")).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    comp = np.arange(len(x))
    for _ in comp:
        comp = np.where(near, comp[None, :], 99).min(1)
    for k in range(len(x)):
        assert (got[k]["n_links"], got[k]["component_id"], got[k]["kept"]) == (near[k].sum() - 1, comp[k], comp[k] == k)
    for k in range(90, 95):
        assert (got[k]["n_links"], got[k]["component_id"]) == (0, k)
    assert embedding_dedup.near_vectors(spark, t.limit(0), Workspace(spark, "t")).count() == 0


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns, name
        docs = Workspace(spark, "t").put(out, name)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, "")
    assert last.where("start = 0").count() == docs.count() > 0


@pytest.mark.parametrize("name", ["op1_minhash_dedup", "op3_mixing", "op5_suffix_dedup", "op6_sharding", "op7_pii", "op10_embedding_dedup"])
def test_queries_as_their_sql(spark, name):
    import duckdb

    from stratavault.llm import queries

    sf_dir = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    want = con.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    got = queries.queries()[name](spark, sf_dir)
    assert sorted(got.columns) == sorted(columns)
    assert Counter(tuple(r) for r in got.select(*columns).collect()) == Counter(want.fetchall())
