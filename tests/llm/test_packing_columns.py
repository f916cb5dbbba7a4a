import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from stratavault.llm import packing, queries, tokens
from stratavault.llm.workspace import Workspace

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def plain():
    """Ids of every document by the tokenizer file itself."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.default_path())
    docs = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    return {d["doc_id"]: np.array([*t.encode(d["text"] or "", add_special_tokens=False).ids, 1], "<u4") for d in docs}


@pytest.mark.parametrize("name", ["op8_packing", "op9_token_output"])
def test_every_column_as_the_tokenizer_has_it(spark, plain, name):
    rows = queries.queries()[name](spark, SF).collect()
    pieces, sequences = {}, {}
    for r in rows:
        own = plain[r["doc_id"]]
        assert r["doc_tokens"] == len(own) and r["length"] > 0
        assert r["ids_crc32"] == zlib.crc32(own[r["start"] : r["start"] + r["length"]].tobytes())
        pieces.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert set(pieces) == set(plain)
    for doc, parts in pieces.items():
        at = 0
        for start, n in sorted(parts):
            assert start == at
            at += n
        assert at == len(plain[doc])
    padded = 0
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 2048
        padded += 0 if at & (at - 1) == 0 else 2048 - at
    assert padded <= 0.02 * sum(map(len, plain.values()))
    if name == "op8_packing":
        assert padded == 0
        step = {}
        for r in rows:
            step.setdefault(r["sequence_id"], set()).add(r["step_group"])
        assert all(len(s) == 1 for s in step.values())


def test_step_groups_of_windows_never_share_a_number(monkeypatch):
    monkeypatch.setattr(packing, "WINDOW", 20_000)
    rng = np.random.default_rng(0)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 999, int(n))) for n in rng.integers(1, 900, 300)]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(300)), "text": texts})
    out = [b.to_pydict() for b in packing._pieces(tokens.default_path(), 2048)(iter([batch]))]
    assert len(out) > 3
    seen: set[int] = set()
    for window in out:
        groups, sequences = set(window["step_group"]), set(window["sequence_id"])
        assert not groups & seen and groups <= sequences
        seen |= groups
        cost = {g: sum(n * n for n in {s: n for s, n, h in zip(window["sequence_id"], window["sequence_tokens"], window["step_group"], strict=True) if h == g}.values()) for g in groups}
        assert max(cost.values()) - min(cost.values()) <= 2048**2


def test_matrices_hold_ids_and_positions(spark, plain):
    ws = Workspace(spark, "t")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for r in packing.write_matrices(spark, docs, f"{ws.root}/m").collect():
        line, place, cu = np.frombuffer(r["input_ids"], "<u2"), np.frombuffer(r["position_ids"], "<u2"), r["cu_seqlens"]
        assert len(line) == len(place) == 2048 and cu[0] == 0 and cu[-1] == r["n_tokens"]
        assert not line[cu[-1] :].any() and not place[cu[-1] :].any()
        for k, (doc, start) in enumerate(zip(r["doc_ids"], r["starts"], strict=True)):
            n = cu[k + 1] - cu[k]
            assert (line[cu[k] : cu[k + 1]] == plain[doc][start : start + n]).all() and (place[cu[k] : cu[k + 1]] == np.arange(n)).all()


def test_wide_ids_and_long_sequences_are_refused(spark, monkeypatch):
    monkeypatch.setattr(tokens.WordTokenizer, "greatest_id", lambda self: 70_000)
    with pytest.raises(ValueError, match="70000"):
        next(packing._matrices(tokens.default_path(), 2048)(iter([])))
    with pytest.raises(ValueError):
        packing.write_matrices(spark, spark.read.parquet(f"{SF}/documents.parquet"), "nowhere", length=1 << 17)


def test_what_is_known_of_words_is_bounded(monkeypatch):
    monkeypatch.setattr(tokens, "KNOWN_BYTES", 20_000)
    t = tokens.WordTokenizer(tokens.default_path())
    texts = [" ".join(f"x{a}y{b}," for b in range(40)) for a in range(60)]
    ids, offsets = t.encode(pa.array(texts))
    assert t.held <= 20_000 + 300 * 2500 and sum(map(len, t.known)) < 20_000
    for k in (0, 31, 59):
        assert ids[offsets[k] : offsets[k + 1]].tolist() == t.full.encode(texts[k], add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["<|ENDOFTEXT|> a,b", "x<|startoftext|>y.", "A̸.≠B≠c", "ÉCOLE!! l'École d'Été.", "ǅ Ⅷ ½,x ﬁn.", "a.b,c;d'e's", "日本語。テスト, x", "مرحبا، world.", "ẞ.ß,", "é. é", "́.x"])
def test_setting_punctuation_apart_changes_no_ids(text):
    t = tokens.tokenizer(tokens.default_path())
    assert t.encode(pa.array([text]))[0].tolist() == t.full.encode(text, add_special_tokens=False).ids
