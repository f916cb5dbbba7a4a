import hashlib

import numpy as np
import pyarrow as pa
import pytest

from stratavault.llm import suffix_dedup
from stratavault.llm.workspace import Workspace

LICENCE = "Permission is granted to anyone to use this text for any purpose, free of charge, without warranty."


def brute(rows: list[tuple[int, str | None]]) -> list[tuple]:
    first: dict[bytes, int] = {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        for k in range(len(b) - 49):
            first.setdefault(b[k : k + 50], i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        cover = bytearray(len(b))
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < i:
                cover[k : k + 50] = b"\1" * 50
        kept = bytes(x for x, c in zip(b, cover, strict=True) if not c)
        out.append((i, len(b), sum(cover), sum(1 for k in range(len(b)) if cover[k] and not (k and cover[k - 1])), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("common", [2, 5, 10_000])
def test_a_line_in_every_document(spark, common):
    rng = np.random.default_rng(7)
    own = lambda k: " ".join(f"é{x}" for x in rng.integers(0, 99999, k))
    rows = [(k * 7 % 61, own(int(rng.integers(0, 12))) + " " * int(rng.integers(0, 3)) + LICENCE[: int(rng.integers(55, 99))] + own(int(rng.integers(0, 9)))) for k in range(60)]
    rows += [(100, LICENCE * 3), (101, "ab" * 100), (102, "ab" * 90), (103, None), (104, ""), (105, LICENCE), (106, LICENCE), (3, own(4) + LICENCE)]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, part string, h long")
    got = suffix_dedup.remove_repeats(spark, df, Workspace(spark, "t"), common=common).collect()
    assert sorted(tuple(r) for r in got) == brute(rows)


def test_what_remains_is_returned(spark):
    rows = [(1, LICENCE), (2, "before " + LICENCE + " after"), (None, LICENCE)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: bytes(r["kept"]) for r in suffix_dedup.remove_repeats(spark, df, Workspace(spark, "t"), with_text=True).collect()}
    assert got == {1: LICENCE.encode(), 2: b"before  after", None: LICENCE.encode()}


def test_windows_are_compared_by_bytes():
    rng = np.random.default_rng(1)
    windows = rng.integers(0, 3, (400, suffix_dedup.WINDOW), dtype=np.uint8)
    windows[:, 3:] = 0
    docs = rng.integers(0, 50, 400)
    least = {}
    for w, d in zip(map(bytes, windows), docs.tolist(), strict=True):
        least[w] = min(d, least.get(w, d))
    want = [least[bytes(w)] < d for w, d in zip(windows, docs.tolist(), strict=True)]
    exact = np.unique(windows, axis=0, return_inverse=True)[1].ravel().astype(np.uint64)
    for keys in (exact, exact // np.uint64(2), np.zeros(400, np.uint64)):  # hashes that tell all, some and none of them apart
        assert suffix_dedup._in_smaller(keys, docs, lambda rows: windows[rows]).tolist() == want


def test_no_group_grows_with_the_documents_of_a_line():
    # a part names a digit once, and passes on each window of a common one from its least document alone
    texts = pa.table({"doc_id": list(range(3000)), "text": [f"{k} {LICENCE}" for k in range(3000)], "h1": [0] * 3000, "part": [0] * 3000})
    none = pa.table({"copy": pa.array([], pa.int64()), "h1": pa.array([], pa.int64()), "digits": pa.array([], pa.binary()), "common": pa.array([], pa.binary())})
    first = suffix_dedup._first_digits(1)(texts, none)
    assert first.num_rows == 1
    shared = suffix_dedup._shared_digits(1000)(first)
    marks = pa.table({"copy": pa.array([None], pa.int64()), "h1": pa.array([None], pa.int64()), "digits": shared.column("digits"), "common": shared.column("common")})
    second = suffix_dedup._second_digits(1)(texts, marks)
    sent = {r["kind"]: len(r["at"]) // 4 for r in second.to_pylist()}
    inside = len(LICENCE) - suffix_dedup.WINDOW + 1
    assert sent[2] >= inside * 2999  # settled where they are
    assert sent[1] <= inside + 12 * 3000  # from the least document, and those that reach into the numbers before the line
