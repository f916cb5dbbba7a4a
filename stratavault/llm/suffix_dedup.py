"""Repeated byte windows across documents by a depth-limited radix sort of suffixes.

Two most-significant-digit passes order suffixes through 50 bytes.  The first digit
is 25 bytes: suffixes that start with a digit no other document has leave.  The
second pass orders the rest by the other 25 bytes, to the left and right of the
digit; equal groups are exactly the repeated windows, as their bytes are compared.
Only anchors go through the passes: of the 26 digits inside a window the one with the
least hash, which equal windows choose alike, so about 2 in 27 positions stand for all.

The unit of work is a part of the documents.  A part names each of its digits once,
however many documents have it, and windows that start with a very common digit are
dealt by all of their 50 bytes, once for each part: no group grows with the copies of
a line.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from .workspace import Workspace

WINDOW, DIGIT = 50, 25
REACH = WINDOW - DIGIT  # an anchor's digit starts 0 to REACH bytes into its window
GAP = 255  # stands between documents; no UTF-8 text has it
CHUNK = 256 << 10
#: Text bytes that a part of the documents and a group of digits stand for, about: at least this, and more for very large tables, where a part would name too few digits of each group.
PART_BYTES, GROUP_BYTES = 2 << 20, 4 << 20
#: Documents from which a digit is very common; what starts with it is then dealt by whole windows.
COMMON = 5_000
SALTS = 32
_MUL = np.uint64(0x9E3779B97F4A7C15)
_MUL2 = np.uint64(0xC2B2AE3D27D4EB4F)
_BYTE = np.random.default_rng(5).integers(1, 1 << 63, 256, dtype=np.uint64)


def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(_MUL), n, 1 << 64))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MUL2
    return h ^ (h >> np.uint64(29))


def digit_hashes(data: np.ndarray) -> np.ndarray:
    """64-bit hash of the DIGIT bytes from each position on; lengths 1, 2, 3, 6, 12, 24, 25."""
    one = _BYTE[data]
    with np.errstate(over="ignore"):
        two = one[:-1] * _power(1) + one[1:]
        h = two[:-1] * _power(1) + one[2:]
        n = 3
        while n < DIGIT - 1:
            h = h[:-n] * _power(n) + h[n:]
            n *= 2
        h = h[:-1] * _power(1) + one[n:]
        return _mix(h) | np.uint64(1)


def _sliding(h: np.ndarray, width: int, op: np.ufunc) -> np.ndarray:
    """op over h[i : i + width] for each i."""
    n = 1
    while 2 * n <= width:
        h = op(h[:-n], h[n:])
        n *= 2
    return op(h[: len(h) - (width - n)], h[width - n :]) if n < width else h


def anchors(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions, digit hashes) of the anchors of documents laid one behind another with REACH or more GAPs between.

    ``ends`` has, for each position, the end of its document (0 in gaps).
    """
    if len(data) < WINDOW:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    h = digit_hashes(data)
    least = _sliding(h, REACH + 1, np.minimum)  # of the window at each start
    starts = np.arange(len(least))
    least = np.where(starts + WINDOW <= ends[: len(least)], least, np.uint64(0))
    padded = np.concatenate([np.zeros(REACH, np.uint64), least, np.zeros(REACH, np.uint64)])
    most = _sliding(padded, REACH + 1, np.maximum)  # over the windows a position lies in
    at = np.flatnonzero(most[: len(h)] == h)
    return at, h[at]


def lay_out(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(data, ends, first): texts in one array, REACH gaps before, between and behind."""
    gap = bytes([GAP]) * REACH
    data = np.frombuffer(gap + b"".join(t + gap for t in texts), np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    first = REACH + np.cumsum(sizes + REACH) - (sizes + REACH)
    ends = np.zeros(len(data), np.int64)
    for a, n in zip(first.tolist(), sizes.tolist(), strict=True):
        ends[a : a + n] = a + n
    return data, ends, first


def _chunks(ids: Iterator, texts: Iterator) -> Iterator[tuple[list[int], list[bytes]]]:
    held_ids: list[int] = []
    held: list[bytes] = []
    size = 0
    for i, t in zip(ids, texts, strict=True):
        if t is None or len(t) < WINDOW:
            continue
        held_ids.append(i)
        held.append(t)
        size += len(t)
        if size >= CHUNK:
            yield held_ids, held
            held_ids, held, size = [], [], 0
    if held:
        yield held_ids, held


def _as_bytes(column: pa.Array | pa.ChunkedArray) -> Iterator[bytes | None]:
    return (x.as_buffer().to_pybytes() if x.is_valid else None for x in column.cast(pa.large_binary()))


def _split(group: np.ndarray, *arrays: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    """The arrays' rows by group, in order."""
    order = np.argsort(group, kind="stable")
    g = group[order]
    cuts = [0, *(np.flatnonzero(g[1:] != g[:-1]) + 1).tolist(), len(g)] if len(g) else [0]
    arrays = [a[order] for a in arrays]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield int(g[a]), [x[a:b] for x in arrays]


def _packed(x: np.ndarray) -> bytes:
    """Differences of longs; they compress well."""
    return np.diff(x, prepend=np.int64(0)).tobytes()


def _unpacked(column: pa.ChunkedArray) -> np.ndarray:
    return np.concatenate([np.cumsum(np.frombuffer(x.as_buffer(), np.int64)) for x in column] or [np.empty(0, np.int64)])


def _joined(column: pa.ChunkedArray, kind) -> np.ndarray:
    return np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in column] or [np.empty(0, kind)])


def _deflated(x: np.ndarray) -> bytes:
    return pa.compress(x.tobytes(), "zstd", asbytes=True) if len(x) else b""


def _inflated(column: pa.ChunkedArray, sizes: list[int], kind) -> np.ndarray:
    return np.frombuffer(b"".join(pa.decompress(x.as_buffer(), n, "zstd", asbytes=True) for x, n in zip(column, sizes, strict=True) if n), kind)


def _originals(texts: pa.Table, marks: pa.Table) -> tuple[pa.Table, pa.Table]:
    """(texts that are no copies of smaller documents, the marks that name no copies)."""
    named = marks.column("copy").is_valid()
    copies = set(zip(*(marks.filter(named).column(c).to_pylist() for c in ("copy", "h1")), strict=True))
    if copies:
        texts = texts.filter(pa.array([(i, h) not in copies for i, h in zip(texts.column("doc_id").to_pylist(), texts.column("h1").to_pylist(), strict=True)], pa.bool_()))
    return texts, marks.filter(pc.invert(named))


def _places(texts: pa.Table) -> list[tuple[int, int]]:
    """(document, place of the text's first byte) of each row: the different texts of one id lie one behind another, by hash."""
    rows = list(zip(texts.column("doc_id").to_pylist(), texts.column("h1").to_pylist(), pc.fill_null(pc.binary_length(texts.column("text")), 0).to_pylist(), strict=True))
    at, place, last = 0, {}, None
    for i, h, n in sorted(set(rows)):
        at = at if i == last else 0
        place[i, h] = at
        at, last = at + n + WINDOW, i
    return [(i, place[i, h]) for i, h, _ in rows]


def _first_digits(groups: int):
    """Per part of the documents and group of digits: each digit of the part and how many of its documents have it."""

    def run(texts: pa.Table, marks: pa.Table) -> pa.Table:
        part = texts.column("part")[0].as_py() if len(texts) else 0
        texts, _ = _originals(texts, marks)
        found: list[np.ndarray] = []
        for ids, raw in _chunks(texts.column("doc_id").to_pylist(), _as_bytes(texts.column("text"))):
            data, ends, first = lay_out(raw)
            at, h = anchors(data, ends)
            doc = np.array(ids, np.int64)[np.searchsorted(first, at, "right") - 1]
            order = np.lexsort((doc, h))
            doc, h = doc[order], h[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
            found.append(h[new])
        rows: list[tuple] = []
        if found:
            digits, counts = np.unique(np.concatenate(found), return_counts=True)
            rows = [(g, part, x.tobytes(), _deflated(n)) for g, (x, n) in _split((digits >> np.uint64(33)) % np.uint64(groups), digits, counts.astype(np.uint32))]
        cols = list(zip(*rows, strict=True)) or [()] * 4
        return pa.table([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), *[pa.array(c, pa.binary()) for c in cols[2:]]], names=["g", "part", "digits", "counts"])

    return run


def _group_least(keys: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row the least and the greatest document with its key."""
    order = np.argsort(keys)
    k, d = keys[order], docs[order]
    starts = np.concatenate([[0], np.flatnonzero(k[1:] != k[:-1]) + 1])
    sizes = np.diff(np.append(starts, len(k)))
    low, high = np.empty_like(docs), np.empty_like(docs)
    low[order] = np.repeat(np.minimum.reduceat(d, starts), sizes)
    high[order] = np.repeat(np.maximum.reduceat(d, starts), sizes)
    return low, high


def _shared_digits(common: int):
    """Per group of digits: for each part those of its digits that are in two documents or more, and which are common."""

    def run(table: pa.Table) -> pa.Table:
        sizes = [len(x.as_buffer()) // 8 for x in table.column("digits")]
        digits, counts = _joined(table.column("digits"), np.uint64), _inflated(table.column("counts"), [4 * n for n in sizes], np.uint32)
        rows: list[tuple] = []
        if len(digits):
            order = np.argsort(digits, kind="stable")
            starts = np.concatenate([[0], np.flatnonzero(np.diff(digits[order])) + 1])
            sums = np.add.reduceat(counts[order].astype(np.int64), starts)
            total = np.empty(len(digits), np.int64)
            total[order] = np.repeat(sums, np.diff(np.append(starts, len(digits))))
            ends = np.cumsum(sizes)
            for part, a, b in zip(table.column("part").to_pylist(), (ends - sizes).tolist(), ends.tolist(), strict=True):
                some = total[a:b] > 1
                if some.any():
                    rows.append((part, digits[a:b][some].tobytes(), _deflated((total[a:b][some] >= common).astype(np.uint8))))
        cols = list(zip(*rows, strict=True)) or [()] * 3
        return pa.table([pa.array(cols[0], pa.int64()), *[pa.array(c, pa.binary()) for c in cols[1:]]], names=["part", "digits", "common"])

    return run


PASSED = ["kind", "key", "docs", "at", "digits", "around"]


def _second_digits(groups: int):
    """Per part of the documents, by kind: 0, around each anchor whose digit is shared, the bytes left and right of it,
    by group of digits; 1, windows that start with a common digit, by group of windows; 2, the part's own repeats among
    the latter, which need no comparison with other parts."""
    around = np.arange(-REACH, DIGIT + REACH)

    def run(texts: pa.Table, marks: pa.Table) -> pa.Table:
        part = texts.column("part")[0].as_py() if len(texts) else 0
        texts, shared = _originals(texts, marks)
        sizes = [len(x.as_buffer()) // 8 for x in shared.column("digits")]
        digits, common = _joined(shared.column("digits"), np.uint64), _inflated(shared.column("common"), sizes, np.uint8)
        order = np.argsort(digits)
        digits, common = digits[order], common[order]
        found: list[list[np.ndarray]] = []
        for ids, raw in _chunks(_places(texts), _as_bytes(texts.column("text"))) if len(digits) else ():
            data, ends, first = lay_out(raw)
            at, h = anchors(data, ends)
            place = np.minimum(np.searchsorted(digits, h), len(digits) - 1)
            hit = digits[place] == h
            at, h, place = at[hit], h[hit], place[hit]
            which = np.searchsorted(first, at, "right") - 1
            doc, base = np.array(ids, np.int64).T
            found.append([doc[which], at - first[which] + base[which], h, common[place], data[at[:, None] + around]])
        rows: list[tuple] = []
        if found:
            d, p, h, often, ctx = (np.concatenate(x) for x in zip(*found, strict=True))
            seldom = often == 0
            rows += [(0, g, _packed(a), b.astype(np.uint32).tobytes(), c.tobytes(), _deflated(e)) for g, (a, b, c, e) in _split((h[seldom] >> np.uint64(33)) % np.uint64(groups), d[seldom], p[seldom], h[seldom], ctx[seldom])]
            rows += _common_windows(part, groups, *(x[~seldom] for x in (d, p, h, ctx)))
        cols = list(zip(*rows, strict=True)) or [()] * 6
        return pa.table([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int64()), *[pa.array(c, pa.binary()) for c in cols[2:]]], names=PASSED)

    return run


def _windows(digits: np.ndarray, ctx: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each o the windows that start o bytes before the digit: (o, rows that have one, hashes of all their bytes)."""
    left, right = _prefix_hashes(ctx[:, :REACH][:, ::-1]), _prefix_hashes(ctx[:, REACH + DIGIT :])
    for o in range(REACH + 1):
        a, b = left[o], right[REACH - o]
        ok = np.flatnonzero((a != 0) & (b != 0))
        if len(ok):
            with np.errstate(over="ignore"):
                yield o, ok, _mix(_mix(digits[ok] + a[ok] * _MUL) + b[ok] * _MUL2)


def _cut(ctx: np.ndarray, ok: np.ndarray, o: int) -> Callable[[np.ndarray], np.ndarray]:
    """The bytes of the windows that start o bytes before the digits of the rows ``ok``."""
    return lambda rows: ctx[ok[rows], REACH - o : REACH - o + WINDOW]


def _in_smaller(keys: np.ndarray, docs: np.ndarray, windows: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Whether a row's window is in a smaller document too; ``windows`` gives the bytes of rows.

    Equal keys are taken for equal windows where the bytes agree with those of the
    least document; should two windows ever have one key, all are sorted by their bytes.
    """
    order = np.argsort(keys)
    k, d = keys[order], docs[order]
    starts = np.concatenate([[0], np.flatnonzero(k[1:] != k[:-1]) + 1])
    runs = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(k))))
    low = np.minimum.reduceat(d, starts)
    later = low[runs] < d
    gone = np.zeros(len(keys), bool)
    if later.any():
        holder = np.empty(len(starts), np.int64)
        holder[runs[~later]] = order[~later]  # of each run a row of its least document
        rows, least = order[later], holder[runs[later]]
        if not (windows(rows) == windows(least)).all():
            exact = np.unique(np.ascontiguousarray(windows(np.arange(len(keys)))).view(f"V{WINDOW}").ravel(), return_inverse=True)[1]
            return _group_least(exact, docs)[0] < docs
        gone[rows] = True
    return gone


def _common_windows(part: int, groups: int, docs: np.ndarray, at: np.ndarray, digits: np.ndarray, ctx: np.ndarray) -> list[tuple]:
    """Rows of kinds 1 and 2: of equal windows only those in the part's least document need others."""
    rows: list[tuple] = []
    gone: list[list[np.ndarray]] = []
    asked: list[list[np.ndarray]] = []
    for o, ok, keys in _windows(digits, ctx) if len(docs) else ():
        window = _cut(ctx, ok, o)
        again = _in_smaller(keys, docs[ok], window)
        gone.append([docs[ok][again], at[ok][again] - o])
        asked.append([docs[ok][~again], at[ok][~again] - o, keys[~again], window(np.flatnonzero(~again))])
    if gone:
        d, a = (np.concatenate(x) for x in zip(*gone, strict=True))
        if len(d):
            rows.append((2, part, _packed(d), a.astype(np.uint32).tobytes(), (a + WINDOW).astype(np.uint32).tobytes(), b""))
        d, a, k, w = (np.concatenate(x) for x in zip(*asked, strict=True))
        rows += [(1, g, _packed(x), y.astype(np.uint32).tobytes(), z.tobytes(), _deflated(e)) for g, (x, y, z, e) in _split((k >> np.uint64(33)) % np.uint64(groups), d, a, k, w)]
    return rows


def _prefix_hashes(bytes_: np.ndarray) -> list[np.ndarray]:
    """Hashes of the first 0, 1, ... bytes of each row; 0 once a GAP is among them."""
    h = np.ones(len(bytes_), np.uint64)
    out = [h]
    ok = np.ones(len(bytes_), bool)
    with np.errstate(over="ignore"):
        for k in range(bytes_.shape[1]):
            ok = ok & (bytes_[:, k] != GAP)
            h = _mix(h * _MUL + _BYTE[bytes_[:, k]]) | np.uint64(1)
            out.append(np.where(ok, h, np.uint64(0)))
    return out


def _repeated(parts: int):
    """Per group of digits or windows: byte ranges whose every 50-byte window starts in a smaller document too, by part of the documents."""
    names, types = ["part", "docs", "starts", "ends"], [pa.int64(), pa.binary(), pa.binary(), pa.binary()]

    def run(table: pa.Table) -> pa.Table:
        kind = table.column("kind")[0].as_py()
        if kind == 2:
            return table.select(["key", "docs", "at", "digits"]).rename_columns(names)
        docs, at, digits = _unpacked(table.column("docs")), _joined(table.column("at"), np.uint32).astype(np.int64), _joined(table.column("digits"), np.uint64)
        width = WINDOW if kind else DIGIT + 2 * REACH
        ctx = _inflated(table.column("around"), [len(x.as_buffer()) // 4 * width for x in table.column("at")], np.uint8).reshape(-1, width)
        if kind:
            some = np.flatnonzero(_in_smaller(digits, docs, lambda rows: ctx[rows])) if len(docs) else np.empty(0, np.int64)
            start, end = at[some], at[some] + WINDOW
        else:
            first, last = np.full(len(docs), -1), np.full(len(docs), -1)
            for o, ok, keys in _windows(digits, ctx) if len(docs) else ():
                gone = ok[_in_smaller(keys, docs[ok], _cut(ctx, ok, o))]
                last[gone] = o
                first[gone] = np.where(first[gone] < 0, o, first[gone])
            some = np.flatnonzero(first >= 0)
            start, end = at[some] - last[some], at[some] - first[some] + WINDOW
        rows = [(p, _packed(d), s.astype(np.uint32).tobytes(), e.astype(np.uint32).tobytes()) for p, (d, s, e) in _split(np.mod(docs[some], parts), docs[some], start, end)]
        cols = list(zip(*rows, strict=True)) or [()] * 4
        return pa.table([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    return run


def merge_ranges(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of the bytes that lie in any range."""
    order = np.argsort(starts, kind="stable")
    s, e = starts[order], np.maximum.accumulate(ends[order])
    cut = np.flatnonzero(s[1:] > e[:-1]) + 1
    return list(zip(s[np.concatenate([[0], cut])].tolist(), e[np.append(cut, len(s)) - 1].tolist(), strict=True))


def _outcome(cut: bool):
    def run(texts: pa.Table, gone: pa.Table) -> pa.Table:
        copies = set(zip(*(gone.filter(gone.column("copy").is_valid()).column(c).to_pylist() for c in ("copy", "h1")), strict=True))
        gone = gone.filter(gone.column("copy").is_null())
        docs, starts, ends = _unpacked(gone.column("docs")), _joined(gone.column("starts"), np.uint32).astype(np.int64), _joined(gone.column("ends"), np.uint32).astype(np.int64)
        order = np.argsort(docs, kind="stable")
        docs, starts, ends = docs[order], starts[order], ends[order]
        rows = []
        whole = [(i, h) in copies for i, h in zip(texts.column("doc_id").to_pylist(), texts.column("h1").to_pylist(), strict=True)]
        places = iter(_places(texts.filter(pa.array([not w for w in whole], pa.bool_()))))
        for i, copy, raw in zip(texts.column("doc_id").to_pylist(), whole, _as_bytes(texts.column("text")), strict=True):
            base = 0 if copy else next(places)[1]
            raw = raw or b""
            spans: list[tuple[int, int]] = []
            if copy:
                spans = [(0, len(raw))]
            elif len(raw) >= WINDOW:
                lo, hi = np.searchsorted(docs, i), np.searchsorted(docs, i, "right")
                own = slice(lo, hi)
                here = (starts[own] >= base) & (ends[own] <= base + len(raw))
                if here.any():
                    spans = merge_ranges(starts[own][here] - base, ends[own][here] - base)
            kept, upto = [], 0
            for a, b in spans:
                kept.append(raw[upto:a])
                upto = b
            rest = b"".join([*kept, raw[upto:]])
            row = (i, len(raw), sum(b - a for a, b in spans), len(spans), hashlib.sha256(rest).hexdigest())
            rows.append((*row, rest) if cut else row)
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * cut]
        types = [*[pa.int64()] * 4, pa.string(), *[pa.binary()] * cut]
        cols = list(zip(*rows, strict=True)) or [()] * len(names)
        return pa.table([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    return run


def _prime(n: int) -> int:
    while any(n % d == 0 for d in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def remove_repeats(spark: SparkSession, docs: DataFrame, ws: Workspace, doc_id: str = "doc_id", text: str = "text", with_text: bool = False, common: int = COMMON) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept]) per row of ``docs``.

    Removes each byte covered by a 50-byte string that also starts in a document
    with a smaller id, judged on the input.  ``kept`` has the remaining bytes.

    A null text is empty; a null id neither removes nor loses anything; equal ids
    don't remove from each other; texts under 50 bytes stay whole; an empty table
    gives an empty result.  Exact copies of a smaller document (by 128-bit hash) go as
    a whole and enter neither pass.  ``common`` is the number of documents from which
    a digit's windows are dealt one by one; it changes the plan, never the result.
    """
    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("h1"))
    slim = ws.put(d.select("doc_id", "h1", F.xxhash64(F.lit(1), "text").alias("h2"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("n")), "slim")
    total = slim.agg(F.sum("n")).first()[0] or 0
    share = max(GROUP_BYTES, int((2600 * total) ** 0.5))  # 512 MB at 100 TB
    groups, parts = max(32, -(-total // share)), _prime(max(31, -(-total // max(PART_BYTES, share // 8))))
    real = slim.where(f"doc_id is not null and n >= {WINDOW}")
    # a class of copies may be very large: it meets its least document in as many places as there are salts
    least = real.groupBy("h1", "h2").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most")
    least = least.select("h1", "h2", "least", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = real.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    part = F.pmod("doc_id", F.lit(parts))
    copies = ws.put(salted.join(least, ["h1", "h2", "salt"]).where("doc_id > least").select(part.alias("part"), F.col("doc_id").alias("copy"), "h1"), "copies")

    blank = F.lit(None).cast("binary")
    none = F.lit(None).cast("long")
    by_part = d.where("doc_id is not null").withColumn("part", part)
    digits = by_part.groupBy("part").cogroup(copies.groupBy("part")).applyInArrow(_first_digits(groups), "g long, part long, digits binary, counts binary")
    shared = ws.put(digits.groupBy("g").applyInArrow(_shared_digits(common), "part long, digits binary, common binary"), "shared")
    del digits
    ws.settle()
    marks = copies.withColumns({"digits": blank, "common": blank}).unionByName(shared.withColumns({"copy": none, "h1": none}))
    second = by_part.groupBy("part").cogroup(marks.groupBy("part")).applyInArrow(_second_digits(groups), "kind int, key long, docs binary, at binary, digits binary, around binary")
    gone = ws.put(second.groupBy("kind", "key").applyInArrow(_repeated(parts), "part long, docs binary, starts binary, ends binary"), "gone")
    del second, marks
    ws.drop("shared", "slim")
    ws.settle()
    cuts = copies.withColumns({"docs": blank, "starts": blank, "ends": blank}).unionByName(gone.withColumns({"copy": none, "h1": none}))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    done = by_part.groupBy("part").cogroup(cuts.groupBy("part")).applyInArrow(_outcome(with_text), schema)
    # rows without an id lose nothing and need no others
    whole = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    alone = d.where("doc_id is null").select("doc_id", F.octet_length(whole).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2(whole, 256).alias("kept_sha256"), *[whole.alias("kept")] * with_text)
    return done.unionByName(alone)
