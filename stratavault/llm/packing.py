"""Token sequences of fixed length: hierarchical multi-length packing, and best-fit-decreasing packing into matrices."""

from __future__ import annotations

import heapq
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, types as T

from .tokens import default_path, document_ids, tokenizer as load_tokenizer

LENGTH = 2048
TIERS = (2048, 1024, 512, 256)
#: Tokens that are packed together; a task holds about this many (4 bytes each) and a few texts.
WINDOW = 1_000_000
STEP = 32  # sequences in a step group

Piece = tuple[int, int, int]  # document's place in the window, start, length


def binary_parts(n: int) -> list[int]:
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


class _Pool:
    """Short pieces by length; gives the longest that fits, or cuts the shortest that does not."""

    def __init__(self, pieces: list[Piece]):
        self.items = sorted((n, d, a) for d, a, n in pieces)

    def take(self, room: int) -> Piece:
        i = bisect_right(self.items, (room, 1 << 62, 0)) - 1
        if i >= 0:
            n, d, a = self.items.pop(i)
            return d, a, n
        n, d, a = self.items.pop(0)
        insort(self.items, (n - room, d, a + room))
        return d, a, room

    def pop_tier(self, above: int) -> Piece | None:
        """A longest piece of more than ``above`` tokens."""
        if self.items and self.items[-1][0] > above:
            n, d, a = self.items.pop()
            return d, a, n
        return None


def pack_tiers(lengths: list[int], length: int = LENGTH, tiers: tuple[int, ...] = TIERS) -> list[list[Piece]]:
    """Sequences of pieces; every token of every document lies in exactly one piece.

    Whole windows of a long document are sequences of their own.  What is left of
    each document goes to the smallest tier that holds it.  The tiers are packed
    from long to short; the gap behind each leading piece is filled from shorter
    tiers, the last filler being cut to fit.  Tokens that are left when no filler
    is, are chopped: full sequences, then a power of two each, so nothing is padded.
    """
    out: list[list[Piece]] = []
    rest: list[Piece] = []
    for d, n in enumerate(lengths):
        full = n - n % length
        out += [[(d, a, length)] for a in range(0, full, length)]
        if n > full:
            rest.append((d, full, n - full))
    longs = sorted((p for p in rest if p[2] > tiers[1]), key=lambda p: -p[2])
    pool = _Pool([p for p in rest if p[2] <= tiers[1]])
    left: list[Piece] = []

    def fill(first: Piece, size: int) -> None:
        seq, room = [first], size - first[2]
        while room and pool.items:
            piece = pool.take(room)
            seq.append(piece)
            room -= piece[2]
        if room:
            left.extend(seq)
        else:
            out.append(seq)

    for p in longs:
        fill(p, tiers[0])
    for tier, below in zip(tiers[1:], [*tiers[2:], 0], strict=True):
        while (p := pool.pop_tier(below)) is not None:
            fill(p, tier)
    total = sum(n for _, _, n in left)
    sizes = [length] * (total // length) + binary_parts(total % length)
    queue = iter(left)
    d = a = n = 0
    for size in sizes:
        seq, room = [], size
        while room:
            if not n:
                d, a, n = next(queue)
            take = min(n, room)
            seq.append((d, a, take))
            a, n, room = a + take, n - take, room - take
        out.append(seq)
    return out


def step_groups(sizes: list[int], step: int = STEP) -> list[int]:
    """A group for each sequence so that the groups' attention costs (squares) are near equal: largest first to the lightest."""
    heap = [(0, g) for g in range(max(1, -(-len(sizes) // step)))]
    group = [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        cost, g = heapq.heappop(heap)
        group[i] = g
        heapq.heappush(heap, (cost + sizes[i] ** 2, g))
    return group


class _Tree:
    """Segment tree over the room 0..length that open bins have; finds the least room that is enough."""

    def __init__(self, length: int):
        self.size = 1 << length.bit_length()
        self.count = [0] * (2 * self.size)
        self.bins: list[list[int]] = [[] for _ in range(length + 1)]

    def _add(self, room: int, by: int) -> None:
        i = room + self.size
        while i:
            self.count[i] += by
            i >>= 1

    def put(self, room: int, bin_: int) -> None:
        self.bins[room].append(bin_)
        self._add(room, 1)

    def pull(self, need: int) -> tuple[int, int] | None:
        """(bin, its room): of a bin with the least room from ``need`` on."""
        i = need + self.size
        if not self.count[i]:
            while i > 1 and (i & 1 or not self.count[i ^ 1]):
                i >>= 1
            if i <= 1:
                return None
            i ^= 1
            while i < self.size:
                i = 2 * i if self.count[2 * i] else 2 * i + 1
        room = i - self.size
        self._add(room, -1)
        return self.bins[room].pop(), room


def pack_best_fit(lengths: list[int], length: int = LENGTH) -> list[list[Piece]]:
    """Best-fit decreasing: documents are split losslessly into windows of ``length``, then longest first into the fullest bin with room."""
    pieces = [(d, a, min(length, n - a)) for d, n in enumerate(lengths) for a in range(0, n, length)]
    tree, bins = _Tree(length), []
    for p in sorted(pieces, key=lambda p: (-p[2], p[0], p[1])):
        got = tree.pull(p[2])
        bin_, room = got or (len(bins), length)
        if got is None:
            bins.append([])
        bins[bin_].append(p)
        if room > p[2]:
            tree.put(room - p[2], bin_)
    return bins


def _windows(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[tuple[list, list[np.ndarray]]]:
    """Document ids and their token ids, some WINDOW tokens at a time."""
    names: list = []
    ids: list[np.ndarray] = []
    held = 0
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            part = batch.slice(at, 2000)
            for name, x in zip(part.column(0).to_pylist(), document_ids(path, part.column(1)), strict=True):
                names.append(name)
                ids.append(x)
                held += len(x)
                if held >= WINDOW:
                    yield names, ids
                    names, ids, held = [], [], 0
    if names:
        yield names, ids


def _first_sequence() -> int:
    return (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32


PIECE = [("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType()), ("doc_tokens", T.LongType()), ("sequence_id", T.LongType()), ("offset", T.LongType())]


def _pieces(path: str, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence = _first_sequence()
        for names, ids in _windows(batches, path):
            seqs = pack_tiers([len(x) for x in ids], length)
            sizes = [sum(n for _, _, n in s) for s in seqs]
            groups = [sequence + g for g in step_groups(sizes)]  # a window has at least as many sequences as groups
            rows = []
            for s, size, group in zip(seqs, sizes, groups, strict=True):
                offset = 0
                for d, a, n in s:
                    rows.append((names[d], a, n, zlib.crc32(ids[d][a : a + n].tobytes()), len(ids[d]), sequence, offset, size, group))
                    offset += n
                sequence += 1
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", *[n for n, _ in PIECE], "sequence_tokens", "step_group"])

    return run


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None, length: int = LENGTH) -> DataFrame:
    """One row per piece: doc_id (long), start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_tokens, step_group.

    Each task packs the documents of its partition, WINDOW tokens at a time, so
    nothing is shuffled; sequence ids carry the partition's number.  The sequences of
    a window are dealt into step groups of near equal attention cost, STEP at most on
    average; ``step_group`` is the id of a sequence of the same window, so groups of
    different windows never share a number.  A document's ids end with id 1; a null or empty text is that id alone; null or repeated ids
    are documents like others; an empty table gives an empty result.
    """
    schema = T.StructType([T.StructField(n, t) for n, t in [("doc_id", T.LongType()), *PIECE, ("sequence_tokens", T.LongType()), ("step_group", T.LongType())]])
    src = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text"))
    return src.mapInArrow(_pieces(tokenizer or default_path(), length), schema)


MATRIX = T.StructType([
    T.StructField("sequence_id", T.LongType()), T.StructField("input_ids", T.BinaryType()), T.StructField("position_ids", T.BinaryType()), T.StructField("n_tokens", T.IntegerType()),
    T.StructField("cu_seqlens", T.ArrayType(T.IntegerType())), T.StructField("doc_ids", T.ArrayType(T.LongType())),
    T.StructField("starts", T.ArrayType(T.LongType())), T.StructField("doc_tokens", T.ArrayType(T.LongType())),
])


#: Ids and positions of a matrix are unsigned 16-bit numbers.
WIDEST = 1 << 16


def _matrices(path: str, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (top := load_tokenizer(path).greatest_id()) >= WIDEST:
            raise ValueError(f"the tokenizer has id {top}, which a matrix of 16-bit ids can't hold")
        sequence = _first_sequence()
        for names, ids in _windows(batches, path):
            rows = []
            for seq in pack_best_fit([len(x) for x in ids], length):
                line, place = np.zeros((2, length), "<u2")
                ends = np.cumsum([0, *(n for _, _, n in seq)])
                for (d, a, n), at in zip(seq, ends, strict=False):
                    line[at : at + n] = ids[d][a : a + n]
                place[: ends[-1]] = positions(ends)
                rows.append((sequence, line.tobytes(), place.tobytes(), int(ends[-1]), ends.tolist(), [names[d] for d, _, _ in seq], [a for _, a, _ in seq], [len(ids[d]) for d, _, _ in seq]))
                sequence += 1
            types = [pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.list_(pa.int32()), *[pa.list_(pa.int64())] * 3]
            for at in range(0, len(rows), 256):
                cols = list(zip(*rows[at : at + 256], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=MATRIX.names)

    return run


def write_matrices(spark: SparkSession, docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None, length: int = LENGTH) -> DataFrame:
    """Packs ``docs`` and writes the sequences to ``path``; returns them as read back.

    A row is a line of the id matrix: ``input_ids`` (``length`` little-endian
    unsigned 16-bit ids, 0 behind ``n_tokens``), ``position_ids`` (likewise, from 0
    again at each segment), ``cu_seqlens`` (cumulative segment lengths from 0), and
    per segment the document, its start there and the document's tokens.  Null or
    empty texts are the end id alone; null and repeated ids are documents like
    others; an empty table writes an empty one.  A tokenizer with ids that 16 bits
    can't hold is refused.
    """
    if length > WIDEST:
        raise ValueError("positions of a longer sequence don't fit 16 bits")
    src = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text"))
    src.mapInArrow(_matrices(tokenizer or default_path(), length), MATRIX).write.option("compression", "zstd").parquet(path)
    return spark.read.schema(MATRIX).parquet(path)


def positions(cu_seqlens: list[int]) -> np.ndarray:
    """Position of each token in its segment."""
    ends = np.asarray(cu_seqlens)
    return np.arange(ends[-1]) - np.repeat(ends[:-1], np.diff(ends))


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            line = np.frombuffer(r["input_ids"], "<u2").astype("<u4")
            cu = r["cu_seqlens"]
            for k, (doc, start, total) in enumerate(zip(r["doc_ids"], r["starts"], r["doc_tokens"], strict=True)):
                rows.append((doc, start, cu[k + 1] - cu[k], zlib.crc32(line[cu[k] : cu[k + 1]].tobytes()), total, r["sequence_id"], cu[k]))
        cols = list(zip(*rows, strict=True)) or [()] * 7
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", *[n for n, _ in PIECE]])


def segments(matrices: DataFrame) -> DataFrame:
    """One row per segment, as ``pack`` has them, from what ``write_matrices`` wrote."""
    return matrices.mapInArrow(_segments, T.StructType([T.StructField("doc_id", T.LongType()), *[T.StructField(n, t) for n, t in PIECE]]))
