"""Fixed and content-defined chunks of binary columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ..params import Chunking


def fixed_chunks(files: DataFrame, size: int, data: str = "data") -> DataFrame:
    """``files`` with secret_id, secret_size and chunk for ``data``: ends at every ``size`` bytes; empty or null files give no rows."""
    n = F.ceil(F.octet_length(data) / size).cast("int")
    cut = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(F.col(data), (i * size + 1).cast("int"), F.lit(size)))
    out = files.where(F.octet_length(data) > 0).select(*[c for c in files.columns if c != data], F.posexplode(cut).alias("secret_id", "chunk"))
    return out.withColumn("secret_size", F.octet_length("chunk"))


#: Bytes whose hashes are computed at a time; what is at hand then stays small and in the processor's cache.
PIECE = 1 << 18
#: Bytes of files that go out in one batch of chunks.
FLUSH = 8 << 20


def anchors(data: np.ndarray, p: Chunking) -> np.ndarray:
    """Positions whose last ``window`` bytes have a polynomial hash that is 0 under the mask."""
    if len(data) < p.window:
        return np.empty(0, np.int64)
    found = []
    for at in range(p.window - 1, len(data), PIECE):
        h = _window_hashes(data[at - p.window + 1 : at + PIECE], p.window)
        found.append(np.flatnonzero((h & np.uint32(p.mask)) == 0) + at)
    return np.concatenate(found)


def _window_hashes(data: np.ndarray, window: int) -> np.ndarray:
    """The hash modulo 2^32 of each ``window`` bytes, from those of half as many: hash(ab) = hash(a) 257^|b| + hash(b).

    Masks are below 2^23 and so are their multiples' remainders, whatever is above.
    """
    if window == 1:
        return data.astype(np.uint32)
    half = window // 2
    h = _window_hashes(data, half)
    pair = h[: len(h) - half] * np.uint32(pow(257, half, 1 << 32)) + h[half:]
    if window % 2:
        pair = pair[:-1] * np.uint32(257) + data[window - 1 :]
    return pair


def variable_ends(data: bytes, p: Chunking) -> list[int]:
    """Last byte of each chunk.  From the end of one, the next is the first anchor at least ``minimum`` on, or ``maximum`` on, or the last byte."""
    ends: list[int] = []
    for base in range(0, len(data), p.read_buffer):
        block = np.frombuffer(data, np.uint8, min(p.read_buffer, len(data) - base), base)
        last, at, prev = len(block) - 1, anchors(block, p), -1
        while prev + p.minimum <= last:
            i = np.searchsorted(at, prev + p.minimum)
            stop = min(prev + p.maximum, last)
            prev = min(int(at[i]), stop) if i < len(at) else stop
            ends.append(base + prev)
        if prev < last:
            ends.append(base + last)
    return ends


def variable_chunks(files: DataFrame, p: Chunking | None = None, data: str = "data") -> DataFrame:
    """As ``fixed_chunks``, with content-defined ends."""
    p = p or Chunking()
    own = [f for f in files.schema.fields if f.name != data]
    schema = T.StructType([*own, T.StructField("secret_id", T.IntegerType()), T.StructField("chunk", T.BinaryType()), T.StructField("secret_size", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(len(own))
            rows: list[int] = []
            numbers: list[int] = []
            chunks: list[bytes] = []
            held = 0
            for row in range(batch.num_rows):
                raw = column[row].as_py() or b""
                start = 0
                for i, end in enumerate(variable_ends(raw, p)):
                    rows.append(row)
                    numbers.append(i)
                    chunks.append(raw[start : end + 1])
                    start = end + 1
                held += len(raw)
                if rows and (held >= FLUSH or row == batch.num_rows - 1):
                    take = pa.array(rows, pa.int32())
                    yield pa.RecordBatch.from_arrays([*[batch.column(i).take(take) for i in range(len(own))], pa.array(numbers, pa.int32()), pa.array(chunks, pa.binary()), pa.array(map(len, chunks), pa.int32())], names=schema.names)
                    rows, numbers, chunks, held = [], [], [], 0

    return files.select(*[f.name for f in own], data).mapInArrow(run, schema)
