"""Secrets to n shares of which any k rebuild them, and back.

Hashes and AES are column expressions; XOR and field arithmetic run in Arrow
batches, on all rows of a batch at once.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions import binary as B, gf256
from ..params import Coding

SHARES = T.ArrayType(T.BinaryType())


def _hash(c: Coding):
    return hashlib.sha256 if c.pair == "high" else hashlib.md5


class _Rows:
    """Binary rows as one byte array and their ends in it; rows that are null have no bytes."""

    def __init__(self, data: np.ndarray, ends: np.ndarray):
        self.data, self.ends = data, ends
        self.sizes = np.diff(ends, prepend=0)

    @classmethod
    def of(cls, column: pa.Array) -> _Rows:
        sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        # what is joined anew has neither the offsets of a slice nor bytes of null rows
        whole = b"".join(x for x in column.to_pylist() if x)
        return cls(np.frombuffer(whole, np.uint8), np.cumsum(sizes))

    @classmethod
    def join(cls, rows: list[bytes]) -> _Rows:
        return cls(np.frombuffer(b"".join(rows), np.uint8), np.cumsum([len(x) for x in rows], dtype=np.int64))

    def list(self) -> list[bytes]:
        whole, ends = self.data.tobytes(), self.ends.tolist()
        return [whole[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def __xor__(self, other: _Rows) -> _Rows:
        return _Rows(self.data ^ other.data, self.ends)


def _split(packages: list[bytes], k: int) -> list[_Rows]:
    """The k blocks of each package, block by block."""
    return [_Rows.join([x[len(x) // k * j : len(x) // k * (j + 1)] for x in packages]) for j in range(k)]


def _combined(matrix: np.ndarray, blocks: list[_Rows]) -> list[list[bytes]]:
    """matrix times the blocks, row by row of the matrix, as lists over the secrets."""
    whole = np.stack([b.data for b in blocks])
    out = []
    for row in matrix:
        one = np.flatnonzero(row)
        same = len(one) == 1 and row[one[0]] == 1
        out.append((blocks[one[0]] if same else _Rows(gf256.combine(row, whole), blocks[0].ends)).list())
    return out


def _once(f):
    """``f`` as a column function that a filter on its result doesn't run again: Spark copies deterministic ones into the filter."""
    return f.asNondeterministic()


def _keystream(size: Column, key: Column, c: Coding) -> Column:
    return B.cipher(B.counter_pattern(size), key) if c.codec == "caont_rs" else B.keystream_by_word(size, key, c.word)


def _filled(n: int, at: list[int], values: list) -> list:
    out: list = [None] * n
    for i, v in zip(at, values, strict=True):
        out[i] = v
    return out


def encode(rows: DataFrame, c: Coding | None = None, data: str = "chunk") -> DataFrame:
    """Adds ``shares`` (array of n binaries); an empty or null secret has null shares."""
    c = c or Coding()
    matrix = gf256.dispersal(c.n, c.m) if c.codec == "crsss" else gf256.systematic(c.n, c.m)
    digest, w, k, r = _hash(c), c.word, c.k, c.r

    def dispersed(n: int, real: list[int], packages: list[bytes]) -> pa.Array:
        shares = zip(*_combined(matrix, _split(packages, k)), strict=True) if real else ()
        return pa.array(_filled(n, real, list(shares)), pa.list_(pa.binary()))

    @F.arrow_udf(SHARES)
    def package(a: pa.Array, ks: pa.Array, key: pa.Array) -> pa.Array:
        real = pc.indices_nonzero(a.is_valid()).to_pylist()
        mains = (_Rows.of(a.drop_null()) ^ _Rows.of(ks.filter(a.is_valid()))).list()
        tails = (_Rows.join([digest(x).digest() for x in mains]) ^ _Rows.of(key.filter(a.is_valid()))).list()
        return dispersed(len(a), real, [x + y for x, y in zip(mains, tails, strict=True)])

    @F.arrow_udf(SHARES)
    def hashed_groups(a: pa.Array) -> pa.Array:
        per = w * (k - r)
        real, packages = pc.indices_nonzero(a.is_valid()).to_pylist(), []
        for x in a.drop_null().to_pylist():
            groups = [x[at : at + per] for at in range(0, len(x), per)]
            words = [b"".join(g[w * j : w * j + w] for g in groups) for j in range(k - r)]
            packages.append(b"".join(words) + b"".join(digest(g + bytes([j])).digest() for j in range(r) for g in groups))
        return dispersed(len(a), real, packages)

    size = F.octet_length(data)
    whole = F.when(size > 0, B.pad_zero(F.col(data), B.aligned_size(size, c)))
    step = rows.withColumn("__a", whole)
    if c.codec == "crsss":
        return step.withColumn("shares", _once(hashed_groups)("__a")).drop("__a")
    key = B.pair_hash(F.col("__a"), c) if c.codec != "aont_rs" else F.substring(F.unhex(F.sha2(F.uuid(), 256)), F.lit(1), F.lit(w))
    step = step.withColumn("__key", key)
    step = step.withColumn("__ks", _keystream(F.octet_length("__a"), F.col("__key"), c))
    return step.withColumn("shares", _once(package)("__a", "__ks", "__key")).drop("__a", "__key", "__ks")


def sane(c: Coding, ids: str = "share_ids", shares: str = "kept", size: str = "secret_size") -> Column:
    """Whether shares can be what they claim: k of them, all of one size that is whole words, distinct numbers below n, and room for the secret."""
    one = F.octet_length(F.element_at(shares, 1)).cast("long")
    equal = F.forall(shares, lambda s: s.isNotNull() & (F.octet_length(s) == one))
    numbers = (F.size(ids) == c.k) & (F.size(F.array_distinct(ids)) == c.k) & F.forall(ids, lambda i: i.isNotNull() & (i >= 0) & (i < c.n))
    most = one * (c.k - c.r) if c.codec == "crsss" else one * c.k - c.word
    fits = F.col(size).isNotNull() & (F.col(size) >= 0) & (F.col(size) <= most)
    counted = F.col(shares).isNotNull() & F.col(ids).isNotNull() & (F.size(shares) == c.k)
    return F.coalesce(F.when(counted, (one > 0) & (one % c.word == 0) & equal & numbers & fits), F.lit(False))


def decode(rows: DataFrame, c: Coding | None = None, ids: str = "share_ids", shares: str = "kept", size: str = "secret_size") -> DataFrame:
    """Adds ``secret`` and ``intact`` from any k shares (``ids`` are their numbers).

    ``intact`` tells whether the recomputed hash agrees (always true for aont_rs,
    which has none), and is null where ``sane`` fails; ``secret`` is null in either
    case.  A bad row never fails the others.
    """
    c = c or Coding()
    digest, w, k, n, m, r = _hash(c), c.word, c.k, c.n, c.m, c.r

    def rebuilt(numbers: pa.Array, parts: pa.Array) -> tuple[list[int], list[tuple[bytes, ...]]]:
        """(rows that are there, their k blocks), with one matrix for all rows of the same share numbers."""
        by: dict[tuple, list[int]] = defaultdict(list)
        ids, shares = numbers.to_pylist(), parts.to_pylist()
        for i, p in enumerate(shares):
            if p is not None:
                by[tuple(ids[i])].append(i)
        real: list[int] = []
        blocks: list[tuple[bytes, ...]] = []
        for key, at in by.items():
            cols = [_Rows.join([shares[i][j] for i in at]) for j in range(k)]
            real += at
            blocks += zip(*_combined(gf256.decoding(n, m, key, c.codec == "crsss"), cols), strict=True)
        return real, blocks

    given = F.when(sane(c, ids, shares, size), F.col(shares))
    if c.codec == "crsss":

        @F.arrow_udf("struct<secret: binary, intact: boolean>")
        def regroup(numbers: pa.Array, parts: pa.Array, sizes: pa.Array) -> pa.Array:
            real, blocks = rebuilt(numbers, parts)
            rows, sizes = [], sizes.to_pylist()
            for i, b in zip(real, blocks, strict=True):
                groups = [b"".join(b[j][at : at + w] for j in range(k - r)) for at in range(0, len(b[0]), w)]
                ok = all(b"".join(digest(g + bytes([j])).digest() for g in groups) == b[k - r + j] for j in range(r))
                rows.append({"secret": b"".join(groups)[: int(sizes[i])] if ok else None, "intact": ok})
            return pa.array(_filled(len(parts), real, rows), pa.struct([("secret", pa.binary()), ("intact", pa.bool_())]))

        step = rows.withColumn("__p", given)
        return step.withColumn("__o", _once(regroup)(ids, "__p", size)).withColumns({"secret": F.col("__o.secret"), "intact": F.col("__o.intact")}).drop("__p", "__o")

    @F.arrow_udf("struct<main: binary, key: binary>")
    def unpack(numbers: pa.Array, parts: pa.Array) -> pa.Array:
        real, blocks = rebuilt(numbers, parts)
        raw = [b"".join(b) for b in blocks]
        mains = [x[:-w] for x in raw]
        keys = (_Rows.join([digest(x).digest() for x in mains]) ^ _Rows.join([x[-w:] for x in raw])).list()
        cols = [pa.array(_filled(len(parts), real, x), pa.binary()) for x in (mains, keys)]
        return pa.StructArray.from_arrays(cols, ["main", "key"])

    @F.arrow_udf("binary")
    def unmask(main: pa.Array, ks: pa.Array) -> pa.Array:
        real = pc.indices_nonzero(main.is_valid()).to_pylist()
        secrets = (_Rows.of(main.drop_null()) ^ _Rows.of(ks.filter(main.is_valid()))).list()
        return pa.array(_filled(len(main), real, secrets), pa.binary())

    step = rows.withColumn("__u", _once(unpack)(ids, given))
    step = step.withColumn("__ks", _keystream(F.octet_length("__u.main"), F.col("__u.key"), c))
    step = step.withColumn("__a", _once(unmask)("__u.main", "__ks"))
    intact = F.when(F.col("__a").isNotNull(), F.lit(True) if c.codec == "aont_rs" else B.pair_hash(F.col("__a"), c) == F.col("__u.key"))
    step = step.withColumn("intact", intact)
    return step.withColumn("secret", F.when(F.col("intact"), F.substring(F.col("__a"), F.lit(1), F.col(size).cast("int")))).drop("__u", "__ks", "__a")


def keep_shares(rows: DataFrame, numbers: list[int], shares: str = "shares") -> DataFrame:
    """Adds share_ids and kept: only the shares with these numbers are left."""
    return rows.withColumns({"share_ids": F.array(*[F.lit(i) for i in numbers]), "kept": F.when(F.col(shares).isNotNull(), F.array(*[F.element_at(shares, i + 1) for i in numbers]))})
