"""Encodings and checksums of index records: varints, fixed integers, CRC-32C, a seeded byte hash."""

from __future__ import annotations

from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F

# fixed values: the Castagnoli polynomial (reflected), the mask's offset, the hash's multiplier
CASTAGNOLI = 0x82F63B78
MASK_DELTA = 0xA282EAD8
MULTIPLIER = 0xC6A4A793


def _byte_hex(value: Column) -> Column:
    return F.lpad(F.hex(value), 2, "0")


def fixed(value: Column, size: int) -> Column:
    """``size`` bytes of an integer, least first."""
    return F.unhex(F.concat(*[_byte_hex(F.shiftrightunsigned(value.cast("long"), 8 * i).bitwiseAND(255)) for i in range(size)]))


def varint(value: Column) -> Column:
    """Seven bits a byte, least first, the top bit set on all but the last."""
    v = value.cast("long")
    more = [F.when(F.shiftrightunsigned(v, 7 * i) != 0, _byte_hex(F.shiftrightunsigned(v, 7 * i).bitwiseAND(127).bitwiseOR(F.when(F.shiftrightunsigned(v, 7 * (i + 1)) != 0, 128).otherwise(0)))) for i in range(1, 10)]
    first = _byte_hex(v.bitwiseAND(127).bitwiseOR(F.when(F.shiftrightunsigned(v, 7) != 0, 128).otherwise(0)))
    return F.when(v.isNotNull(), F.unhex(F.concat_ws("", first, *more)))


def read_varint(data: Column) -> Column:
    """The integer that a varint stands for."""
    n = F.octet_length(data)
    byte = lambda i: F.conv(F.hex(F.substring(data, i, F.lit(1))), 16, 10).cast("long")
    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0).cast("long"), lambda acc, i: acc + F.call_function("shiftleft", byte(i).bitwiseAND(127), (7 * (i - 1)).cast("int")))


@cache
def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(CASTAGNOLI), table >> 1).astype(np.uint32)
    return table


def crc32c_of(data: bytes, before: int = 0) -> int:
    """CRC-32C of ``data`` behind bytes whose CRC is ``before``."""
    table = _crc_table().tolist()
    crc = before ^ 0xFFFFFFFF
    for b in data:
        crc = table[(crc ^ b) & 255] ^ (crc >> 8)
    return crc ^ 0xFFFFFFFF


def crc32c_many(rows: list[bytes]) -> np.ndarray:
    """CRC-32C of each row, a byte of all rows that are long enough at a time."""
    table = _crc_table()
    order = sorted(range(len(rows)), key=lambda i: -len(rows[i]))
    sizes = np.array([len(rows[i]) for i in order], np.int64)
    data = np.frombuffer(b"".join(rows[i] for i in order) or b"\0", np.uint8)
    first = np.cumsum(sizes) - sizes
    crc = np.full(len(rows), 0xFFFFFFFF, np.uint32)
    for at in range(int(sizes[0]) if len(rows) else 0):
        n = int(np.searchsorted(-sizes, -at, "left"))  # rows with a byte there
        crc[:n] = table[(crc[:n] ^ data[first[:n] + at]) & 255] ^ (crc[:n] >> np.uint32(8))
    out = np.empty(len(rows), np.int64)
    out[order] = crc ^ np.uint32(0xFFFFFFFF)
    return out


def crc32c(data: Column) -> Column:
    """CRC-32C as an unsigned number; null for null."""

    @F.pandas_udf("long")
    def run(data: pd.Series) -> pd.Series:
        real = [i for i, x in enumerate(data) if x is not None]
        out = pd.Series([None] * len(data), dtype="Int64")
        if real:
            out.iloc[real] = crc32c_many([bytes(data.iloc[i]) for i in real])
        return out

    return run(data)


def masked(crc: Column) -> Column:
    """A CRC as it is stored beside data that may hold CRCs: turned right by 15 bits, plus a constant."""
    turned = F.shiftrightunsigned(crc, 15).bitwiseOR(F.shiftleft(crc, 17)).bitwiseAND(0xFFFFFFFF)
    return (turned + MASK_DELTA).bitwiseAND(0xFFFFFFFF)


def unmasked(stored: Column) -> Column:
    turned = (stored - MASK_DELTA).bitwiseAND(0xFFFFFFFF)
    return F.shiftrightunsigned(turned, 17).bitwiseOR(F.shiftleft(turned, 15)).bitwiseAND(0xFFFFFFFF)


def hash_of(data: bytes, seed: int) -> int:
    """A 32-bit multiplicative hash over little-endian words, the last of them of 1 to 3 bytes."""
    whole = len(data) // 4 * 4
    h = (seed ^ len(data) * MULTIPLIER) & 0xFFFFFFFF
    for at in range(0, whole, 4):
        h = (h + int.from_bytes(data[at : at + 4], "little")) * MULTIPLIER & 0xFFFFFFFF
        h ^= h >> 16
    if whole < len(data):
        h = (h + int.from_bytes(data[whole:], "little")) * MULTIPLIER & 0xFFFFFFFF
        h ^= h >> 24
    return h


def index_key(fingerprint: Column, table: str) -> Column:
    """The key of an inode ('0') or share ('1') fingerprint (hex) in an index that holds both: the table's mark, then the fingerprint's bytes."""
    marks = {"inode": "0", "share": "1"}
    return F.concat(F.encode(F.lit(marks[table]), "UTF-8"), F.unhex(fingerprint))


def epoch_seconds(at: Column | None = None) -> Column:
    """Seconds since 1970 as a double, to the microsecond; of now if no time is given."""
    return F.unix_micros(F.current_timestamp() if at is None else at.cast("timestamp")) / 1_000_000
