"""Hashes, sizes, ciphers and names as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..params import Coding


def zero_iv() -> Column:
    return F.unhex(F.lit("00" * 16))


def fingerprint(data: Column) -> Column:
    """SHA-256 in lower-case hex."""
    return F.sha2(data, 256)


def pair_hash(data: Column, c: Coding) -> Column:
    """The hash of the crypto pair, binary: SHA-256 or MD5."""
    return F.unhex(F.sha2(data, 256) if c.pair == "high" else F.md5(data))


def share_size(size: Column, c: Coding) -> Column:
    """Bytes of each share of a secret."""
    w = c.word
    per = w * ((c.k - c.r) if c.codec == "crsss" else c.k)
    whole = size if c.codec == "crsss" else size + w
    return (F.floor((whole + per - 1) / per) * w).cast("long")


def aligned_size(size: Column, c: Coding) -> Column:
    """Least size from ``size`` on that the codec takes without padding."""
    s = share_size(size, c)
    return (s * (c.k - c.r) if c.codec == "crsss" else s * c.k - c.word).cast("long")


def pad_zero(data: Column, to: Column) -> Column:
    return F.concat(data, F.unhex(F.repeat(F.lit("00"), (to - F.octet_length(data)).cast("int"))))


def counter_pattern(size: Column) -> Column:
    """Bytes 0, 1, ... 255, 0, ..."""
    every = "".join(f"{i:02x}" for i in range(256))
    return F.substring(F.unhex(F.repeat(F.lit(every), (F.floor(size / 256) + 1).cast("int"))), F.lit(1), size.cast("int"))


def cipher(data: Column, key: Column) -> Column:
    """AES-CBC with a zero vector and no padding; the size is a multiple of 16."""
    boxed = F.aes_encrypt(data, key, F.lit("CBC"), F.lit("DEFAULT"), zero_iv())
    return F.substring(boxed, F.lit(17), F.octet_length(data))


def keystream_by_word(size: Column, key: Column, word: int) -> Column:
    """Each word's place (little-endian, zero-filled) enciphered on its own."""
    n = F.floor(size / word).cast("int")
    place = lambda i: F.unhex(F.rpad(F.concat(*[F.lpad(F.hex(F.shiftright(i, 8 * b).bitwiseAND(255)), 2, "0") for b in range(4)]), 2 * word, "0"))
    words = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.hex(cipher(place(i), key)))
    return F.when(n > 0, F.unhex(F.concat_ws("", words))).otherwise(F.unhex(F.lit("")))


def base26_name(number: Column, suffix: str = "", letters: int = 12) -> Column:
    """Twelve letters counting from aaaaaaaaaaaa."""
    parts = [F.char(F.lit(97) + F.pmod(F.floor(number / (26**i)), F.lit(26)).cast("int")) for i in range(letters - 1, -1, -1)]
    return F.concat(*parts, F.lit(suffix))


def little_endian_hex(number: Column) -> Column:
    """A 32-bit integer's bytes, least first."""
    return F.lower(F.concat(*[F.lpad(F.hex(F.shiftright(number, 8 * b).bitwiseAND(255)), 2, "0") for b in range(4)]))


def inode_fingerprint(path: Column, user: Column) -> Column:
    return F.sha2(F.concat(F.encode(path, "UTF-8"), F.unhex(little_endian_hex(user))), 256)


def is_zero(data: Column) -> Column:
    return F.hex(data).rlike("^0*$")
