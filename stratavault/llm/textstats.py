"""Counts over whole texts that the quality operators share."""

from __future__ import annotations

import numpy as np

WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"
_KINDS = ["upper", "letter", "digit", "punct", "shout", "bar", "symbol", "blank", "other"]
_LAST = 0x3000


def _kind(c: str) -> int:
    if c in BLANKS:
        return 7
    if c == "!":
        return 4
    if c == "|":
        return 5
    if c in SYMBOLS:
        return 6
    if c in "?.,;:":
        return 3
    if c in "0123456789":
        return 2
    return (0 if c.isupper() else 1) if c.isalpha() else 8


#: The kind of each code point; those from _LAST on (mostly CJK) count as letters.
_TABLE = np.array([_kind(chr(i)) for i in range(_LAST)] + [1], np.uint8)


def kinds_of(text: str) -> dict[str, int]:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    counts = np.bincount(_TABLE[np.minimum(codes, _LAST)], minlength=len(_KINDS))
    return dict(zip(_KINDS, counts.tolist(), strict=True))


def words_of(text: str) -> list[bytes]:
    """Maximal runs of anything but the six ASCII blanks, as UTF-8 bytes."""
    return text.encode("utf-8", "surrogatepass").split()


def ids_of(words: list[bytes]) -> np.ndarray:
    """Equal words get equal numbers."""
    table: dict[bytes, int] = {}
    return np.fromiter((table.setdefault(w, len(table)) for w in words), np.int64, len(words))


def repeated_words(ids: np.ndarray, width: int = 3) -> int:
    """Words inside a window of ``width`` words that is found twice or more, the first time included."""
    n = len(ids) - width + 1
    if n < 2:
        return 0
    code = ids[:n]
    for k in range(1, width):
        span = int(ids.max()) + 1
        if int(code.max() + 1) * span >= 1 << 62:
            code = np.unique(code, return_inverse=True)[1].astype(np.int64)
        code = code * span + ids[k : k + n]
    _, inverse, counts = np.unique(code, return_inverse=True, return_counts=True)
    again = counts[inverse] > 1
    hit = np.zeros(len(ids), bool)
    for k in range(width):
        hit[k : k + n] |= again
    return int(hit.sum())


def duplicate_lines(text: str) -> tuple[int, int]:
    """(lines with a word, those of them equal to an earlier line)."""
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    return len(lines), len(lines) - len(set(lines))


def measure(text: str | None) -> dict[str, int]:
    """Every count for one text; a null text counts as an empty one."""
    text = text or ""
    words = words_of(text)
    ids = ids_of(words)
    n_lines, dup = duplicate_lines(text)
    kinds = kinds_of(text)
    return {
        "n_words": len(words),
        "word_chars": len(text) - kinds["blank"],
        "n_symbols": kinds["symbol"] + kinds["bar"],
        "n_dup_lines": dup,
        "n_repeat_words": repeated_words(ids),
        "n_lines": n_lines,
        "n_distinct": int(ids.max()) + 1 if len(ids) else 0,
        "n_upper": kinds["upper"],
        "n_letters": kinds["upper"] + kinds["letter"],
        "n_digits": kinds["digit"],
        "n_punct": kinds["punct"] + kinds["shout"],
        "n_shout": kinds["shout"],
        "n_bars": kinds["bar"],
    }


STATS = list(measure(""))
