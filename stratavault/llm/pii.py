"""Personal data: plain patterns, and patterns behind disguises mapped back to where they stand in the text."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import DataFrame, types as T

KINDS = ["email", "ip", "card", "phone"]

# fixed values: look-alikes of ASCII letters and digits
HOMOGLYPHS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j", "ԁ": "d", "һ": "h",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X",
    "α": "a", "ο": "o", "ν": "v", "ι": "i", "κ": "k", "ρ": "p", "Ο": "O", "Α": "A", "Ε": "E",
    "․": ".", "。": ".", "‐": "-", "‑": "-", "–": "-", " ": " ", " ": " ",
}
# fixed values: digits, plus, at and dot as English, German, French and Spanish spell them
DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "zwo": "2", "drei": "3", "vier": "4", "fünf": "5", "fuenf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
PLUS_WORDS = ["plus", "más"]
#: An at word without brackets, and the dot words that may follow it.
AT_WORDS = {"at": {"dot", "punkt"}, "ät": {"punkt"}, "klammeraffe": {"punkt"}, "arobase": {"point"}, "arroba": {"punto"}}
DOT_WORDS = ["dot", "punkt", "point", "punto"]
ZERO_WIDTH = "​‌‍⁠﻿"

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_ODD = re.compile("[" + "".join(HOMOGLYPHS) + ZERO_WIDTH + "！-～]")
_OPEN, _CLOSE = r"[\[({<]", r"[\])}>]"
_ATS, _DOTS = "|".join(AT_WORDS), "|".join(DOT_WORDS)
_AT = re.compile(rf"{_OPEN}\s*+(?:{_ATS}|@)\s*+{_CLOSE}|@|(?<=\s)(?:{_ATS})(?=\s)", re.I)
_DOT = re.compile(rf"\.|\s*+{_OPEN}\s*+(?:{_DOTS}|\.)\s*+{_CLOSE}\s*+|\s++({_DOTS})\s++", re.I)
_LABEL = re.compile(r"[A-Za-z0-9-]++")
_BLANKS = re.compile(r"\s*+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: The digit words by first letter, which the search tells apart at once.
_SPELLED = "|".join(f"[{c}{c.upper()}](?i:{'|'.join(w[1:] for w in DIGIT_WORDS if w[0] == c)})" for c in sorted({w[0] for w in DIGIT_WORDS}))
_NUMBER = rf"(?<![^\W_])(?:[0-9]++|{_SPELLED})(?![^\W_])"
_DOT_WORD = rf"(?:{_OPEN}\s*+(?:{_DOTS}|\.)\s*+{_CLOSE}|(?<=\s)(?:{_DOTS})(?=\s))"
_GAP = rf"(?:\s++|{_DOT_WORD}|[().,-])++"
_NUMERIC = re.compile(rf"{_NUMBER}(?:(?i:{_GAP}){_NUMBER})*+")
_PLUS = re.compile(rf"(?:(?<![^\W_])(?:{'|'.join(PLUS_WORDS)})|\+)[\s,-]++\Z", re.I)
_TOKEN = re.compile(_NUMBER)
_ANY_DOT_WORD = re.compile(rf"\s*+{_DOT_WORD}\s*+", re.I)
_DIGIT_WORD = re.compile("|".join(DIGIT_WORDS), re.I)

Span = tuple[int, int, int]  # start, kind's place in KINDS, end


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def find_emails(text: str) -> Iterator[tuple[int, int]]:
    """As the pattern local@domain finds them from the left, in linear time: each @ looks back for its local part."""
    free = 0
    for m in _DOMAIN.finditer(text):
        at = start = m.start()
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at:
            yield start, m.end()
            free = m.end()


def find_plain(text: str) -> list[Span]:
    """The base spans, each kind leftmost and non-overlapping, in order."""
    found = [(a, 0, b) for a, b in find_emails(text)] if "@" in text else []
    for m in _IP.finditer(text) if "." in text else ():
        if all(len(x) <= 3 and int(x) <= 255 if len(x.lstrip("0")) <= 3 and not x.startswith("0") else int(x.lstrip("0")[:4] or 0) <= 255 for x in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            found.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text) if "+" in text else ():
        if 9 <= len(_digits(m[0])) <= 15:
            found.append((m.start(), 3, m.end()))
    return sorted(found)


class Mapped:
    """A rewritten text that knows, for each of its characters, the source span it stands for.

    Only the replaced pieces are kept, by their ends in the text before and after; a
    character outside of them is as far from the last piece as it was before.
    """

    def __init__(self, text: str, before: Mapped | None = None, ends: tuple[list[int], ...] = ([], [], [], [])):
        self.text, self.before, self.ends = text, before, ends

    def rewrite(self, pieces: Iterable[tuple[int, int, str]]) -> Mapped:
        """Replaces each (start, end, new) of the present text; pieces are in order, apart and not empty."""
        out: list[str] = []
        new_a, new_b, old_a, old_b = [], [], [], []
        at = size = 0
        for a, b, new in pieces:
            out += [self.text[at:a], new]
            size += a - at
            new_a.append(size)
            size += len(new)
            new_b.append(size)
            old_a.append(a)
            old_b.append(b)
            at = b
        return Mapped("".join(out) + self.text[at:], self, (new_a, new_b, old_a, old_b))

    def source(self, start: int, end: int) -> tuple[int, int]:
        """The least span of the source that the characters start to end - 1 stand for."""
        view = self
        while view.before is not None:
            new_a, new_b, old_a, old_b = view.ends
            i, j = bisect_right(new_a, start) - 1, bisect_right(new_a, end - 1) - 1
            if i >= 0:
                start = old_a[i] if start < new_b[i] else old_b[i] + start - new_b[i]
            if j >= 0:
                end = old_b[j] if end - 1 < new_b[j] else old_b[j] + end - new_b[j]
            view = view.before
        return start, end


def _plain_char(c: str) -> str:
    if c in ZERO_WIDTH:
        return ""
    return chr(ord(c) - 0xFEE0) if "！" <= c <= "～" else HOMOGLYPHS[c]


def _separators(text: str) -> Iterator[tuple[int, int, str]]:
    """@ and . for the disguised separators of addresses, found from each at: a name before it, labels parted by dots behind.

    A run of characters is looked at from the one at next to it only, so the time is linear.
    """
    upto = 0
    for m in _AT.finditer(text):
        if m.start() < upto:
            continue
        left = m.start()
        while left > upto and text[left - 1].isspace():
            left -= 1
        if left == upto or text[left - 1] not in _LOCAL:
            continue
        right = _BLANKS.match(text, m.end()).end()
        label = _LABEL.match(text, right)
        word = m[0].lower()
        bare = word == "@" and left == m.start() and right == m.end()
        dots: list[tuple[int, int]] = []
        plain = True  # whether all dots are
        last = label
        while last and (d := _DOT.match(text, last.end())) and (after := _LABEL.match(text, d.end())):
            if d[1] and word in AT_WORDS and d[1].lower() not in AT_WORDS[word]:
                break
            if d[0] != ".":
                dots.append(d.span())
                plain = False
            elif not dots:
                dots.append(d.span())
            last = after
        if not dots or (plain and (bare or word in AT_WORDS)):
            continue  # not an address, or a plain one, or words around an "at" and a full stop, which are prose
        if word == "@" and not re.search("[A-Za-z]", last[0]):
            continue  # a number of things at a price
        if word in AT_WORDS and (n := _NUMERIC.match(text, right)) and _reads_as_ip(n[0]):
            continue  # so are words before an address of numbers
        yield left, right, "@"
        yield from ((a, b, ".") for a, b in dots if b - a > 1)
        upto = last.end()


def _new_gap(gap: str, words: int, wide: bool) -> str:
    """What stands for ``gap`` between two numbers of which ``words`` are spelled."""
    if not gap.strip(" \t\n\r\f\v,-\xa0"):
        if "\n" in gap and not wide:
            return gap
        return "" if words else " " if gap.strip("- ") or len(gap) > 1 else gap
    return gap if gap == "." else re.sub(r"[\s,]+", " ", _ANY_DOT_WORD.sub(".", gap))


def _numbers(text: str, wide: bool) -> Iterator[tuple[int, int, str]]:
    """Digits for the words of each row of numbers, with gaps that the plain patterns know; those decide what it is.

    A line's end parts numbers unless ``wide``.  An address keeps its numbers apart
    from words beside it: in a row with three dots no number gets more than three
    digits by joining, and a plain address none.  A single digit word beside plain
    data is a word ("un", "one").
    """
    ips, edges = None, set()
    for m in _NUMERIC.finditer(text):
        plus = _PLUS.search(text, max(0, m.start() - 12), m.start())
        if not (plus or _DIGIT_WORD.search(m[0]) or _ANY_DOT_WORD.search(m[0])):
            continue
        tokens = [(t.start(), t.end(), DIGIT_WORDS.get(t[0].lower())) for t in _TOKEN.finditer(text, m.start(), m.end())]
        if sum(1 if d else b - a for a, b, d in tokens) < 4:
            continue
        if ips is None:
            ips = {x for i in _IP.finditer(text) for x in i.span()}
            edges = {x for a, kind, b in find_plain(text) for x in (a + (kind == 3), b)}
        spelled = [bool(d) for _, _, d in tokens]
        for i, (a, b, d) in enumerate(tokens):
            before, after = tokens[i - 1] if i else None, tokens[i + 1] if i + 1 < len(tokens) else None
            if d and not (before and spelled[i - 1]) and not (after and spelled[i + 1]) and ((before and before[1] in edges) or (after and after[0] in edges)):
                tokens[i] = (a, b, None)
                ips |= {a, b}
        gaps = [_new_gap(text[b:c], bool(d) + bool(e), wide) for (_, b, d), (c, _, e) in pairwise(tokens)]
        gaps = [text[b:c] if not g and (b in ips or c in ips) else g for g, ((_, b, _), (c, _, _)) in zip(gaps, pairwise(tokens), strict=True)]
        if gaps.count(".") > 2:
            gaps = _threes(tokens, gaps)
        if plus:
            yield plus.start(), plus.end(), "+"
        for (a, b, d), gap, (c, _, _) in zip(tokens, [*gaps, None], [*tokens[1:], tokens[-1]], strict=True):
            if d:
                yield a, b, d
            if gap is not None and gap != text[b:c]:
                yield b, c, gap


def _reads_as_ip(row: str) -> bool:
    read = Mapped(row).rewrite(_numbers(row, True)).text
    return any(kind == 1 and a == 0 for a, kind, _ in find_plain(read))


def _threes(tokens: list[tuple], gaps: list[str]) -> list[str]:
    """``gaps`` with blanks where joined numbers would pass three digits, counted from the dot that they stand at."""
    gaps = list(gaps)
    at = 0
    while at < len(gaps):
        to = at
        while to < len(gaps) and not gaps[to]:
            to += 1
        before_dot = to < len(gaps) and gaps[to] == "." and not (at and gaps[at - 1] == ".")
        held = 0
        for k in reversed(range(at, to + 1)) if before_dot else range(at, to + 1):
            n = 1 if tokens[k][2] else tokens[k][1] - tokens[k][0]
            if held and held + n > 3:
                gaps[k if before_dot else k - 1] = " "
                held = 0
            held += n
        at = to + 1
    return gaps


class _Taken:
    """Spans found so far, as rows of spans that are in order and apart."""

    def __init__(self):
        self.rows: list[tuple[list[int], list[int]]] = []

    def row(self) -> tuple[list[int], list[int]]:
        self.rows.append(([], []))
        return self.rows[-1]

    def holds_whole(self, start: int, end: int) -> bool:
        """Whether start to end cuts through no span: what it overlaps it contains."""
        for starts, ends in self.rows:
            i, j = bisect_right(ends, start), bisect_left(starts, end) - 1
            if i <= j and not (start <= starts[i] and ends[j] <= end):
                return False
        return True


def find_disguised(text: str, base: list[Span]) -> list[Span]:
    """Spans that show only in the normalised text, mapped back; each contains the base spans that it overlaps."""
    view = Mapped(text)
    # each step looks at what the steps before it left, as a disguise may stand behind another one
    if _ODD.search(text):
        view = view.rewrite((m.start(), m.end(), _plain_char(m[0])) for m in _ODD.finditer(view.text))
    if pieces := list(_separators(view.text)):
        view = view.rewrite(pieces)
    pieces = list(_numbers(view.text, False))
    views = [view.rewrite(pieces) if pieces else view]
    if pieces and "\n" in view.text and (more := list(_numbers(view.text, True))) != pieces:
        views.append(view.rewrite(more))
    taken = _Taken()
    for kind in range(len(KINDS)):
        row = taken.row()
        for a, k, b in base:
            if k == kind:
                row[0].append(a)
                row[1].append(b)
    new: set[Span] = set()
    for view in views:
        rows = [taken.row() for _ in KINDS]
        for a, kind, b in find_plain(view.text) if view.text != text else ():
            start, end = view.source(a, b)
            if text[start:end] == view.text[a:b] or (start, kind, end) in new:
                continue
            if taken.holds_whole(start, end):
                new.add((start, kind, end))
                rows[kind][0].append(start)
                rows[kind][1].append(end)
    return sorted(new)


def find_all(text: str | None) -> tuple[list[Span], list[Span]]:
    """(base spans, base and disguised spans in order); a null text has none."""
    base = find_plain(text or "")
    return base, sorted(base + find_disguised(text or "", base))


def join_spans(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def redact_text(text: str | None) -> str | None:
    """Every span, overlapping ones merged, gives way to the name of its first kind."""
    if not text:
        return text
    out, at, upto = [], 0, 0
    for a, kind, b in find_all(text)[1]:
        if a >= upto:
            out += [text[upto if upto > at else at : a], f"[{KINDS[kind].upper()}]"]
            at = upto = b
        else:
            at = upto = max(upto, b)
    return "".join(out) + text[at:]


def _found_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text in batch.column(1):
            base, every = find_all(text.as_py())
            counts = [sum(k == kind for _, k, _ in base) for kind in range(4)]
            rows.append((*counts, hashlib.sha256(join_spans(base).encode()).hexdigest(), join_spans(every)))
        cols = list(zip(*rows, strict=True)) or [()] * 6
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in cols[:4]], *[pa.array(c, pa.string()) for c in cols[4:]]], names=["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"])


def find_pii(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) per row.

    The counts and base_sha256 are of the plain spans, ``spans`` lists those and the
    disguised ones as kind:start:end in code points, by start, then kind.  A null
    text counts as empty; rows are treated one by one, so repeated rows and null
    ids come back as they are; an empty table gives an empty result.
    """
    schema = T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType), *[T.StructField(f"n_{k}", T.LongType()) for k in KINDS], T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())])
    return docs.select(doc_id, text).mapInArrow(_found_batches, schema)


def redact(docs: DataFrame, text: str = "text", n_chars: str | None = "n_chars") -> DataFrame:
    """``docs`` with personal data in ``text`` replaced by [EMAIL], [IP], [CARD] or [PHONE]; ``n_chars``, if there, is counted anew."""
    at = docs.columns.index(text)
    where_n = docs.columns.index(n_chars) if n_chars in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [batch.column(i) for i in range(batch.num_columns)]
            new = [redact_text(x.as_py()) for x in cols[at]]
            changed = [x.as_py() != y for x, y in zip(cols[at], new, strict=True)]
            if where_n is not None and any(changed):
                cols[where_n] = pa.array([len(y) if c else x.as_py() for x, y, c in zip(cols[where_n], new, changed, strict=True)], cols[where_n].type)
            cols[at] = pa.array(new, pa.string())
            yield pa.RecordBatch.from_arrays(cols, names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)
