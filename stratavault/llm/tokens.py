"""Token ids of a public word-end BPE vocabulary, words at a time."""

from __future__ import annotations

import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

VOCABULARY = "word_bpe_49k.json"
END_ID = 1

#: Lower-case Latin letters whose NFC form is certain, or ASCII punctuation but the apostrophe: one piece for the model.
_SIMPLE = re.compile(r"[a-zß-öø-įı-ž]+|[!-&(-/:-@\[-`{-~]+")
#: Punctuation right behind a letter always starts a piece of its own, so a blank between them changes no ids.
_SEAM = r"(\p{L})([!-&(-/:-@\[-`{-~])"
#: Bytes that the known words may take, about; beyond, all are forgotten.
KNOWN_BYTES = 48 << 20
PART = 4 << 20


def default_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordTokenizer:
    """Gives exactly the ids of the tokenizer file for whole texts.

    The vocabulary's pieces never cross ASCII blanks, so texts are split there, each
    distinct word of a part is looked up once and the texts are put together from the
    words' ids.  ASCII capitals are lowered and punctuation is set apart before the
    split, both of which the tokenizer does anyway, so that far fewer words are
    distinct; texts with the mark of special tokens are left as they are.  Simple
    words go to the BPE model itself, all others through the whole tokenizer.  What
    is known of words is kept between parts, KNOWN_BYTES at most.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path)
        self.model = self.full.model
        self.byte_char = self._byte_chars()
        self.known: dict[str, bytes] = {}  # the ids as 32-bit integers
        self.held = 0

    @staticmethod
    def _byte_chars() -> dict[int, str]:
        """The printable character that stands for each byte in byte-level vocabularies: itself, or the next free one from U+0100 on."""
        own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
        free = iter(range(0x100, 0x200))
        return {b: chr(b) if b in own else chr(next(free)) for b in range(256)}

    def greatest_id(self) -> int:
        return max(self.full.get_vocab(with_added_tokens=True).values(), default=0)

    def _ids(self, word: str) -> list[int]:
        if not word:
            return []
        if not _SIMPLE.fullmatch(word):
            return self.full.encode(word, add_special_tokens=False).ids
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(self.byte_char)
        return [t.id for t in self.model.tokenize(word)]

    def _table(self, words: list[str]) -> pa.ListArray:
        """The ids of each word."""
        known = self.known
        got = list(map(known.get, words))
        for i in [i for i, ids in enumerate(got) if ids is None]:
            ids = got[i] = array("I", self._ids(words[i])).tobytes()
            if len(words[i]) <= 64:
                known[words[i]] = ids
                self.held += 200 + len(words[i]) + len(ids)
        if self.held > KNOWN_BYTES:
            known.clear()
            self.held = 0
        offsets = np.cumsum([0, *map(len, got)], dtype=np.int32) >> 2
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(got), np.uint32)))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, offsets): the ids of text i are ids[offsets[i] : offsets[i + 1]]; a null text has none.

        Texts are taken PART bytes at a time, which bounds the words at hand.
        """
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
        parts = np.searchsorted(np.cumsum(sizes), np.arange(0, max(1, sizes.sum()), PART)[1:])
        parts = [0, *sorted({int(x) for x in parts} - {0}), len(texts)]
        got = [self._encode(texts.slice(a, b - a)) for a, b in zip(parts[:-1], parts[1:], strict=True) if b > a or len(texts) == 0]
        ids = np.concatenate([g[0] for g in got]) if got else np.empty(0, np.uint32)
        counts = np.concatenate([np.diff(g[1]) for g in got]) if got else np.empty(0, np.int64)
        return ids, np.concatenate([[0], np.cumsum(counts)])

    def _encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        # in this order: lowering a slice of an array whose offsets don't begin at 0 garbles it
        plain = pc.ascii_lower(pc.replace_substring_regex(texts, _SEAM, r"\1 \2"))
        special = pc.match_substring(texts, "<|").to_numpy(zero_copy_only=False)
        if special.any():
            plain = pa.array([(t if s else p).as_py() for s, t, p in zip(special, texts, plain, strict=True)], pa.large_string())
        split = pc.ascii_split_whitespace(plain)
        words = split.flatten().dictionary_encode()
        taken = self._table(words.dictionary.to_pylist()).take(words.indices)
        ends = taken.offsets.to_numpy().astype(np.int64)
        offsets = split.offsets.to_numpy().astype(np.int64)
        return taken.flatten().to_numpy(), (ends - ends[0])[offsets - offsets[0]]


_LOADED: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """One per process."""
    if path not in _LOADED:
        _LOADED[path] = WordTokenizer(path)
    return _LOADED[path]


def document_ids(path: str, texts: pa.Array) -> list[np.ndarray]:
    """Per text its ids, then END_ID; a null text is an empty one."""
    ids, offsets = tokenizer(path).encode(texts)
    out = np.insert(ids, offsets[1:], END_ID).astype(np.uint32)
    bounds = offsets + np.arange(len(offsets))
    return [out[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
