"""Parameters of the store that change results, checked when they are made."""

from __future__ import annotations

from dataclasses import dataclass

# fixed values
MAX_SECRET = 64 << 10  # bytes that a codec takes at once
CACHE_SLOTS = 4  # containers that restore keeps at hand
CODECS = {"crsss": 0, "aont_rs": 1, "caont_rs_old": 2, "caont_rs": 3}
BUFFER_BYTES = 4 << 20  # of an upload batch and of a container
IDLE_SECONDS = 1800


@dataclass(frozen=True)
class Chunking:
    minimum: int = 2048
    average: int = 8192
    maximum: int = 16384
    window: int = 48
    read_buffer: int = 128 << 20

    def __post_init__(self):
        if not self.window <= self.minimum < self.average < self.maximum:
            raise ValueError("window <= minimum < average < maximum is needed")

    @property
    def mask(self) -> int:
        return (1 << (self.average.bit_length() - 1)) - 1


@dataclass(frozen=True)
class Coding:
    """n shares of which any n - m rebuild a secret; ``pair`` is high (AES-256, SHA-256) or low (AES-128, MD5)."""

    n: int = 4
    m: int = 1
    r: int = 2
    pair: str = "high"
    codec: str = "caont_rs"

    def __post_init__(self):
        if self.codec not in CODECS or self.pair not in ("high", "low"):
            raise ValueError("unknown codec or pair")
        if not (self.n > 0 and 0 < self.m < self.n and self.k > 1):
            raise ValueError("0 < m < n and n - m > 1 are needed")
        if self.codec == "crsss" and not 0 < self.r < self.k:
            raise ValueError("0 < r < k is needed")

    @property
    def k(self) -> int:
        return self.n - self.m

    @property
    def sizes(self) -> tuple[int, int, int]:
        """Bytes of the pair's hash, its key and a cipher block."""
        return self.word, self.word, 16

    @property
    def word(self) -> int:
        """Bytes of a hash, which is also the key."""
        return 32 if self.pair == "high" else 16
