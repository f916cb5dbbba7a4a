"""Arithmetic in GF(2^8) with the polynomial 0x11d, as numpy tables, and in other widths by shifts."""

from __future__ import annotations

from functools import cache

import numpy as np

# fixed values: the polynomial of each word width
POLYNOMIALS = {4: 0x13, 8: 0x11D, 16: 0x1100B, 32: 0x100400007}
POLYNOMIAL = POLYNOMIALS[8]


def product(a: int, b: int, width: int = 8) -> int:
    """In GF(2^width)."""
    out, top, polynomial = 0, 1 << (width - 1), POLYNOMIALS[width]
    while b:
        if b & 1:
            out ^= a
        a, b = (a << 1) ^ (polynomial if a & top else 0), b >> 1
    return out


def power(a: int, n: int, width: int = 8) -> int:
    out = 1
    while n:
        if n & 1:
            out = product(out, a, width)
        a, n = product(a, a, width), n >> 1
    return out


def inverse_in(a: int, width: int) -> int:
    """The nonzero elements form a group of 2^width - 1, so a^(2^width - 2) is a's inverse."""
    if not a:
        raise ZeroDivisionError("0 has no inverse")
    return power(a, (1 << width) - 2, width)


def region_in(coefficient: int, data: bytes, width: int) -> bytes:
    """Every little-endian word of ``data`` times the coefficient; words of 4 bits are the halves of a byte.

    A product is linear over xor, so a byte of each word at a time is looked up in a
    table of what it contributes.
    """
    if width == 4:
        table = np.array([product(coefficient, b & 15, 4) | product(coefficient, b >> 4, 4) << 4 for b in range(256)], np.uint8)
        return table[np.frombuffer(data, np.uint8)].tobytes()
    size = width // 8
    words = np.frombuffer(data, np.uint8).reshape(-1, size)
    out = np.zeros(len(words), f"<u{size}")
    for k in range(size):
        out ^= np.array([product(coefficient, b << 8 * k, width) for b in range(256)], f"<u{size}")[words[:, k]]
    return out.tobytes()


def extract_word(data: bytes, width: int, index: int) -> int:
    """The word at ``index`` of a region; of 4-bit words the lower half of a byte comes first."""
    if width == 4:
        return data[index // 2] >> 4 * (index % 2) & 15
    size = width // 8
    return int.from_bytes(data[index * size : (index + 1) * size], "little")


@cache
def table() -> np.ndarray:
    return np.array([[product(a, b) for b in range(256)] for a in range(256)], np.uint8)


def inverse(a: int) -> int:
    if not a:
        raise ZeroDivisionError("0 has no inverse")
    return int(np.flatnonzero(table()[a] == 1)[0])


def divide(a: int, b: int) -> int:
    return int(table()[a, inverse(b)])


def region(coefficient: int, data: np.ndarray) -> np.ndarray:
    return data if coefficient == 1 else table()[coefficient][data]


def combine(row: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """Sum over j of row[j] * blocks[j]."""
    out = np.zeros(blocks.shape[1], np.uint8)
    for c, block in zip(row, blocks, strict=True):
        if c:
            out ^= region(int(c), block)
    return out


def matmul(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_xor.reduce(table()[a[:, :, None], b[None, :, :]], axis=1)


def invert(matrix: np.ndarray) -> np.ndarray | None:
    """By elimination on [matrix | identity]; None if singular."""
    n = len(matrix)
    work = np.hstack([matrix.astype(np.uint8), np.eye(n, dtype=np.uint8)])
    for col in range(n):
        pivots = np.flatnonzero(work[col:, col])
        if not len(pivots):
            return None
        swap = col + int(pivots[0])
        work[[col, swap]] = work[[swap, col]]
        work[col] = table()[inverse(int(work[col, col]))][work[col]]
        for other in np.flatnonzero(work[:, col]):
            if other != col:
                work[other] ^= table()[int(work[other, col])][work[col]]
    return work[:, n:]


def cauchy(rows: int, cols: int, shift: int) -> np.ndarray:
    """Entries 1 / (i + (shift + j))."""
    return np.array([[inverse(i ^ (shift + j)) for j in range(cols)] for i in range(rows)], np.uint8)


def cauchy_of(x: list[int], y: list[int]) -> np.ndarray:
    """Entries 1 / (x + y) for two lists of elements, all distinct."""
    if len({*x, *y}) < len(x) + len(y):
        raise ValueError("the elements must be distinct")
    return np.array([[inverse(a ^ b) for b in y] for a in x], np.uint8)


@cache
def bit_ones(a: int) -> int:
    """Ones in the 8 x 8 bit matrix of a product with a: what a bitwise encoder has to add up."""
    return sum(product(a, 1 << i).bit_count() for i in range(8))


def improved(matrix: np.ndarray) -> np.ndarray:
    """The same code with fewer ones: columns are divided so that the first row is all 1, then each row by the element of it that leaves the fewest ones.

    Every square part stays invertible, as rows and columns are only scaled.
    """
    out = np.array([[divide(int(v), int(top)) for v, top in zip(row, matrix[0], strict=True)] for row in matrix], np.uint8)
    for i in range(1, len(out)):
        scaled = [[divide(int(v), int(d)) for v in out[i]] for d in {*out[i].tolist()}]
        out[i] = min([out[i].tolist(), *scaled], key=lambda row: (sum(map(bit_ones, row)), row))
    return out


def good(rows: int, cols: int) -> np.ndarray:
    """A matrix with few ones.  Two rows: all 1 over the cols cheapest elements (any distinct ones will do); else an improved Cauchy matrix."""
    if rows == 2 and cols < 256:
        cheap = sorted(range(1, 256), key=lambda a: (bit_ones(a), a))[:cols]
        return np.array([[1] * cols, cheap], np.uint8)
    return improved(cauchy(rows, cols, rows))


@cache
def systematic(n: int, m: int) -> np.ndarray:
    """n x (n - m): the identity over Cauchy rows."""
    return np.vstack([np.eye(n - m, dtype=np.uint8), cauchy(m, n - m, m)])


@cache
def dispersal(n: int, m: int) -> np.ndarray:
    """n x (n - m), Cauchy throughout."""
    return cauchy(n, n - m, n)


@cache
def decoding(n: int, m: int, ids: tuple[int, ...], whole: bool) -> np.ndarray:
    """Inverse of the rows of the shares at hand; ``whole``: of the dispersal matrix."""
    out = invert((dispersal(n, m) if whole else systematic(n, m))[list(ids)])
    if out is None:
        raise ValueError(f"shares {ids} don't rebuild")
    return out
