"""Rolling hashes over the bytes of many texts at once, in numpy.

A stretch [a, b) of a buffer hashes to mix((P[b] - P[a]) * B**-a) with the prefix sums P of
(byte + 1) * B**i modulo 2**64 and an odd B: equal stretches have equal hashes wherever they stand.
"""

from __future__ import annotations

from functools import cache

import numpy as np

B = 0x9E3779B97F4A7C15
U = np.uint64
#: Space and the control characters tab to carriage return.
SPACES = np.zeros(256, bool)
SPACES[[32, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit words."""
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


@cache
def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, U)
    out[0] = 1
    return np.multiply.accumulate(out)


def powers(n: int, base: int = B) -> np.ndarray:
    """base**0 .. base**(n-1); kept by the next power of two."""
    return _powers(1 << max(16, (n - 1).bit_length()), base)[:n]


class Rolling:
    """Hashes of stretches of one buffer."""

    def __init__(self, data: np.ndarray):
        self.prefix = np.zeros(len(data) + 1, U)
        np.cumsum((data.astype(U) + U(1)) * powers(len(data)), out=self.prefix[1:])
        self.inverse = powers(len(data) + 1, pow(B, -1, 1 << 64))

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.prefix[end] - self.prefix[start]) * self.inverse[start])

    def every(self, size: int) -> np.ndarray:
        """The hash of each stretch of ``size`` bytes, by its start."""
        n = len(self.prefix) - size
        return mix((self.prefix[size:] - self.prefix[:-size]) * self.inverse[:n]) if n > 0 else np.zeros(0, U)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case, other bytes as they are."""
    return data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each word; words end at spaces and at the ends of rows."""
    inside = ~SPACES[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    first[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def shingles(data: np.ndarray, offsets: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of the distinct ``size``-word shingles of each row, sorted by row, then hash.

    A-Z count as lower case. A row of fewer words has the whole sequence as its one shingle; a row without words has none.
    """
    data = lower_ascii(data)
    start, end, row = words(data, offsets)
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, U)
    word = Rolling(data).of(start, end)
    n = np.bincount(row, minlength=len(offsets) - 1)
    begin = np.cumsum(n) - n
    left = (begin + n)[row] - np.arange(len(row))  # words from here to the end of the row
    keep = (left >= size) | ((np.arange(len(row)) == begin[row]) & (n[row] < size))
    at = np.flatnonzero(keep)
    mixed = np.zeros(len(at), U)
    for k in range(size):
        there = left[at] > k
        mixed = mixed * U(0x2545F4914F6CDD1D) + np.where(there, word[np.minimum(at + k, len(word) - 1)] | U(1), U(0))
    mixed, row = mix(mixed), row[at]
    order = np.argsort(row_key(row, mixed))
    mixed, row = mixed[order], row[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (mixed[1:] != mixed[:-1])
    return row[new], mixed[new]


def row_key(row: np.ndarray, code: np.ndarray) -> np.ndarray:
    """One word to sort by: the row (under 2**20), then the upper 44 bits of a hash."""
    return (row.astype(U) << U(44)) | (code >> U(20))
