"""Elias-Fano code of an ascending sequence of whole numbers.

With n numbers below u, the low log2(u / n) bits of each are stored as they
are; the rest of number i is a one at place (number >> low bits) + i of a bit
vector.  This takes about 2 + log2(u / n) bits a number.  ``select`` finds the
i-th one from counts per block of ``BLOCK`` bits, and so any number alone.

Bytes: n, low bits and upper bits (8 bytes each), the low bits, the upper bits,
and a 4-byte count of ones before each block, all little-endian; bits run from
the lowest of each byte.
"""

from __future__ import annotations

import numpy as np

#: Bits of the upper vector between two counts.
BLOCK = 512


def _to_bits(values: np.ndarray, width: int) -> np.ndarray:
    shifted = values[:, None] >> np.arange(width, dtype=np.uint64)
    return np.packbits((shifted & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")


def encode(values: np.ndarray) -> bytes:
    values = np.asarray(values, np.uint64)
    n = len(values)
    if n and (np.diff(values.astype(np.int64)) < 0).any():
        raise ValueError("the numbers have to ascend")
    most = int(values[-1]) + 1 if n else 0
    width = max(0, (most // n).bit_length() - 1) if n else 0
    low = values & np.uint64((1 << width) - 1)
    ones = (values >> np.uint64(width)).astype(np.int64) + np.arange(n)
    size = int(ones[-1]) + 1 if n else 0
    upper = np.zeros(-(-size // BLOCK) * BLOCK, np.uint8)
    upper[ones] = 1
    before = np.concatenate(([0], np.cumsum(upper.reshape(-1, BLOCK).sum(axis=1, dtype=np.int64))))[:-1].astype("<u4")
    packed = _to_bits(low, width) if width else np.zeros(0, np.uint8)
    head = np.array([n, width, len(upper)], "<i8")
    return head.tobytes() + packed.tobytes() + np.packbits(upper, bitorder="little").tobytes() + before.tobytes()


class Sequence:
    """Reads numbers of an encoded sequence by place."""

    def __init__(self, data: bytes, at: int = 0):
        self.n, self.width, size = np.frombuffer(data, "<i8", 3, at).tolist()
        at += 24
        low = -(-self.n * self.width // 8)
        self.low = np.frombuffer(data, np.uint8, low, at)
        self.upper = np.frombuffer(data, np.uint8, size // 8, at + low)
        self.before = np.frombuffer(data, "<u4", size // BLOCK, at + low + size // 8)
        self.end = at + low + size // 8 + 4 * (size // BLOCK)

    def _low(self, places: np.ndarray) -> np.ndarray:
        out = np.zeros(len(places), np.int64)
        for bit in range(self.width):
            at = places * self.width + bit
            out |= ((self.low[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(np.int64) << bit
        return out

    def select(self, places: np.ndarray) -> np.ndarray:
        """The numbers at ``places``."""
        places = np.asarray(places, np.int64)
        if len(places) and (places.min() < 0 or places.max() >= self.n):
            raise IndexError("no such place")
        block = np.searchsorted(self.before, places, side="right") - 1
        ones = np.empty(len(places), np.int64)
        for b in np.unique(block):
            bits = np.unpackbits(self.upper[b * BLOCK // 8 : (b + 1) * BLOCK // 8], bitorder="little")
            here = block == b
            ones[here] = b * BLOCK + np.flatnonzero(bits)[places[here] - int(self.before[b])]
        return (ones - places) << self.width | self._low(places)

    def all(self) -> np.ndarray:
        """All numbers in order."""
        places = np.arange(self.n)
        ones = np.flatnonzero(np.unpackbits(self.upper, bitorder="little"))
        return (ones - places) << self.width | self._low(places)
