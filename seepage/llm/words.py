"""Words of Arrow text columns as 64-bit hashes, a whole batch at a time.

A word's hash is a polynomial over its bytes modulo 2^64, read from running
sums, so that no Python string is made per word.  Only A-Z are lower-cased.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

#: Bytes hashed at once; a longer text is cut between words.
SPAN = 1 << 20

_SPACE = [0x20, *range(0x09, 0x0E)]
_BASE = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64: each bit of ``x`` reaches every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def distinct(x: np.ndarray) -> np.ndarray:
    """The different values of ``x``, ascending: by sorting, which is many times faster than the hash table of ``np.unique``."""
    x = np.sort(x)
    first = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=first[1:])
    return x[first]


@cache
def white_space() -> np.ndarray:
    """The separators of ``[^\\x20\\x09-\\x0D]+``."""
    out = np.zeros(256, bool)
    out[_SPACE] = True
    return out


@cache
def not_alphanumeric() -> np.ndarray:
    """All ASCII but letters and digits; bytes of other characters stay in words."""
    out = np.ones(256, bool)
    out[0x80:] = False
    out[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = False
    return out


@cache
def _byte_values() -> np.ndarray:
    low = np.arange(256, dtype=np.uint64)
    low[0x41:0x5B] += np.uint64(32)
    return mix((low + np.uint64(1)) * np.uint64(_BASE))


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(_BASE, -1, 1 << 64)
    factors = np.ones((2, n + 1), np.uint64)
    factors[:, 1:] = np.array([[_BASE], [inverse]], np.uint64)
    return tuple(np.cumprod(factors, axis=1, dtype=np.uint64))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a text column and the place where each row starts; null is empty."""
    texts = column.cast(pa.large_string()).fill_null("")
    _, places, data = texts.buffers()
    starts = np.frombuffer(places, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[starts[0] : starts[-1]], starts - starts[0]


def _spans(data: np.ndarray, separators: np.ndarray) -> Iterator[tuple[int, int]]:
    """Cut ``data`` where no word is cut; one word longer than a span stays whole."""
    start = 0
    while start < len(data):
        end = min(start + SPAN, len(data))
        if end < len(data):
            gaps = np.flatnonzero(separators[data[start:end]])
            while not len(gaps) and end < len(data):
                further = min(end + SPAN, len(data))
                gaps = np.flatnonzero(separators[data[end:further]]) + (end - start)
                end = further
            if len(gaps):
                end = start + int(gaps[-1]) + 1
        yield start, end
        start = end


class Words:
    """Words of the rows of a batch, in order."""

    def __init__(self, column: pa.Array, separators: np.ndarray | None = None, prefixes: tuple[int, ...] = ()):
        separators = white_space() if separators is None else separators
        data, rows = text_bytes(column)
        self.n_rows = len(rows) - 1
        first = np.zeros(len(data) + 1, bool)
        first[rows] = True
        hashes, heads, at = [], [[] for _ in prefixes], []
        for a, b in _spans(data, separators):
            span = data[a:b]
            inside = ~separators[span]
            breaks = first[a : b + 1]
            starts = np.flatnonzero(inside & (breaks[:-1] | ~np.concatenate(([False], inside[:-1]))))
            ends = np.flatnonzero(inside & (breaks[1:] | ~np.concatenate((inside[1:], [False])))) + 1
            if not len(starts):
                continue
            up, down = _powers(max(SPAN, 1 << (len(span) - 1).bit_length()))
            sums = np.zeros(len(span) + 1, np.uint64)
            np.cumsum(_byte_values()[span] * up[: len(span)], out=sums[1:])
            lengths = (ends - starts).astype(np.uint64)
            hashes.append(mix((sums[ends] - sums[starts]) * down[starts] + lengths))
            for out, width in zip(heads, prefixes):
                cut = np.minimum(starts + width, ends)
                head = mix((sums[cut] - sums[starts]) * down[starts] + np.uint64(1000 + width))
                out.append(np.where(ends - starts > width, head, np.uint64(0)))
            at.append(starts + a)
        empty = np.zeros(0, np.uint64)
        self.hashes = np.concatenate(hashes) if hashes else empty
        #: For each prefix length a hash per word, 0 where the word is not longer.
        self.heads = [np.concatenate(out) if out else empty for out in heads]
        places = np.concatenate(at) if at else np.zeros(0, np.int64)
        #: Words of row i are those from ``offsets[i]`` up to ``offsets[i + 1]``.
        self.offsets = np.searchsorted(places, rows)

    def row_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.n_rows), np.diff(self.offsets))


def small_batches(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most_bytes`` of text (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = batch.column(column).cast(pa.large_string()).fill_null("")
        _, places, _ = texts.buffers()
        ends = np.frombuffer(places, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        start = 0
        while start < batch.num_rows:
            end = max(start + 1, int(np.searchsorted(ends, ends[start] + most_bytes, side="right")) - 1)
            yield batch.slice(start, end - start)
            start = end


def shingle_sets(column: pa.Array, width: int) -> list[np.ndarray]:
    """Distinct hashes of ``width`` consecutive words per row, ascending.

    A row with fewer words gives one hash of them all, a row without words none.
    """
    return word_shingles(Words(column), width)


def word_shingles(words: Words, width: int) -> list[np.ndarray]:
    """``shingle_sets`` of words that are known already."""
    marked = mix(words.hashes + np.uint64(_BASE))
    n = len(marked)
    factors = mix(np.arange(1, width + 1, dtype=np.uint64) * np.uint64(_BASE)) | np.uint64(1)
    if n >= width:
        rolled = np.zeros(n - width + 1, np.uint64)
        for k in range(width):
            rolled += marked[k : n - width + 1 + k] * factors[k]
        rolled = mix(rolled)
    out = []
    for a, b in zip(words.offsets[:-1].tolist(), words.offsets[1:].tolist()):
        if b - a >= width:
            out.append(distinct(rolled[a : b - width + 1]))
        elif b > a:
            whole = (marked[a:b] * factors[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
            out.append(mix(np.array([whole], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
