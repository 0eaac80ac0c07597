"""Periodic runs of words by internal pattern matching.

Per text: for every length m = 8, 16, 32, ... the blocks at multiples of m are
looked up in the window that starts where they end and is as long as they are
(for m = 8 also in the window right behind their start).  A block's
occurrences are an interval of the suffix array; which of them lie in a
window, the first, second and last one, comes from range successor queries on
a wavelet matrix over the suffix array.  Three or more occurrences form an
arithmetic progression whose step is the block's own period.  One or two
occurrences give their distances as candidate periods; a progression gives
those at which the stretches of its step around both places end alike, on the
right or on the left.  Each candidate is extended both ways as far as its
period holds.

A run of smallest period q and at least max(24, 3q) words holds, for the
largest m up to max(q, 8), an aligned block whose copy q words on is inside the
run, too, so none is missed.

Only places whose next eight words occur twice in the same text take part, so
texts without repetition cost one sort.  Blocks are named by their rank among
equal halves; those of eight words by 64-bit hash.  All steps run on whole
arrays for a batch of texts; a text longer than a batch is one of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seepage.llm.words import mix, small_batches, text_bytes

#: Words of a run at least, and repeats of its period at least.
LEAST_WORDS, LEAST_REPEATS = 24, 3
#: Words of the shortest blocks; runs of at least three times this length hold one of them.
BASE = 8
_LEVEL = 3
_RUN = "struct<start:long,length:long,period:long>"


class WaveletMatrix:
    """Bit planes of a sequence of numbers below ``size``, with counts and range successors for many queries at once."""

    def __init__(self, values: np.ndarray, size: int):
        self.bits = max(1, int(size - 1).bit_length()) if size > 1 else 1
        self.n = len(values)
        self.zeros, self.ones = [], []
        now = values.astype(np.int64)
        for b in range(self.bits - 1, -1, -1):
            bit = (now >> b) & 1
            ones = np.zeros(self.n + 1, np.int64)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(self.n - int(ones[-1]))
            now = np.concatenate((now[bit == 0], now[bit == 1]))

    def less(self, left: np.ndarray, right: np.ndarray, than: np.ndarray) -> np.ndarray:
        """How many of ``values[left:right]`` are below ``than``."""
        beyond = than >= 1 << self.bits
        l, r, found = left.copy(), right.copy(), np.zeros(len(left), np.int64)
        for plane, b in enumerate(range(self.bits - 1, -1, -1)):
            ones, zeros = self.ones[plane], self.zeros[plane]
            l1, r1 = ones[l], ones[r]
            high = (than >> b & 1) == 1
            found += np.where(high, (r - l) - (r1 - l1), 0)
            l, r = np.where(high, zeros + l1, l - l1), np.where(high, zeros + r1, r - r1)
        return np.where(beyond, right - left, found)

    def nth(self, left: np.ndarray, right: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The ``place``-th smallest of ``values[left:right]``, from 0."""
        l, r, k, found = left.copy(), right.copy(), place.copy(), np.zeros(len(left), np.int64)
        for plane, b in enumerate(range(self.bits - 1, -1, -1)):
            ones, zeros = self.ones[plane], self.zeros[plane]
            l1, r1 = ones[l], ones[r]
            low = (r - l) - (r1 - l1)
            high = k >= low
            found |= np.where(high, 1 << b, 0)
            k = np.where(high, k - low, k)
            l, r = np.where(high, zeros + l1, l - l1), np.where(high, zeros + r1, r - r1)
        return found


class Blocks:
    """Names of repeated blocks of 8, 16, ... words, their suffix array intervals, and common extensions."""

    def __init__(self, ids: np.ndarray, offsets: np.ndarray):
        self.ids = ids
        sizes = np.diff(offsets)
        row = np.repeat(np.arange(len(sizes)), sizes)
        self.start, self.end = offsets[:-1][row], offsets[1:][row]
        n = len(ids)
        self.at = np.zeros(0, np.int64)
        if n < BASE:
            return
        # block hashes by doubling; a text's number is part of them, so copies in other texts don't count
        hashes = mix((ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) + row.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        for step in (1, 2, 4):
            hashes = mix(hashes[:-step] * np.uint64(0xA0761D6478BD642F) + hashes[step:])
        whole = np.flatnonzero(np.arange(len(hashes)) + BASE <= self.end[: len(hashes)])
        hashes = hashes[whole]
        order = np.argsort(hashes)
        ranked = hashes[order]
        same = ranked[1:] == ranked[:-1]
        twice = np.concatenate(([False], same)) | np.concatenate((same, [False]))
        # places that have a copy, in text order, and their first names
        keep = order[twice]
        ranked = ranked[twice]
        self.at = np.sort(whole[keep])
        m = len(self.at)
        if not m:
            return
        self.place = np.full(n + 1, -1, np.int32)
        self.place[self.at] = np.arange(m, dtype=np.int32)
        name = np.zeros(m, np.int64)
        name[self.place[whole[keep]]] = np.searchsorted(ranked, ranked)
        self.names = [name.astype(np.int32)]
        self.queries: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []
        size = np.bincount(name, minlength=m + 1)
        block = BASE
        while True:
            open_ = np.flatnonzero(size[name] > 1)
            if not len(open_):
                break
            aligned = open_[(self.at[open_] - self.start[self.at[open_]]) % block == 0]
            self.queries.append((block, self.at[aligned], name[aligned], name[aligned] + size[name[aligned]]))
            further = np.minimum(self.at[open_] + block, n)
            inside = (further < self.end[self.at[open_]]) & (self.place[further] >= 0)
            # a second half without a copy makes the whole block one without a copy
            second = np.where(inside, name[np.maximum(self.place[further], 0)], -1 - open_)
            order = np.lexsort((second, name[open_]))
            first, then = name[open_][order], second[order]
            fresh = np.concatenate(([True], first[1:] != first[:-1]))
            changed = fresh | np.concatenate(([True], then[1:] != then[:-1]))
            # a group's name is the place of its first member in the suffix array
            base = np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))
            head = np.maximum.accumulate(np.where(changed, np.arange(len(order)), 0))
            name = name.copy()
            name[open_[order]] = first + head - base
            size = np.bincount(name, minlength=m + 1)
            self.names.append(name.astype(np.int32))
            block *= 2
        suffixes = np.empty(m, np.int64)
        suffixes[name] = np.arange(m)
        self.wavelet = WaveletMatrix(suffixes, m)

    def _named(self, level: int, at: np.ndarray) -> np.ndarray:
        place = np.where((at >= 0) & (at < len(self.ids)), self.place[np.clip(at, 0, len(self.ids))], -1)
        return np.where(place >= 0, self.names[level][np.maximum(place, 0)], -1)

    def right(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words from ``a`` and from ``b`` (of the same text, a < b) are equal."""
        stop, a, b, total = self.end[np.minimum(a, len(self.ids) - 1)], a.copy(), b.copy(), np.zeros(len(a), np.int64)
        for level in range(len(self.names) - 1, -1, -1):
            one, two = self._named(level, a), self._named(level, b)
            step = np.where((one >= 0) & (one == two) & (b < stop), BASE << level, 0)
            a, b, total = a + step, b + step, total + step
        going = np.ones(len(a), bool)
        last = len(self.ids) - 1
        for _ in range(BASE):
            going &= (b < stop) & (self.ids[np.minimum(a, last)] == self.ids[np.minimum(b, last)])
            a, b, total = a + going, b + going, total + going
        return total

    def left(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words before ``a`` and before ``b`` (of the same text, a < b) are equal."""
        stop, a, b, total = self.start[np.minimum(a, len(self.ids) - 1)], a.copy(), b.copy(), np.zeros(len(a), np.int64)
        for level in range(len(self.names) - 1, -1, -1):
            size = BASE << level
            one, two = self._named(level, np.where(a - size >= stop, a - size, -1)), self._named(level, b - size)
            step = np.where((one >= 0) & (one == two), size, 0)
            a, b, total = a - step, b - step, total + step
        going = np.ones(len(a), bool)
        for _ in range(BASE):
            going &= (a > stop) & (self.ids[np.maximum(a - 1, 0)] == self.ids[np.maximum(b - 1, 0)])
            a, b, total = a - going, b - going, total + going
        return total

    def _window(self, at: np.ndarray, left: np.ndarray, right: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, ...]:
        """(how many, first, second, last) occurrences from ``start`` up to ``stop``; -1 where there is none."""
        before = self.wavelet.less(left, right, np.searchsorted(self.at, start))
        upto = self.wavelet.less(left, right, np.searchsorted(self.at, stop))
        n = upto - before
        out = []
        for place, there in ((before, n > 0), (before + 1, n > 1), (upto - 1, n > 0)):
            found = np.full(len(at), -1, np.int64)
            if there.any():
                found[there] = self.at[self.wavelet.nth(left[there], right[there], place[there])]
            out.append(found)
        return n, *out

    def candidates(self) -> tuple[np.ndarray, np.ndarray]:
        """(place, period) pairs, each with a block at the place and a copy one period on."""
        places, periods = [], []
        for block, at, left, right in self.queries if len(self.at) else []:
            if block == BASE:
                # a period below eight is the distance of the first copy
                n, first, _, _ = self._window(at, left, right, at + 1, np.minimum(at + BASE, self.end[at]))
                places.append(at[n > 0])
                periods.append((first - at)[n > 0])
            n, first, second, last = self._window(at, left, right, at + block, np.minimum(at + 2 * block, self.end[at]))
            for some, found in ((n > 0, first), (n > 1, last)):
                places.append(at[some])
                periods.append((found - at)[some])
            many = n > 2
            if many.any():
                here, there, step = at[many], first[many], (second - first)[many]
                ends = there + self.right(there, there + step) - here - self.right(here, here + step)
                starts = there - self.left(there, there + step) - here + self.left(here, here + step)
                for found in (ends, starts):
                    fits = (found >= block) & (found < 2 * block) & (here + found < self.end[here])
                    places.append(here[fits])
                    periods.append(found[fits])
        empty = np.zeros(0, np.int64)
        return (np.concatenate(places), np.concatenate(periods)) if places else (empty, empty)


def runs(ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all runs in the texts whose words are ``ids[offsets[i]:offsets[i + 1]]``, by start, then period."""
    blocks = Blocks(ids, offsets)
    at, period = blocks.candidates()
    if not len(at):
        return at, at, period
    start, end = at - blocks.left(at, at + period), at + period + blocks.right(at, at + period)
    long_enough = end - start >= np.maximum(LEAST_WORDS, LEAST_REPEATS * period)
    start, end, period = start[long_enough], end[long_enough], period[long_enough]
    # the smallest period of each stretch; larger ones of the same stretch are its multiples
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    first = np.ones(len(start), bool)
    first[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, period = start[first], end[first], period[first]
    order = np.lexsort((period, start))
    return start[order], end[order], period[order]


def _collapsed(words: list[bytes], start: list[int], end: list[int], period: list[int]) -> bytes:
    """The words that no run holds after its first period."""
    covered = np.zeros(len(words) + 1, np.int64)
    for s, e, q in zip(start, end, period):
        covered[s + q] += 1
        covered[e] -= 1
    kept = np.cumsum(covered)[:-1] == 0
    return b" ".join([w for w, k in zip(words, kept.tolist()) if k])


def periodic(docs: DataFrame) -> DataFrame:
    """(doc_id, runs, collapsed) per row of ``docs`` (doc_id, text).

    ``runs`` holds (start, length, period) of every longest stretch of words
    with smallest period q and at least max(24, 3q) words, by start, then
    period.  Words are separated by blanks and the characters 9 to 13 and
    compared as they are; places count from 0.  ``collapsed`` has the words
    that no run holds after its first period, one blank between them.

    A null or empty text has no runs and an empty ``collapsed``.  Rows are
    judged one by one: repeated rows and null ids stay.  No row leaves its
    task; memory follows the longest text.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            data, places = text_bytes(batch.column("text"))
            whole = data.tobytes()
            texts = [whole[a:b].split() for a, b in zip(places[:-1].tolist(), places[1:].tolist())]
            offsets = np.cumsum([0, *map(len, texts)])
            known: dict[bytes, int] = {}
            number = count()
            # any number that is the same for the same word
            ids = np.fromiter((known.setdefault(w, i) for words in texts for w, i in zip(words, number)), np.int64, int(offsets[-1]))
            start, end, period = runs(ids, offsets)
            row = np.searchsorted(offsets, start, side="right") - 1
            bounds = np.searchsorted(row, np.arange(len(texts) + 1))
            first = offsets[row]
            found = list(zip((start - first).tolist(), (end - start).tolist(), period.tolist()))
            collapsed = []
            for words, a, b, base in zip(texts, bounds[:-1].tolist(), bounds[1:].tolist(), offsets.tolist()):
                collapsed.append(_collapsed(words, (start[a:b] - base).tolist(), (end[a:b] - base).tolist(), period[a:b].tolist()) if a < b else b" ".join(words))
            lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.StructArray.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in range(3)], ["start", "length", "period"]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists, pa.array(collapsed, pa.binary()).cast(pa.string())], ["doc_id", "runs", "collapsed"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, f"doc_id long, runs array<{_RUN}>, collapsed string")


def strongest(found: Column) -> Column:
    """The run with the greatest length by period; ties go to the smallest start, then period.  Null without a run."""
    def better(a: Column, b: Column) -> Column:
        ahead = a["length"] * b["period"] - b["length"] * a["period"]
        earlier = F.when(a["start"] != b["start"], a["start"] < b["start"]).otherwise(a["period"] < b["period"])
        return (ahead > 0) | ((ahead == 0) & earlier)

    return F.reduce(found, F.lit(None).cast(_RUN), lambda best, r: F.when(best.isNull() | better(r, best), r).otherwise(best))


def words_of(text: Column) -> Column:
    """Words of a text; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def repeated_tail(words: Column, first: Column, period: Column) -> Column:
    """A text of ``words``, those from ``first`` on replaced by repeats of the ``period`` words that start there."""
    tail = F.transform(F.sequence(F.lit(0), F.size(words) - 1 - first), lambda i: F.get(words, first + i % period))
    return F.array_join(F.concat(F.slice(words, F.lit(1), first), tail), " ")
