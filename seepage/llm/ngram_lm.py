"""Language model over a log-frequency Bloom filter.

N-grams of the training texts are counted, and each goes into a Bloom filter
once per level 1, 2, ... up to 1 + floor(log2(count)).  A count is read back
by probing one level after the other until one is missing; it is then the mean
count of the training n-grams of that level.  Absent n-grams get a count only by
a false positive of all probes, and an n-gram never counts more often than the
shorter ones that it holds.  Counts of single tokens are exact.

Probabilities are interpolated from one token upwards: with c counts of the
context, (n-gram count + m * shorter probability) / (c + m), m = c^0.85.

The filter consists of segments by n-gram hash; their number follows the size
of the corpus, so a segment has a bounded size.  While vocabulary and segments
stay below ``HELD`` bytes, every worker loads all of them once from the shared
folder and texts are scored where they lie.  Above that, texts are cut into
blocks, the distinct n-grams of each block go to the segments, and the levels come
back to the block: the same numbers in bounded memory, whatever the corpus.  A
block asks ``1 << GROUP`` segments at once, so that there are few and long lists of
keys, and its texts are read again where they were written.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs, parquet
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seepage.llm.words import Words, distinct, mix, small_batches
from seepage.sources.checkpoint import fresh_folder, shuffles_dropped

#: Longest n-grams, exponent of the weight of shorter n-grams.
ORDER, WEIGHT = 3, 0.85
#: Hash functions of the first level, where an error invents an n-gram, and of the others, where it raises a count.
HASHES = 6, 4
#: What is added to the count of each token.
ADDED = 0.1
#: Bytes of vocabulary and filter that a worker may hold.
HELD = 320 << 20
#: N-gram tokens per segment, at most about this many; n-grams that a task counts before it hands them on.
SEGMENT, FLUSH = 1 << 20, 1 << 22
#: Bytes of text of a block that asks segments, power of two of the segments that it asks at once, and keys looked up at once.
BLOCK, GROUP, ASKED = 8 << 20, 5, 1 << 16
#: Bits of an n-gram's hash behind its segment, and of the segment at most.
_REST, _MOST = 40, 24
_LEVELS = 48
# numbers in place of word hashes
_START, _END = np.uint64(0x5EED0000000057A7), np.uint64(0x5EED00000000E4D5)
_ONE, _TWO = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)
_PART = "order int, segment int, keys binary, counts binary"
_KEPT = "order int, segment int, size long, data binary, counts binary, n array<long>, total array<long>"


class Sequences:
    """Texts as token hashes: a start, the lower-cased words, an end."""

    def __init__(self, column: pa.Array):
        words = Words(column)
        #: Text i is ``tokens[offsets[i]:offsets[i + 1]]``.
        self.offsets = words.offsets + 2 * np.arange(words.n_rows + 1)
        self.tokens = np.empty(int(self.offsets[-1]), np.uint64)
        inside = np.ones(len(self.tokens), bool)
        inside[self.offsets[:-1]] = inside[self.offsets[1:] - 1] = False
        self.tokens[self.offsets[:-1]], self.tokens[self.offsets[1:] - 1] = _START, _END
        self.tokens[inside] = words.hashes
        #: Place of each token in its text; the start has 0.
        self.depth = np.arange(len(self.tokens)) - np.repeat(self.offsets[:-1], np.diff(self.offsets))

    def n_grams(self, order: int, bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per length 1, ..., ``order``: places of the last tokens, and hashes (whole ones of tokens, else segment and rest)."""
        out = [(np.flatnonzero(self.depth > 0), self.tokens[self.depth > 0])]
        hashes = self.tokens
        for n in range(2, order + 1):
            hashes = np.concatenate((hashes[:1], mix(hashes[:-1] * _ONE + self.tokens[1:] * _TWO + np.uint64(n))))
            places = np.flatnonzero(self.depth >= n - 1)
            out.append((places, hashes[places] >> np.uint64(64 - bits - _REST)))
        return out


def _segments(keys: np.ndarray, order: int, bits: int) -> np.ndarray:
    return (keys >> np.uint64(64 - bits if order == 1 else _REST)).astype(np.int64) if bits or order > 1 else np.zeros(len(keys), np.int64)


def _cut(keys: np.ndarray, order: int, bits: int, group: int = 0) -> Iterator[tuple[int, slice]]:
    """(segment, its place in the ascending ``keys``), or groups of ``1 << group`` segments."""
    own = _segments(keys, order, bits) >> group
    starts = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1]))) if len(own) else []
    for a, b in zip(starts, [*starts[1:], len(own)]):
        yield int(own[a]), slice(int(a), int(b))


def _packed(keys: np.ndarray, order: int) -> bytes:
    if order == 1:
        return keys.tobytes()
    # the segment's bits are known
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : _REST // 8]).tobytes()


def _opened(data: bytes, order: int) -> np.ndarray:
    """Keys as packed, n-grams without the bits of their segment."""
    if order == 1:
        return np.frombuffer(data, np.uint64)
    out = np.zeros((len(data) * 8 // _REST, 8), np.uint8)
    out[:, : _REST // 8] = np.frombuffer(data, np.uint8).reshape(-1, _REST // 8)
    return out.view("<u8").ravel()


def _steps(keys: np.ndarray) -> bytes:
    """Ascending distinct keys: the first, the width of the differences, and these with all lowest bytes first."""
    steps = np.diff(keys)
    width = max(1, -(-int(steps.max(initial=0)).bit_length() // 8))
    return keys[:1].tobytes() + bytes([width]) + np.ascontiguousarray(steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _keys(data: bytes) -> np.ndarray:
    """Keys of ``_steps``."""
    width, rest = data[8], np.frombuffer(data, np.uint8)[9:]
    steps = np.zeros((len(rest) // width, 8), np.uint8)
    steps[:, :width] = rest.reshape(width, -1).T
    return np.cumsum(np.concatenate((np.frombuffer(data, np.uint64, 1), steps.view("<u8").ravel())), dtype=np.uint64)


def _hashed(keys: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each key at one level; all hash functions are sums of them."""
    first = mix(keys + np.uint64(level * int(_ONE) & (1 << 64) - 1))
    return first, mix(first + _TWO) | np.uint64(1)


def _bit(first: np.ndarray, second: np.ndarray, i: int, size: np.ndarray | int) -> np.ndarray:
    """Place of a key by its hash function ``i`` in a filter of ``size`` bits, less than 2^32."""
    return ((first + np.uint64(i) * second >> np.uint64(32)) * np.asarray(size, np.uint64) >> np.uint64(32)).astype(np.int64)


def levels_of(counts: np.ndarray) -> np.ndarray:
    """1 + floor(log2(count))."""
    return np.frexp(counts.astype(np.float64))[1].astype(np.int64)


def bloom(keys: np.ndarray, counts: np.ndarray, hashes: tuple[int, int] = HASHES) -> tuple[int, bytes]:
    """(bits, packed bits) of a filter that holds each key once per level of its count."""
    levels = levels_of(counts)
    size = max(1 << 12, int(np.ceil((len(keys) * hashes[0] + (levels - 1).sum() * hashes[1]) / np.log(2))))
    flags = np.zeros(size, bool)
    for level in range(1, int(levels.max(initial=0)) + 1):
        first, second = _hashed(keys[levels >= level], level)
        for i in range(hashes[min(level, 2) - 1]):
            flags[_bit(first, second, i, size)] = True
    return size, np.packbits(flags, bitorder="little").tobytes()


def probe(bits: np.ndarray, base: np.ndarray | int, size: np.ndarray | int, keys: np.ndarray, hashes: tuple[int, int] = HASHES) -> np.ndarray:
    """Level of each key: the last one before the first that is missing; 0 if none is there.

    ``base`` (first bit) and ``size`` are one number or one per key.
    """
    found = np.zeros(len(keys), np.uint8)
    alive = np.arange(len(keys))
    base, size = np.broadcast_to(base, len(keys)), np.broadcast_to(np.asarray(size, np.uint64), len(keys))
    for level in range(1, _LEVELS):
        if not len(alive):
            break
        start, own, place = base[alive], size[alive], np.arange(len(alive))
        first, second = _hashed(keys[alive], level)
        for i in range(hashes[min(level, 2) - 1]):
            at = _bit(first[place], second[place], i, own[place]) + start[place]
            place = place[(bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1]
        alive = alive[place]
        found[alive] = level
    return found


@dataclass(frozen=True)
class Model:
    """What is known of the training texts; ``means[n]`` are counts by level of n-grams of that length."""

    folder: str
    kept: DataFrame
    order: int
    bits: int
    tokens: int
    distinct: int
    texts: int
    held: int
    means: tuple[tuple[float, ...], ...]

    def scorer(self) -> "Scorer":
        return Scorer(self.order, self.bits, self.tokens, self.distinct, self.texts, self.means)


@dataclass(frozen=True)
class Scorer:
    """The part of a model that every task gets."""

    order: int
    bits: int
    tokens: int
    distinct: int
    texts: int
    means: tuple[tuple[float, ...], ...]

    def score(self, texts: Sequences, grams: list[tuple[np.ndarray, np.ndarray]], counts: list[np.ndarray]) -> list[np.ndarray]:
        """(tokens, known tokens, base score, score) per text; ``counts``: per n-gram the exact count or the level."""
        n = len(texts.tokens)
        places = grams[0][0]
        own = np.zeros(n)
        own[places] = counts[0]
        shorter = np.zeros(n)
        shorter[places] = (own[places] + ADDED) / (self.tokens + ADDED * (self.distinct + 1))
        base = shorter.copy()
        # a start stands before as many tokens as there are training texts
        context = np.where(texts.depth == 0, float(self.texts), own)
        for order in range(2, self.order + 1):
            places = grams[order - 1][0]
            means = np.zeros(_LEVELS)
            means[: len(self.means[order])] = self.means[order]
            # never more often than the context and than the same n-gram without its first token
            before = context[places - 1]
            count = np.minimum(means[counts[order - 1]], np.minimum(before, own[places]))
            weight = np.maximum(before, 1) ** WEIGHT
            shorter[places] = (count + weight * shorter[places]) / (before + weight)
            own = np.zeros(n)
            own[places] = count
            context = own
        starts, tokens = texts.offsets[:-1], texts.depth > 0
        logs = [np.where(tokens, np.log10(np.where(tokens, p, 1)), 0.0) for p in (base, shorter)]
        known = np.zeros(n)
        known[grams[0][0]] = counts[0] > 0
        sums = [np.add.reduceat(x, starts) if len(starts) else np.zeros(0) for x in (known, *logs)]
        return [np.diff(texts.offsets) - 1, sums[0].astype(np.int64), sums[1], sums[2]]


def _counted(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and the sums of their counts."""
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def train(docs: DataFrame, order: int = ORDER) -> Model:
    """A model of ``docs`` (text): whole texts, null ones as empty; repeated rows count as often as they are there."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    # six bytes a word
    bits = min(_MOST, max(0, int(np.ceil(np.log2(max(1, size / 6 * max(1, order - 1) / SEGMENT))))))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a worker that trains drops the model that it scored with
        _whole.cache_clear()
        waiting: list[list[np.ndarray]] = [[] for _ in range(order)]
        total = 0

        def handed_on() -> Iterator[pa.RecordBatch]:
            for n in range(order):
                keys, counts = np.unique(np.concatenate(waiting[n]), return_counts=True)
                waiting[n] = []
                counts = counts.astype(np.uint32)
                rows = [(segment, _packed(keys[s], n + 1), counts[s].tobytes()) for segment, s in _cut(keys, n + 1, bits)]
                for i in range(0, len(rows), 64):
                    some = rows[i : i + 64]
                    yield pa.RecordBatch.from_arrays([
                        pa.array([n + 1] * len(some), pa.int32()), pa.array([r[0] for r in some], pa.int32()),
                        pa.array([r[1] for r in some], pa.binary()), pa.array([r[2] for r in some], pa.binary())], ["order", "segment", "keys", "counts"])

        for batch in small_batches(batches, "text"):
            for n, (_, keys) in enumerate(Sequences(batch.column("text")).n_grams(order, bits)):
                waiting[n].append(keys)
                total += len(keys)
            if total > FLUSH:
                yield from handed_on()
                total = 0
        if total:
            yield from handed_on()

    def merge(key: tuple, rows: pa.Table) -> pa.Table:
        n = key[0].as_py()
        keys = np.concatenate([_opened(k.as_py(), n) for k in rows.column("keys")])
        counts = np.concatenate([np.frombuffer(c.as_py(), np.uint32) for c in rows.column("counts")]).astype(np.int64)
        keys, counts = _counted(keys, counts)
        level = levels_of(counts)
        many, total = np.bincount(level, minlength=_LEVELS), np.bincount(level, counts.astype(np.float64), _LEVELS).astype(np.int64)
        bits_, data = bloom(keys, counts) if n > 1 else (len(keys), keys.tobytes())
        own = counts.tobytes() if n == 1 else None
        return pa.table([
            pa.array([n], pa.int32()), pa.array([key[1].as_py()], pa.int32()), pa.array([bits_], pa.int64()), pa.array([data], pa.binary()),
            pa.array([own], pa.binary()), pa.array([many.tolist()], pa.list_(pa.int64())), pa.array([total.tolist()], pa.list_(pa.int64()))],
            names=["order", "segment", "size", "data", "counts", "n", "total"])

    folder = fresh_folder(spark, "ngram-lm")
    with shuffles_dropped(spark):
        docs.select("text").mapInArrow(count, _PART).groupBy("order", "segment").applyInArrow(merge, _KEPT).write.parquet(folder)
    kept = spark.read.schema(_KEPT).parquet(folder)
    held = kept.agg(F.sum(F.octet_length("data") + F.coalesce(F.octet_length("counts"), F.lit(0))).alias("n")).first()["n"] or 0
    # one row per length and level
    levels = kept.select("order", F.posexplode("n").alias("level", "n"), "total").select("order", "level", "n", F.get("total", F.col("level")).alias("total"))
    sums = {(r["order"], r["level"]): (r["n"], r["total"]) for r in levels.groupBy("order", "level").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect()}
    means = [tuple(sums[n, v][1] / sums[n, v][0] if sums.get((n, v), (0, 0))[0] else 0.0 for v in range(_LEVELS)) for n in range(order + 1)]
    single = [sums[1, v] for v in range(_LEVELS) if (1, v) in sums]
    texts = docs.count()
    return Model(folder, kept, order, bits, sum(s[1] for s in single), sum(s[0] for s in single), texts, held, tuple(means))


def _files(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else "file://" + folder)


class _Whole:
    """All segments of a model in one worker, each byte of them once."""

    def __init__(self, folder: str, order: int, bits: int, most: int):
        store, base = _files(folder)
        files = sorted(f.path for f in store.get_file_info(fs.FileSelector(base)) if f.path.endswith(".parquet"))
        self.bits = bits
        self.start, self.size = np.zeros((order + 1, 1 << bits), np.int64), np.full((order + 1, 1 << bits), 64, np.uint64)
        words = np.zeros((1 << bits) + 1, np.int64)
        # segments that nothing fell into point at the empty first bytes
        filled = 8
        for row in self._rows(store, files, ["order", "segment", "size"]):
            if row["order"] == 1:
                words[row["segment"] + 1] = row["size"]
            else:
                self.start[row["order"], row["segment"]], self.size[row["order"], row["segment"]] = 8 * filled, row["size"]
                filled += -(-row["size"] // 8)
        words = np.cumsum(words)
        kind = np.uint32 if most < 1 << 32 else np.int64
        self.data, self.keys, self.counts = np.zeros(filled, np.uint8), np.zeros(words[-1], np.uint64), np.zeros(words[-1], kind)
        for row in self._rows(store, files, ["order", "segment", "data", "counts"]):
            n, segment = row["order"], row["segment"]
            if n == 1:
                self.keys[words[segment] : words[segment + 1]] = np.frombuffer(row["data"], np.uint64)
                self.counts[words[segment] : words[segment + 1]] = np.frombuffer(row["counts"], np.int64)
            else:
                first = self.start[n, segment] >> 3
                self.data[first : first + len(row["data"])] = np.frombuffer(row["data"], np.uint8)
        pa.default_memory_pool().release_unused()

    @staticmethod
    def _rows(store: fs.FileSystem, files: list[str], columns: list[str]) -> Iterator[dict]:
        for file in files:
            with store.open_input_file(file) as f:
                for batch in parquet.ParquetFile(f).iter_batches(1, columns=columns):
                    yield from batch.to_pylist()

    def find(self, order: int, keys: np.ndarray) -> np.ndarray:
        if order == 1:
            return looked_up(self.keys, self.counts, keys)
        segment = _segments(keys, order, self.bits)
        rest = keys & np.uint64((1 << _REST) - 1)
        return probe(self.data, self.start[order][segment], self.size[order][segment], rest)


@lru_cache(1)
def _whole(folder: str, order: int, bits: int, most: int) -> _Whole:
    """One per worker process, kept between its tasks; ``most`` bounds the counts."""
    return _Whole(folder, order, bits, most)


class _Group:
    """The segments that are asked at once: rows (segment, size, data, counts) in ascending order of segments."""

    def __init__(self, order: int, bits: int, rows: list[tuple[int, int, bytes, bytes | None]]):
        self.order, self.bits = order, bits
        self.data = np.frombuffer(b"".join(r[2] for r in rows), np.uint64 if order == 1 else np.uint8)
        if order == 1:
            self.counts = np.frombuffer(b"".join(r[3] for r in rows), np.int64)
            return
        # a segment that nothing fell into has 64 bits of its own, all clear
        self.start, self.size = np.full(1 << GROUP, 8 * len(self.data), np.int64), np.full(1 << GROUP, 64, np.uint64)
        at = 0
        for segment, size, data, _ in rows:
            self.start[segment & (1 << GROUP) - 1], self.size[segment & (1 << GROUP) - 1] = 8 * at, size
            at += len(data)
        self.data = np.concatenate((self.data, np.zeros(8, np.uint8)))

    def find(self, keys: np.ndarray) -> np.ndarray:
        if self.order == 1:
            return looked_up(self.data, self.counts, keys)
        own = _segments(keys, self.order, self.bits) & (1 << GROUP) - 1
        return probe(self.data, self.start[own], self.size[own], keys & np.uint64((1 << _REST) - 1))


def looked_up(known: np.ndarray, counts: np.ndarray, keys: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(keys), np.int64)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return np.where(known[at] == keys, counts[at], 0)


def _scored(doc_id: pa.Array, column: pa.Array, scorer: Scorer, find: Callable[[int, np.ndarray], np.ndarray]) -> pa.RecordBatch:
    texts = Sequences(column)
    grams, counts = texts.n_grams(scorer.order, scorer.bits), []
    for n, (_, keys) in enumerate(grams):
        different, place = np.unique(keys, return_inverse=True)
        counts.append(find(n + 1, different)[place])
    found = scorer.score(texts, grams, counts)
    return pa.RecordBatch.from_arrays([
        doc_id, *(pa.array(x, pa.int64()) for x in found[:2]), *(pa.array(x, pa.float64()) for x in found[2:])], ["doc_id", "n_tokens", "n_known", "base_score", "score"])


_SCORED = "doc_id long, n_tokens long, n_known long, base_score double, score double"


def score(docs: DataFrame, model: Model, held: int = HELD) -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score) per row of ``docs`` (doc_id, text).

    ``base_score`` adds the logarithms to base 10 of (c + 0.1) / (N + 0.1 *
    (V + 1)) over the tokens: the words, lower-cased from A to Z, and one end.
    ``score`` is the model's.  A null text is empty: its end alone.  A model of
    no texts gives every token the probability 1 / (V + 1) = 1.  Rows are
    scored one by one: repeated rows and null ids stay.  Words are compared by
    64-bit hash.
    """
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    if model.held > held:
        return _score_routed(rows, model)
    folder, scorer = model.folder, model.scorer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            own = _whole(folder, scorer.order, scorer.bits, scorer.tokens)
            yield _scored(batch.column("doc_id"), batch.column("text"), scorer, own.find)

    return rows.mapInArrow(run, _SCORED)


def _score_routed(rows: DataFrame, model: Model) -> DataFrame:
    """As above; distinct n-grams of blocks of texts travel to the segments, their levels and counts back."""
    scorer, spark = model.scorer(), rows.sparkSession
    kind = np.uint32 if scorer.tokens < 1 << 32 else np.int64

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        waiting: list[pa.RecordBatch] = []
        size = 0

        def handed_on() -> pa.RecordBatch:
            joined = pa.Table.from_batches(waiting).combine_chunks()
            lists = [pa.ListArray.from_arrays(pa.array([0, joined.num_rows], pa.int32()), pa.concat_arrays(joined.column(c).chunks).cast(t)) for c, t in (("doc_id", pa.int64()), ("text", pa.string()))]
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *lists], ["block", "doc_id", "text"])

        for batch in small_batches(batches, "text", BLOCK // 4):
            waiting.append(batch)
            # a start and an end of each text count, too
            size += (pc.sum(pc.binary_length(batch.column("text"))).as_py() or 0) + 12 * batch.num_rows
            if size >= BLOCK:
                yield handed_on()
                waiting, size, number = [], 0, number + 1
        if waiting:
            yield handed_on()

    folder = fresh_folder(spark, "lm-blocks")
    blocked = "block long, doc_id array<long>, text array<string>"
    # a row group for each block, so that it can be read alone
    single = {"parquet.block.size": 1 << 20, "parquet.block.size.row.check.min": 1, "parquet.block.size.row.check.max": 1, "parquet.page.size.row.check.min": 1}
    rows.mapInArrow(block, blocked).write.options(compression="zstd", **single).parquet(folder)
    blocks = spark.read.schema(blocked).parquet(folder)
    # one name per block
    names = {r["block"]: r["file_name"] for r in blocks.select("block", "_metadata.file_name").collect()}

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, texts in zip(batch.column("block").to_pylist(), batch.column("text")):
                for n, (_, keys) in enumerate(Sequences(texts.values).n_grams(scorer.order, scorer.bits)):
                    keys = distinct(keys)
                    cut = [(s, _steps(keys[own])) for s, own in _cut(keys, n + 1, scorer.bits, GROUP)]
                    yield pa.RecordBatch.from_arrays([
                        pa.array([n + 1] * len(cut), pa.int32()), pa.array([c[0] for c in cut], pa.int32()), pa.array([number] * len(cut), pa.int64()),
                        pa.array([c[1] for c in cut], pa.binary())], ["order", "part", "block", "keys"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, segments, group = None, [], None
        for batch in batches:
            out, waiting = [], []

            def handed_on() -> None:
                if waiting:
                    values = group.find(np.concatenate([k for _, k in waiting])).astype(kind if own[0] == 1 else np.uint8)  # noqa: B023
                    cuts = np.cumsum([len(k) for _, k in waiting])  # noqa: B023
                    out.extend((number, *own, v.tobytes()) for (number, _), v in zip(waiting, np.split(values, cuts[:-1])))  # noqa: B023
                    waiting.clear()  # noqa: B023

            n_waiting = 0
            columns = [batch.column(c) for c in ("segment", "size", "data", "counts")]
            for i, key in enumerate(zip(batch.column("order").to_pylist(), batch.column("part").to_pylist())):
                if key != own:
                    handed_on()
                    own, segments, group, n_waiting = key, [], None, 0
                number = batch.column("block")[i].as_py()
                if number is None:
                    # segments come before the keys that ask for them
                    segments.append(tuple(c[i].as_py() for c in columns))
                    continue
                if group is None:
                    group, segments = _Group(own[0], scorer.bits, segments), []
                keys = _keys(batch.column("keys")[i].as_py())
                waiting.append((number, keys))
                n_waiting += len(keys)
                if n_waiting >= ASKED:
                    handed_on()
                    n_waiting = 0
            handed_on()
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.int32(), pa.binary()))], ["block", "order", "part", "values"])

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _files(folder)
        last, found = None, {}

        def scored() -> Iterator[pa.RecordBatch]:
            if last is not None:
                with store.open_input_file(f"{base}/{names[last]}") as f:
                    doc_id, text = _block(parquet.ParquetFile(f), last)
                yield _scored(doc_id, text, scorer, lambda order, keys: np.concatenate(found[order]) if order in found else np.zeros(0, np.int64))

        for batch in batches:
            for number, n, values in zip(*(batch.column(c).to_pylist() for c in ("block", "order", "values"))):
                if number != last:
                    yield from scored()
                    last, found = number, {}
                # groups of segments ascend with the keys
                found.setdefault(n, []).append(np.frombuffer(values, kind if n == 1 else np.uint8))
        yield from scored()

    asked = blocks.select("block", "text").mapInArrow(ask, "order int, part int, block long, keys binary")

    def missing(*columns: str) -> list[Column]:
        return [F.lit(None).cast(t).alias(c) for c, t in (x.split() for x in columns)]

    kept = model.kept.select("order", F.shiftright("segment", GROUP).alias("part"), *missing("block long", "keys binary"), "segment", "size", "data", "counts")
    sides = kept.unionByName(asked.select("*", *missing("segment int", "size long", "data binary", "counts binary")))
    answers = sides.repartition("order", "part").sortWithinPartitions("order", "part", F.col("block").asc_nulls_first(), "segment").mapInArrow(answer, "block long, order int, part int, values binary")
    return answers.repartition("block").sortWithinPartitions("block", "order", "part").mapInArrow(together, _SCORED)


def _block(file: parquet.ParquetFile, number: int) -> tuple[pa.Array, pa.Array]:
    """Ids and texts of a block in its file."""
    for i in range(file.num_row_groups):
        numbers = file.read_row_group(i, ["block"]).column("block").to_pylist()
        if number in numbers:
            row = file.read_row_group(i).slice(numbers.index(number), 1)
            return tuple(pa.concat_arrays([c.values for c in row.column(name).combine_chunks()]) for name in ("doc_id", "text"))
    raise ValueError(f"block {number} is not in its file")


def held_out(doc_id: Column) -> Column:
    """A tenth of the ids by hash; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 10 == 0, F.lit(False))
