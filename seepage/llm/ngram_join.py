"""Exact Jaccard self-join of word n-gram sets by prefix trees.

Two texts link when ``100 * |A & B| >= percent * |A | B|`` over their distinct
n-word shingles.  The join is exact up to equal 56-bit shingle hashes within
one pair of texts:

1. Texts with equal sets form a class, found by digest; its least id stands
   for it, copies are never expanded into pairs.
2. A shingle that no other set holds cannot be shared, and a set that can have
   a partner needs ``percent`` of its shingles shared.  One exchange of packed
   shingles finds the shared ones; all other sets leave here.
3. The global order is: shingles held by one set only, then the shared ones by
   the power of two of their number of holders, then by hash.  Partners share
   a shingle among the first ``n - need + 1`` of either set.  The sets that hold
   such a shingle meet under the least id among them, once each.  A line that
   very many texts hold comes last, so that only texts made of such lines meet
   by it, and meetings do not grow with the corpus.
4. Within a meeting the ordered sets are stored in a trie.  A set walks it
   once, sharing the overlap counted so far with all sets below a node, and
   leaves a subtree when the shingles that remain on either side cannot bring
   enough.  Subtrees that are already connected to the set are left, too.
5. A meeting beyond the bounds of one task is split: all are checked against
   the least id first; only those not linked to it walk the tries of the rest,
   block by block.

Edge cases: null, empty and blank texts have no shingles and link with
nothing.  Rows with a null id take part as copies only.  Rows that share an id
are one document.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seepage.llm.components import components
from seepage.llm.tables import stored
from seepage.llm.words import Words, distinct, small_batches, word_shingles
from seepage.sources.checkpoint import shuffles_dropped

#: Words of a shingle, and the least similarity in percent.
WIDTH, PERCENT = 5, 80
#: Shingles of a bucket (half of it at least), and that a task gathers before it hands them on.
BUCKET, CHUNK = 2_000_000, 2_000_000
#: Sets and shingles of one trie; a larger meeting is split.
TRIE_SETS, TRIE_SHINGLES = 2_000, 3_000_000
#: A shingle with fewer holders than two to this power is rare; rare ones are ordered by hash alone.
RARE = 3

#: Bytes of a shingle's hash that are kept.
_BYTES = 7
#: From here on a place is a mark: this plus the number of holders.
_KNOWN = np.uint32(1 << 31)
_SEARCHED, _DOCUMENTS, _FOUND, _CARRIED, _COMMON = range(5)
_EMPTY = np.zeros(0, np.uint64)


def token_sets(words: Words, width: int) -> list[np.ndarray]:
    """Shingle sets as ascending numbers of ``_BYTES`` bytes."""
    return [distinct(s >> np.uint64(64 - 8 * _BYTES)) for s in word_shingles(words, width)]


def digests(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, n_shingles, digest) per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            sets = token_sets(Words(batch.column("text")), width)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
            ], ["doc_id", "n_shingles", "digest"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_shingles long, digest binary")


def classes(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, n_shingles, rep) per row: ``rep`` is the least id with the same set."""
    rows = stored(digests(docs, width), "digests")
    least = rows.filter("n_shingles > 0").groupBy("digest").agg(F.min("doc_id").alias("rep"))
    tied = rows.join(least, "digest", "left")
    return stored(tied.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("rep")).otherwise(F.col("doc_id")).alias("rep")), "classes")


# -- shingles that several sets hold ------------------------------------------------------------------------------


def _planes(values: np.ndarray, width: int) -> bytes:
    """The lower ``width`` bytes of each value, all lowest ones first: sorted values have long runs in the upper ones."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize)[:, :width].T).tobytes()


def _values(block: bytes, at: int, n: int, width: int, kind: type) -> np.ndarray:
    out = np.zeros((n, np.dtype(kind).itemsize), np.uint8)
    out[:, :width] = np.frombuffer(block, np.uint8, n * width, at).reshape(width, n).T
    return out.view(kind).ravel()


class _Postings:
    """Tokens and who holds them: places in the chunk's list of documents, or marks from ``_KNOWN`` on."""

    def __init__(self, tokens: np.ndarray, place: np.ndarray):
        self.tokens, self.place = tokens, place

    def pack(self, keys: np.ndarray | None = None) -> bytes:
        """With ``keys``, the key of each document that occurs, in ascending order of places, is added."""
        used = distinct(self.place[self.place < _KNOWN]) if keys is not None else _EMPTY
        head = np.array([len(self.tokens), len(used)], np.int64).tobytes()
        added = _planes(used.astype(np.uint32), 4) + keys[used].tobytes() if keys is not None else b""
        return head + _planes(self.tokens, _BYTES) + _planes(self.place, 4) + added

    @classmethod
    def unpack(cls, block: bytes) -> tuple["_Postings", np.ndarray]:
        """The postings and the key of each one's document (0 for marks)."""
        n, docs = np.frombuffer(block, np.int64, 2).tolist()
        at = 16 + n * _BYTES
        own = cls(_values(block, 16, n, _BYTES, np.uint64), _values(block, at, n, 4, np.uint32))
        if not docs:
            return own, np.zeros(n, np.uint64)
        used = _values(block, at + 4 * n, docs, 4, np.uint32)
        keys = np.frombuffer(block, np.uint64, docs, at + 4 * n + 4 * docs)
        known = own.place >= _KNOWN
        return own, np.where(known, np.uint64(0), keys[np.searchsorted(used, np.where(known, used[0], own.place))])


def _shared(tokens: np.ndarray, keys: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the postings by token, for each in that order whether different sets hold its token, and where tokens start."""
    order = np.argsort(tokens)
    ordered = tokens[order]
    starts = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    key = keys[order]
    differ = (np.minimum.reduceat(key, starts) != np.maximum.reduceat(key, starts)) | np.logical_or.reduceat(known[order], starts)
    return order, np.repeat(differ, np.diff(np.append(starts, len(ordered)))), starts


def _commonness(tokens: np.ndarray, place: np.ndarray, order: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Of each posting, how many powers of two the holders of its token are beyond a rare one's; ``order`` sorts by token.

    Equal sets of different chunks count as often as they are there: only the order follows from it.
    """
    many = np.diff(np.append(starts, len(tokens)))
    marks = np.flatnonzero(place >= _KNOWN)
    # a mark is one posting, but stands for all its holders
    total = many + np.bincount(np.searchsorted(tokens[order[starts]], tokens[marks]), place[marks] - _KNOWN - np.uint32(1), len(starts)).astype(np.int64)
    out = np.zeros(len(tokens), np.uint32)
    common = total >= 1 << RARE
    many, rank = many[common], np.frexp(total[common].astype(np.float64))[1] - RARE
    out[order[np.repeat(starts[common] - np.cumsum(many) + many, many) + np.arange(many.sum())]] = np.repeat(rank, many)
    return out


def _looked_up(ranked: list[_Postings], tokens: np.ndarray) -> np.ndarray:
    """What ``ranked`` says of each token, 0 for those that it does not have."""
    if not ranked:
        return np.zeros(len(tokens), np.uint32)
    known, ranks = np.concatenate([p.tokens for p in ranked]), np.concatenate([p.place for p in ranked])
    order = np.argsort(known)
    known, ranks = known[order], ranks[order]
    at = np.minimum(np.searchsorted(known, tokens), len(known) - 1)
    return np.where(known[at] == tokens, ranks[at], np.uint32(0))


class _Chunk:
    """Sets gathered by a task until there are enough shingles to hand on."""

    def __init__(self) -> None:
        self.by_digest: dict[bytes, int] = {}
        self.ids: list[int] = []
        self.sets: list[np.ndarray] = []
        self.carried: list[pa.RecordBatch] = []
        self.n = 0

    def add(self, doc_id: int | None, shingles: np.ndarray) -> int:
        """The id of the set: ``doc_id``, or a part of its digest if that is null."""
        digest = hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()
        if doc_id is None:
            doc_id = int.from_bytes(digest[:8], "little", signed=True)
        at = self.by_digest.get(digest)
        if at is not None:  # a copy: only the least id can stand for its class
            self.ids[at] = min(self.ids[at], doc_id)
            return doc_id
        self.by_digest[digest] = len(self.ids)
        self.ids.append(doc_id)
        self.sets.append(shingles)
        self.n += len(shingles)
        return doc_id

    def carry(self, batch: pa.RecordBatch, words: Words, width: int) -> None:
        """Add the sets of a batch (row_id, source, text) under ids of their own, and keep the rows with words."""
        sets = token_sets(words, width)
        kept = [i for i, s in enumerate(sets) if len(s)]
        rows = batch.select(["row_id", "source"]).take(pa.array(kept, pa.int64()))
        own = pa.array([self.add(None, sets[i]) for i in kept], pa.int64())
        size = pa.array(np.diff(words.offsets)[kept].astype(np.int64))
        self.carried.append(pa.RecordBatch.from_arrays([own, *rows.columns, size], schema=_ROW))
        # copies bring no shingles, but are not gathered without end
        self.n += len(kept)

    def rows(self, buckets: int) -> Iterator[tuple[int, int, int, bytes]]:
        """(bucket, chunk, kind, block) rows.

        A token that one set here holds goes to its bucket with its holder.  A
        token that several hold is known to be shared: it goes to its bucket
        as a mark with their number, so that a bucket gets at most one posting
        per token and chunk, and its holders' postings go on with the chunk.
        """
        digests = b"".join(self.by_digest)
        ids, sizes = np.array(self.ids, np.int64), np.array([len(s) for s in self.sets], np.int64)
        chunk = int.from_bytes(hashlib.blake2b(digests + ids.tobytes(), digest_size=8).digest(), "little", signed=True)
        keys = np.frombuffer(digests, np.uint64)[::2]
        tokens, place = np.concatenate(self.sets), np.repeat(np.arange(len(ids), dtype=np.uint32), sizes)
        order, shared, _ = _shared(tokens, keys[place], np.zeros(len(place), bool))
        tokens, place = tokens[order], place[order]
        marks, held = np.unique(tokens[shared], return_counts=True)
        single = np.concatenate((tokens[~shared], marks))
        holder = np.concatenate((place[~shared], _KNOWN + held.astype(np.uint32)))
        order = np.argsort(single)
        single, holder = single[order], holder[order]
        edges = np.searchsorted(_bucket(single, buckets), np.arange(buckets + 1)).tolist()
        for bucket, (a, b) in enumerate(zip(edges, edges[1:])):
            if b > a:
                yield bucket, chunk, _SEARCHED, _Postings(single[a:b], holder[a:b]).pack(keys)
        onward = buckets + chunk % buckets
        yield onward, chunk, _DOCUMENTS, np.array([len(ids)], np.int64).tobytes() + ids.tobytes() + sizes.tobytes()
        if shared.any():
            tokens, place = tokens[shared], place[shared]
            order = np.lexsort((tokens, place))
            yield onward, chunk, _FOUND, _Postings(tokens[order], place[order]).pack()
        if self.carried:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, _ROW) as out:
                for batch in self.carried:
                    out.write_batch(batch)
            yield onward, chunk, _CARRIED, sink.getvalue().to_pybytes()


def _bucket(tokens: np.ndarray, buckets: int) -> np.ndarray:
    """Ranges of tokens; ``buckets`` is a power of two."""
    return (tokens >> np.uint64(8 * _BYTES + 1 - buckets.bit_length())).astype(np.int64)


_ROWS = "bucket long, chunk long, kind int, block binary"
#: A row of the input that travels with the chunk of its set.
_ROW = pa.schema([("doc_id", pa.int64()), ("row_id", pa.int64()), ("source", pa.string()), ("size", pa.int64())])


def _batch(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["bucket", "chunk", "kind", "block"])


def partnered(docs: DataFrame, total: int, width: int = WIDTH, percent: int = PERCENT, carry: bool = False) -> DataFrame:
    """(doc_id, n, tokens) of sets of which at least ``percent`` is held by other sets too.

    ``tokens`` are the shared shingles in the global order, ``n`` is the size
    of the whole set, ``total`` the number of shingles in all of ``docs``.
    Of equal sets one may be left out, never the one with the least id.

    With ``carry``, ``docs`` is (doc_id, source, text): the id of a set is made
    of its digest, and the result also has a row (doc_id of its set, row_id,
    source, size in words) without tokens for each row of ``docs`` with words.
    """
    buckets = 1 << max(0, (total // BUCKET).bit_length())

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = _Chunk()
        for batch in small_batches(batches, "text"):
            words = Words(batch.column("text"))
            if carry:
                chunk.carry(batch, words, width)
            else:
                for doc_id, shingles in zip(batch.column("doc_id").to_pylist(), token_sets(words, width)):
                    if doc_id is not None and len(shingles):
                        chunk.add(doc_id, shingles)
            if chunk.n >= CHUNK:
                yield from (_batch([row]) for row in chunk.rows(buckets))
                chunk = _Chunk()
        if chunk.n:
            yield from (_batch([row]) for row in chunk.rows(buckets))

    def meet(group: pa.Table) -> pa.Table:
        if group.column("bucket")[0].as_py() >= buckets:
            return group
        chunks = group.column("chunk").to_pylist()
        parts = [_Postings.unpack(b) for b in group.column("block").to_pylist()]
        lengths = [len(p.tokens) for p, _ in parts]
        tokens, place = np.concatenate([p.tokens for p, _ in parts]), np.concatenate([p.place for p, _ in parts])
        known = place >= _KNOWN
        order, shared, starts = _shared(tokens, np.concatenate([k for _, k in parts]), known)
        found = np.zeros(len(tokens), bool)
        found[order[shared]] = True
        found &= ~known
        common = _commonness(tokens, place, order, starts)
        bucket = group.column("bucket")[0].as_py()
        rows, start = [], 0
        for chunk, n in zip(chunks, lengths):
            mine = found[start : start + n]
            if mine.any():
                rows.append((bucket, chunk, _FOUND, _Postings(tokens[start : start + n][mine], place[start : start + n][mine]).pack()))
            mine = common[start : start + n] > 0
            if mine.any():
                rows.append((bucket, chunk, _COMMON, _Postings(tokens[start : start + n][mine], common[start : start + n][mine]).pack()))
            start += n
        return pa.Table.from_batches([_batch(rows)])

    def collect(group: pa.Table) -> pa.Table:
        kinds, blocks = group.column("kind").to_pylist(), group.column("block").to_pylist()
        listed = next(b for b, kind in zip(blocks, kinds) if kind == _DOCUMENTS)
        docs = int.from_bytes(listed[:8], "little")
        ids, sizes = np.frombuffer(listed, np.int64, docs, 8), np.frombuffer(listed, np.int64, docs, 8 + 8 * docs)
        parts = [_Postings.unpack(b)[0] for b, kind in zip(blocks, kinds) if kind == _FOUND]
        tokens = np.concatenate([p.tokens for p in parts] or [_EMPTY])
        place = np.concatenate([p.place for p in parts] or [np.zeros(0, np.uint32)])
        ranked = [_Postings.unpack(b)[0] for b, kind in zip(blocks, kinds) if kind == _COMMON]
        order = np.lexsort((tokens, _looked_up(ranked, tokens), place))
        tokens, place = tokens[order], place[order]
        # a chunk that was read from two equal files comes twice
        fresh = np.ones(len(tokens), bool)
        fresh[1:] = (tokens[1:] != tokens[:-1]) | (place[1:] != place[:-1])
        tokens, place = tokens[fresh], place[fresh]
        edges = np.searchsorted(place, np.arange(docs + 1))
        kept = np.flatnonzero(np.diff(edges) * 100 >= percent * sizes)
        parts = [tokens[edges[i] : edges[i + 1]] for i in kept.tolist()]
        lists = pa.ListArray.from_arrays(
            pa.array(np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int32)), pa.array(np.concatenate(parts or [_EMPTY]).view(np.int64)))
        found = pa.table({"doc_id": pa.array(ids[kept]), "n": pa.array(sizes[kept]), "tokens": lists})
        if not carry:
            return found
        rows = [pa.ipc.open_stream(b).read_all() for b, kind in zip(blocks, kinds) if kind == _CARRIED]
        return pa.concat_tables([found, *rows], promote_options="default").select(["doc_id", "n", "tokens", "row_id", "source", "size"])

    columns = [F.col("doc_id").cast("long").alias("row_id"), F.col("source").cast("string").alias("source")] if carry else [F.col("doc_id").cast("long")]
    sent = docs.select(*columns, "text").mapInArrow(send, _ROWS)
    met = sent.groupBy("bucket").applyInArrow(meet, _ROWS)
    return met.groupBy("chunk").applyInArrow(collect, "doc_id long, n long, tokens array<bigint>" + ", row_id long, source string, size long" * carry)


# -- the prefix tree ----------------------------------------------------------------------------------------------


def linked(overlap: int, a: int, b: int, percent: int) -> bool:
    return (100 + percent) * overlap >= percent * (a + b)


class Trie:
    """Ordered sets along common beginnings; an edge holds a run of tokens.

    Sets are sorted, so every node covers a range of them.  A node is
    (start, end, low, high, least n, most tokens, children, sets that end here);
    its edge is ``tokens[low][start:end]``.
    """

    def __init__(self, sets: list[np.ndarray], sizes: list[int]):
        self.sets, self.sizes = sets, sizes
        shared = np.array([self._common(a, b) for a, b in zip(sets, sets[1:])], np.int64)
        lengths, n = np.array([len(s) for s in sets]), np.array(sizes)
        self.root: list = []
        work = [(0, len(sets), 0, self.root)] if sets else []
        while work:
            low, high, start, into = work.pop()
            end = int(shared[low : high - 1].min()) if high - low > 1 else int(lengths[low])
            children: list = []
            ends = [i for i in range(low, high) if lengths[i] == end] if high - low < 64 else (low + np.flatnonzero(lengths[low:high] == end)).tolist()
            into.append((start, end, low, high, int(n[low:high].min()), int(lengths[low:high].max()), children, ends))
            if high - low > 1:
                cuts = (low + 1 + np.flatnonzero(shared[low : high - 1] == end)).tolist()
                for a, b in zip([low, *cuts], [*cuts, high]):
                    if b - a > 1 or lengths[a] > end:
                        if b - a > 1 or a not in ends:
                            work.append((a, b, end, children))

    @staticmethod
    def _common(a: np.ndarray, b: np.ndarray) -> int:
        m = min(len(a), len(b))
        differ = np.flatnonzero(a[:m] != b[:m])
        return int(differ[0]) if len(differ) else m

    def partners(self, probe: np.ndarray, size: int, flags: np.ndarray, percent: int, comp: np.ndarray, own: int, after: int) -> Iterator[int]:
        """Places of the sets linked to ``probe`` from ``after`` on, without those of its own component.

        ``flags`` is true at the probe's tokens.  ``comp`` may change while this runs.
        """
        order = probe.tolist()
        work = [(node, 0) for node in self.root]
        while work:
            (start, end, low, high, least, longest, children, ends), overlap = work.pop()
            if high <= after or (comp[max(low, after) : high] == comp[own]).all():
                continue
            if end > start:
                edge = self.sets[low][start:end]
                overlap += int(np.count_nonzero(flags[edge]))
                left = min(len(order) - bisect_right(order, int(edge[-1])), longest - end)
            else:
                left = min(len(order), longest)
            if not linked(overlap + left, size, least, percent):
                continue
            for i in ends:
                if i >= after and comp[i] != comp[own] and linked(overlap, size, self.sizes[i], percent):
                    yield i
            work.extend((child, overlap) for child in children)


def trie_links(sets: list[np.ndarray], sizes: list[int], percent: int, probes: list[bool] | None = None) -> list[tuple[int, int]]:
    """Links between places of ``sets`` that connect what all links connect.

    With ``probes`` only pairs with a marked set are looked at, and unmarked
    sets count as connected among themselves.
    """
    vocabulary, flat = np.unique(np.concatenate(sets) if sets else _EMPTY, return_inverse=True)
    bounds = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int64)
    local = [np.sort(flat[a:b].astype(np.int64)) for a, b in zip(bounds[:-1], bounds[1:])]
    order = sorted(range(len(sets)), key=lambda i: local[i].astype(">u4").tobytes())
    trie = Trie([local[i] for i in order], [sizes[i] for i in order])
    comp = np.arange(len(sets))
    if probes is not None:
        rest = np.array([not probes[i] for i in order])
        if rest.any():
            comp[rest] = int(np.flatnonzero(rest)[0])
    flags = np.zeros(len(vocabulary), bool)
    found = []
    for own in range(len(order)):
        if probes is not None and not probes[order[own]]:
            continue
        probe = trie.sets[own]
        flags[probe] = True
        for i in trie.partners(probe, trie.sizes[own], flags, percent, comp, own, own + 1 if probes is None else 0):
            if comp[i] != comp[own]:
                comp[comp == comp[i]] = comp[own]
                found.append((order[own], order[i]))
        flags[probe] = False
    return found


# -- links between classes ----------------------------------------------------------------------------------------


def links(sets: DataFrame, percent: int = PERCENT, most_sets: int = TRIE_SETS, most_shingles: int = TRIE_SHINGLES) -> DataFrame:
    """(u, v) of links that connect all that links of ``percent`` connect, for (doc_id, n, tokens)."""
    least = f"(({percent} * n + 99) div 100)"
    first = sets.select("doc_id", "n", F.explode(F.expr(f"slice(tokens, 1, cast(greatest(size(tokens) - {least} + 1, 0) as int))")).alias("token"))
    leaders = first.groupBy("token").agg(F.min("doc_id").alias("leader"), F.max("doc_id").alias("other")).filter("leader < other")
    meetings = stored(first.join(leaders.select("token", "leader"), "token").select("leader", "doc_id", "n").distinct(), "meetings")
    sizes = meetings.groupBy("leader").agg(F.count("*").alias("members"), F.sum("n").alias("weight"))
    fits = f"members <= {most_sets} and weight <= {most_shingles}"
    small = meetings.join(sizes.filter(fits).select("leader"), "leader")
    large = stored(meetings.join(sizes.filter(f"not ({fits})"), "leader"), "large")

    def join_all(group: pa.Table) -> pa.Table:
        ids = group.column("doc_id").to_pylist()
        tokens = [np.asarray(x.values, dtype=np.int64).view(np.uint64) for x in group.column("tokens")]
        probes = group.column("probe").to_pylist()
        found = trie_links(tokens, group.column("n").to_pylist(), percent, None if all(probes) else probes)
        return pa.table({"u": pa.array([ids[i] for i, _ in found], pa.int64()), "v": pa.array([ids[j] for _, j in found], pa.int64())})

    def walk(rows: DataFrame) -> DataFrame:
        """A trie per (leader, block, slice) over the sets (probe, doc_id, n, tokens) of its rows."""
        # tries take time rather than bytes, so tasks are not merged by size
        parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return rows.repartition(parts, "leader", "block", "slice").groupBy("leader", "block", "slice").applyInArrow(join_all, "u long, v long")

    carried = small.select("leader", "doc_id").join(sets, "doc_id")
    whole = walk(carried.select("leader", F.lit(0).alias("block"), F.lit(0).alias("slice"), F.lit(True).alias("probe"), "doc_id", "n", "tokens"))
    if large.isEmpty():
        return stored(whole, "links")
    # written by one job, which deals the sets out by id once for both
    checked = _checked(large, sets, percent)
    both = stored(whole.unionByName(checked, allowMissingColumns=True), "links")
    split = _split_links(both.filter("leader is not null").drop("u", "v"), walk, most_sets, most_shingles)
    return both.filter("leader is null").select("u", "v").unionByName(split)


def _checked(large: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``large`` with n and tokens, and ``near``: whether the set is linked to the leader's, or is it."""
    leaders = large.select(F.col("leader").alias("doc_id")).distinct()
    head = sets.join(F.broadcast(leaders), "doc_id", "left_semi").select(F.col("doc_id").alias("leader"), F.col("n").alias("leader_n"), F.col("tokens").alias("leader_tokens"))
    # of rows that share an id one is enough here: what is not linked to it is compared with all
    head = head.dropDuplicates(["leader"])
    own = large.select("leader", "doc_id", "members", "weight").distinct().join(sets, "doc_id").join(head, "leader")
    overlap = F.size(F.array_intersect("tokens", "leader_tokens")).cast("long")
    near = (F.col("doc_id") == F.col("leader")) | ((100 + percent) * overlap >= percent * (F.col("n") + F.col("leader_n")))
    return own.select("leader", "doc_id", "n", "tokens", "members", "weight", near.alias("near"))


def _split_links(checked: DataFrame, walk, most_sets: int, most_shingles: int) -> DataFrame:
    """Links of meetings that are too large for one trie.

    The sets that are not linked to their leader are the probes: a block of
    them walks the tries of all slices of the meeting.
    """
    far = checked.groupBy("leader").agg(F.sum(F.when(~F.col("near"), 1).otherwise(0)).alias("far"), F.sum(F.when(~F.col("near"), F.col("n")).otherwise(0)).alias("far_weight"))
    sized = checked.join(far.filter("far > 0"), "leader").select(
        "leader", "doc_id", "n", "tokens", "near",
        F.expr(f"cast(greatest(ceil(members / {most_sets}), ceil(weight / {most_shingles})) as int)").alias("slices"),
        F.expr(f"cast(greatest(ceil(far / {most_sets}), ceil(far_weight / {most_shingles})) as int)").alias("blocks"))
    number = F.xxhash64("doc_id")
    row = ["leader", "doc_id", "n", "tokens"]
    probes = sized.filter("not near").select(*row, F.pmod(number, "blocks").cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), F.lit(True).alias("probe"))
    stay = sized.filter("near").select(*row, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.pmod(number, "slices").cast("int").alias("slice"), F.lit(False).alias("probe"))
    # probes of different blocks have to meet as well: each block's probes are also rows of their slice in the other blocks
    other = sized.filter("not near").select(*row, F.pmod(number, "slices").cast("int").alias("slice"), F.pmod(number, "blocks").cast("int").alias("home"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")).filter("block < home")
    guests = other.select(*row, "block", "slice", F.lit(True).alias("probe"))
    stars = checked.filter("near and doc_id <> leader").select(F.col("leader").alias("u"), F.col("doc_id").alias("v"))
    return stars.unionByName(stored(walk(probes.unionByName(stay).unionByName(guests)), "links"))


def sized_components(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(doc_id, source, size, component) per row of ``docs`` (doc_id, text, source) with words, from one pass over the texts.

    ``size`` is the number of words.  Rows have one component if links or equal
    sets connect them; its number says no more than that.
    """
    # about seven bytes a word; only the number of buckets follows from it
    total = (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // 7
    with shuffles_dropped(docs.sparkSession):
        found = stored(partnered(docs, total, width, percent, carry=True), "carried")
    # equal sets of different chunks have one id
    sets = stored(found.filter("tokens is not null").select("doc_id", "n", "tokens").dropDuplicates(["doc_id"]), "sets")
    rows = found.filter("tokens is null").select(F.col("doc_id").alias("node"), F.col("row_id").alias("doc_id"), "source", "size")
    return rows.join(components(links(sets, percent)), "node", "left").select("doc_id", "source", "size", F.coalesce("component", "node").alias("component"))


def near_components(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) per row of ``docs`` (doc_id, text).

    ``component_id`` is the least id that links reach; without links it is the own id.
    """
    tied = classes(docs, width)
    total = tied.agg(F.sum("n_shingles")).first()[0] or 0
    reps = tied.filter("n_shingles > 0 and doc_id = rep").select("doc_id").distinct()
    with shuffles_dropped(docs.sparkSession):
        sets = stored(partnered(docs, total, width, percent).join(reps, "doc_id", "left_semi"), "sets")
    found = components(links(sets, percent))
    out = tied.join(found.withColumnRenamed("node", "rep"), "rep", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "rep", "doc_id").alias("component_id"))
