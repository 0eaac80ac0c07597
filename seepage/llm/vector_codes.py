"""Product codes of vectors by k-means with adaptive distance bounds (Drake and Hamerly).

A vector is cut into parts; each part position has a codebook of its own.  Per
vector and part a row keeps the entry it belongs to with an upper bound of the
distance, the ``b`` next entries with ordered lower bounds, and one outer bound
for all others.  When entries move the bounds are widened by the moves, and
only the entries that the bounds leave open are measured again.  Bounds are
rounded outwards; whatever they leave undecided, ties among it, is decided by
whole-number distances.  How deep the walks went sets ``b`` for the next round.

Each round writes its table to the shared folder.  Per task and entry one sum
is shuffled; a codebook has at most entries x dimensions numbers and is the
only thing that passes the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seepage.llm.tables import stored

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Labels up to this number of rows are sent to all tasks, more are joined in salted shares.
FEW_LABELS, SALTS = 100_000, 16
#: Walks that the next round's lists have to cover.
COVERED = 0.999
#: Sums of large components travel in pieces of this many bits.
_LIMB = 32


@dataclass(frozen=True)
class Codebooks:
    """Entries of every part as whole numbers."""

    entries: tuple[tuple[tuple[int, ...], ...], ...]

    def sha256(self) -> str:
        return hashlib.sha256(",".join(str(x) for part in self.entries for entry in part for x in entry).encode()).hexdigest()


@dataclass(frozen=True)
class Moves:
    """A codebook after an update: its entries before, and how many neighbours its table keeps."""

    before: Codebooks | None
    kept: int
    next_kept: int


def usable(embedding: Column) -> Column:
    """The vector is there and all its components are finite."""
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return embedding.isNotNull() & ~F.coalesce(bad, F.lit(True))


def _cuts(width: int, parts: int) -> list[tuple[int, int]]:
    """Places of the parts; they are equal if ``parts`` divides ``width``."""
    return [(p * width // parts, (p + 1) * width // parts) for p in range(parts)]


def _whole(cells: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as float64 where that is exact, else as Python integers."""
    if not cells.size or np.abs(cells).max() * scale < 2**52:
        return np.floor(cells * scale)
    # a float beyond 2^52 is a whole number
    exact = [int(x) * scale if abs(x) >= 2**52 else int(np.floor(x * scale)) if abs(x) * scale < 2**52 else int(x * scale // 1) for x in cells.ravel().tolist()]
    out = np.empty(len(exact), object)
    out[:] = exact
    return out.reshape(cells.shape)


def _narrow(width: int) -> int:
    """Components up to this give squared distances that float64 holds exactly."""
    return int((2**52 / max(width, 1)) ** 0.5) // 2


def _is_narrow(x: np.ndarray, entries: Sequence[Sequence[int]]) -> bool:
    limit = _narrow(x.shape[1])
    return x.dtype != object and (not x.size or np.abs(x).max() <= limit) and all(abs(v) <= limit for e in entries for v in e)


def _distances(x: np.ndarray, entries: Sequence[Sequence[int]], narrow: bool) -> np.ndarray:
    """Exact squared distances: int64, or Python integers for large components."""
    if narrow:
        c = np.array(entries, np.float64).reshape(len(entries), x.shape[1])
        d = (x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)
        return d.astype(np.int64)
    rows = [[sum((int(a) - b) ** 2 for a, b in zip(row, e)) for e in entries] for row in x.tolist()]
    out = np.empty((len(rows), len(entries)), object)
    for i, row in enumerate(rows):
        out[i, :] = row
    return out


def _up(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x.astype(np.float32), np.float32(np.inf))


def _down(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x.astype(np.float32), np.float32(-np.inf))


def _layout(parts: int, kept: int) -> np.dtype:
    """What a vector remembers: per part its entry, the next ones, and their bounds; the last lower bound is the outer one."""
    return np.dtype([("own", "u1", (parts,)), ("near", "u1", (parts, kept)), ("upper", "<f4", (parts,)), ("lower", "<f4", (parts, kept + 1))])


def _nearest(distances: np.ndarray, kept: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Own entry, next entries, bounds and exact distance from all distances; ties go to the lower index."""
    n, k = distances.shape
    order = np.argsort(distances, axis=1, kind="stable")
    sorted_ = np.take_along_axis(distances, order, axis=1)
    if distances.dtype == object:
        # too large for bounds: the next round measures all entries again
        return order[:, 0], order[:, 1 : kept + 1], np.full(n, np.inf, np.float32), np.full((n, kept + 1), -np.inf, np.float32), sorted_[:, 0]
    lower = np.full((n, kept + 1), np.inf, np.float32)
    have = min(kept + 1, k - 1)
    lower[:, :have] = _down(np.sqrt(sorted_[:, 1 : have + 1].astype(np.float64)))
    return order[:, 0], order[:, 1 : kept + 1], _up(np.sqrt(sorted_[:, 0].astype(np.float64))), lower, sorted_[:, 0]


def _walk(x: np.ndarray, entries: Sequence[Sequence[int]], moved: np.ndarray, own: np.ndarray, near: np.ndarray, upper: np.ndarray, lower: np.ndarray, depths: np.ndarray) -> None:
    """Bring one part's rows up to date with moved entries, in place; counts in ``depths`` how deep they went."""
    kept = near.shape[1]
    upper[:] = _up(upper.astype(np.float64) + moved[own])
    lower[:, :kept] = _down(lower[:, :kept].astype(np.float64) - moved[near])
    lower[:, kept] = _down(lower[:, kept].astype(np.float64) - moved.max(initial=0.0))
    # entry z and all behind it are no nearer than bound z
    lower[:] = np.minimum.accumulate(lower[:, ::-1], axis=1)[:, ::-1]
    c = np.array(entries, np.float64).reshape(len(entries), x.shape[1])
    open_ = np.flatnonzero(~(upper < lower[:, 0]))
    depths[0] += len(upper) - len(open_)
    if not len(open_):
        return
    exact = ((x[open_] - c[own[open_]]) ** 2).sum(1)
    upper[open_] = _up(np.sqrt(exact))
    reach = upper[open_, None] < lower[open_]
    depth = np.where(reach.any(axis=1), reach.argmax(axis=1), kept + 1)
    for z in np.unique(depth).tolist():
        rows = open_[depth == z]
        depths[z] += len(rows)
        if z == 0:
            continue
        if z > kept:
            own[rows], near[rows], upper[rows], lower[rows], _ = _nearest(_distances(x[rows], entries, True), kept)
            continue
        some = np.concatenate((own[rows, None], near[rows, :z]), axis=1).astype(np.int64)
        d = ((x[rows, None, :] - c[some]) ** 2).sum(2)
        # distance first, then the lower index
        order = np.argsort(d.astype(np.int64) * 256 + some, axis=1)
        some, d = np.take_along_axis(some, order, axis=1), np.sqrt(np.take_along_axis(d, order, axis=1))
        own[rows], near[rows, :z] = some[:, 0], some[:, 1:]
        upper[rows], lower[rows, :z] = _up(d[:, 0]), _down(d[:, 1:])


def _moved(before: Sequence[Sequence[int]], after: Sequence[Sequence[int]]) -> np.ndarray:
    """How far each entry went, rounded up."""
    return np.array([np.nextafter(float(sum((a - b) ** 2 for a, b in zip(x, y))) ** 0.5, np.inf) for x, y in zip(before, after)])


def _column(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return batch.column("cells").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width)


def _assigned(vectors: DataFrame, carry: Sequence[str], books: Codebooks, moves: Moves, width: int, scale: int, last: bool) -> DataFrame:
    """One assignment: rows with a new state, or with code and error in the last one."""
    parts, cuts = len(books.entries), _cuts(width, len(books.entries))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = _whole(_column(batch, width), scale)
            if moves.before is not None:
                old = np.frombuffer(b"".join(batch.column("state").to_pylist()), _layout(parts, moves.kept))
            new = np.zeros(n, _layout(parts, moves.next_kept))
            depths = np.zeros(max(moves.kept, moves.next_kept) + 2, np.int64)
            error = np.zeros(n, object)
            for p, (a, b) in enumerate(cuts):
                piece, entries = x[:, a:b], books.entries[p]
                narrow = _is_narrow(piece, entries)
                if moves.before is None or not narrow:
                    d = _distances(piece, entries, narrow)
                    own, near, upper, lower, best = _nearest(d, moves.next_kept)
                    depths[-1] += n
                else:
                    own, upper = old["own"][:, p].astype(np.int64), old["upper"][:, p].copy()
                    near, lower = old["near"][:, p, : moves.next_kept].astype(np.int64), old["lower"][:, p, : moves.next_kept + 1].copy()
                    # a shorter list leaves the rest to the outer bound
                    lower[:, -1] = old["lower"][:, p, moves.next_kept :].min(axis=1)
                    _walk(piece, entries, _moved(moves.before.entries[p], entries), own, near, upper, lower, depths)
                    c = np.array(entries, np.float64).reshape(len(entries), b - a)
                    best = ((piece - c[own]) ** 2).sum(1).astype(np.int64) if last else np.zeros(n, np.int64)
                new["own"][:, p], new["near"][:, p], new["upper"][:, p], new["lower"][:, p] = own, near, upper, lower
                error += best.astype(object)
            kept = [batch.column(c) for c in ("vec_id", *carry)]
            if last:
                size = parts
                out = [pa.array([row.tobytes() for row in new["own"]], pa.binary()), pa.array([e if e < 2**63 else None for e in error.tolist()], pa.int64())]
                names = ["code", "error"]
            else:
                size = new.dtype.itemsize
                raw = new.tobytes()
                out = [batch.column("cells"), pa.array([raw[i : i + size] for i in range(0, len(raw), size)], pa.binary()),
                       pa.array([depths.tolist()] + [None] * (n - 1), pa.list_(pa.int64()))]
                names = ["cells", "state", "depths"]
            yield pa.RecordBatch.from_arrays([*kept, *out], ["vec_id", *carry, *names])

    kinds = dict(vectors.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in ("vec_id", *carry))
    schema += ", code binary, error long" if last else ", cells array<double>, state binary, depths array<long>"
    return vectors.mapInArrow(run, schema)


def _split(value: int) -> list[int]:
    """Pieces of a whole number, lowest first, each with its sign."""
    sign, rest, out = (-1 if value < 0 else 1), abs(value), []
    while rest:
        out.append(sign * (rest & ((1 << _LIMB) - 1)))
        rest >>= _LIMB
    return out


def _updated(held: DataFrame, books: Codebooks, kept: int, width: int, scale: int) -> Codebooks:
    """Entries replaced by the floor of the mean of their parts; unused ones stay."""
    parts, cuts = len(books.entries), _cuts(width, len(books.entries))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple[int, int], list[int]] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _whole(_column(batch, width), scale)
            own = np.frombuffer(b"".join(batch.column("state").to_pylist()), _layout(parts, kept))["own"]
            for p, (a, b) in enumerate(cuts):
                used, place, n = np.unique(own[:, p], return_inverse=True, return_counts=True)
                if x.dtype == object or (x.size and np.abs(x).max() >= 2**31):
                    sums = [[sum(int(v) for v in x[place == i, c].tolist()) for c in range(a, b)] for i in range(len(used))]
                else:
                    sums = np.array([np.bincount(place, x[:, c], len(used)) for c in range(a, b)]).reshape(b - a, len(used)).T.astype(np.int64).tolist()
                for e, count, row in zip(used.tolist(), n.tolist(), sums):
                    before = totals.get((p, e), [0] * (b - a + 1))
                    totals[p, e] = [u + v for u, v in zip(before, [count, *row])]
        rows = [(p, e, at, limb, piece) for (p, e), values in totals.items() for at, value in enumerate(values) for limb, piece in enumerate(_split(value))]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(5)], ["part", "entry", "at", "limb", "value"])

    keys = ["part", "entry", "at", "limb"]
    summed = held.select("cells", "state").mapInArrow(run, "part long, entry long, at long, limb long, value long").groupBy(*keys).agg(F.sum("value").alias("value"))
    totals: dict[tuple[int, int, int], int] = {}
    # at most entries x (dimensions + parts) numbers, in as many pieces as they are long
    for part, entry, at, limb, value in summed.select(*keys, "value").collect():
        totals[part, entry, at] = totals.get((part, entry, at), 0) + (value << (_LIMB * limb))
    new = []
    for p, part in enumerate(books.entries):
        rows = []
        for e, entry in enumerate(part):
            n = totals.get((p, e, 0), 0)
            rows.append(tuple(totals.get((p, e, i + 1), 0) // n for i in range(len(entry))) if n else entry)
        new.append(tuple(rows))
    return Codebooks(tuple(new))


def _next_kept(held: DataFrame, kept: int, least: int) -> int:
    """Shortest list that covers almost all walks of the round."""
    found = held.filter("depths is not null").select(F.posexplode("depths").alias("z", "n")).groupBy("z").agg(F.sum("n").alias("n")).collect()
    counts = dict((r["z"], r["n"]) for r in found)
    total, seen = sum(n for z, n in counts.items() if z <= kept), 0
    for z in range(kept + 1):
        seen += counts.get(z, 0)
        if seen >= COVERED * total:
            return min(kept, max(z, least))
    return kept


def compress(vectors: DataFrame, carry: Sequence[str] = (), parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, Codebooks]:
    """((vec_id, *carry, code binary, error long), codebooks) of ``vectors`` (vec_id, embedding, *carry).

    Components become floor(``scale`` * x).  Codebooks start as the parts of
    the vectors with the ``entries`` smallest ids (of rows with one id the
    least vector); ``rounds`` times all parts are assigned to their nearest
    entry, ties to the lower index, and entries replaced by the floor of their
    mean; then parts are assigned once more.  ``code`` has one byte a part.

    Rows without a usable vector are dropped.  Rows without an id are encoded
    but start no entry; repeated rows count as often as they are there.  A
    vector of another length than that of the smallest id has no code and no
    error (both null).  A length that ``parts`` doesn't divide gives parts
    that differ by one component.  Components of any finite size are exact; an
    error beyond 2^63 - 1 is null.  No usable vector gives no rows.
    """
    if not 1 <= entries <= 256:
        raise ValueError("an entry's index is one byte")
    kept_rows = vectors.filter(usable(F.col("embedding"))).select(
        F.col("vec_id").cast("long"), *carry, F.transform("embedding", lambda x: x.cast("double")).alias("cells"))
    # a fixed number of ids
    ids = [r[0] for r in kept_rows.select("vec_id").filter("vec_id is not null").distinct().orderBy("vec_id").limit(entries).collect()]
    first = kept_rows.filter(F.col("vec_id").isin(ids)).groupBy("vec_id").agg(F.min("cells").alias("cells")).orderBy("vec_id").collect()
    width = len(first[0]["cells"]) if first else 0
    start = [_whole(np.array(r["cells"], np.float64)[None, :], scale)[0].tolist() for r in first if len(r["cells"]) == width]
    books = Codebooks(tuple(tuple(tuple(int(v) for v in row[a:b]) for row in start) for a, b in _cuts(width, parts)))
    other = kept_rows.filter(F.size("cells") != width) if start else kept_rows
    other = other.select("vec_id", *carry, F.lit(None).cast("binary").alias("code"), F.lit(None).cast("long").alias("error"))
    if not start:
        return other, Codebooks(((),) * parts)
    kept = min(max(1, entries // 4), len(start) - 1)
    held = kept_rows.filter(F.size("cells") == width)
    moves = Moves(None, kept, kept)
    for r in range(rounds):
        held = stored(_assigned(held, carry, books, moves, width, scale, False), "vector-states")
        after = _updated(held, books, moves.next_kept, width, scale)
        shorter = _next_kept(held, moves.next_kept, min(moves.next_kept, entries // 8)) if r else moves.next_kept
        books, moves = after, Moves(books, moves.next_kept, shorter)
    done = _assigned(held, carry, books, moves, width, scale, True)
    return stored(done.unionByName(other), "vector-codes"), books


def label_errors(coded: DataFrame, label: str = "label") -> DataFrame:
    """``coded`` with ``label_error``: the errors summed over equal labels, nulls together; null beyond 2^63 - 1."""
    sums = coded.groupBy(F.col(label).alias("_label")).agg(F.try_sum("error").alias("label_error"))
    same = F.col(label).eqNullSafe(F.col("_label"))
    if sums.count() <= FEW_LABELS:
        return coded.join(F.broadcast(sums), same, "left").drop("_label")
    shares = sums.withColumn("_share", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = coded.withColumn("_own", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int"))
    return rows.join(shares, same & (F.col("_own") == F.col("_share")), "left").drop("_label", "_share", "_own")
