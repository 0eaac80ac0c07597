"""Exact top-k search by columnar branch and bound.

Vectors lie in blocks in vertical layout: one row per dimension.  A block of
queries takes the candidates of a block dimension group by dimension group.
After each group the score so far plus the most that the remaining dimensions
can add (the product of both remaining norms) is compared with the k-th best
score that the query has already; candidates that cannot reach it are dropped
and the surviving columns are moved together.  Scores are integers, so equal
bounds are kept and the result is exact.  Where components are so large that
float64 rounds the products, bounds leave room for that and what survives is
multiplied again as whole numbers.

Queries and candidates meet as blocks: every slice of candidate blocks takes
every query block, in tasks of bounded size.  Neither side is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seepage.llm.tables import stored

#: Hits per query, dimensions per step, vectors of a block, queries of a block, candidate blocks of a task.
K, STEP, BLOCK, QUERIES, SLICE = 20, 16, 4096, 1024, 8


#: Whole numbers up to this are exact in float64.
_EXACT = 2.0**53


def quantized(embedding: Column, scale: int) -> Column:
    """floor(scale * x) of every component as a double, or null if a component is null or not finite (or beyond 1e300)."""
    wide = F.transform(embedding, lambda x: x.cast("double"))
    bad = F.exists(wide, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) > 1e300))
    # a double beyond 2^52 is a whole number
    return F.when(~bad, F.transform(wide, lambda x: F.when(F.abs(x * scale) < 2**52, F.floor(x * scale).cast("double")).otherwise(x * scale)))


def _tail_norms(vertical: np.ndarray, step: int) -> np.ndarray:
    """Norms of what follows each dimension group: row g is what is left after group g."""
    squares = vertical**2
    groups = [squares[at:].sum(axis=0) for at in range(step, vertical.shape[0] + step, step)]
    return np.sqrt(np.array(groups))


class Best:
    """The k best (score, id) of each query so far; higher scores, then smaller ids."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.scores = [np.zeros(0, np.int64) for _ in range(n)]
        self.ids = [np.zeros(0, np.int64) for _ in range(n)]
        self.floor = np.full(n, -np.inf)

    def add(self, q: int, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate((self.scores[q], scores)), np.concatenate((self.ids[q], ids))
        if scores.dtype == object:
            order = np.array(sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i]))[: self.k], np.int64)
        else:
            order = np.lexsort((ids, -scores))[: self.k]
        self.scores[q], self.ids[q] = scores[order], ids[order]
        if len(order) == self.k:
            self.floor[q] = self.scores[q][-1]


def search_block(queries: np.ndarray, query_ids: np.ndarray, query_tails: np.ndarray, candidates: np.ndarray, ids: np.ndarray, best: Best, step: int) -> int:
    """Fold one candidate block (dimensions x vectors) into ``best``; returns the products of dimensions made."""
    tails = _tail_norms(candidates, step)
    dims, made = candidates.shape[0], 0
    first = queries[:step].T @ candidates[:step]
    made += first.size * min(step, dims)
    for q in range(len(query_ids)):
        alive = None  # all columns
        score = first[q]
        at, group = step, 0
        floor = best.floor[q]
        while at < dims:
            bound = score + query_tails[group, q] * (tails[group] if alive is None else tails[group, alive])
            # norms are rounded: half a unit of score is room enough
            keep = np.flatnonzero(bound >= floor - 0.5)
            if not len(keep):
                score, alive = score[:0], keep
                break
            alive = keep if alive is None else alive[keep]
            # survivors are moved together before the next group
            score = score[keep] + queries[at : at + step, q] @ candidates[at : at + step][:, alive]
            made += len(alive) * min(step, dims - at)
            at, group = at + step, group + 1
        found = ids if alive is None else ids[alive]
        hits = (score >= floor) & (found != query_ids[q])
        if hits.any():
            score, found = np.rint(score[hits]).astype(np.int64), found[hits]
            if len(score) > 4 * best.k:
                least = np.partition(score, len(score) - best.k)[len(score) - best.k]
                score, found = score[score >= least], found[score >= least]
            best.add(q, score, found)
    return made


def search_wide(queries: np.ndarray, query_ids: np.ndarray, candidates: np.ndarray, ids: np.ndarray, best: Best) -> None:
    """``search_block`` for components whose products float64 rounds: rounded scores leave out what is surely too low."""
    rough = queries.T @ candidates
    room = np.abs(queries).T @ np.abs(candidates) * (4 * len(queries) * 2.0**-52) + 1
    for q in range(len(query_ids)):
        sure = (rough[q] - room[q])[ids != query_ids[q]]
        # at least k candidates reach this
        least = np.partition(sure, len(sure) - best.k)[len(sure) - best.k] if len(sure) >= best.k else -np.inf
        keep = np.flatnonzero((rough[q] + room[q] >= max(least, float(best.floor[q]) * (1 - 2.0**-50 * np.sign(float(best.floor[q]))))) & (ids != query_ids[q]))
        own = [int(x) for x in queries[:, q].tolist()]
        scores = np.empty(len(keep), object)
        scores[:] = [sum(a * int(b) for a, b in zip(own, column)) for column in candidates[:, keep].T.tolist()]
        best.add(q, scores, ids[keep])


def _is_exact(queries: np.ndarray, candidates: np.ndarray) -> bool:
    """All sums of products are whole numbers that float64 holds."""
    if not queries.size or not candidates.size:
        return True
    return float(np.abs(queries).max()) * float(np.abs(candidates).max()) * len(queries) < _EXACT


def _blocks(vectors: DataFrame, size: int, name: str) -> DataFrame:
    """(block, n, ids, dims, cells): at most ``size`` vectors each, of one length, dimension by dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            widths = np.asarray(batch.column("codes").value_lengths())
            for width in np.unique(widths).tolist():
                part = batch.filter(pa.array(widths == width))
                for start in range(0, part.num_rows, size):
                    some = part.slice(start, size)
                    cells = some.column("codes").flatten().to_numpy(zero_copy_only=False).reshape(some.num_rows, width).T
                    yield pa.RecordBatch.from_arrays([
                        pa.array([int(some.column("vec_id")[0].as_py())], pa.int64()), pa.array([width], pa.int32()),
                        pa.array([some.column("vec_id").to_numpy().astype(np.int64).tobytes()], pa.binary()),
                        pa.array([np.ascontiguousarray(cells, _kind(cells)).tobytes()], pa.binary())], ["block", "dims", "ids", "cells"])

    return stored(vectors.mapInArrow(run, "block long, dims int, ids binary, cells binary"), name)


def _kind(cells: np.ndarray) -> type:
    """The narrowest type that holds all components."""
    return np.int32 if not cells.size or np.abs(cells).max() < 2**31 else np.float64


def _open(ids: bytes, cells: bytes, dims: int) -> tuple[np.ndarray, np.ndarray]:
    own = np.frombuffer(ids, np.int64)
    kind = np.int32 if len(cells) <= 4 * dims * len(own) else np.float64
    return own, np.frombuffer(cells, kind).reshape(dims, len(own)).astype(np.float64)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, step: int = STEP) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` largest inner products of each query with other vectors.

    Both tables hold (vec_id long, codes array<double>) of whole numbers.  Rows with null ids or
    codes take no part; vectors of another length than the query's are no
    candidates.  A query never finds a vector of its own id; vectors that are
    given twice are found twice; a query that is given twice asks once.  Ties go to the smaller id.  Scores are exact
    for whole components of any size; one beyond the range of a long is given as the nearest long.
    """
    usable = "vec_id is not null and codes is not null"
    held = _blocks(vectors.filter(usable).select(F.col("vec_id").cast("long"), F.col("codes").cast("array<double>")), BLOCK, "candidates")
    asked = _blocks(queries.filter(usable).select(F.col("vec_id").cast("long"), F.col("codes").cast("array<double>")).distinct(), QUERIES, "queries")
    slices = max(1, -(-held.count() // SLICE))
    sides = max(1, asked.count())

    def part(n: int) -> Column:
        return F.pmod(F.xxhash64("block", "ids"), F.lit(n)).cast("int")

    # a candidate block goes to each group of query blocks, a query block to each slice of candidate blocks
    candidates = held.select("*", part(slices).alias("slice"), F.explode(F.sequence(F.lit(0), F.lit(sides - 1))).alias("side"))
    askers = asked.select("*", part(sides).alias("side"), F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"))

    def search(asking: pa.Table, offered: pa.Table) -> pa.Table:
        rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for q in asking.to_pylist():
            query_ids, wanted = _open(q["ids"], q["cells"], q["dims"])
            tails, best = _tail_norms(wanted, step), Best(len(query_ids), k)
            for places, cells, dims in zip(offered.column("ids"), offered.column("cells"), offered.column("dims")):
                if dims.as_py() == q["dims"]:
                    ids, block = _open(places.as_py(), cells.as_py(), q["dims"])
                    if _is_exact(wanted, block):
                        search_block(wanted, query_ids, tails, block, ids, best, step)
                    else:
                        search_wide(wanted, query_ids, block, ids, best)
            for i, query_id in enumerate(query_ids.tolist()):
                rows.append((np.full(len(best.ids[i]), query_id), best.ids[i], best.scores[i]))
        columns = [np.concatenate([r[c] for r in rows]) if rows else np.zeros(0, np.int64) for c in range(3)]
        if columns[2].dtype == object:
            columns[2] = np.array([max(-(2**63), min(2**63 - 1, s)) for s in columns[2].tolist()], np.int64)
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["query_id", "vec_id", "score"])

    found = askers.groupBy("slice", "side").cogroup(candidates.groupBy("slice", "side")).applyInArrow(search, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
