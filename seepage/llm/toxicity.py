"""Severity grades by cumulative-link ordinal regression over sparse text features.

Features of a text are the words in it and their first bytes, as hashes, each
weighted by 1 + log2 of how often it occurs.  One weight per feature is shared
by all grades; the ordered thresholds cut the same score:
P(grade > k) = sigmoid(score - threshold_k).  The expected severity is the sum
of these probabilities.

The model is fitted on a bounded sample of labelled rows (``PER_GRADE`` of each
grade, chosen by hash); everything else covers all rows.  Features enter if
their association with the grade is significant among all features tried.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seepage.llm.tables import stored
from seepage.llm.words import Words, not_alphanumeric, small_batches

#: Labelled rows of each grade that the model is fitted on, and features that it may have.
PER_GRADE, MOST_FEATURES = 3000, 20_000
#: Lengths in bytes of the word beginnings that are features, too.
PREFIXES = (4, 5, 6)
#: A text is rejected if its probability of any severity is at least this.
REJECT = 0.5

_TABLE_BITS = 20


@dataclass(frozen=True)
class Model:
    features: np.ndarray  # ascending hashes
    weights: np.ndarray
    thresholds: np.ndarray

    def lookup(self) -> np.ndarray:
        """Which low bits of a hash a feature has at all."""
        out = np.zeros(1 << _TABLE_BITS, bool)
        out[(self.features & np.uint64((1 << _TABLE_BITS) - 1)).astype(np.int64)] = True
        return out

    def above(self, scores: np.ndarray) -> np.ndarray:
        """P(grade > k) for each k, one row per text."""
        return 1 / (1 + np.exp(-np.clip(scores[:, None] - self.thresholds[None, :], -500, 500)))


def _features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
    """(row, hash) of each word and word beginning of a batch, and its number of rows."""
    words = Words(texts, not_alphanumeric(), PREFIXES)
    row = words.row_of_word()
    rows, hashes = [row], [words.hashes]
    for heads in words.heads:
        longer = heads != 0
        rows.append(row[longer])
        hashes.append(heads[longer])
    return np.concatenate(rows), np.concatenate(hashes), words.n_rows


def _values(rows: np.ndarray, places: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, feature) with 1 + log2 of their count."""
    keys, counts = np.unique(rows.astype(np.int64) * n + places, return_counts=True)
    return keys // n, keys % n, 1 + np.log2(counts)


def scores(texts: pa.Array, model: Model, table: np.ndarray) -> np.ndarray:
    rows, hashes, n_rows = _features(texts)
    out = np.zeros(n_rows)
    if not len(model.features):
        return out
    hit = table[(hashes & np.uint64((1 << _TABLE_BITS) - 1)).astype(np.int64)]
    rows, hashes = rows[hit], hashes[hit]
    places = np.minimum(np.searchsorted(model.features, hashes), len(model.features) - 1)
    equal = model.features[places] == hashes
    row, feature, value = _values(rows[equal], places[equal], len(model.features))
    return out + np.bincount(row, value * model.weights[feature], minlength=n_rows)


def _select(per_row: list[np.ndarray], grades: np.ndarray) -> np.ndarray:
    """Features whose presence differs between severe and harmless texts beyond chance.

    The G statistic of the 2x2 table must exceed 2 ln of the number of features
    tried (and 4 more), so that hardly one of them passes by chance.
    """
    severe = grades > 0
    n1, n0 = int(severe.sum()), int((~severe).sum())
    if not n1 or not n0:
        return np.zeros(0, np.uint64)
    found, counts1 = np.unique(np.concatenate([f for f, s in zip(per_row, severe) if s] or [np.zeros(0, np.uint64)]), return_counts=True)
    found, counts1 = found[counts1 >= 3], counts1[counts1 >= 3]
    counts0 = np.zeros(len(found), np.int64)
    for f, s in zip(per_row, severe):
        if not s and len(found):
            at = np.minimum(np.searchsorted(found, f), len(found) - 1)
            counts0[at[found[at] == f]] += 1
    n, c = n0 + n1, counts0 + counts1
    g = np.zeros(len(found))
    for seen, rows, share in ((counts1, n1, c), (counts0, n0, c), (n1 - counts1, n1, n - c), (n0 - counts0, n0, n - c)):
        expected = rows * share / n
        g += 2 * np.where(seen > 0, seen * np.log(np.maximum(seen, 1) / np.maximum(expected, 1e-12)), 0)
    g = np.where(g > 2 * np.log(max(len(found), 2)) + 4, g, 0)
    best = np.lexsort((found, -g))[:MOST_FEATURES]
    return np.sort(found[best[g[best] > 0]])


def fit(texts: list[str | None], grades: list[int], row_weights: list[float], steps: int = 400, ridge: float = 1e-5) -> Model:
    """Maximum likelihood with a ridge, by full-batch Adam steps; the thresholds stay ordered."""
    grades, row_weights = np.asarray(grades, np.int64), np.asarray(row_weights, float)
    per_row: list[np.ndarray] = []
    counted: list[tuple[np.ndarray, np.ndarray]] = []
    column = pa.array(texts, pa.large_string())
    for batch in small_batches(iter([pa.RecordBatch.from_arrays([column], ["text"])]), "text"):
        rows, hashes, n = _features(batch.column("text"))
        order = np.argsort(rows, kind="stable")
        cuts = np.searchsorted(rows[order], np.arange(n + 1))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            found, counts = np.unique(hashes[order[a:b]], return_counts=True)
            per_row.append(found)
            counted.append((found, counts))
    features = _select(per_row, grades)
    row, column_of, value = [], [], []
    for i, (found, counts) in enumerate(counted):
        if len(features) and len(found):
            at = np.minimum(np.searchsorted(features, found), len(features) - 1)
            hit = features[at] == found
            row.append(np.full(int(hit.sum()), i))
            column_of.append(at[hit])
            value.append(1 + np.log2(counts[hit]))
    row, column_of = (np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in (row, column_of))
    value = np.concatenate(value) if value else np.zeros(0)
    levels = max(1, int(grades.max(initial=0)))
    total = row_weights.sum() or 1.0
    # the first threshold and the logarithms of the steps to the next ones
    free = np.concatenate((np.zeros(len(features)), [2.0], np.zeros(levels - 1)))
    m, v = np.zeros_like(free), np.zeros_like(free)
    for step in range(1, steps + 1):
        weights, gaps = free[: len(features)], np.exp(free[len(features) + 1 :])
        thresholds = free[len(features)] + np.concatenate(([0.0], np.cumsum(gaps)))
        score = np.bincount(row, value * weights[column_of], minlength=len(grades))
        edge = np.clip(score[:, None] - thresholds[None, :], -500, 500)
        above = 1 / (1 + np.exp(-edge))
        padded = np.concatenate((np.ones((len(grades), 1)), above, np.zeros((len(grades), 1))), axis=1)
        slope = padded * (1 - padded)
        each = np.arange(len(grades))
        chance = np.maximum(padded[each, grades] - padded[each, grades + 1], 1e-12)
        # d(-log chance)/d(score) and /d(threshold k)
        by_score = -row_weights * (slope[each, grades] - slope[each, grades + 1]) / chance
        by_threshold = np.zeros(levels + 2)
        np.add.at(by_threshold, grades, row_weights * slope[each, grades] / chance)
        np.add.at(by_threshold, grades + 1, -row_weights * slope[each, grades + 1] / chance)
        cut = by_threshold[1:-1]
        gradient = np.zeros_like(free)
        gradient[: len(features)] = np.bincount(column_of, value * by_score[row], minlength=len(features)) / total + ridge * weights
        gradient[len(features)] = cut.sum() / total
        if levels > 1:
            gradient[len(features) + 1 :] = np.cumsum(cut[::-1])[::-1][1:] * gaps / total
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        free = free - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    gaps = np.exp(free[len(features) + 1 :])
    thresholds = free[len(features)] + np.concatenate(([0.0], np.cumsum(gaps)))
    return Model(features, free[: len(features)].copy(), thresholds)


def train(docs: DataFrame, grades: DataFrame, per_grade: int = PER_GRADE, behind: float = 1.0) -> Model:
    """A model for (doc_id, text) from (doc_id, grade) rows, grade 0 for harmless.

    Of each grade the ``per_grade`` rows with the least hash are used, with
    weights that restore the shares of the grades.  Null ids, grades below 0
    and null grades are left out; of several grades of one id the highest
    counts.  A row of a grade above 0 stands for ``behind`` rows.  Without
    labels nothing is rejected.
    """
    known = grades.filter("doc_id is not null and grade >= 0").groupBy("doc_id").agg(F.max("grade").cast("int").alias("grade"))
    sizes = {r["grade"]: r["count"] for r in known.groupBy("grade").count().collect()}  # one row per grade
    harmless = Model(np.zeros(0, np.uint64), np.zeros(0), np.array([50.0]))
    if not sizes:
        return harmless
    samples = None
    for grade, size in sorted(sizes.items()):
        part = known.filter(F.col("grade") == grade).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_grade)
        part = part.withColumn("weight", F.lit(size / min(size, per_grade) * (behind if grade else 1.0)))
        samples = part if samples is None else samples.unionByName(part)
    # at most per_grade ids of each grade are sent to the tasks; of an id with several rows the least text counts
    found = docs.select("doc_id", "text").join(F.broadcast(samples), "doc_id")
    rows = found.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("grade").alias("grade"), F.min("weight").alias("weight"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(r["doc_id"], r["text"] or "", r["grade"], r["weight"]) for b in batches for r in b.to_pylist()]
        if not rows:
            return
        rows.sort(key=lambda r: (r[0], r[1]))
        model = fit([r[1] for r in rows], [r[2] for r in rows], [r[3] for r in rows])
        yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (model.features, model.weights, model.thresholds)], ["features", "weights", "thresholds"])

    found = rows.repartition(1).mapInArrow(run, "features binary, weights binary, thresholds binary").first()
    if found is None:  # no labelled text
        return harmless
    return Model(np.frombuffer(found["features"], np.uint64), np.frombuffer(found["weights"], np.float64), np.frombuffer(found["thresholds"], np.float64))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, severity, grade, toxic_share, toxic) per row: what the thresholds cut, expected
    severity, likeliest grade, probability of any severity and whether it is at least ``REJECT``.

    Null and empty texts have no features and the severity of the thresholds alone.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = model.lookup()
        for batch in small_batches(batches, "text"):
            score = scores(batch.column("text"), model, table)
            above = model.above(score)
            padded = np.concatenate((np.ones((len(above), 1)), above, np.zeros((len(above), 1))), axis=1)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array(score), pa.array(above.sum(axis=1)), pa.array(np.argmax(-np.diff(padded, axis=1), axis=1).astype(np.int32)),
                pa.array(above[:, 0]), pa.array(above[:, 0] >= REJECT)], ["doc_id", "score", "severity", "grade", "toxic_share", "toxic"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double, severity double, grade int, toxic_share double, toxic boolean")


def keep_harmless(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that are not rejected, with all columns, without a shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = model.lookup()
        for batch in small_batches(batches, "text"):
            yield batch.filter(pa.array(model.above(scores(batch.column("text"), model, table))[:, 0] < REJECT))

    return docs.mapInArrow(run, docs.schema)


def train_from_labels(docs: DataFrame, labels: DataFrame, per_grade: int = PER_GRADE) -> Model:
    """A model with grades 0 harmless, 1 toxic, 2 severely toxic from binary labels (doc_id, toxic).

    Binary labels do not say how severe a text is.  A first model is fitted to
    them as they are; of the toxic texts in its sample, those that hold more of
    the cues it found than the middle one count as severe.  The second model is
    fitted to these grades.
    """
    marked = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("grade"))
    marked = stored(marked.select("doc_id", F.least("grade", F.lit(1)).alias("grade")), "labels")
    first = train(docs, marked, per_grade)
    toxic = marked.filter("grade > 0").orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_grade).select("doc_id")
    # at most per_grade ids are sent to the tasks
    rated = stored(predict(docs.select("doc_id", "text").join(F.broadcast(toxic), "doc_id"), first).groupBy("doc_id").agg(F.max("score").alias("score")), "rated")
    middle = rated.agg(F.percentile_approx("score", 0.5)).first()[0]
    if middle is None:
        return first
    severe = (F.col("score") > middle).cast("int")
    graded = rated.select("doc_id", (severe + 1).alias("grade")).unionByName(marked.filter("grade = 0"))
    return train(docs, graded, per_grade, (marked.filter("grade > 0").count() or 1) / max(1, rated.count()))
