"""Language identification by rank-order profiles of character n-grams.

A language's profile is the ranked list of its most frequent n-grams (one to
three characters of lower-cased words, padded with a blank).  A document is
ranked in the same way and compared with each profile: an n-gram is out of
place by the difference of its ranks, and by the length of the profile if the
language lacks it.  The language with the smallest sum wins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: N-grams in a profile, of a language and of a document.
PROFILE = 300
#: Most languages that a model may have (one profile each is sent to the tasks).
MOST_LANGUAGES = 2000
#: Texts whose n-grams are nearer to being out of place everywhere than this are rejected.
LEAST_SCORE = 0.05
#: Limit of a language as a share of the median score of its learned texts, with room for short ones, and the highest
#: limit: the texts of a language with few of them fit its profile too well.
LIMIT_SHARE, MOST_LIMIT = 0.6, 0.45
UNKNOWN = "und"

#: Characters whose n-grams are counted at once.
_SPAN = 1 << 20
_SHARDS = 16
_BITS = np.int64(21)
_BLANK = 0x20


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def _codes(text: str) -> np.ndarray:
    """Lower-cased letters with one blank around each word; empty without a letter."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    padded = np.full(len(points) + 2, _BLANK, np.int64)
    padded[1:-1] = np.where(_letters()[points], points, _BLANK)
    blank = padded == _BLANK
    keep = np.ones(len(padded), bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    out = padded[keep]
    return out if len(out) > 1 else out[:0]


def n_grams(codes: np.ndarray) -> np.ndarray:
    """All n-grams of 1 to 3 characters as numbers, without those of blanks or across words."""
    blank = codes == _BLANK
    two = codes[:-1] << _BITS | codes[1:]
    three = (two[:-1] << _BITS | codes[2:])[~blank[1:-1]]
    return np.concatenate((codes[~blank], two, three))


def ranked(grams: np.ndarray, most: int = PROFILE) -> np.ndarray:
    """The most frequent n-grams, most frequent first; of equally frequent ones the smaller number."""
    found, counts = np.unique(grams, return_counts=True)
    if len(found) > most:
        least = np.partition(counts, len(counts) - most)[len(counts) - most]
        sure = counts > least
        tied = np.flatnonzero(counts == least)[: most - int(sure.sum())]
        keep = np.sort(np.concatenate((np.flatnonzero(sure), tied)))
        found, counts = found[keep], counts[keep]
    return found[np.argsort(-counts, kind="stable")]


@dataclass(frozen=True)
class Profiles:
    languages: list[str]
    grams: np.ndarray  # all n-grams of any profile, ascending
    ranks: np.ndarray  # (n-gram, language); the profile's length where it is missing
    length: int

    def nearest(self, text: str | None) -> tuple[str, float]:
        """(language, score): 1 at equal rankings, 0 if no n-gram is known; ties go to the first language."""
        codes = _codes(text) if text else np.zeros(0, np.int64)
        if not len(codes) or not self.languages:
            return UNKNOWN, 0.0
        own = ranked(n_grams(codes), self.length)
        at = np.minimum(np.searchsorted(self.grams, own), len(self.grams) - 1)
        known = self.grams[at] == own
        places = np.arange(len(own))[:, None]
        ranks = np.where(known[:, None], self.ranks[at], self.length)
        apart = np.where(ranks < self.length, np.abs(ranks - places), self.length).sum(axis=0)
        best = int(np.argmin(apart))
        return self.languages[best], 1 - float(apart[best]) / (len(own) * self.length)


def learn(docs: DataFrame, length: int = PROFILE) -> Profiles:
    """Profiles from all rows (text, lang) whose lang is not null.

    Each task counts its n-grams per language and hands on one row for each
    n-gram.  The top of each language is found in shards of its n-grams first,
    so no task holds all n-grams of a language.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[str, list[np.ndarray]] = {}
        sizes: dict[str, int] = {}
        total: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def fold(lang: str) -> None:
            found, counts = np.unique(n_grams(np.concatenate(waiting.pop(lang))), return_counts=True)
            sizes[lang] = 0
            if lang in total:
                both = np.concatenate((total[lang][0], found))
                found, place = np.unique(both, return_inverse=True)
                counts = np.bincount(place, np.concatenate((total[lang][1], counts))).astype(np.int64)
            total[lang] = found, counts

        for batch in batches:
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
                codes = _codes(text or "")
                if len(codes):
                    waiting.setdefault(lang, []).append(codes)
                    sizes[lang] = sizes.get(lang, 0) + len(codes)
                    if sizes[lang] > _SPAN:
                        fold(lang)
        for lang in list(waiting):
            fold(lang)
        for lang, (found, counts) in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(found), pa.array(counts, pa.int64())], ["lang", "gram", "n"])

    named = docs.filter("lang is not null").select("lang").distinct().limit(MOST_LANGUAGES + 1).count()
    if named > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages; one profile each is sent to the tasks")
    counted = docs.filter("lang is not null").select("text", "lang").mapInArrow(run, "lang string, gram long, n long")
    summed = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n")).withColumn("shard", F.pmod(F.xxhash64("gram"), F.lit(_SHARDS)))
    best = (F.col("n").desc(), F.col("gram"))
    tops = summed.withColumn("place", F.row_number().over(Window.partitionBy("lang", "shard").orderBy(*best))).filter(F.col("place") <= length)
    # at most PROFILE n-grams of each shard of each of MOST_LANGUAGES languages
    rows = tops.select("lang", "gram", "n").toPandas()
    languages = sorted(rows["lang"].unique().tolist())
    profiles = []
    for lang in languages:
        own = rows[rows["lang"] == lang].sort_values(["n", "gram"], ascending=[False, True])["gram"].to_numpy(np.int64)
        profiles.append(own[:length])
    grams = np.unique(np.concatenate(profiles)) if profiles else np.zeros(0, np.int64)
    ranks = np.full((len(grams), len(languages)), length, np.int64)
    for k, own in enumerate(profiles):
        ranks[np.searchsorted(grams, own), k] = np.arange(len(own))
    return Profiles(languages, grams, ranks, length)


def predict(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """(doc_id, lang_pred, score) per row of ``docs`` (doc_id, text).

    A null text, or one without a letter, is ``und`` with score 0.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [profiles.nearest(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def learn_limits(docs: DataFrame, profiles: Profiles) -> dict[str, float]:
    """Least score per language, from all rows (doc_id, text, lang) whose lang is not null."""
    found = predict(docs.filter("lang is not null"), profiles).filter(F.col("lang_pred") != UNKNOWN)
    # one row per language
    middles = found.groupBy("lang_pred").agg(F.percentile_approx("score", 0.5, 10000).alias("middle")).collect()
    return {r["lang_pred"]: min(LIMIT_SHARE * r["middle"], MOST_LIMIT) for r in middles}


def keep_known(docs: DataFrame, profiles: Profiles, least: float = LEAST_SCORE, limits: dict[str, float] | None = None) -> DataFrame:
    """The rows of ``docs`` in one of the languages, with all columns, without a shuffle.

    A language has its own least score in ``limits``, or ``least``.
    """
    own = limits or {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [profiles.nearest(t) for t in batch.column("text").to_pylist()]
            yield batch.filter(pa.array([lang != UNKNOWN and score >= own.get(lang, least) for lang, score in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
