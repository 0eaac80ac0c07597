import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seepage.llm import vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int, state string, code string, error string"


def brute(rows, parts, entries, rounds, scale=256):
    """Plain k-means in whole numbers: ({row: (code, error)}, codebooks)."""
    good = [(i, [int(np.floor(np.float64(x) * scale)) for x in v]) for i, v in rows]
    width = len(good[0][1])
    cuts = [(p * width // parts, (p + 1) * width // parts) for p in range(parts)]
    first = [dict(reversed(good))[i] for i in sorted({i for i, _ in good})[:entries]]
    books = [[v[a:b] for v in first] for a, b in cuts]

    def nearest(p, piece):
        return min((sum((x - y) ** 2 for x, y in zip(piece, e)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        for p, (a, b) in enumerate(cuts):
            own = [nearest(p, v[a:b])[1] for _, v in good]
            for k in range(len(books[p])):
                mine = [v[a:b] for (_, v), o in zip(good, own) if o == k]
                if mine:
                    books[p][k] = [sum(c) // len(mine) for c in zip(*mine)]
    out = []
    for i, v in good:
        best = [nearest(p, v[a:b]) for p, (a, b) in enumerate(cuts)]
        out.append((i, bytes(k for _, k in best), sum(d for d, _ in best)))
    digest = hashlib.sha256(",".join(str(x) for part in books for e in part for x in e).encode()).hexdigest()
    return sorted(out), digest


def frame(spark, rows):
    return spark.createDataFrame([(i, v, None, "x", "x", "x") for i, v in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize("rounds", [0, 1, 2, 6])
def test_against_plain_k_means(spark, rounds):
    rng = random.Random(rounds)
    centres = [[rng.gauss(0, 1) for _ in range(12)] for _ in range(9)]
    # coarse components make many ties
    rows = [(i, [round(c + rng.gauss(0, 0.4), 1) for c in rng.choice(centres)]) for i in range(400)]
    coded, books = vector_codes.compress(frame(spark, rows), parts=4, entries=16, rounds=rounds, scale=8)
    found = sorted((r.vec_id, bytes(r.code), r.error) for r in coded.collect())
    wanted, digest = brute([(i, [float(np.float32(x)) for x in v]) for i, v in rows], 4, 16, rounds, 8)
    assert found == wanted and books.sha256() == digest


def test_bounds_spare_measurements():
    rng = np.random.default_rng(2)
    before = rng.integers(-1000, 1000, (64, 4))
    x = (before[rng.integers(0, 64, 5000)] + rng.integers(-60, 60, (5000, 4))).astype(float)
    after = before + rng.integers(-3, 4, before.shape)
    own, near, upper, lower, _ = vector_codes._nearest(vector_codes._distances(x, before.tolist(), True), 16)
    depths = np.zeros(18, np.int64)
    vector_codes._walk(x, after.tolist(), vector_codes._moved(before.tolist(), after.tolist()), own, near, upper, lower, depths)
    assert (own == vector_codes._distances(x, after.tolist(), True).argmin(1)).all()
    assert depths.sum() == 5000 and depths[0] > 4000 and depths[-1] == 0
    d = np.sqrt(vector_codes._distances(x, after.tolist(), True))
    rest = np.sort(d, axis=1)
    assert (lower[:, 0] <= rest[:, 1]).all() and (upper >= rest[:, 0]).all()


def test_large_components_are_exact(spark):
    rows = [(0, [1e9, -3.5]), (1, [3e38, 1.0]), (2, [-3e38, 0.25]), (3, [1e9, -3.0]), (4, [5.0, 5.0]), (5, [1.5e9, 2.0])]
    coded, books = vector_codes.compress(frame(spark, rows), parts=2, entries=3, rounds=2)
    wanted, digest = brute([(i, [float(np.float32(x)) for x in v]) for i, v in rows], 2, 3, 2)
    found = sorted((r.vec_id, bytes(r.code), r.error) for r in coded.collect())
    assert books.sha256() == digest
    assert found == [(i, code, e if e < 2**63 else None) for i, code, e in wanted]


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(7, [1.0, 2.0]), (7, [1.0, 2.0]), (3, [0.0, 0.5]), (None, [1.0, 1.0]), (1, [nan, 1.0]), (2, [inf, 0.0]), (4, None), (5, [None, 1.0]), (6, [1.0]), (8, [])]
    coded, books = vector_codes.compress(frame(spark, rows), ["label"], parts=16, entries=64)
    found = sorted(((r.vec_id is None, r.vec_id or 0), r.code is not None, r.error) for r in vector_codes.label_errors(coded).collect())
    assert [f[0][1] for f in found] == [3, 6, 7, 7, 8, 0]
    assert [f[1] for f in found] == [True, False, True, True, False, True]
    assert len(books.entries) == 16 and all(len(part) == 2 for part in books.entries)
    empty = frame(spark, rows).filter(F.col("vec_id") > 100)
    coded, books = vector_codes.compress(empty, ["label"])
    assert coded.collect() == [] and books.sha256() == hashlib.sha256(b"").hexdigest()
    assert vector_codes.label_errors(coded).collect() == []


def test_labels_in_shares(spark, monkeypatch):
    rows = [(i, i % 3 if i % 4 else None, i, b"x") for i in range(60)]
    coded = spark.createDataFrame(rows, "vec_id long, label int, error long, code binary")
    wanted = sorted((r.vec_id, r.label_error) for r in vector_codes.label_errors(coded).collect())
    monkeypatch.setattr(vector_codes, "FEW_LABELS", 0)
    assert sorted((r.vec_id, r.label_error) for r in vector_codes.label_errors(coded).collect()) == wanted
    assert dict(wanted)[0] == sum(range(0, 60, 4))
