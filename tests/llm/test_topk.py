import random

import numpy as np
from pyspark.sql import functions as F

from seepage.llm import topk


def brute(rows, queries, k):
    out = []
    for q, v in queries:
        hits = sorted(((-int(np.dot(v, w)), i) for i, w in rows if i != q and len(w) == len(v)))[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(hits)]
    return sorted(out)


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 32)
    monkeypatch.setattr(topk, "QUERIES", 5)
    monkeypatch.setattr(topk, "SLICE", 2)
    rng = random.Random(4)
    rows = [(i, [rng.randint(-8, 8) * (3 if i % 7 == 0 else 1) for _ in range(40)]) for i in range(300)]
    rows += [(1000 + i, rows[i][1]) for i in range(30)]  # ties
    df = spark.createDataFrame(rows, "vec_id long, codes array<long>").repartition(4)
    queries = df.filter("vec_id % 20 = 0")
    found = sorted(tuple(r) for r in topk.top_k(df, queries, 7, 8).collect())
    assert found == brute(rows, [r for r in rows if r[0] % 20 == 0], 7)


def test_bounds_drop_candidates():
    rng = np.random.default_rng(1)
    centres = rng.integers(-40, 40, (5, 64))
    block = np.concatenate([c + rng.integers(-3, 4, (200, 64)) for c in centres]).T.astype(float)
    ids = np.arange(1000)
    queries = block[:, :20].copy()
    best = topk.Best(20, 5)
    topk.search_block(queries, ids[:20], topk._tail_norms(queries, 16), block, ids, best, 16)
    made = topk.search_block(queries, ids[:20], topk._tail_norms(queries, 16), block, ids, best, 16)
    assert made < 0.6 * 20 * 1000 * 64


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [0.5, -0.26]), (20, [1.0, 1.0]), (1, [nan, 0.0]), (2, None), (3, [inf, 1.0]), (None, [1.0, 1.0]), (4, [0.1]), (5, [0.5, None]), (6, [0.5, -0.26]), (6, [0.5, -0.26])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("x"))
    codes = df.select("vec_id", topk.quantized(F.col("embedding"), 64).alias("codes"))
    known = {r.vec_id: r.codes for r in codes.collect()}
    assert known[0] == [32, -17] and known[1] is None and known[5] is None
    found = sorted(tuple(r) for r in topk.top_k(codes, codes.filter("vec_id % 20 = 0"), 3).collect())
    assert [r for r in found if r[0] == 0] == [(0, 1, 6, 1313), (0, 2, 6, 1313), (0, 3, 20, 960)]
    assert len([r for r in found if r[0] == 20]) == 3
    assert topk.top_k(codes.filter("false"), codes.filter("false")).collect() == []


def test_large_components_are_exact(spark):
    rng = random.Random(8)
    rows = [(i, [rng.choice([1e9, -3e9, 64.0, 2.0**40 + 1, 0.0, float(rng.randrange(10**6))]) for _ in range(6)]) for i in range(120)]
    rows += [(500, [1e9, 0.0, 0.0, 0.0, 0.0, 0.0]), (501, [64.0, 0.0, 0.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, codes array<double>").repartition(3)
    found = sorted(tuple(r) for r in topk.top_k(df, df.filter("vec_id % 20 = 0"), 6).collect())
    plain = []
    for q, v in [r for r in rows if r[0] % 20 == 0]:
        hits = sorted((-sum(int(a) * int(b) for a, b in zip(v, w)), i) for i, w in rows if i != q)[:6]
        plain += [(q, n + 1, i, max(-(2**63), min(2**63 - 1, -s))) for n, (s, i) in enumerate(hits)]
    wanted = sorted(plain)
    # scores beyond a long are equal in the result; the others and their order are not
    assert [r[:2] + r[3:] for r in found] == [r[:2] + r[3:] for r in wanted]
    assert [r for r in found if abs(r[3]) < 2**63 - 1] == [r for r in wanted if abs(r[3]) < 2**63 - 1]
    codes = spark.createDataFrame([(0, [1e9]), (1, [64.0]), (2, [3e38])], "vec_id long, embedding array<double>").select("vec_id", topk.quantized(F.col("embedding"), 64).alias("codes"))
    assert {r.vec_id: r.codes for r in codes.collect()} == {0: [64e9], 1: [4096.0], 2: [3e38 * 64]}
