import re

import pytest
from pyspark.sql import functions as F

from seepage.llm import mixing


def shares(sizes, weights=(3, 1, 2), share=1.5, most=2):
    """Share out again and again until no source is above its limit."""
    names = sorted(s for s in sizes if s is not None) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    budget, full = share * sum(sizes.values()), {}
    while True:
        rest = [s for s in names if s not in full]
        left = budget - sum(full.values())
        level = {s: left * weight[s] / sum(weight[r] for r in rest) for s in rest}
        above = [s for s in rest if level[s] > most * sizes[s]]
        if not above:
            return full | level
        full |= {s: float(most * sizes[s]) for s in above}


def rows(mixed):
    return sorted((r.doc_id if r.doc_id is not None else -1, r.size, r.source_size, r.target, r.copies) for r in mixed.collect())


def test_targets_and_taken_words(spark, small):
    mixed = mixing.mix(small)
    found = rows(mixed)
    docs = {r.doc_id: r for r in small.collect()}
    size = {}
    for r in docs.values():
        size[r.source] = size.get(r.source, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    wanted = shares(size)
    taken = dict.fromkeys(size, 0)
    for doc_id, n, source_size, target, copies in found:
        source = docs[doc_id].source
        assert source_size == size[source] and target == pytest.approx(wanted[source], rel=1e-12)
        assert 0 <= copies <= 2
        taken[source] += n * copies
    longest = max(r[1] for r in found)
    assert len(found) == len(docs) and all(abs(taken[s] - wanted[s]) <= 2 * longest for s in size)
    assert rows(mixing.mix(small.repartition(7))) == found
    assert rows(mixing.mix(small, seed="other")) != found


def test_edges(documents):
    docs = documents((1, "a b c", None, "s"), (1, "a b c", None, "s"), (2, None, None, "s"), (3, "", None, "t"), (None, "x y", None, None), (4, "x " * 9000, None, "u"))
    found = rows(mixing.mix(docs))
    assert len(found) == 6 and {r[0] for r in found} == {-1, 1, 2, 3, 4}
    by_id = {r[0]: r for r in found}
    assert by_id[3][2:] == (0, 0.0, 0) and by_id[2][1] == 0 and by_id[4][1] == 9000
    assert mixing.mix(docs.filter("false")).collect() == []


def test_copies_cross_whole_numbers(spark):
    df = spark.range(200).select(F.col("id"), F.lit("s").alias("s"), (F.col("id") % 3 * (mixing.UNIT // 4)).alias("u"))
    copies = [r.copies for r in mixing.systematic(df, "u", "s", ["id"], "x").orderBy("id").collect()]
    total = sum(i % 3 for i in range(200)) / 4
    assert abs(sum(copies) - total) < 1
    for i in range(200):
        assert copies[i] in (int(i % 3 / 4), int(i % 3 / 4) + 1)
