import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from seepage.llm import ngram_lm
from seepage.llm.queries import op12_ngram_lm

SF = "/root/testdata/sf0.001"


def words(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lowered) + [None]


def brute(rows, order=3):
    """Plain counts: {doc_id: (held out, tokens, known, N, base)} and the model's score without a filter's errors."""
    held = {i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows}
    training = [words(t) for i, t in rows if not held[i]]
    grams = [Counter() for _ in range(order + 1)]
    for tokens in training:
        padded = ["", *tokens]
        for n in range(1, order + 1):
            grams[n].update(tuple(padded[i - n + 1 : i + 1]) for i in range(max(1, n - 1), len(padded)))
    total, distinct = sum(grams[1].values()), len(grams[1])
    means = []
    for n in range(order + 1):
        by = {}
        for c in grams[n].values():
            by.setdefault(c.bit_length(), []).append(c)
        means.append({v: sum(x) / len(x) for v, x in by.items()})
    grams[1][("",)] = len(training)

    def count(gram):
        c = grams[len(gram)][gram]
        if len(gram) == 1 or not c:
            return c
        return min(means[len(gram)][c.bit_length()], count(gram[:-1]), count(gram[1:]))

    def p(gram):
        if len(gram) == 1:
            return ((count(gram) if gram != ("",) else 0) + 0.1) / (total + 0.1 * (distinct + 1))
        before = count(gram[:-1])
        weight = max(before, 1) ** 0.85
        return (count(gram) + weight * p(gram[1:])) / (before + weight)

    out = {}
    for i, t in rows:
        tokens = words(t)
        padded = ["", *tokens]
        own = [grams[1][(w,)] for w in tokens]
        base = sum(math.log10((c + 0.1) / (total + 0.1 * (distinct + 1))) for c in own)
        model = sum(math.log10(p(tuple(padded[max(0, k - order + 1) : k + 1]))) for k in range(1, len(padded)))
        out[i] = (held[i], len(tokens), sum(c > 0 for c in own), total, base, model)
    return out


def test_query_against_plain_counts(spark, small):
    wanted = brute([(r.doc_id, r.text) for r in small.collect()])
    rows = op12_ngram_lm(spark, SF).collect()
    assert len(rows) == len(wanted)
    apart = []
    for r in rows:
        exact = wanted[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == exact[:4]
        assert r.base_score == pytest.approx(exact[4], rel=1e-9)
        # a false positive makes an unseen n-gram likelier
        apart.append((r.score - exact[5]) / r.n_tokens)
    apart = np.array(apart)
    assert np.median(np.abs(apart)) < 0.03 and abs(np.mean(apart)) < 0.03 and np.quantile(np.abs(apart), 0.99) < 0.5, np.quantile(apart, [0, 0.01, 0.5, 0.99, 1])
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_both_ways_agree(spark, small, monkeypatch, order):
    monkeypatch.setattr(ngram_lm, "SEGMENT", 20_000)
    monkeypatch.setattr(ngram_lm, "FLUSH", 50_000)
    model = ngram_lm.train(small.filter("doc_id % 3 > 0"), order)
    assert model.bits >= 2
    near = sorted(map(tuple, ngram_lm.score(small, model).collect()))
    far = sorted(map(tuple, ngram_lm.score(small, model, held=0).collect()))
    assert near == far and len(near) == small.count()


def test_filter_gives_levels_and_few_false_positives():
    rng = np.random.default_rng(5)
    keys = np.unique(rng.integers(0, 1 << 40, 50_000).astype(np.uint64))
    counts = np.minimum(rng.zipf(1.6, len(keys)), 1 << 30)
    size, data = ngram_lm.bloom(keys, counts)
    bits = np.frombuffer(data, np.uint8)
    wanted = ngram_lm.levels_of(counts)
    found = ngram_lm.probe(bits, 0, size, keys)
    # never less, seldom more
    assert (found >= wanted).all() and (found > wanted).mean() < 0.09
    assert (ngram_lm.probe(bits, 0, size, keys + np.uint64(1 << 41)) > 0).mean() < 0.03
    assert ngram_lm.levels_of(np.array([1, 2, 3, 4, 7, 8])).tolist() == [1, 2, 2, 3, 3, 4]


def test_seen_words_are_likelier(spark, documents):
    docs = documents((1, "a b a b c"), (2, "a b d"), (3, "A"))
    model = ngram_lm.train(docs)
    ends = ngram_lm.score(documents(*[(i, f"a {w}") for i, w in enumerate("abcd")], (9, "a"), (10, "a never-seen")), model)
    one = {r.doc_id: r.score for r in ends.collect()}
    assert all(v < 0 for v in one.values())
    assert one[1] > one[0] and one[10] < one[0]


def test_edges(spark, documents):
    docs = documents((1, "Ab ab"), (1, "Ab ab"), (2, None), (3, ""), (None, "ab c ab"), (4, "x" * 300_000), (5, "w " * 50_000))
    model = ngram_lm.train(docs)
    assert (model.tokens, model.distinct, model.texts) == (2 * 3 + 1 + 1 + 3 + 2 + 50_001, 5, 7)
    found = {str(r.doc_id): r for r in ngram_lm.score(docs, model).collect()}
    assert ngram_lm.score(docs, model).count() == 7
    assert found["2"].n_tokens == 1 and found["2"].score == found["3"].score < 0
    assert found["5"].n_known == 50_001
    nothing = ngram_lm.train(docs.filter(F.col("doc_id") > 100))
    alone = ngram_lm.score(docs, nothing).collect()
    assert len(alone) == 7 and all(r.score == 0 and r.base_score == 0 and r.n_known == 0 for r in alone)
    assert ngram_lm.score(docs.filter(F.col("doc_id") > 100), nothing).collect() == []


def test_a_block_asks_many_segments_at_once(spark, small, monkeypatch):
    monkeypatch.setattr(ngram_lm, "SEGMENT", 2_000)
    model = ngram_lm.train(small)
    assert model.bits >= 6
    blocks, sent = 4, []

    def counted(self, *a, repartition=type(small).repartition):
        sent.append(self.count())
        return repartition(self, *a)

    texts = small.repartition(blocks)
    near = sorted(map(tuple, ngram_lm.score(texts, model).collect()))
    monkeypatch.setattr(type(small), "repartition", counted)
    far = ngram_lm.score(texts, model, held=0)
    # segments and keys on the way there
    assert sent[0] - model.kept.count() <= blocks * 3 * (2**model.bits // 32)
    assert sorted(map(tuple, far.collect())) == near


def test_keys_by_their_steps():
    rng = np.random.default_rng(7)
    for keys in ([5], [0, 1], [0, (1 << 64) - 1], np.unique(rng.integers(0, 1 << 52, 1000)), np.unique(rng.integers(0, 1 << 9, 300))):
        keys = np.array(keys, np.uint64)
        assert (ngram_lm._keys(ngram_lm._steps(keys)) == keys).all()
