import random

import numpy as np
import pytest

from seepage.llm import ngram_join as N
from seepage.llm.components import components


def plain_sets(rows):
    out = []
    for doc_id, text in rows:
        w = (text or "").lower().split()
        out.append((doc_id, frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])))
    return out


def brute(rows):
    sets = plain_sets(rows)
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (a, x) in enumerate(sets):
        for j in range(i):
            b, y = sets[j]
            if x and y and (x == y or a is not None and b is not None and 100 * len(x & y) >= 80 * len(x | y)):
                root[find(i)] = find(j)
    least = {}
    for i, (a, _) in enumerate(sets):
        if a is not None:
            least[find(i)] = min(least.get(find(i), a), a)
    return sorted(((a is not None, a or 0), len(x), least.get(find(i)) if x else a) for i, (a, x) in enumerate(sets))


def corpus(seed, groups=12):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    shared = [[rng.choice(words) for _ in range(30)] for _ in range(3)]
    rows, n = [], 0
    for _ in range(groups):
        base = [rng.choice(words) for _ in range(rng.randint(6, 120))] + (rng.choice(shared) if rng.random() < 0.6 else [])
        for _ in range(rng.randint(1, 9)):
            own = list(base)
            for _ in range(rng.randint(0, 3)):
                own[rng.randrange(len(own))] = rng.choice(words).upper()
            rows.append((n, " ".join(own)))
            n += 1
    return rows + [(n, None), (n + 1, ""), (n + 2, "one two"), (n + 3, "ONE two"), (n + 4, "one two three"), (2, rows[2][1]), (None, rows[3][1]), (n + 5, "x " * 20000)]


def found(docs):
    return sorted(((r.doc_id is not None, r.doc_id or 0), r.n_shingles, r.component_id) for r in N.near_components(docs).collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(documents, seed, monkeypatch):
    rows = corpus(seed)
    if seed == 2:
        # several buckets and chunks, and meetings that have to be split
        monkeypatch.setattr(N, "CHUNK", 300)
        monkeypatch.setattr(N, "BUCKET", 400)
        monkeypatch.setattr(N.links, "__defaults__", (80, 3, 400))
    assert found(documents(*rows)) == brute(rows)


def test_empty_table(documents):
    assert N.near_components(documents((1, "a")).filter("false")).collect() == []
    assert found(documents((1, None))) == [((True, 1), 0, 1)]


def test_trie_finds_every_connection():
    rng = np.random.default_rng(5)
    for percent in (50, 80):
        base = [np.sort(rng.choice(500, 40, replace=False)) for _ in range(6)]
        sets = [np.sort(rng.choice(b, rng.integers(30, 41), replace=False)).astype(np.uint64) for b in base for _ in range(12)]
        sizes = [len(s) + int(rng.integers(0, 3)) for s in sets]
        root = list(range(len(sets)))

        def find(i, root=root):
            return i if root[i] == i else find(root[i])

        for i in range(len(sets)):
            for j in range(i):
                if N.linked(len(np.intersect1d(sets[i], sets[j])), sizes[i], sizes[j], percent):
                    root[find(i)] = find(j)
        wanted = {frozenset(j for j in range(len(sets)) if find(j) == find(i)) for i in range(len(sets))}
        got = list(range(len(sets)))

        def at(i, got=got):
            return i if got[i] == i else at(got[i])

        for i, j in N.trie_links(sets, sizes, percent):
            assert N.linked(len(np.intersect1d(sets[i], sets[j])), sizes[i], sizes[j], percent)
            got[at(i)] = at(j)
        assert {frozenset(j for j in range(len(sets)) if at(j) == at(i)) for i in range(len(sets))} == wanted


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(7, x) for x in (3, 9, 11)] + [(5, 5), (None, 4)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, **dict.fromkeys((3, 7, 9, 11), 3)}


def test_texts_that_share_all_their_shingles(spark):
    # every shingle is held by several texts of one chunk, so buckets get marks and no holders
    unit = " ".join(f"u{i}" for i in range(9))
    rows = [(k, (unit + " ") * k) for k in range(1, 7)] + [(9, (unit + "\n").upper() * 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    found = {r.doc_id: r.component_id for r in N.near_components(docs).collect()}
    assert found == {c[0][1]: c[2] for c in brute(rows)}


@pytest.mark.parametrize("seed", [1, 2])
def test_components_with_sizes(documents, seed, monkeypatch):
    if seed == 2:
        monkeypatch.setattr(N, "CHUNK", 300)
        monkeypatch.setattr(N, "BUCKET", 400)
        monkeypatch.setattr(N.links, "__defaults__", (80, 3, 400))
    rows = corpus(seed)
    # ids play no part here, so the plain side numbers the rows
    want = {}
    for (i, _, c), (_, text) in zip(brute([(k, text) for k, (_, text) in enumerate(rows)]), rows):
        if text and text.split():
            want.setdefault(c, set()).add((str(i[1]), rows[i[1]][0], len(text.split())))
    got = {}
    for r in N.sized_components(documents(*[(i, text, None, str(k)) for k, (i, text) in enumerate(rows)])).collect():
        got.setdefault(r.component, set()).add((r.source, r.doc_id, r.size))
    assert sorted(map(sorted, got.values()), key=str) == sorted(map(sorted, want.values()), key=str)
    assert N.sized_components(documents((1, "a")).filter("false")).collect() == []


@pytest.mark.parametrize("chunk", [250, 2_000_000])
def test_a_line_of_all_texts_does_not_make_them_meet(spark, monkeypatch, chunk):
    monkeypatch.setattr(N, "CHUNK", chunk)
    monkeypatch.setattr(N, "BUCKET", 400)
    met = []

    def noted(df, name, stored=N.stored):
        out = stored(df, name)
        if name == "meetings":
            met.extend(r["count"] for r in out.groupBy("leader").count().collect())
        return out

    monkeypatch.setattr(N, "stored", noted)
    rng = random.Random(3)
    line = " ".join(f"line{i}" for i in range(30))
    rows = []
    for k in range(40):
        own = [f"w{rng.randrange(10**6)}" for _ in range(60)]
        rows += [(2 * k, " ".join([*own, line])), (2 * k + 1, " ".join([*own, line, f"z{k}"]))]
    # texts of the line alone do meet
    rows += [(100, line), (101, line + " end")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert found(docs) == brute(rows)
    assert max(met) <= 4
