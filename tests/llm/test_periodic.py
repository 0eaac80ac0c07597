import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from seepage.llm import periodic
from seepage.llm.queries import op11_periodic_runs


def brute(words, least=24):
    """All (start, end, period) by trying every period."""
    n, out = len(words), []
    for q in range(1, n // 3 + 1):
        s = 0
        while s < n - q:
            e = s
            while e < n - q and words[e] == words[e + q]:
                e += 1
            if e > s and e + q - s >= max(least, 3 * q):
                w = words[s : e + q]
                if not any(w[p:] == w[:-p] for p in range(1, q)):
                    out.append((s, e + q, q))
            s = max(e, s) + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def found(texts):
    known = {}
    ids = np.array([known.setdefault(w, len(known)) for t in texts for w in t], np.int64)
    offsets = np.cumsum([0, *map(len, texts)])
    out = [[] for _ in texts]
    for s, e, q in zip(*(x.tolist() for x in periodic.runs(ids, offsets))):
        row = int(np.searchsorted(offsets, s, side="right") - 1)
        out[row].append((s - int(offsets[row]), e - int(offsets[row]), q))
    return out


def nested(rng, alphabet):
    """Words with runs inside runs, broken here and there."""
    words = [rng.choice(alphabet) for _ in range(rng.randint(1, 4))]
    for _ in range(rng.randint(1, 4)):
        words = words * rng.randint(1, 5) + [rng.choice(alphabet) for _ in range(rng.randint(0, 3))]
        if len(words) > 400:
            break
    for _ in range(rng.choice([0, 0, 1, 2])):
        words[rng.randrange(len(words))] = rng.choice(alphabet)
    return words[:600]


@pytest.mark.parametrize("seed", range(6))
def test_against_every_period(seed):
    rng = random.Random(seed)
    texts = [nested(rng, "ab" if seed % 2 else "abcdef") for _ in range(150)]
    texts += [[rng.choice("ab") for _ in range(300)], [], ["a"] * 23, ["a"] * 24, list("abc") * 8, list("abcdefgh") * 3, list("abcdefghi") * 3 + ["a"], list("abcdefghi")[:] * 2]
    for text, runs in zip(texts, found(texts)):
        assert runs == brute(text), text


def test_fibonacci_words_and_long_periods():
    a, b = ["a"], ["a", "b"]
    for _ in range(12):
        a, b = b, b + a
    rng = random.Random(1)
    long_ = [str(rng.randrange(10**6)) for _ in range(170)]
    texts = [b, ["x", "y", *(long_ * 4)[:600], "z"], long_, long_]
    results = found(texts)
    assert results[0] == brute(texts[0])
    assert results[1] == [(2, 602, 170)] and results[2] == results[3] == []


def planted(doc_id, words):
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    g = h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def digest(doc_id, text):
    words = planted(doc_id, re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode()))
    runs = brute(words)
    best = min(runs, key=lambda r: (-(r[1] - r[0]) / r[2], r[0], r[2]), default=None)
    dropped = {i for s, e, q in runs for i in range(s + q, e)}
    first = (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2]) if best else (None,) * 4
    lines = "".join(f"{s},{e - s},{q}\n" for s, e, q in runs)
    kept = b" ".join(w for i, w in enumerate(words) if i not in dropped)
    return doc_id, len(runs), *first, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest()


def test_query_against_every_period(spark, small):
    short = [r for r in small.collect() if len(r.text or "") < 5000]
    wanted = {r.doc_id: digest(r.doc_id, r.text) for r in short}
    got = {r.doc_id: tuple(r) for r in op11_periodic_runs(spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == small.count() and sum(v[1] > 0 for v in wanted.values()) > 5
    for doc_id, row in wanted.items():
        assert got[doc_id] == row


def test_edges(documents):
    line = "no more\u00a0blanks é "
    rows = [(1, "a " * 24), (1, "a " * 24), (2, None), (3, ""), (None, " \t\n"), (4, "A a " * 30), (5, line * 400 + "end"), (6, "x y " * 30)]
    got = sorted((str(r.doc_id), [tuple(x) for x in r.runs], r.collapsed) for r in periodic.periodic(documents(*rows)).collect())
    assert got == [("1", [(0, 24, 1)], "a"), ("1", [(0, 24, 1)], "a"), ("2", [], ""), ("3", [], ""), ("4", [(0, 60, 2)], "A a"),
                   ("5", [(0, 1200, 3)], "no more\u00a0blanks é end"), ("6", [(0, 30, 1)], "x y"), ("None", [], "")]
    assert periodic.periodic(documents(*rows).filter("doc_id > 100")).collect() == []
