import random
import re

import numpy as np

from seepage.llm import outliers

ODD = [None, "", "a b a b a b", "x # *$ y\nx # *$ y\n\n \nx", "a b c\r\na b c\r\n", "one", "a b", "É é\u00a0z <|>", "same " * 9000]


def slow(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    at = {}
    for i in range(len(words) - 2):
        at.setdefault(tuple(words[i : i + 3]), []).append(i)
    covered = {i + k for places in at.values() if len(places) > 1 for i in places for k in range(3)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


def test_base_counts(documents, small):
    docs = documents(*enumerate(ODD))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    for df in (docs, small):
        text = {r.doc_id: r.text for r in df.collect()}
        for r in outliers.judge(df).collect():
            wanted = slow(text[r.doc_id])
            assert tuple(r[n] for n in names) == wanted
            assert r.base_failed == (wanted[0] < 50 or 100 * wanted[4] > 50 * wanted[0])
            assert not (r.base_failed and r.kept)


def concentrated(x, tries, rng):
    """Least determinant that concentration from many random starts finds; the allowed deviations are added as in the operator."""
    floor = np.diag(np.square(list(outliers.FEATURES.values())))
    found = []
    for _ in range(tries):
        core = rng.choice(len(x), 8, replace=False)
        last = np.inf
        while True:
            mean, cov = x[core].mean(axis=0), np.cov(x[core].T, bias=True) + floor
            now = np.linalg.slogdet(cov)[1]
            if len(core) > 8 and now >= last - 1e-9:
                break
            last = now if len(core) > 8 else np.inf
            d = np.einsum("ni,ij,nj->n", x - mean, np.linalg.inv(cov), x - mean)
            core = np.argsort(d, kind="stable")[: int(np.ceil(outliers.CORE * len(x)))]
        found.append((now, mean))
    return min(found, key=lambda f: f[0])


def test_estimates_are_those_of_the_least_determinant(spark):
    """Against plain concentration from 200 random starts: two groups, a fifth of each far away in a cluster of its own."""
    rng = np.random.default_rng(2)
    rows, wanted = [], {}
    for grp in ("a", "b"):
        mix = rng.normal(size=(5, 5)) * 0.4
        x = rng.normal(size=(300, 5)) @ mix + rng.normal(size=5)
        x[:60] = x[:60] * 0.2 + 4 * rng.normal(size=5)
        wanted[grp] = concentrated(x, 200, rng)
        rows += [(grp, *map(float, v)) for v in x]
    got = {r.grp: r for r in outliers.estimates(spark.createDataFrame(rows, ["grp", *outliers.NAMES]))[0].collect()}
    for grp, (size, mean) in wanted.items():
        assert abs(got[grp]["size"] - size) < 0.05
        assert np.allclose([got[grp][f"m{i}"] for i in range(5)], mean, atol=0.1)


def test_large_tables_of_groups_are_not_sent(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = spark.createDataFrame([("g" if i % 3 else "h", *map(float, rng.normal(size=5))) for i in range(300)], ["grp", *outliers.NAMES])
    sent = {r.grp: r for r in outliers.estimates(rows)[0].collect()}
    monkeypatch.setattr(outliers, "SENT", 0)
    for r in outliers.estimates(rows)[0].collect():
        assert all(np.isclose(r[c], sent[r.grp][c]) for c in r.asDict() if c not in ("grp", "start"))


def test_whitening(spark):
    rng = np.random.default_rng(3)
    a = rng.normal(size=(5, 5))
    cov = a @ a.T + np.eye(5)
    row = {"grp": "g", "start": 0, **{f"s{i}": 0.0 for i in range(5)}, **{f"m{i}": 0.0 for i in range(5)}, **{f"c{i}_{j}": float(cov[i, j]) for i, j in outliers.PAIRS}}
    got = outliers._whitened(spark.createDataFrame([row])).first()
    factor = np.array([[got[f"w{i}_{j}"] if j <= i else 0.0 for j in range(5)] for i in range(5)])
    assert np.allclose(factor, np.linalg.inv(np.linalg.cholesky(cov)))
    assert np.isclose(got["size"], np.linalg.slogdet(cov)[1])


def test_planted_outliers_go_and_the_others_stay(documents):
    rng = random.Random(6)
    rows = []
    for i in range(420):
        n = rng.randint(80, 300)
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(n)]
        if i % 60 == 7:
            words = [w + "###" for w in words]
        if i % 60 == 8:
            words = [w * 9 for w in words]
        rows.append((i, " ".join(words), ("en", None)[i % 2], "s"))
    docs = documents(*rows, (900, "short", "en", "s"), (901, " ".join(f"w{i}" for i in range(60)), "xx", "t"))
    got = {r.doc_id: r for r in outliers.judge(docs).collect()}
    planted = {i for i in range(420) if i % 60 in (7, 8)}
    assert {i for i in range(420) if not got[i].kept} == planted
    assert not got[900].kept and got[901].distance is not None


def test_moderate_outliers_go_from_clean_groups(documents):
    rng = random.Random(9)

    def words(n, least=2, most=9):
        return ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(least, most))) for _ in range(n)]

    def lines(own):
        return [" ".join(own[k : k + 10]) for k in range(0, len(own), 10)]

    rows = [(i, "\n".join(lines(words(rng.randint(80, 300)))), "en", "s") for i in range(400)]
    twice = words(50)
    own = lines(words(200))
    odd = {
        "boilerplate": own[:10] + lines(words(100))[:5] + own[:5],
        "repeats": lines(words(75) + [w for _ in range(2) for w in twice] + words(25)),
        "same lines": lines(words(100)) + ["-"] * 10,
        "symbols": lines([w + "#" if k % 20 == 0 else w for k, w in enumerate(words(200))]),
        "long": lines(words(200, 6, 13)), "many": lines(words(4000))}
    docs = documents(*rows, *[(1000 + k, "\n".join(x), "en", "s") for k, x in enumerate(odd.values())])
    got = {r.doc_id: r for r in outliers.judge(docs).collect()}
    assert [name for k, name in enumerate(odd) if got[1000 + k].kept or got[1000 + k].base_failed] == []
    assert sum(not got[i].kept for i in range(400)) <= 2


def test_texts_of_small_groups_are_judged(documents):
    """The same odd text goes among few and among many, alone in its language or not; the others stay."""
    rng = random.Random(12)

    def clean(i):
        return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(80, 300))), i

    odd = " ".join(w + "###" for w in clean(0)[0].split())
    for n in (98, 200):
        rows = [(i, clean(i)[0], "en", "s") for i in range(n)]
        got = {r.doc_id: r for r in outliers.judge(documents(*rows, (900, odd, "en", "s"), (901, odd, "xx", "s"), (902, odd, "en", None))).collect()}
        assert not any(got[i].kept for i in (900, 901, 902)) and min(got[i].distance for i in (900, 901, 902)) > outliers.CUTOFF
        assert sum(not got[i].kept for i in range(n)) <= n // 25
    few = outliers.judge(documents(*[(i, clean(i)[0], "en", "s") for i in range(6)])).collect()
    assert len(few) == 6 and all(r.kept for r in few)


def test_texts_that_are_all_alike_stay(documents):
    text = " ".join(f"word{i}" for i in range(80))
    got = outliers.judge(documents(*[(i, text, "en", "s") for i in range(150)], (500, text + " more", "en", "s"))).collect()
    assert len(got) == 151 and all(r.kept for r in got)


def test_empty_and_native(spark, documents):
    docs = documents((1, "a", "en", "s")).filter("false")
    judged = outliers.judge(docs)
    assert judged.collect() == []
    plan = outliers.statistics(docs)._jdf.queryExecution().executedPlan().toString() + judged._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
