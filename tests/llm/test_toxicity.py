import random

import numpy as np

from seepage.llm import toxicity


def corpus(n, seed):
    rng = random.Random(seed)
    plain = [a + b for a in ("ka", "lo", "mi", "ru", "te") for b in ("ren", "sto", "vu", "xal", "bin", "dor")]
    cues = ["grubber", "vexling", "vexlard"]
    out = []
    for i in range(n):
        words = [rng.choice(plain) for _ in range(rng.randint(5, 200))]
        grade = rng.choice((0, 0, 0, 1, 2))
        for _ in range((0, 1, 6)[grade]):
            words.insert(rng.randrange(len(words)), rng.choice(cues).capitalize() + rng.choice(("", ".", ",")))
        out.append((i, " ".join(words), grade))
    return out


def test_grades_of_unseen_texts():
    seen, unseen = corpus(400, 1), corpus(200, 2)
    model = toxicity.fit([t for _, t, _ in seen], [g for _, _, g in seen], [1.0] * len(seen))
    import pyarrow as pa

    score = toxicity.scores(pa.array([t for _, t, _ in unseen]), model, model.lookup())
    above = model.above(score)
    assert (np.diff(model.thresholds) > 0).all()
    assert ((above[:, 0] >= 0.5) == np.array([g > 0 for _, _, g in unseen])).mean() > 0.97
    assert np.abs(above.sum(axis=1) - [g for _, _, g in unseen]).mean() < 0.25


def test_train_and_predict(spark, documents):
    rows = corpus(300, 3)
    docs = documents(*[(i, t) for i, t, _ in rows], (900, None), (901, ""), (None, "grubber vexling"), (902, "kalo " * 30000), (5, rows[5][1]))
    labels = spark.createDataFrame([(i, int(g > 0)) for i, _, g in rows[:200]] + [(None, 1), (7, None)], "doc_id long, toxic int")
    model = toxicity.train_from_labels(docs, labels)
    found = toxicity.predict(docs, model).collect()
    by_id = {r.doc_id: r for r in found}
    assert len(found) == len(rows) + 5 and not any(by_id[i].toxic for i in (900, 901, 902)) and by_id[None].toxic
    held = [(by_id[i].toxic, g > 0) for i, _, g in rows[200:]]
    assert sum(a == b for a, b in held) / len(held) > 0.95
    assert np.mean([by_id[i].severity for i, _, g in rows if g == 2]) > np.mean([by_id[i].severity for i, _, g in rows if g == 1])
    kept = toxicity.keep_harmless(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(not r.toxic for r in found)


def test_copies_of_a_row_weigh_as_one_label(spark, documents):
    rows = corpus(60, 5)
    labels = spark.createDataFrame([(i, int(g > 0)) for i, _, g in rows], "doc_id long, grade int")
    once = toxicity.train(documents(*[(i, t) for i, t, _ in rows]), labels)
    often = toxicity.train(documents(*[(i, t) for i, t, _ in rows + rows[:1] * 40]), labels)
    assert np.array_equal(once.features, often.features) and np.array_equal(once.weights, often.weights)


def test_without_labels_or_rows(spark, documents):
    docs = documents((1, "a"), (2, None))
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.train_from_labels(docs, none)
    assert [r.toxic for r in toxicity.predict(docs, model).collect()] == [False, False]
    assert toxicity.predict(docs.filter("false"), model).collect() == []
    one_class = toxicity.train_from_labels(docs, spark.createDataFrame([(1, 0)], "doc_id long, toxic int"))
    assert toxicity.keep_harmless(docs, one_class).count() == 2


def test_tables_without_rows(spark, tmp_path):
    # read from files, so that the optimizer can't see that they are empty
    folder = str(tmp_path)
    spark.createDataFrame([], "doc_id long, text string, lang string, source string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(77, 1), (78, 0)], "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    empty, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    assert toxicity.predict(empty, toxicity.train_from_labels(empty, labels)).collect() == []
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    assert toxicity.keep_harmless(docs, toxicity.train_from_labels(docs, labels)).count() == 2


def scores_by_hand(texts, grades, weights, features, row_weights, thresholds):
    """Average loss of a cumulative-link model, written out row by row."""
    import math

    out = 0.0
    for text, grade, weight in zip(texts, grades, row_weights):
        score = sum(weights[f] * (1 + math.log2(n)) for f, n in text.items() if f in features)
        above = [1.0, *(1 / (1 + math.exp(-(score - t))) for t in thresholds), 0.0]
        out -= weight * math.log(max(above[grade] - above[grade + 1], 1e-12))
    return out / sum(row_weights)


def test_fitted_weights_are_at_the_least_loss():
    import pyarrow as pa

    rows = corpus(150, 9)
    texts, grades = [t for _, t, _ in rows], [g for _, _, g in rows]
    model = toxicity.fit(texts, grades, [1.0] * len(rows), steps=3000, ridge=0.01)
    found, hashes, _ = toxicity._features(pa.array(texts))
    counted = [{} for _ in texts]
    for row, h in zip(found.tolist(), hashes.tolist()):
        counted[row][h] = counted[row].get(h, 0) + 1
    features = model.features.tolist()
    own = dict(zip(features, model.weights.tolist()))

    def loss(weights, thresholds):
        return scores_by_hand(counted, grades, weights, own, [1.0] * len(rows), thresholds) + 0.005 * sum(w * w for w in weights.values())

    least = loss(own, model.thresholds)
    for f in features[:: max(1, len(features) // 6)]:
        for step in (-0.2, 0.2):
            assert loss({**own, f: own[f] + step}, model.thresholds) > least - 1e-6
    for k in range(len(model.thresholds)):
        for step in (-0.2, 0.2):
            moved = model.thresholds.copy()
            moved[k] += step
            if (np.diff(moved) > 0).all():
                assert loss(own, moved) > least - 1e-6
