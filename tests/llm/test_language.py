import numpy as np
from pyspark.sql import functions as F

from seepage.llm import language
from seepage.llm.queries import held_out, op9_language


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op9_language(spark, sf).collect()
    held = [docs[r.doc_id] == r.lang_pred for r in rows if r.held_out]
    assert len(rows) == len(docs) and len(held) > 30 and np.mean(held) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_profile_is_ranked_by_count_then_number():
    codes = language._codes("Aab, ba 7!")
    assert [chr(c) for c in codes] == list(" aab ba ")
    ranked = language.ranked(language.n_grams(codes), 3)
    counts = {}
    for g in language.n_grams(codes).tolist():
        counts[g] = counts.get(g, 0) + 1
    assert ranked.tolist() == [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))][:3]


def test_distance_is_out_of_place():
    profiles = language.Profiles(["x", "y"], np.array([1, 2, 3]), np.array([[0, 3], [1, 1], [3, 0]]), 3)
    assert language._codes("...").tolist() == [] and profiles.nearest(" 1 2 ") == ("und", 0.0) and profiles.nearest(None) == ("und", 0.0)


def test_edges(spark, documents):
    docs = documents((1, "der die das und nicht", "de"), (1, "der die das und nicht", "de"), (2, "the and of to with", "en"), (3, None, "en"), (4, "123 ...", None), (5, "", None),
                     (6, "und nicht das", None), (None, "of the", None), (7, "of the and " * 20000, None))
    profiles = language.learn(docs)
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.predict(docs, profiles).collect()}
    assert got[6][0] == "de" and got[None][0] == "en" and got[7][0] == "en" and {got[i] for i in (3, 4, 5)} == {("und", 0.0)}
    kept = language.keep_known(docs, profiles)
    assert kept.columns == docs.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 1, 2, 6, 7]
    nothing = language.learn(docs.filter("false"))
    assert language.predict(docs, nothing).filter("lang_pred <> 'und'").count() == 0 and language.predict(docs.filter("false"), nothing).collect() == []


def test_limits_reject_random_letters_and_unlearned_languages(small):
    import random

    rng = random.Random(4)
    noise = [" ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(n)) for n in (20, 60, 200)]
    other = ["Wszyscy ludzie rodza sie wolni i rowni pod wzgledem swej godnosci i swych praw. Sa oni obdarzeni rozumem i sumieniem i powinni postepowac wobec innych w duchu braterstwa.",
             "Butun insanlar hur, haysiyet ve haklar bakimindan esit dogarlar. Akil ve vicdana sahiptirler ve birbirlerine karsi kardeslik zihniyeti ile hareket etmelidirler."]
    spark = small.sparkSession
    odd = spark.createDataFrame([(10**9 + i, t) for i, t in enumerate(noise + other)], "doc_id long, text string")
    docs = small.select("doc_id", "text", "lang").unionByName(odd.withColumn("lang", F.lit(None).cast("string")))
    profiles = language.learn(docs)
    kept = {r.doc_id for r in language.keep_known(docs, profiles, limits=language.learn_limits(docs, profiles)).collect()}
    assert kept == {r.doc_id for r in small.collect()}


def test_split_uses_the_id_as_text(spark):
    import zlib

    rows = spark.range(50).select(F.col("id").alias("doc_id"), held_out("id").alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)


def plain_grams(text):
    """N-grams of lower-cased words, letter by letter."""
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    padded = " " + " ".join(words) + " " if words else ""
    out = [c for c in padded if c != " "] + [padded[i : i + 2] for i in range(len(padded) - 1)]
    return out + [padded[i : i + 3] for i in range(len(padded) - 2) if padded[i + 1] != " "]


def plain_ranks(grams, most):
    from collections import Counter

    number = lambda g: sum(ord(c) << 21 * (len(g) - 1 - i) for i, c in enumerate(g))
    return [g for g, _ in sorted(Counter(grams).items(), key=lambda x: (-x[1], number(x[0])))[:most]]


def test_out_of_place_sums_by_hand(spark, small):
    learned = small.filter("doc_id % 3 > 0 and lang is not null")
    profiles = language.learn(learned, 80)
    texts = {}
    for r in learned.collect():
        texts.setdefault(r.lang, []).append(r.text or "")
    wanted = {lang: plain_ranks([g for t in own for g in plain_grams(t)], 80) for lang, own in texts.items()}
    assert profiles.languages == sorted(wanted)
    for r in small.filter("doc_id % 3 = 0").limit(25).collect():
        own = plain_ranks(plain_grams(r.text or ""), 80)
        if own:
            apart = {lang: sum(abs(w.index(g) - i) if g in w else 80 for i, g in enumerate(own)) for lang, w in wanted.items()}
            best = min(sorted(apart), key=apart.get)
            assert profiles.nearest(r.text) == (best, 1 - apart[best] / (len(own) * 80))


def test_too_many_languages(spark, monkeypatch):
    import pytest

    monkeypatch.setattr(language, "MOST_LANGUAGES", 3)
    docs = spark.createDataFrame([(i, "ab", f"l{i}") for i in range(4)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError):
        language.learn(docs)
    assert len(language.learn(docs.filter("doc_id < 3")).languages) == 3
