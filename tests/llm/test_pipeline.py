import importlib.util

import pytest

import corpus_pipeline as P
from seepage.llm import language, ngram_join, toxicity
from tests.llm.test_ngram_join import brute

SF = "/root/testdata/sf0.001"


def test_stages_against_plain_versions(spark, small):
    docs = small
    toxic = P.drop_toxic(spark, docs, SF).cache()
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id for r in toxic.collect()}
    harmless = [i for i, t in labels.items() if not t]
    assert toxic.columns == docs.columns and all(i in kept for i in harmless)
    known = P.keep_languages(spark, toxic, SF).cache()
    assert known.columns == docs.columns and known.count() == toxic.count()
    single = P.drop_near_copies(spark, known, SF).cache()
    wanted = {c for (_, i), _, c in brute([(r.doc_id, r.text) for r in known.collect()])}
    assert single.columns == docs.columns and sorted(r.doc_id for r in single.collect()) == sorted(wanted)
    mixed = P.mix_sources(spark, single, SF).cache()
    size = lambda df: sum(len(r.text.split()) for r in df.collect())
    assert mixed.columns == docs.columns and abs(size(mixed) / size(single) - 1.5) < 0.1
    packed = P.pack(spark, mixed, SF).collect()
    assert sum(r.n_words for r in packed) == size(mixed)


def test_run_and_names(spark):
    assert [n for n, _ in P.STAGES] == ["toxicity", "language ID", "n-gram Jaccard join", "mixing sources", "best-fit packing"]
    assert P.ORACLE_SQL is None and P.run(spark, SF).count() > 0


@pytest.mark.parametrize("stage", [f for _, f in P.STAGES], ids=[n for n, _ in P.STAGES])
def test_edges(spark, documents, stage):
    docs = documents((1, "a b c d e f", "en", "s"), (1, "a b c d e f", "en", "s"), (2, "A b c d e f", None, None), (3, None, None, "s"), (4, "", "en", None), (None, "x y", "en", "s"), (None, "x y", "en", "s"))
    got = stage(spark, docs, SF)
    if stage is not P.pack:
        assert got.columns == docs.columns
    got.collect()
    assert stage(spark, docs.filter("false"), SF).collect() == []


def test_the_other_operators_do_not_need_these():
    assert importlib.util.find_spec("seepage.llm") and language and ngram_join and toxicity
