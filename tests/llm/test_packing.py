import random

from pyspark.sql import functions as F

from seepage.llm import packing


def slow_best_fit(pieces, capacity, lanes):
    bins, out = [], []
    for size, source, cluster in pieces:
        fits = [b for b in range(len(bins)) if bins[b][0] >= size and bins[b][1].count(source) < lanes and cluster not in bins[b][2] and bins[b][0] > 0]
        b = min(fits, key=lambda b: (bins[b][0], b)) if fits else len(bins)
        if b == len(bins):
            bins.append([capacity, [], set()])
        bins[b][0] -= size
        bins[b][1].append(source)
        bins[b][2].add(cluster)
        out.append(b)
    return out


def test_search_finds_the_tightest_compatible_bin():
    rng = random.Random(3)
    for lanes in (1, 3):
        for _ in range(30):
            pieces = sorted(((rng.randint(1, 60), rng.randint(0, 4), rng.randint(0, 30)) for _ in range(80)), reverse=True)
            assert packing.best_fit(pieces, 100, lanes) == slow_best_fit(pieces, 100, lanes)


def test_whole_table_is_packed(small):
    packed = [r.asDict() for r in packing.pack_documents(small, capacity=256, group=50).collect()]
    docs = {r.doc_id: r for r in small.collect()}
    words, bins = {}, {}
    for p in packed:
        words.setdefault(p["doc_id"], []).append((p["first_word"], p["n_words"]))
        bins.setdefault((p["bin_group"], p["bin"]), []).append(p)
    for doc_id, doc in docs.items():
        n, at = len((doc.text or "").split()), 0
        for first, size in sorted(words.get(doc_id, [])):
            assert first == at
            at += size
        assert at == n
    for own in bins.values():
        assert sum(p["n_words"] for p in own) <= 256 and [p["slot"] for p in sorted(own, key=lambda p: p["slot"])] == list(range(len(own)))
        if len(own) > 1:
            sources = [docs[p["doc_id"]].source for p in own]
            texts = [docs[p["doc_id"]].text.lower() for p in own]
            assert max(map(sources.count, sources)) <= packing.LANES and len(set(texts)) == len(texts)
    again = [r.asDict() for r in packing.pack_documents(small.repartition(5), capacity=256, group=50).collect()]
    key = lambda p: str(sorted(p.items()))
    assert sorted(again, key=key) == sorted(packed, key=key)


def test_near_copies_do_not_share_a_sequence(documents):
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(base[:30] + [f"x{i}"] + base[31:]), None, f"s{i}") for i in range(4)] + [(None, " ".join(base).upper(), None, "s9"), (9, " ".join(base), None, "s8")]
    packed = packing.pack_near_documents(documents(*rows)).collect()
    assert len(packed) == 6 and len({(r.bin_group, r.bin) for r in packed}) == 6


def test_edges(documents):
    docs = documents((1, "a b c", None, "s"), (1, "a b c", None, "s"), (2, None, None, "s"), (3, " ", None, None), (None, "x y", None, None), (4, "x " * 25, None, "u"))
    packed = packing.pack_documents(docs, capacity=10).collect()
    copies = [(r.bin_group, r.bin) for r in packed if r.doc_id == 1]
    assert len(copies) == 2 and len(set(copies)) == 2
    assert sorted(r.n_words for r in packed if r.doc_id == 4) == [5, 10, 10]
    assert {r.doc_id for r in packed} == {1, None, 4}
    assert packing.pack_documents(docs.filter("false")).collect() == []


def test_texts_are_read_once_beside_their_length(spark, small):
    read = spark.sparkContext.accumulator(0)

    def seen(text):
        read.add(1)
        return text

    docs = small.limit(60).select("doc_id", "source", F.udf(seen, "string").asNondeterministic()("text").alias("text"))
    assert {r.doc_id for r in packing.pack_near_documents(docs).collect()} == {r.doc_id for r in packing.pack_documents(small.limit(60)).collect()}
    # a pass for the total length, one for sizes, clusters and shingles
    assert read.value <= 2 * 60
