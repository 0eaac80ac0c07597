import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from seepage.llm import elias_fano, encoding, token_files
from seepage.sources.checkpoint import fresh_folder


def test_elias_fano_round_trip():
    rng = random.Random(1)
    for n, most in ((0, 1), (1, 1), (1, 10**12), (5, 3), (700, 1), (2000, 50), (3000, 10**9), (600, 10**5)):
        values = np.array(sorted(rng.randrange(most) for _ in range(n)), np.uint64)
        data = elias_fano.encode(values)
        read = elias_fano.Sequence(b"12345678" + data, 8)
        assert read.end == 8 + len(data) and read.all().tolist() == values.tolist()
        places = [rng.randrange(n) for _ in range(50)] if n else []
        assert read.select(places).tolist() == values[places].tolist() if n else True
        with pytest.raises(IndexError):
            read.select([n])
    dense = elias_fano.encode(np.arange(0, 10**6, 100, dtype=np.uint64))
    assert len(dense) * 8 / 10**4 < 2 + 7 + 1
    with pytest.raises(ValueError):
        elias_fano.encode(np.array([3, 2], np.uint64))


def round_trip(spark, docs):
    own = Tokenizer.from_file(encoding.default_path())
    folder = fresh_folder(spark, "ids")
    manifest = token_files.write(docs, folder)
    found = sorted(token_files.read(spark, folder, manifest).collect(), key=lambda r: r.start)
    ids = [r.doc_id for r in found]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    wanted, at = [], 0
    for r in docs.select("doc_id", "text").collect():
        all_ids = [*own.encode(r.text or "", add_special_tokens=False).ids, 2]
        wanted.append((r.doc_id, len(all_ids), zlib.crc32(np.array(all_ids, "<u4").tobytes())))
    for r in found:
        assert r.start == at
        at += r.n_tokens
    key = lambda x: (x[0] is not None, x[0] or 0, x[1:])
    assert sorted([(r.doc_id, r.n_tokens, r.ids_crc32) for r in found], key=key) == sorted(wanted, key=key)
    return folder, manifest


def test_files_give_back_all_documents(spark, small):
    folder, manifest = round_trip(spark, small)
    shard = manifest.first()
    with token_files.Shard(folder, shard["shard"]) as own:
        whole = own.between(0, shard["n_ids"])
        assert np.concatenate([own.ids(i) for i in range(len(own))]).tolist() == whole.tolist() and len(own) == shard["n_docs"]


def test_edges(spark, documents):
    docs = documents((5, None), (5, ""), (-3, "a b"), (7, "same"), (7, "same"), (None, "x"), (None, None), (2**62, "x " * 30000))
    round_trip(spark, docs)
    assert token_files.read(spark, *(lambda f: (f, token_files.write(docs.filter("false"), f)))(fresh_folder(spark, "ids"))).collect() == []


def test_strings_of_added_tokens_are_what_the_library_makes_of_them(spark, documents):
    own = Tokenizer.from_file(encoding.default_path())
    added = [t.content for t in own.get_added_tokens_decoder().values()]
    assert added
    texts = [f"a {t} b{t}{t}c\n{t}" for t in added] + [t[:-1] + " x" for t in added]
    round_trip(spark, documents(*enumerate(texts)))


def test_files_do_not_depend_on_the_order_of_rows(spark, documents):
    rows = [(i % 3 if i % 4 else None, f"text {i % 7} " * (i % 5)) for i in range(60)]
    found = []
    for some in (rows, rows[::-1]):
        folder = fresh_folder(spark, "ids")
        manifest = token_files.write(documents(*some, partitions=2), folder)
        found.append(sorted((r.start, str(r.doc_id), r.n_tokens, r.ids_crc32) for r in token_files.read(spark, folder, manifest).collect()))
    assert [f[::2] for f in found[0]] == [f[::2] for f in found[1]] and [f[3] for f in found[0]] == [f[3] for f in found[1]]
