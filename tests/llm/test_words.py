import re

import numpy as np
import pyarrow as pa

from seepage.llm import words as W

TEXTS = ["The cat sat", "the CAT  sat\n", None, "", " \t\r\n", "É x", "é x", "a\xa0b c", "one", "x" * 5000 + " y", "a b c d e f a b c d e"]


def plain(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_words_are_those_of_the_pattern(monkeypatch):
    for span in (1 << 20, 7):
        monkeypatch.setattr(W, "SPAN", span)
        W._powers.cache_clear()
        found = W.Words(pa.array(TEXTS))
        by_hash, by_word = {}, {}
        for i, text in enumerate(TEXTS):
            own = found.hashes[found.offsets[i] : found.offsets[i + 1]].tolist()
            assert len(own) == len(plain(text))
            for h, w in zip(own, plain(text)):
                assert by_hash.setdefault(h, w) == w and by_word.setdefault(w, h) == h
    W._powers.cache_clear()


def test_slices_and_small_batches():
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(TEXTS))), pa.array(TEXTS)], ["i", "text"])
    whole = W.Words(batch.column("text")).hashes.tolist()
    parts = list(W.small_batches(iter([batch.slice(0, 4), batch.slice(4)]), "text", 12))
    assert [i for p in parts for i in p.column("i").to_pylist()] == list(range(len(TEXTS)))
    assert [h for p in parts for h in W.Words(p.column("text")).hashes.tolist()] == whole


def test_prefixes_and_other_separators():
    found = W.Words(pa.array(["scum, scumbag (scums)", "éa scu"]), W.not_alphanumeric(), (4,))
    assert np.diff(found.offsets).tolist() == [3, 2]
    head = found.heads[0]
    assert head[0] == 0 and head[1] == head[2] != 0 and head[4] == 0


def test_shingles_are_distinct_windows_or_the_whole():
    sets = W.shingle_sets(pa.array(TEXTS), 5)
    for text, own in zip(TEXTS, sets):
        w = plain(text)
        wanted = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
        assert len(own) == len(wanted) and (np.diff(own.astype(object)) > 0).all()
    assert sets[0].tolist() == sets[1].tolist()
