from collections import Counter

import pytest
from tokenizers import Tokenizer

from seepage.llm import encoding, token_lengths

ODD = ["", None, "a", " a", "a ", "a  b", "a\n\nb", "a\nb c.\nD", "don't stop", "été, été! 漢字 x\u3000y", "<|endoftext|> x", "a\x1cb \x1c c", "12 345 a1 b2c",
       "tab\there", "x" * 3000, "e\u0301 a\u0301.", "it's 'quoted' words'", "...!? a... b.,;", "\n", " ", "\u00a0 nbsp \u00a0"]


@pytest.fixture(scope="module")
def plain():
    own = Tokenizer.from_file(encoding.default_path())
    return lambda text: own.encode(text or "", add_special_tokens=False).ids


def test_pieces_give_the_ids_of_the_whole_text(plain, small):
    import numpy as np

    own = encoding.Encoder(encoding.default_path())
    texts = ODD + [r.text for r in small.limit(60).collect()]
    for text in texts + texts[::-1]:
        assert np.frombuffer(own.encode(text or ""), own.kind).tolist() == plain(text), text


def test_every_limit_is_answered(plain, small):
    lengths = [len(plain(r.text)) for r in small.collect()]
    report = token_lengths.limits(token_lengths.histogram(small), strip=100)
    counts = Counter(lengths)
    rows = {r.length: r for r in report.collect()}
    assert {k: r.n_docs for k, r in rows.items()} == counts
    for limit, r in rows.items():
        longer = [n for n in lengths if n >= limit]
        assert (r.docs_at_least, r.tokens_at_least, r.n_tokens, r.total) == (len(longer), sum(longer), limit * counts[limit], sum(lengths))
        assert r.truncated_total == sum(min(n, limit) for n in lengths)
        assert r.docs_up_to == sum(n <= limit for n in lengths) and r.share_up_to == r.docs_up_to / len(lengths)
    for limit in (0, 7, 100, 10**6):
        assert token_lengths.truncated_total(report, limit).first()[0] == sum(min(n, limit) for n in lengths)
    assert token_lengths.quantile(report, 0.5).first()[0] == sorted(lengths)[(len(lengths) - 1) // 2]


def test_edges(documents, plain):
    docs = documents((1, None), (1, ""), (2, "a b"), (2, "a b"), (None, "x " * 20000))
    rows = {r.length: r.n_docs for r in token_lengths.length_report(docs).collect()}
    assert rows == Counter(len(plain(t)) for t in (None, "", "a b", "a b", "x " * 20000))
    assert token_lengths.length_report(docs.filter("false")).collect() == []
