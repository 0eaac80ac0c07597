"""Contexts of many matches: those of a search for each match, in time in proportion to the text."""

import base64
import hashlib
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from seepage.functions.text import strip
from seepage.operators import matching
from seepage.operators.body import cloud_hits, secret_hits, source_hits, token_hits
from seepage.operators.javascript import js_inputs
from seepage.operators.matching import TEXT, per_placed_rule, placed_matches, run
from seepage.rules import Rule


def expected(body, match, width):
    at = body.find(match)
    first, last = max(at - width, 0), min(len(body), at + len(match) + width)
    return ("... " if first else "") + body[first:last] + (" ..." if last < len(body) else "")


def contexts(spark, bodies, rule, width, clean=lambda m: m):
    hits = per_placed_rule(
        placed_matches([rule]), width, lambda r, m: F.length(m) > 1,
        lambda r, m, n, c: matching.hit("m", m, c, F.array(F.lit("t")), F.lit(0), pos=n, url=F.lit(""), with_status=False), clean)
    rows = spark.createDataFrame(list(enumerate(bodies)), f"i int, {TEXT} string")
    return {r.i: [(h.title, h.evidence) for h in r.h] for r in matching.with_views(rows.withColumns(
        {"url": F.lit("u"), "target": F.lit("u")})).select("i", hits.alias("h")).collect()}


RULES = [
    Rule("digits", "d", r"[0-9]{2,9}-?[0-9]{0,4}"),
    Rule("word", "w", r"\b(ab?c+)[ ;]", 1),
    Rule("mail", "m", r"[a-c.]+@[a-c]{1,3}"),
    Rule("comment", "c", r"<!--(.*?)-->", 1, stop="-->"),
    Rule("bucket", "b", r"\b[a-c.]+x", 0, opener=r"\b", skip=r"[a-c.]++"),
]


@pytest.mark.parametrize("few", [0, 256])
@pytest.mark.parametrize("rule", RULES, ids=lambda r: r.rule_id)
def test_contexts_are_those_of_a_search(spark, monkeypatch, rule, few):
    monkeypatch.setattr(matching, "_FEW", few)
    rng = random.Random(11)
    bodies = []
    for _ in range(60):
        alphabet = rng.choice(["0123-", "abc ;", "abc@. é", "<!--> ab", "abcx. ", "01-abc @<!-->;x😀"])
        unit = rng.choice([1, 1, 5])
        bodies.append("".join(rng.choice(["".join(rng.choice(alphabet) for _ in range(unit)), rng.choice(alphabet), "<!--", "-->", "abc ", "012345678-9"]) for _ in range(rng.randint(0, 150))))
    got = contexts(spark, bodies, rule, 6, strip)
    for i, body in enumerate(bodies):
        found = [(m.group(rule.group)).strip() for m in re.finditer(rule.pattern, body, re.A if rule.rule_id == "digits" else 0)]
        wanted = list(dict.fromkeys(m for m in found if len(m) > 1))
        assert got[i] == [(m, expected(body, m, 6)) for m in wanted], body


def seconds(responses, detector, body):
    df = run(responses(("t", "t/a", 200, body)), detector)
    start = time.perf_counter()
    n = df.count()
    return time.perf_counter() - start, n


def test_time_grows_with_the_text_however_many_matches(spark, responses):
    def mails(n):
        return " ".join(f"user{i}@corp{i % 97}.io" for i in range(n))

    seconds(responses, source_hits(), mails(2000))
    once, n = seconds(responses, source_hits(), mails(16_000))
    twice, m = seconds(responses, source_hits(), mails(32_000))
    assert (n, m) == (16_000, 32_000)
    assert once < 6 and twice < 2.6 * once + 1


@pytest.mark.parametrize("detector, text", [
    (secret_hits(), lambda i: "ghp_" + hashlib.sha256(b"%d" % i).hexdigest()[:36]),
    (token_hits(), lambda i: f"k=\"{base64.b64encode(hashlib.sha256(b'%d' % i).digest()).decode()}\""),
    (cloud_hits(), lambda i: f"https://bucket{i}.s3.amazonaws.com/x"),
], ids=["secrets", "tokens", "cloud"])
def test_many_matches_of_other_detectors(spark, responses, detector, text):
    body = "\n".join(text(i) for i in range(5000))
    took, n = seconds(responses, detector, body)
    assert n >= 5000 and took < 20


def test_inline_scripts_count_sources_once(spark, responses):
    def page(n):
        return "".join(f"<script>var a{i} = {i};</script>" for i in range(n))

    times = []
    for n in (400, 6400, 12800):
        start = time.perf_counter()
        assert js_inputs(responses(("t", "t/a", 200, page(n)))).count() == n
        times.append(time.perf_counter() - start)
    assert times[2] < 3 * times[1] + 2
