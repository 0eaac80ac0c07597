"""Every rule gives what Python's re gives, with needles, gates, stops and faster forms."""

import random
import re

import pytest
from pyspark.sql import functions as F

from checks import seeds
from seepage.operators.matching import find_all, with_views
from seepage.rules import GATES, Rule, cloud, errors, javascript, listing, metadata, secrets, source

FAMILIES = {
    "source": (source.RULES, lambda r: "ms"),
    "secrets": (secrets.RULES, lambda r: ""),
    "errors": (errors.RULES, lambda r: "m" if r.rule_id in errors.LINE_RULES else "ms"),
    "cloud": (cloud.RULES + cloud.IDENTIFIERS, lambda r: "i"),
    "scripts": (javascript.ENDPOINTS + [javascript.ENV, javascript.CONFIG, javascript.CLOUD_CONFIG], lambda r: ""),
    "html": ([javascript.SCRIPT_SRC, javascript.INLINE_SCRIPT, Rule("href", "", listing.HREF, 1)], lambda r: "si"),
    "email": ([Rule("email", "", metadata.EMAIL, 0, fast=metadata.EMAIL_FAST)], lambda r: ""),
}
FLAGS = {"i": re.I, "m": re.M, "s": re.S}


def corpus():
    rng = random.Random(7)
    snippets = [s for name in ("SECRETS", "SOURCE", "ERRORS", "CLOUD", "SCRIPTS", "LISTINGS", "TECH") for s in getattr(seeds, name)]
    texts = list(snippets)
    texts += [s.upper() for s in snippets] + [s.lower() for s in snippets] + [s[:-1] for s in snippets] + [s[1:] for s in snippets]
    texts += [s.replace("s", "ſ").replace("k", "K").replace("i", "ı") for s in snippets]
    texts += [s.replace(" ", " ") for s in snippets] + [s.replace("\n", "\r\n") for s in snippets]
    texts += [f"é{s}é" for s in snippets] + [s.replace("1", "١") for s in snippets]
    for _ in range(400):
        texts.append(rng.choice(["\n", " ", "", "x"]).join(rng.sample(snippets, rng.randint(2, 6))))
    texts += [
        "x-1.us-east.elb.amazonaws.com-2.us-west.elb.amazonaws.com a.rds.comb.rds.com.rds.amazonaws.com 1-2-" + "a" * 32
        + ".apps.googleusercontent.com7-" + "b" * 32 + ".apps.googleusercontent.com",
        "a.firebaseio.comb.firebaseio.com c@d.eef@g.hh", "x@y.zz@w.vv", "<!-- a <!-- b --> c --> <!-- d",
        "<script>a</script><SCRIPT x=1>\nb</Script><script>c", "Warning: a Warning: b in c in d.php on line 3 Warning: x in y",
        "Exception in thread \"a\" \"b\": at at x.java:1 y.java:22 Error in thread \"q\" at z",
        "TypeError: \n  at f (a.js:1:2)\n  at g (b.ts:3:4)\nError:\n\n at h (c.tsx:5:6)",
        "panic: \n\n goroutine 7 x\n a.go:1 b.go:2 panic: goroutine 1\n.go:3",
        "NoMethodError app/ \n x app/ y:1:in z:2:in ArgumentError\napp/:3:in",
        "Warning: a in b.php on line 1 Warning: c Warning: d.php on line 2", "Warning: Warning: a in b.php on line 1",
        "panic: a\ngoroutine 1\nb.go:1 panic: c panic: d\n.go:2", "Error in thread \"a\" at b.java:1 Error in thread \"c.java:2",
        "Traceback (most recent call last):\nFooErrorBarError\nx\nBazException Traceback (most recent call last): q\n",
        "Traceback (most recent call last):\n ValueError\nTraceback (most recent call last):\nAError",
        "  \n at a.b(C.java:1)\n\t at d.e(F.java:2) at g.h(I.java:3)", "tempé bugs hack_ TODO\n. temp. fixme",
        "<script defer src='/a/b.js'></script><SCRIPT SRC=\"https://x/y.min.js\">z</SCRIPT><script src='x.css'>",
        "1234567890123456789 (12)345-6789 +1-22-333-4444 12 345 6789", "1.2.3.4.5.6.7.8 a1.2.3.4 1.2.3.4b 0.0.0.0",
    ]
    return texts


def expected(rule, flags, text):
    combined = 0
    for f in flags:
        combined |= FLAGS[f]
    return [m.group(rule.group) or "" for m in re.finditer(rule.pattern, text, combined)]


@pytest.mark.parametrize("family", FAMILIES)
def test_same_matches_as_python(spark, family):
    rules, flags = FAMILIES[family]
    texts = corpus()
    rows = spark.createDataFrame([(i, t, "u", "t") for i, t in enumerate(texts)], "i int, text string, url string, target string")
    columns = [find_all(rule, flags(rule)).alias(f"r{n}") for n, rule in enumerate(rules)]
    got = with_views(rows.repartition(8)).select("i", *columns).collect()
    hits = {}
    for row in got:
        for n, rule in enumerate(rules):
            want = [m for m in expected(rule, flags(rule), texts[row.i]) if m or not rule.opener]
            assert row[f"r{n}"] == want, (rule.rule_id, texts[row.i])
            hits[rule.rule_id] = hits.get(rule.rule_id, 0) + len(want)
    missing = [r.rule_id for r in rules if not hits.get(r.rule_id)]
    assert not missing, f"no text exercises {missing}"


def test_long_unclosed_traceback(spark):
    body = "Traceback (most recent call last):\n" + "  File x, line 1\n" * 50_000
    rule = next(r for r in errors.RULES if r.rule_id == "python_traceback")
    rows = spark.createDataFrame([(body, "u", "t"), (body + "KeyError: 1", "u", "t")], "text string, url string, target string")
    sizes = [r[0] for r in with_views(rows).select(F.size(find_all(rule, "m"))).collect()]
    assert sorted(sizes) == [0, 1]


def test_hostile_bodies_stay_cheap(spark):
    """Openers without an end, and runs that invite backtracking."""
    bodies = [
        "<!--" * 40_000, "Warning: in " * 20_000, "Warning: " * 20_000 + "x.php on line 3", "<script>" * 20_000,
        'Exception in thread "a" at ' * 10_000, "TypeError: x\n at f (" * 10_000, "panic: x\ngoroutine 1\n" * 10_000,
        "a" * 100_000, " " * 100_000, "NoMethodError\napp/" * 10_000,
        ".firebaseio.com .rds.com 1-.apps.googleusercontent.com .elb.amazonaws.com " + "a" * 100_000 + "1" * 100_000,
    ]
    rows = spark.createDataFrame([(b, "u", "t") for b in bodies], "text string, url string, target string").repartition(4)
    rules = [(r, "m" if r.rule_id in errors.LINE_RULES else "ms") for r in errors.RULES]
    rules += [(source.RULES[0], "ms"), (javascript.INLINE_SCRIPT, "si")]
    rules += [(r, "") for r in secrets.RULES] + [(r, "i") for r in cloud.RULES]
    columns = [F.size(find_all(r, f)).alias(f"r{i}") for i, (r, f) in enumerate(rules)]
    assert len(with_views(rows).select(*columns).collect()) == len(bodies)


def test_time_grows_with_the_body_only(spark):
    """Bodies that hold the literals of a rule and many starts that lead nowhere."""
    import time

    from seepage.operators.listing import _HREF

    errors_by_id = {r.rule_id: r for r in errors.RULES}
    source_by_id = {r.rule_id: r for r in source.RULES}
    cases = [
        (errors_by_id["nodejs_stack"], "m", lambda n: "node_modules" + " " * n), (errors_by_id["nodejs_stack"], "m", lambda n: "node_modules\n" + " at x (" * (n // 7)),
        (errors_by_id["php_stack_trace"], "m", lambda n: "a.php( " + "#1 x " * (n // 5)),
        (source_by_id["s3_bucket"], "ms", lambda n: "b.s3.amazonaws.com " + "a." * (n // 2)),
        (_HREF, "i", lambda n: "<a " * (n // 3)), (javascript.SCRIPT_SRC, "i", lambda n: "<script " * (n // 8)),
        (javascript.INLINE_SCRIPT, "si", lambda n: "<script " * (n // 8) + "</script>"),
    ]
    for rule, flags, body in cases:
        seconds = []
        for n in (2_000, 400_000):
            row = with_views(spark.createDataFrame([(body(n), "u", "t")], "text string, url string, target string"))
            start = time.time()
            row.select(F.size(find_all(rule, flags))).collect()
            seconds.append(time.time() - start)
        # a quadratic search of the large body takes minutes
        assert seconds[1] < seconds[0] + 5, (rule.rule_id, seconds)


def test_linear_forms_find_the_same(spark):
    import re

    from seepage.operators.listing import _HREF

    texts = [
        "x\n  at f (/a/node_modules/b.js:1:2)\n at g (c) at h (node_modules:3:4) at k (node_modules/x:5:6)\n", "#0 a b.php(3): f()\n#1 x #2 y.php(1): z\n#3 q.php(1):\n\n#4\n  c.php(a): d\n#5 n.php(2): e",
        "-a.s3.amazonaws.com.b.s3.amazonaws.com _x.y.s3.amazonaws.com .s3.amazonaws.com a.s3.amazonaws.comx b..s3.amazonaws.com",
        "<a <a href='x'>1</a><a\nclass=b href = \"y/\">2<a href=z><a title='>' href='w'>", "<script a <script src='q.js'></script><script src=\"a.min.js\" ><script>var x</script><script src='b.css'>",
        "<script>a</script ><SCRIPT t=1>b</SCRIPT><script <script>c</script><script>d",
    ]
    rules = [(r, "m") for r in errors.RULES if r.rule_id in ("nodejs_stack", "php_stack_trace")] + [(r, "ms") for r in source.RULES if r.rule_id == "s3_bucket"]
    rules += [(_HREF, "i"), (javascript.SCRIPT_SRC, "i"), (javascript.INLINE_SCRIPT, "si")]
    rows = with_views(spark.createDataFrame([(i, t, "u", "t") for i, t in enumerate(texts)], "i int, text string, url string, target string"))
    for rule, flags in rules:
        got = {r.i: list(r.m) for r in rows.select("i", find_all(rule, flags).alias("m")).collect()}
        for i, text in enumerate(texts):
            wanted = [m[rule.group] for m in re.finditer(f"(?{flags}){rule.pattern}", text)]
            assert got[i] == [w for w in wanted if w], (rule.rule_id, text)


def test_rule_tables_are_complete():
    assert len(secrets.RULES) == 21 and len(source.RULES) == 12 and len(errors.RULES) == 19
    assert len(cloud.RULES) == 25 and len(cloud.IDENTIFIERS) == 4 and len(javascript.ENDPOINTS) == 11
    assert set(GATES) == {"scheme", "host", "arn"}
    with pytest.raises(ValueError):
        Rule("x", "x", "x", gate="nothing")
