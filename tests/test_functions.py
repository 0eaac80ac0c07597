import ipaddress
import math
import random
from collections import Counter

from pyspark.sql import functions as F

from seepage.functions import entropy, net, text


def values(spark, items, column):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(items)], "i int, x string")
    return [r[0] for r in df.orderBy("i").select(column(F.col("x"))).collect()]


def python_entropy(s):
    return -sum(n / len(s) * math.log2(n / len(s)) for n in Counter(s).values()) if s else 0.0


def test_entropy_follows_its_definition(spark):
    rng = random.Random(1)
    items = ["", "a", "aaaaaaaa", "ab" * 9, "aB3dE5fG7iJ9kL1mN0oP2qR4sT6uV8wXyZ", "é€😀😀x", "日本語"]
    items += ["".join(rng.choice("abcXYZ019+/é😀") for _ in range(rng.randint(1, 60))) for _ in range(200)]
    for got, item in zip(values(spark, items, entropy.shannon_entropy), items):
        assert abs(got - python_entropy(item)) < 1e-9, item
    for got, item in zip(values(spark, items, entropy.charset_ratio), items):
        assert abs(got - (len(set(item)) / len(item) if item else 0)) < 1e-12


def test_thresholds_and_classes(spark):
    items = ["", "hello", "aB3dE5fG7iJ9kL1mN0oP2qR4sT6uV8wXyZ", "a1b2c3d4e5f6a7b8c9d0e1f2a3b4c5d6",
             "dGhpcyBpcyBhIHRlc3Qgc3RyaW5nIGZvciBiYXNlNjQ=", "aaaaaa"]
    assert values(spark, items, entropy.classify_string) == [
        "empty", "low_entropy", "high_entropy", "high_entropy_hex", "high_entropy_base64", "low_entropy"]
    assert values(spark, items, entropy.is_high_entropy) == [False, False, True, True, True, False]
    # a threshold of zero falls back to the default
    assert values(spark, ["hello"], lambda c: entropy.is_high_entropy(c, 0)) == [False]
    # sixteen different characters of twice each: exactly on a threshold of 4
    assert values(spark, ["0123456789abcdef" * 2], lambda c: entropy.is_high_entropy(c, 4.0)) == [True]
    flags = values(spark, ["short", "AK" + "IA" + "IOSFODNN7EXAMPLE12345678"], entropy.is_likely_secret)
    assert [f["flag"] for f in flags] == [False, True]
    assert flags[1]["entropy"] > 3.5


def test_private_addresses_agree_with_the_standard_library(spark):
    rng = random.Random(2)
    items = ["10.0.0.1", "8.8.8.8", "192.0.0.9", "192.0.0.10", "192.0.0.11", "192.0.0.170", "172.15.1.1", "172.16.1.1",
             "172.31.255.255", "172.32.0.0", "198.17.0.0", "198.18.0.0", "198.19.255.255", "198.20.0.0", "0.0.0.0",
             "255.255.255.255", "240.0.0.1", "239.1.1.1", "203.0.113.7", "203.0.114.7", "01.2.3.4", "256.1.1.1", "1.2.3",
             "1.2.3.4.5", "", "a.b.c.d", "10.0.0.1\n", "100.64.0.1", "169.254.1.1"]
    items += [".".join(str(rng.randint(0, 255)) for _ in range(4)) for _ in range(500)]

    def expected(item):
        try:
            address = ipaddress.IPv4Address(item)
        except ValueError:
            return None
        return address.is_private or address.is_loopback

    for item, valid, private in zip(items, values(spark, items, net.valid_ipv4), values(spark, items, net.private_ipv4)):
        assert valid == (expected(item) is not None), item
        assert private == bool(expected(item)), item


def test_urls(spark):
    row = spark.createDataFrame([("https://user:p@Example.org:8443",)], "t string").select(
        net.hostname(F.col("t")).alias("host"), net.authority(F.col("t")).alias("authority"),
        net.resolve(F.col("t"), F.lit("//cdn.x/a.js")).alias("a"), net.resolve(F.col("t"), F.lit("/a.js")).alias("b"),
        net.resolve(F.col("t"), F.lit("a.js")).alias("c"), net.resolve(F.col("t"), F.lit("http://x/a.js")).alias("d"),
        net.join_path(F.col("t"), F.lit("//x/y")).alias("e"), net.sub_url(F.lit("https://a.b"), F.lit("dev")).alias("f"),
        net.path_of(F.lit("https://a.b/x/y"), F.lit("https://a.b")).alias("g"),
        net.path_of(F.lit("https://a.bc/x"), F.lit("https://a.b")).alias("h"),
        net.hostname(F.lit("http://[::1]:80/x")).alias("i"), net.hostname(F.lit("plain")).alias("j"),
    ).first()
    assert row.host == "example.org" and row.authority == "user:p@Example.org:8443"
    assert row.a == "https://cdn.x/a.js"
    assert row.b == "https://user:p@Example.org:8443/a.js"
    assert row.c == "https://user:p@Example.org:8443/a.js"
    assert row.d == "http://x/a.js"
    assert row.e == "https://user:p@Example.org:8443/x/y"
    assert row.f == "https://dev.a.b"
    assert row.g == "x/y" and row.h is None
    assert row.i == "::1" and row.j == "plain"


def python_context(body, match, width):
    at = body.find(match)
    if at == -1:
        return match
    first, last = max(0, at - width), min(len(body), at + len(match) + width)
    return ("... " if first > 0 else "") + body[first:last] + (" ..." if last < len(body) else "")


def test_context_window(spark):
    rng = random.Random(3)
    rows = []
    for _ in range(200):
        body = "".join(rng.choice("ab é😀\n") for _ in range(rng.randint(0, 200)))
        at = rng.randint(0, len(body))
        rows.append((body, body[at:at + rng.randint(0, 30)], ))
    rows += [("abc", "zzz"), ("x" * 3000, "x" * 2000), ("", "q" * 900)]
    got = spark.createDataFrame([(i, b, m) for i, (b, m) in enumerate(rows)], "i int, b string, m string").orderBy("i").select(
        text.context_window(F.col("b"), F.col("m"), 50)).collect()
    assert [g[0] for g in got] == [python_context(b, m, 50) for b, m in rows]


def test_line_context(spark):
    body = "a\nhit 1\nb\nc\nhit 2\nhit 3\nd"
    got = spark.range(1).select(text.line_context(
        F.split(F.lit(body), "\n"), lambda line: F.contains(line, F.lit("hit")), 1, 2)).first()[0]
    assert got == "a\nhit 1\nb\n...\nc\nhit 2\nhit 3"


def test_strip_is_the_unicode_one(spark):
    items = [" a ", " a ", "\x1c\x1fa\x1d", "a \n b", "", " \n ", "　x\ty\r\n", "x" + " " * 500 + "y"]
    assert values(spark, items, text.strip) == [i.strip() for i in items]


def test_escape_and_slug(spark):
    assert values(spark, ['<a href="x">&amp;', None], text.html_escape) == ["&lt;a href=&quot;x&quot;&gt;&amp;amp;", ""]
    assert values(spark, ["A_b/c.D"], text.slug) == ["a-b-c-d"]
