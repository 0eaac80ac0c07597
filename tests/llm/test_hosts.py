import pytest
from pyspark.sql import functions as F

from seepage.llm import host_reputation as H
from seepage.llm.queries import RULES

URLS = {
    "https://A.Example.ORG/en/1?x#y": ("a.example.org", "/en/1", "example.org/en/1", "block"),
    "http://example.org/en/2": ("example.org", "/en/2", "org/", "allow"),
    "http://notexample.org/es/2": ("notexample.org", "/es/2", "org/", "allow"),
    "http://b.example.org/es/": ("b.example.org", "/es/", "example.org/es/", "block"),
    "x://org": ("org", "", None, None),
    "x://org/": ("org", "/", "org/", "allow"),
    "http://q.com/fr/1://z": ("q.com", "/fr/1://z", "com/fr/", "allow"),
    "http://q.com/de/": ("q.com", "/de/", "com/de/", "block"),
    "http://q.com?de/": ("q.com", "", None, None),
    "http://É.com\n/de/1\n2": ("É.com\n", "/de/1\n2", None, None),
    "no scheme": ("", "", None, None), "": ("", "", None, None), None: ("", "", None, None), "://": ("", "", None, None),
}


def test_parts_and_rules(spark):
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(URLS)], "page_id long, url string, host string, rule string")
    labels = spark.createDataFrame([], "doc_id long, bad int")
    found = {r.page_id: r for r in H.judge(pages, labels, RULES).collect()}
    for i, (host, path, rule, verdict) in enumerate(URLS.values()):
        r = found[i]
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict == (verdict or "allow"), URLS
    assert H.judge(pages.filter("false"), labels, RULES).collect() == []


def test_priors_come_from_the_level_above(spark):
    rows = [("a.x.com", 90, 100), ("b.x.com", 0, 0), ("a.y.com", 0, 100), ("one.y.com", 1, 1), ("z.net", 0, 0)]
    found = {r.host: r for r in H.reputations(spark.createDataFrame(rows, "host string, bad long, total long")).collect()}
    assert found["a.x.com"].bound > H.LIMIT and found["a.y.com"]["mean"] < 0.1
    assert found["b.x.com"]["mean"] == pytest.approx(found["b.x.com"].a / (found["b.x.com"].a + found["b.x.com"].b))
    assert found["b.x.com"]["mean"] > found["one.y.com"]["mean"] - 0.5 and found["one.y.com"].bound < H.LIMIT
    whole = (90 + 0 + 0 + 1 + 0.5) / (201 + 1)
    assert found["z.net"]["mean"] == pytest.approx(whole)


def test_labels_reach_pages_by_document(spark):
    pages = spark.createDataFrame([(i, f"http://bad.com/en/{i}.html") for i in range(40)] + [(100 + i, f"http://good.com/en/{100 + i}/") for i in range(40)] + [(500, None)], "page_id long, url string")
    labels = spark.createDataFrame([(i, 1) for i in range(40)] + [(100 + i, 0) for i in range(40)] + [(None, 1), (3, None), (3, 0), (3, 1)], "doc_id long, bad int")
    found = {r.page_id: r for r in H.judge(pages, labels, []).collect()}
    assert len(found) == 81 and all(found[i].verdict == "block" for i in range(40)) and all(found[100 + i].verdict == "allow" for i in range(40))
    assert found[500].rule is None and found[500].verdict == "allow"


def test_only_native_operators(spark):
    pages = spark.createDataFrame([(1, "http://a.com/1")], "page_id long, url string").select("page_id", F.col("url"))
    plan = H.judge(pages, spark.createDataFrame([], "doc_id long, bad int"), RULES)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
