import csv
import glob
import hashlib
import io
import json

import pytest
from pyspark.sql import functions as F

from checks import seeds
from seepage.operators import body, dedup, rollup, scoring
from seepage.operators.joins import salted_join
from seepage.operators.matching import run
from seepage.sources import readers, sinks
from tests.conftest import SF

SITE = "https://site.io"


def scored_row(spark, module, evidence, status):
    df = spark.createDataFrame([(module, evidence, status)], "module string, evidence string, status int")
    conf = scoring.confidence(F.col("module"), F.col("evidence"), F.col("status"))
    return tuple(df.select(conf.alias("c"), scoring.severity(F.col("module"), conf).alias("s")).first())


def test_confidence_and_severity(spark):
    assert scored_row(spark, "secrets", "x", 200) == ("Certain", "Critical")
    assert scored_row(spark, "http_header", "x", 200) == ("High", "Medium")
    assert scored_row(spark, "sensitive_file", "content", 301) == ("Medium", "High")
    assert scored_row(spark, "unknown", "", None) == ("Speculative", "Low")
    assert scored_row(spark, "dns", "x" * 11, None) == ("Low", "Informational")
    assert scored_row(spark, "dns", "x" * 51, None) == ("Medium", "Low")
    assert scored_row(spark, "secrets", None, 404) == ("Speculative", "High")


def test_lookups(spark):
    row = spark.range(1).select(
        scoring.cwe(F.lit("secrets")), scoring.cwe(F.lit("unknown")), scoring.owasp(F.lit("http_header")),
        scoring.cvss_estimate(F.lit("secrets"), F.lit("Critical")), scoring.confidence_score(F.lit("Low"))).first()
    assert row[0] == "CWE-798" and row[1] == "CWE-200" and row[2] == "OWASP:API4" and row[3].startswith("CVSS:") and row[4] == 0.3


def sample(spark):
    return scoring.score(run(seeds.captures(spark, SF), body.error_hits(), body.cloud_hits()))


def test_fingerprint_is_the_documented_hash(spark):
    row = dedup.dedup(sample(spark)).first()
    raw = f"{row.target}|{row.module}|{row.title}|{row.severity}"
    assert row.fingerprint == hashlib.sha256(raw.encode()).hexdigest()


def test_overrides(spark):
    raw = run(seeds.captures(spark, SF), body.error_hits())
    table = spark.createDataFrame([("errors", "Critical"), ("errors", "High")], "module string, severity string")
    by_dict = scoring.score(raw, {"errors": "Critical"})
    by_table = scoring.score(raw, table)
    assert by_dict.count() == raw.count() == by_table.count()
    assert set(r.severity for r in by_dict.select("severity").distinct().collect()) <= {"Critical", "High"}
    with pytest.raises(ValueError):
        scoring.score(raw, {"errors": "Awful"})
    awful = scoring.score(raw, spark.createDataFrame([("errors", "Awful")], "module string, severity string"))
    with pytest.raises(Exception, match="unknown severity: Awful"):
        awful.select("severity").collect()


def test_dedup_does_not_depend_on_partitions(spark):
    scored = sample(spark)
    columns = ["fingerprint", "evidence", "url", "emit_seq"]
    wanted = sorted(dedup.dedup(scored.coalesce(1)).select(*columns).collect())
    for n in (3, 7):
        assert sorted(dedup.dedup(scored.repartition(n, F.rand(n))).select(*columns).collect()) == wanted
    # the first one in emission order, by brute force
    first = {}
    for row in scored.select(*columns).collect():
        key = row.fingerprint
        if key not in first or row.emit_seq < first[key].emit_seq:
            first[key] = row
    assert {r.fingerprint: r.emit_seq for r in first.values()} == {r.fingerprint: r.emit_seq for r in dedup.dedup(scored).collect()}


def test_new_findings(spark):
    scored = sample(spark)
    known = dedup.dedup(scored.filter("severity = 'High'"))
    new = dedup.new_only(scored, known)
    assert new.filter("severity = 'High'").count() == 0
    assert dedup.add_all(scored, known).first().added == new.count() == dedup.dedup(scored).count() - known.count()


def test_hot_key_is_spread(spark):
    many = spark.range(9000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"), "id")
    few = spark.createDataFrame([("hot", 1), ("1", 2), ("none", 3)], "k string, v int")
    for how in ("inner", "left", "left_anti", "left_semi"):
        left = salted_join(many, few, "k", how)
        right = many.join(few, "k", how)
        assert sorted(map(tuple, left.select(*right.columns).collect()), key=str) == sorted(map(tuple, right.collect()), key=str)
    spread = many.filter("k = 'hot'").select(F.pmod(F.xxhash64("k", "id"), F.lit(16)).alias("s")).distinct().count()
    assert spread == 16
    with pytest.raises(ValueError):
        salted_join(many, few, "k", "outer")


def test_rollups(spark):
    found = dedup.dedup(sample(spark))
    counts = {r.severity: r.n for r in rollup.severity_counts(found).collect()}
    assert list(counts) == ["Critical", "High", "Medium", "Low", "Informational"] and sum(counts.values()) == found.count()
    empty = found.limit(0)
    assert [r.n for r in rollup.severity_counts(empty).collect()] == [0] * 5
    assert [r.percent for r in rollup.severity_share(empty).collect()] == [0.0] * 5
    assert rollup.gate(empty).first().failed is False
    assert rollup.gate(found, "Critical").first().failed == (counts["Critical"] > 0)


def test_numbers_are_the_report_order(spark):
    found = dedup.dedup(sample(spark))
    wanted = [r.fingerprint for r in rollup.ordered(found).collect()]
    for partitions in (1, 5):
        got = rollup.numbered(found, partitions).orderBy("number").select("number", "fingerprint").collect()
        assert [g.fingerprint for g in got] == wanted and [g.number for g in got] == list(range(1, len(wanted) + 1))


def stats(spark, found):
    captures = seeds.captures(spark, SF)
    targets = captures.select("target").distinct().unionByName(spark.createDataFrame([("https://never.io",)], "target string"))
    return rollup.scan_stats(targets, captures, found)


def test_scan_stats(spark):
    found = dedup.dedup(sample(spark))
    row = stats(spark, found).first()
    assert row.failed_urls >= 1 and row.completed_urls + row.failed_urls == row.total_urls
    assert row.total_findings == found.count() and row.duration_seconds == 49.0


def parts(folder, suffix):
    return "".join(open(p, newline="").read() for p in sorted(glob.glob(f"{folder}/part-*{suffix}")))


def test_sinks(spark, tmp_path):
    found = dedup.dedup(sample(spark))
    total = found.count()
    totals = stats(spark, found)

    sinks.write_csv(found, str(tmp_path / "csv"))
    rows = []
    for path in sorted(glob.glob(f"{tmp_path}/csv/part-*.csv")):
        rows += list(csv.DictReader(io.StringIO(open(path, newline="").read())))
    assert len(rows) == total and list(rows[0]) == [name for name, _ in sinks.CSV_FIELDS]
    by_key = {(r["Target"], r["Title"], r["Severity"]): r for r in rows}
    for f in found.collect():
        assert by_key[(f.target, f.title, f.severity)]["Evidence"] == f.evidence

    sinks.write_json(found, totals, str(tmp_path / "json"))
    summary = json.loads(parts(f"{tmp_path}/json/summary", ".txt"))
    assert summary["scan_summary"]["total_findings"] == total and set(summary["scan_summary"]["severity_counts"]) == {
        "Critical", "High", "Medium", "Low", "Informational"}
    back = readers.read_findings(spark, f"{tmp_path}/json/findings")
    assert back.count() == total
    left = found.select("target", "title", "severity", "confidence", "evidence", "tags")
    assert left.exceptAll(back.select(*left.columns)).count() == 0

    sinks.write_markdown(found, totals, str(tmp_path / "md"))
    text = parts(tmp_path / "md", ".txt")
    assert text.startswith("# seepage Scan Report") and f"\n### {total}. " in text and text.index("### 1. ") < text.index("### 2. ")
    sinks.write_html(found, totals, str(tmp_path / "html"))
    assert parts(tmp_path / "html", ".txt").count('<div class="finding">') == total
    assert sinks.console_rows(found).count() == total


def test_reading_findings(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"target": "t"}\n{"target": "u", "severity": "Awful"}\n')
    marked = {r.target: r for r in readers.read_findings(spark, str(tmp_path), "mark").collect()}
    assert marked["t"].severity == "Informational" and marked["t"].confidence == "Medium" and marked["t"].tags == []
    assert marked["u"].invalid and not marked["t"].invalid
    with pytest.raises(Exception, match="unknown severity"):
        readers.read_findings(spark, str(tmp_path)).collect()
    with pytest.raises(ValueError):
        readers.read_findings(spark, str(tmp_path), "ignore")


def test_targets(spark, tmp_path):
    (tmp_path / "t.txt").write_text("# list\n\n https://a.io/// \nb.io/x/\nhttps:///none\n#c.io\n")
    good, bad = readers.valid_targets(readers.read_targets(spark, str(tmp_path / "t.txt")))
    assert sorted(r.target for r in good.collect()) == ["https://a.io", "https://b.io/x"]
    assert [r.target for r in bad.collect()] == ["https:///none"]


def test_documents_from_files(spark, tmp_path):
    folder = tmp_path / "docs" / "site.io" / "files"
    folder.mkdir(parents=True)
    (folder / "report.pdf").write_bytes(b"/Author (Z)")
    row = readers.read_documents(spark, str(tmp_path / "docs")).first()
    assert (row.target, row.url, bytes(row.body_bytes)) == ("https://site.io", "https://site.io/files/report.pdf", b"/Author (Z)")


def test_dns_and_responses_readers(spark, tmp_path):
    (tmp_path / "d.csv").write_text("hostname,rtype,value\na.io,A,1.2.3.4\n")
    assert readers.read_dns(spark, str(tmp_path / "d.csv"), "csv").first().value == "1.2.3.4"
    (tmp_path / "r.json").write_text('{"target": "https://a.io", "url": "https://a.io/", "status": 200, "headers": {"Server": "x"}, "body": "b"}\n')
    row = readers.read_responses(spark, str(tmp_path / "r.json"), "json").first()
    assert row.headers == {"Server": "x"} and row.status == 200
    spread = readers.spread(spark.read.parquet(f"{SF}/pages.parquet"), 6)
    assert spread.rdd.getNumPartitions() == 6 and readers.spread(spread, 4) is spread


def test_report_files_are_in_order_without_another_sort(spark, tmp_path):
    from seepage.sources import sinks

    rows = [(f"t{i % 5}", "errors", f"Title {i:03d}", f"evidence {i}", f"u{i}", 200, "", ["a"], "", "", None, (3, f"u{i}", 0, 0, 0, 0)) for i in range(60)]
    raw = spark.createDataFrame(rows, (
        "target string, module string, title string, evidence string, url string, status int, description string, tags array<string>, "
        "rule_id string, rule_severity string, timestamp timestamp, "
        "emit_seq struct<module_rank:int,origin:string,source_pos:int,section:int,rule_rank:int,match_pos:int>")).repartition(6)
    found = dedup.dedup(scoring.score(raw))
    stats = spark.createDataFrame([(5, 5, 0, 60, 1.0, 0, 0, 60, 0, 0)], (
        "total_urls long, completed_urls long, failed_urls long, total_findings long, duration_seconds double, "
        "Critical long, High long, Medium long, Low long, Informational long"))
    for write, head, rows_of in ((sinks.write_markdown, sinks.markdown_head, sinks.markdown_rows), (sinks.write_html, sinks.html_head, sinks.html_rows)):
        folder = tmp_path / write.__name__
        at = F.timestamp_seconds(F.lit(1704164645))
        write(found, stats, str(folder), at)
        text = "".join(p.read_text() for p in sorted(folder.glob("part-*")))
        blocks = [r.value for r in rows_of(found).orderBy("number").collect()]
        assert text == "".join(v + "\n" for v in [head(stats, at).first().value, *blocks]) and "2024-01-02 03:04:05 UTC" in text
    numbered = sinks.markdown_rows(found)
    assert "Exchange rangepartitioning" not in numbered._jdf.queryExecution().executedPlan().toString()
