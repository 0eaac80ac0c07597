import pytest
from pyspark.sql import functions as F

from checks import seeds
from seepage.operators import body, dedup, dns, files, headers, javascript, listing, matching, metadata, paths, scoring, tech
from seepage.plans.detect import body_pass, detect
from seepage.rules import Rule
from tests.conftest import SF

SITE = "https://site.io"
KEY = "AK" + "IA" + "IOSFODNN7EXAMPLE"
JWT = "ey" + "JhbGciOiJIUzI1NiJ9.ey" + "JzdWIiOiIxMjM0NTY3ODkwIn0.dozjgNrvP5bGGunC4ojjK8oG4P1uDVhF7UdNQqFz0aA"


def titles(raw):
    return sorted(r.title for r in raw.select("title").collect())


def test_secrets(responses):
    page = responses((SITE, f"{SITE}/a", 200, f"AWS_ACCESS_KEY={KEY}\ntoken={JWT}"), (SITE, f"{SITE}/b", 200, "<p>Hello</p>"))
    found = titles(body.secrets(page, use_entropy=False))
    assert any("AWS Access Key" in t for t in found) and any("JWT" in t for t in found)
    assert titles(body.secrets(responses((SITE, SITE, 200, "<html><body>Hello World</body></html>")))) == []
    with pytest.raises(ValueError):
        body.secrets(page, use_regex=False, use_entropy=False)


def test_secret_gates(responses):
    low = "AK" + "IA" + "A" * 16
    page = responses((SITE, SITE, 404, f"x={low}"))
    assert titles(body.secrets(page)) == []
    assert titles(body.secrets(page, use_entropy=False)) == ["AWS Access Key discovered"]
    assert titles(body.secrets(page, use_entropy=False, max_length=10)) == []


def test_source_takes_every_match_once(responses):
    many = " ".join(f"user{i}@mail.io" for i in range(30))
    same = "x " + " ".join(["a@b.io"] * 30) + " late@b.io"
    got = body.source_text(responses((SITE, f"{SITE}/1", 200, many), (SITE, f"{SITE}/2", 201, same),
                                     (SITE, f"{SITE}/3", 404, many), (SITE, f"{SITE}/4", 200, None), (SITE, f"{SITE}/5", 200, "")))
    by_url = {u: n for u, n in got.filter("rule_id = 'email'").groupBy("url").count().collect()}
    assert by_url == {f"{SITE}/1": 30, f"{SITE}/2": 2}
    hidden = body.source_text(responses((SITE, SITE, 200, " ".join(f"u{i}@example.com" for i in range(20)) + " ops@corp.io")))
    assert [r.title for r in hidden.filter("rule_id = 'email'").collect()] == ["Email address exposed in source: ops@corp.io"]


def test_long_matches_with_equal_starts_stay_apart(responses):
    tokens = ["Zx9kQ2mB7vTa" + tail for tail in ("Lp4sWn8dRf6gHj3cYu1e", "Uy5tEw0qIo9pAs8dGh2k")]
    got = body.secrets(responses((SITE, SITE, 200, " ".join(f'token = "{t}"' for t in tokens))))
    assert len([t for t in titles(dedup.dedup(scoring.score(got))) if t.startswith("High entropy token discovered: Zx9kQ2mB7vTa #")]) == 2
    urls = [f"http://10.0.0.1/{'long/' * 30}{i}" for i in (1, 2)]
    page = responses((SITE, SITE, 200, "<script>" + " ".join(f'a="{u}";' for u in urls) + "</script>"))
    found = [r.title for r in javascript.js_rules(page).filter("rule_id <> ''").collect()]
    assert len(set(found)) >= 2
    jwt = "eyJhbGciOiJIUzI1NiJ9." + "eyJ" + "aZ9kQ2mB7vTxLp4s" * 150 + "." + "Wn8dRf6gHj3cYu1eUy5tEw0q" * 3
    assert "JWT" in " ".join(titles(body.secrets(responses((SITE, SITE, 200, f"x {jwt} y")))))


def test_every_script_of_a_page_is_credited(responses):
    page = "".join(f'<script src="/s{i}.js"></script>' for i in range(60)) + "<script>process.env.LAST</script>"
    captures = responses((SITE, f"{SITE}/p", 200, page), *[(SITE, f"{SITE}/s{i}.js", 200, f"process.env.NAME_{i}") for i in range(60)])
    found = titles(javascript.js_rules(captures))
    assert len([t for t in found if "NAME_" in t]) == 60 and "Environment variable reference: LAST" in found
    inputs = {r.script_url: r.source_pos for r in javascript.js_inputs(captures).collect()}
    assert inputs[f"{SITE}/s59.js"] == 59 and inputs[f"{SITE}/p"] == 60


def test_source_placeholder_mail_and_public_addresses(responses):
    got = body.source_text(responses((SITE, SITE, 200, "dev@example.org ops@corp.io at 8.8.8.8, 10.0.0.300, 10.1.2.3. <!-- TODO: remove -->")))
    rows = {r.rule_id: r.title for r in got.collect()}
    assert rows["email"].endswith("ops@corp.io") and rows["ip_address"].endswith("10.1.2.3")
    # the rule reports its keyword only
    assert rows["todo"] == "Development comment found: TODO"
    assert rows["html_comment"] == "HTML comment contains: TODO: remove"


def test_errors_are_whole(responses):
    text = " ".join(f"Notice: a in b.php on line {i}" for i in range(9)) + " Full Trace " + "x" * 700
    long = "Fatal error: " + "y" * 900 + " in z.php on line 1"
    got = body.error_pages(responses((SITE, f"{SITE}/1", 500, text), (SITE, f"{SITE}/2", 200, long), (SITE, f"{SITE}/3", 301, text)))
    rows = got.collect()
    assert len([r for r in rows if r.rule_id == "php_error" and r.url.endswith("/1")]) == 9
    assert max(len(r.evidence) for r in rows) == len(long)
    assert not [r for r in rows if r.url.endswith("/3")]


def test_listing(responses):
    marked = '<title>Index of /</title><a href="backup/">b</a><a href="?x">s</a><a href="s.txt">t</a>'
    suspected = "".join(f'<a href="d{i}/">d</a>' for i in range(6))
    few = "".join(f'<a href="d{i}/">d</a>' for i in range(5))
    mixed = suspected + "".join(f'<a href="f{i}.txt">d</a>' for i in range(6))
    got = listing.directory_listing(responses(*[(SITE, f"{SITE}/{i}/", 200, b) for i, b in enumerate((marked, suspected, few, mixed))]))
    rows = {r.url[-2:]: r for r in got.collect()}
    assert set(rows) == {"0/", "1/"}
    assert rows["0/"].evidence == f"URL: {SITE}/0/\nEntries (2):\n  - backup/\n  - s.txt"
    assert rows["1/"].title == f"Possible directory listing: {SITE}/1/"


def test_files_git_and_api(responses):
    page = responses(
        (SITE, f"{SITE}/.env", 200, "A=1\nB=2\nDB_HOST=x\nC=3\nD=4"), (SITE, f"{SITE}/.env.bak", 200, "nothing"),
        (SITE, f"{SITE}/config.php", 403, "password"), (SITE, f"{SITE}/robots.txt", 200, None),
        (SITE, f"{SITE}/.git/HEAD", 200, "ref: refs/heads/main\n"), (SITE, f"{SITE}/.git/index", 200, "x" * 20),
        (SITE, f"{SITE}/.git/", 200, "Index of"), (SITE, f"{SITE}/api/docs", 200, "a\nb\n<b>swagger-ui</b>\nc\nd\ne"),
        (SITE, f"{SITE}/openapi.json", 200, '{\n"swagger" : "2.0"}'), (SITE, f"{SITE}/other", 200, "swagger-ui"),
    )
    sensitive = {r.rule_id: r for r in files.sensitive_files(page).collect()}
    assert sensitive[".env"].title == "Sensitive file exposed: .env"
    assert sensitive[".env"].evidence == "B=2\nDB_HOST=x\nC=3"
    assert sensitive[".env.bak"].evidence == f"URL: {SITE}/.env.bak returned HTTP 200 (7 bytes)"
    assert sensitive["robots.txt"].title == "Sensitive file accessible: robots.txt"
    assert "config.php" not in sensitive
    assert titles(files.git_exposure(page)) == [
        "Git HEAD reference exposed (branch: main)", "Git directory listing exposed"]
    api = {r.rule_id: r for r in files.api_docs(page).collect()}
    assert api["swagger-ui"].evidence == "a\nb\n<b>swagger-ui</b>\nc\nd" and api["swagger-ui"].title.startswith("Swagger UI")
    assert api["specification"].evidence == '{\n"swagger" : "2.0"}' and set(api) == {"swagger-ui", "specification"}


def test_headers_ignore_case_and_blank_values(responses):
    page = responses((SITE, SITE, 404, "x", {"SERVER": "nginx/1.2", "x-powered-by": " ", "X-Kong": "", "Other": "1"}))
    got = headers.headers(page).orderBy("emit_seq").collect()
    assert [(r.title, r.evidence) for r in got] == [
        ("Information disclosure via Server header", "Server: nginx/1.2"),
        ("Infrastructure information disclosed via X-Kong", "X-Kong: ")]


def test_tech(responses):
    page = responses((SITE, SITE, 200, "wp-content Wıx", {"server": "nginx/1.2 Apache", "X-Cache": "HIT"}), (SITE, f"{SITE}/2", 200, "joomla"), (SITE, f"{SITE}/3", 0, "joomla"))
    assert [r.tech for r in tech.tech(page).orderBy("url", "seq").collect()][:5] == ["Nginx", "Apache", "WordPress", "Wix", "X-Cache: HIT"]
    assert [r.summary for r in tech.tech_summary(page).orderBy("url").collect()] == [
        "Servers: Apache, Nginx; Cms: Wix, WordPress; Infrastructure: X-Cache: HIT", "Cms: Joomla"]


def test_scripts_are_credited_to_pages(responses):
    script = f'k="{KEY}"; fetch("http://10.0.0.1/x")'
    page = '<script src="/app.js"></script><script src="https://cdn.io/lib.js"></script><script src="gone.js"></script><script>process.env.HOST</script>'
    captures = responses(
        (SITE, f"{SITE}/p1", 200, page), (SITE, f"{SITE}/p2", 200, page), ("https://b.io", "https://b.io/", 200, page),
        (SITE, f"{SITE}/app.js", 200, script), ("https://cdn.io", "https://cdn.io/lib.js", 200, script),
        ("https://cdn.io", "https://cdn.io/lib.js", 200, script + " //again"), (SITE, f"{SITE}/gone.js", 404, script))
    for materialize in (True, False):
        found = dedup.dedup(scoring.score(javascript.js_rules(captures, materialize=materialize)))
        rows = {(r.target, r.title): r.url for r in found.collect()}
        assert rows[(SITE, "AWS Access Key exposed in JavaScript")] == f"{SITE}/app.js"
        assert rows[("https://b.io", "AWS Access Key exposed in JavaScript")] == "https://cdn.io/lib.js"
        assert rows[(SITE, "Environment variable reference: HOST")] == f"{SITE}/p1"
        assert len(rows) == 6


def test_documents(spark):
    import io
    import zipfile

    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as archive:
        archive.writestr("docProps/core.xml", "<dc:creator>Ann</dc:creator><cp:revision>3</cp:revision>")
    rows = [
        ("https://d.io/manual.pdf", "", b"/Author (Jane) /Title () \xff\xfe x@corp.io x@corp.io /home/jane/a /etc/x.conf"),
        ("https://d.io/deck.pptx", "", buffer.getvalue()), ("https://d.io/broken.docx", "", b"PK not an archive"),
        ("https://d.io/notes", "", b"Author: 'Bob'\nCreator - Unknown"), ("https://d.io/empty.pdf", "", b""),
    ]
    docs = spark.createDataFrame(
        [("https://d.io", u, 200, c, bytearray(b), None) for u, c, b in rows],
        "target string, url string, status int, content_type string, body_bytes binary, fetched_at timestamp")
    got = {r.title: r.evidence for r in metadata.documents_metadata(docs).collect()}
    assert got == {
        "PDF metadata exposed": "Author: Jane\nTitle: ", "Document author disclosed: Jane": "Author: Jane",
        "Email address in PDF metadata: x@corp.io": "Email: x@corp.io",
        "Internal path in PDF metadata: /home/jane/a": "Path: /home/jane/a",
        "PPTX document metadata exposed": "Author: Ann\nRevision: 3", "Document metadata author: Bob": "Author: Bob"}


def test_dns(spark):
    records = spark.createDataFrame([
        ("site.io", "TXT", "v=DMARC1; p=none; sp=reject"), ("site.io", "TXT", "v=DMARC1; p=quarantine"),
        ("dev.site.io", "A", "10.0.0.1"), ("other.site.io", "A", "10.0.0.1"), ("api.site.io", "A", "8.8.8.8"),
        ("site.io", "A", "10.9.9.9"), ("10.9.9.9", "PTR", "QA.site.io"), ("site.io", "MX", "10 mail.test"),
    ], "hostname string, rtype string, value string")
    targets = spark.createDataFrame([("https://site.io",), ("http://site.io",)], "target string")
    got = dns.dns(records, targets)
    assert titles(got.filter("target = 'http://site.io'")) == [
        "DMARC policy not set to reject (currently: quarantine)", "Development subdomain resolves to internal IP: dev.site.io -> 10.0.0.1",
        "Development subdomain resolves: api.site.io -> 8.8.8.8", "Development-related MX record: 10 mail.test",
        "Hostname resolves to internal IP: site.io -> 10.9.9.9", "Reverse DNS shows development hostname: 10.9.9.9 -> QA.site.io"]
    assert got.filter("target = 'https://site.io'").count() == 6


def test_coverage_and_probes(spark, responses):
    captures = responses((SITE, f"{SITE}/.env", 200, "x"), (SITE, f"{SITE}/.git/HEAD", 0, ""), ("https://z.io", "https://z.io/a", 200, ""))
    targets = spark.createDataFrame([(SITE,), ("https://never.io",)], "target string")
    listed = [".env", ".git/HEAD"]
    missing = sorted((r.target, r.path) for r in paths.coverage(captures, targets, listed).collect())
    assert missing == [("https://never.io", ".env"), ("https://never.io", ".git/HEAD"), (SITE, ".git/HEAD")]
    assert [r.target for r in paths.uncaptured_targets(captures, targets).collect()] == ["https://never.io"]
    assert paths.probe(captures, listed, targets).count() == 2


def test_own_rules(responses):
    rule = Rule("ticket", "Ticket number", r"TICKET-[0-9]+", needles=("ticket-",))
    got = matching.run(responses((SITE, SITE, 200, "see TICKET-42")), body.source_hits([rule]))
    assert titles(got) == ["Ticket number: TICKET-42"]


def test_one_pass_equals_single_detectors(spark):
    captures = seeds.captures(spark, SF)
    together = detect(captures)
    parts = [files.sensitive_files(captures), body.secrets(captures), files.api_docs(captures), files.git_exposure(captures),
             headers.headers(captures), body.source_text(captures), body.error_pages(captures), body.cloud(captures),
             listing.directory_listing(captures), javascript.js_rules(captures)]
    raw = parts[0]
    for part in parts[1:]:
        raw = raw.unionByName(part)
    alone = dedup.dedup(scoring.score(raw))
    columns = ["target", "module", "title", "severity", "evidence", "url"]
    left = together.select(*columns)
    assert left.exceptAll(alone.select(*columns)).count() == 0 and alone.select(*columns).exceptAll(left).count() == 0
    assert left.select("module").distinct().count() == len(parts)


def test_probed_paths_are_pages_too(responses):
    trace = "Traceback (most recent call last):\n  File x\nValueError"
    found = detect(responses((SITE, f"{SITE}/graphql", 500, trace)))
    assert [r.title for r in found.filter("module = 'errors'").collect()] == ["Error disclosure: Python Traceback"]


def test_bodies_are_read_once_and_never_shuffled(spark, tmp_path):
    folder = str(tmp_path / "captures")
    seeds.captures(spark, SF).write.parquet(folder)
    hits = body_pass(spark.read.parquet(folder), ["source_code", "secrets", "errors", "cloud_exposure", "javascript"])
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Exchange" not in plan
    plan = headers.headers(spark.read.parquet(folder))._jdf.queryExecution().executedPlan().toString()
    assert "body" not in plan
    plan = body.error_pages(spark.read.parquet(folder))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(status, [200,201,202,403,404,500])]" in plan
    # the expensive array must not be evaluated again by an inferred filter
    assert plan.count("regexp_extract_all") <= 2 * 19


def test_unknown_module(responses):
    with pytest.raises(ValueError):
        detect(responses((SITE, SITE, 200, "x")), modules=["nothing"])


def scans(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Relation [")


def test_documents_are_scanned_once(spark, tmp_path):
    import io
    import zipfile

    from seepage.operators import metadata

    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        z.writestr("docProps/core.xml", "<cp><dc:creator>Jane</dc:creator></cp>")
    rows = [(SITE, f"{SITE}/a.pdf", 200, "", b"%PDF /Author (Jane Roe)", None), (SITE, f"{SITE}/b.docx", 200, "", packed.getvalue(), None),
            (SITE, f"{SITE}/c.docx", 200, "", b"no archive", None), (SITE, f"{SITE}/d.bin", 200, "", b"Author: Jo Doe", None), (SITE, f"{SITE}/e.pdf", 404, "", b"x", None)]
    spark.createDataFrame(rows, "target string, url string, status int, content_type string, body_bytes binary, fetched_at timestamp").write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    found = metadata.documents_metadata(docs)
    single = metadata.pdf_metadata(docs).unionByName(metadata.office_metadata(docs)).unionByName(metadata.binary_metadata(docs))
    key = lambda df: sorted((r.title, r.evidence, str(r.tags), str(r.emit_seq)) for r in df.collect())
    assert key(found) == key(single) and len(key(found)) == 4
    assert scans(found) == 1 and scans(single) == 3


def test_records_are_scanned_once_and_hits_meet_hosts_once(spark, tmp_path):
    from seepage.operators import dns

    rows = [("a.io", "TXT", "v=DMARC1; p=none; 10.0.0.1"), ("a.io", "MX", "mail.internal.a.io"), ("dev.a.io", "A", "10.1.2.3"), ("a.io", "A", "10.9.9.9"),
            ("10.9.9.9", "PTR", "dev-box.a.io"), ("a.io", "CNAME", "staging.b.io"), ("b.io", "A", "8.8.8.8"), (None, "A", None)]
    spark.createDataFrame(rows, "hostname string, rtype string, value string").write.parquet(str(tmp_path / "dns"))
    records = spark.read.parquet(str(tmp_path / "dns"))
    targets = spark.createDataFrame([("https://a.io",), ("https://b.io",)], "target string")
    assert scans(dns.record_rows(records)) == 1
    found = dns.dns(records, targets)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert scans(found) == 0 and plan.count("Join Inner") == 2
    single = dns.dns_records_rules(records, targets).unionByName(dns.dns_subdomains(records, targets)).unionByName(dns.dns_reverse(records, targets))
    key = lambda df: sorted((r.target, r.title, r.evidence, str(r.emit_seq)) for r in df.collect())
    assert key(found) == key(single) and len(key(found)) >= 6
    assert key(dns.dns(records, targets, materialize=False)) == key(found)


def test_technologies_come_from_the_pass_over_the_bodies(spark, tmp_path):
    from seepage.operators import tech
    from seepage.plans.detect import body_pass, scan

    rows = [(SITE, f"{SITE}/", 200, "<html>wp-content <!-- some remark --><script>var a=1</script></html>", {"server": "nginx/1.2"}, {"PHPSESSID": "1"}, None),
            (SITE, f"{SITE}/x", 404, None, {"Server": "Apache"}, None, None), (SITE, f"{SITE}/y", 0, "wp-content", None, None, None)]
    spark.createDataFrame(rows, (
        "target string, url string, status int, body string, headers map<string,string>, cookies map<string,string>, fetched_at timestamp")).write.parquet(str(tmp_path / "r"))
    captured = spark.read.parquet(str(tmp_path / "r"))
    assert scans(body_pass(captured, ["source_code", "javascript", "secrets"], technologies=True)) == 1
    found, technologies = scan(captured, modules=["source_code", "javascript", "secrets"])
    key = lambda df: sorted((r.url, r.seq, r.category, r.tech) for r in df.collect())
    assert key(technologies) == key(tech.tech(captured)) and len(key(technologies)) >= 3
    assert {r.module for r in found.collect()} == {"source_code"}
    assert scan(captured.drop("headers", "cookies"), modules=["errors"])[1].count() >= 1


def test_only_hot_keys_are_split(spark, monkeypatch):
    from seepage.operators import joins

    many = spark.range(0, 9000, 1, 8).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 600).cast("string"))).alias("key"), "id")
    many = many.unionByName(spark.createDataFrame([(None, 1)], "key string, id long"))
    few = many.select("key").distinct().filter("key <> 'k7'").withColumn("v", F.length("key"))
    hot = {r.key: r._salts for r in joins.hot_keys(many, "key", 100).collect()}
    assert hot == {"hot": 30}
    joined = joins.measured_join(many, few, "key", 100)
    wanted = many.join(few, "key")
    assert sorted(map(tuple, joined.collect())) == sorted(map(tuple, wanted.collect())) and joined.columns == wanted.columns
    # dealt out as the join deals: no task gets a third of the rows, and only the hot key's row is repeated
    monkeypatch.setattr(joins, "TASK_ROWS", 100)
    hot_rows = F.broadcast(joins.hot_keys(many, "key", 100))
    dealt = many.filter("key is not null").join(hot_rows, "key", "left").withColumn("_salt", F.coalesce(F.pmod(F.xxhash64("key", "id"), F.col("_salts")).cast("int"), F.lit(0)))
    sizes = [r["count"] for r in dealt.repartition(64, "key", "_salt").groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < 9000 / 8
    repeated = few.join(hot_rows, "key", "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1)))
    assert repeated.count() == few.filter("key is not null").count() + 29
