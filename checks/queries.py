"""One query per operator, over whole tables or captures derived from them."""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import seeds
from seepage.functions import entropy, net, text
from seepage.operators import (
    body, dedup, dns, files, headers, javascript, listing, metadata, paths, rollup, scoring, tech,
)
from seepage.operators.matching import run
from seepage.plans.detect import detect, scan
from seepage.rules import Rule
from seepage.rules import source as source_rules
from seepage.schema import documents_as_responses, pages_as_responses
from seepage.sources import readers, sinks
from seepage.sources.checkpoint import fresh_folder
from seepage.streaming import stream


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def pages(spark: SparkSession, sf: str) -> DataFrame:
    return pages_as_responses(readers.spread(table(spark, sf, "pages")))


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return documents_as_responses(readers.spread(table(spark, sf, "documents")))


def conversations(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select(
        F.lit("conversations").alias("target"),
        F.concat_ws("/", F.lit("conversations"), F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("url"),
        F.lit(200).alias("status"), F.col("text").alias("body"), F.lit(None).cast("timestamp").alias("fetched_at"))


def targets(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select(net.origin(F.col("url")).alias("target")).distinct()


SHOWN = [
    "target", "module", "title", "severity", "confidence", "evidence", "cwe", "owasp", "recommendation", "url",
    "description", "cvss_estimate", "fingerprint", "rule_id", "rule_severity",
]


def shown(findings: DataFrame) -> DataFrame:
    return findings.select(*SHOWN, F.concat_ws("; ", "tags").alias("tags"))


def findings(raw: DataFrame) -> DataFrame:
    return shown(dedup.dedup(scoring.score(raw)))


def on_captures(find):
    return lambda spark, sf: findings(find(seeds.captures(spark, sf)))


def on_dns(find):
    return lambda spark, sf: findings(find(seeds.dns_records(spark, sf), targets(spark, sf)))


def on_documents(find):
    return lambda spark, sf: findings(find(seeds.documents(spark, sf)))


# --- sources and probes ---

def target_lines(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql(seeds.target_lines_sql(seeds._table(sf, "pages")))


def targets_clean(spark, sf):
    return readers.valid_targets(readers.clean_targets(target_lines(spark, sf)))[0]


def targets_rejected(spark, sf):
    return readers.valid_targets(readers.clean_targets(target_lines(spark, sf)))[1]


def probe(listed):
    def query(spark, sf):
        narrow = seeds.captures(spark, sf).select(
            "target", "url", F.col("status").cast("bigint").alias("status"), F.length("body").cast("bigint").alias("chars"))
        return paths.probe(narrow, listed, targets(spark, sf)).withColumn("path_pos", F.col("path_pos").cast("bigint"))

    return query


def probe_documents(spark, sf):
    return paths.probe(seeds.documents(spark, sf), paths.DOCUMENTS).select(
        "doc_id", "target", "path", F.col("path_pos").cast("bigint").alias("path_pos"))


def probe_coverage(spark, sf):
    return paths.coverage(seeds.captures(spark, sf), targets(spark, sf), paths.SENSITIVE).select("target", "path", "url")


def uncaptured_targets(spark, sf):
    # of the seeded captures those with a server error are the table, so that some targets have none
    return paths.uncaptured_targets(seeds.captures(spark, sf).filter("status = 500"), targets(spark, sf))


# --- scalars ---

def tokens(spark, sf) -> DataFrame:
    found = F.regexp_extract_all("text", F.lit("[A-Za-z0-9+/=_-]{6,}"), F.lit(0))
    return table(spark, sf, "documents").select("doc_id", F.posexplode(found).alias("pos", "token"))


def entropy_query(spark, sf):
    return tokens(spark, sf).groupBy("token").agg(F.count(F.lit(1)).alias("n")).select(
        "token", "n", F.round(entropy.shannon_entropy(F.col("token")), 9).alias("entropy"),
        entropy.is_high_entropy(F.col("token")).alias("high"))


def charset_ratio(spark, sf):
    return tokens(spark, sf).select("token").distinct().select(
        "token", F.round(entropy.charset_ratio(F.col("token")), 9).alias("ratio"))


def classify_token(spark, sf):
    return tokens(spark, sf).select("token").distinct().select(
        entropy.classify_string(F.col("token")).alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def likely_secret(spark, sf):
    flagged = tokens(spark, sf).select("token").distinct().select(
        "token", entropy.is_likely_secret(F.col("token")).alias("s"))
    return flagged.filter("s.flag").select("token", F.round("s.entropy", 9).alias("entropy"))


def context_window(spark, sf):
    words = F.array_distinct(F.regexp_extract_all("text", F.lit("[a-z]{12,}"), F.lit(0)))
    return table(spark, sf, "documents").withColumn("word", F.explode(words)).select(
        "doc_id", "word", text.context_window(F.col("text"), F.col("word"), 50).alias("context"))


def line_context(spark, sf):
    return table(spark, sf, "documents").withColumn("lines", F.split("text", "\n")).select(
        "doc_id", text.line_context(F.col("lines"), lambda line: F.contains(line, F.lit("the")), 1).alias("context"))


def url_resolve(spark, sf):
    rows = pages(spark, sf).select("target", "url", F.posexplode(F.regexp_extract_all(
        "body", F.lit("""(?i)(?:href|src)=["']([^"']+)["']"""), F.lit(1))).alias("pos", "link"))
    return rows.select(
        "url", F.col("pos").cast("bigint").alias("pos"), net.resolve(F.col("target"), F.col("link")).alias("resolved"),
        net.hostname(F.col("target")).alias("host"), net.join_path(F.col("target"), F.col("link")).alias("joined"),
        net.sub_url(F.col("target"), F.lit("dev")).alias("sub"))


def private_ip(spark, sf):
    quads = F.regexp_extract_all("body", F.lit("[0-9]{1,3}(?:[.][0-9]{1,3}){3}"), F.lit(0))
    rows = seeds.captures(spark, sf).select("url", "body").unionByName(documents(spark, sf).select("url", "body"))
    ip = F.col("ip")
    return rows.select("url", F.explode(quads).alias("ip")).groupBy("ip").agg(F.count(F.lit(1)).alias("n")).select(
        "ip", "n", net.valid_ipv4(ip).alias("valid"), net.private_ipv4(ip).alias("private"))


# --- source text on natural tables ---

def source_rules_on(read, *rule_ids):
    rules = [r for r in source_rules.RULES if not rule_ids or r.rule_id in rule_ids]

    def query(spark, sf):
        return findings(run(read(spark, sf), body.source_hits(rules)))

    return query


# --- scripts, technologies, documents ---

def js_inputs(spark, sf):
    return javascript.js_inputs(seeds.captures(spark, sf)).select(
        "target", "page", F.col("source_pos").cast("bigint").alias("source_pos"), "script_url",
        F.col("chars").cast("bigint").alias("chars"), "external")


def js(part):
    return lambda spark, sf: findings(javascript.js_rules(seeds.captures(spark, sf), parts=[part]))


def tech_fingerprint(spark, sf):
    return tech.tech(seeds.captures(spark, sf)).select("target", "url", "category", "tech", F.col("seq").cast("bigint").alias("seq"))


def metadata_route(spark, sf):
    return metadata.route(seeds.documents(spark, sf)).select("doc_id", "doc_kind")


def office_captures(spark, sf) -> DataFrame:
    """Seeded documents with the property part packed into a real archive."""

    def pack(batches):
        for batch in batches:
            contents = []
            for xml in batch["xml"]:
                buffer = io.BytesIO()
                with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as archive:
                    archive.writestr("[Content_Types].xml", "<Types/>")
                    if xml is not None:
                        archive.writestr("docProps/core.xml", xml)
                contents.append(buffer.getvalue())
            yield batch.drop(columns="xml").assign(body_bytes=contents)

    columns = ["target", "url", "status", "content_type", "fetched_at", "xml"]
    return seeds.documents(spark, sf).select(*columns).mapInPandas(
        pack, "target string, url string, status int, content_type string, fetched_at timestamp, body_bytes binary")


def office_metadata(spark, sf):
    return findings(metadata.office_metadata(office_captures(spark, sf)))


# --- scoring, dedup, rollups ---

def error_raw(spark, sf):
    return body.error_pages(seeds.captures(spark, sf))


def sample(spark, sf) -> DataFrame:
    """De-duplicated findings used by rollups and reports."""
    captures = seeds.captures(spark, sf)
    return dedup.dedup(scoring.score(run(captures, body.error_hits(), body.cloud_hits(), files.sensitive_file_hits)))


def score_findings(spark, sf):
    return shown(scoring.score(error_raw(spark, sf)))


OVERRIDES = {"errors": "Informational"}


def severity_override(spark, sf):
    by_table = spark.createDataFrame([("errors", "Informational")], "module string, severity string")
    return shown(dedup.dedup(scoring.score(error_raw(spark, sf), by_table)))


def confidence_scores(spark, sf):
    return scoring.score(error_raw(spark, sf)).groupBy("confidence").agg(
        F.count(F.lit(1)).alias("n"), F.max(scoring.confidence_score(F.col("confidence"))).alias("score"))


def dedup_findings(spark, sf):
    return findings(run(seeds.captures(spark, sf), body.source_hits(), body.secret_hits()))


def _known(spark, sf):
    return dedup.dedup(scoring.score(body.error_pages(seeds.captures(spark, sf).filter("status = 200"))))


def new_findings(spark, sf):
    return shown(dedup.new_only(scoring.score(error_raw(spark, sf)), _known(spark, sf)))


def added_findings(spark, sf):
    return dedup.add_all(scoring.score(error_raw(spark, sf)), _known(spark, sf))


def _counts(df: DataFrame) -> DataFrame:
    return df.withColumn("severity_rank", F.col("severity_rank").cast("bigint"))


def severity_counts(spark, sf):
    return _counts(rollup.severity_counts(sample(spark, sf)))


def severity_counts_by_target(spark, sf):
    return _counts(rollup.severity_counts(sample(spark, sf), ["target"]))


def findings_by_module(spark, sf):
    return rollup.count_by(sample(spark, sf), "module", "confidence")


def findings_rollup(spark, sf):
    return rollup.findings_cube(sample(spark, sf), "target", "module", "severity")


def scan_stats(spark, sf):
    return rollup.scan_stats(targets(spark, sf), seeds.captures(spark, sf), sample(spark, sf))


def severity_gate(spark, sf):
    gate = rollup.gate(sample(spark, sf), "High")
    return gate.select("failed", F.col("exit_code").cast("bigint").alias("exit_code"))


def severity_share(spark, sf):
    return _counts(rollup.severity_share(sample(spark, sf)))


def findings_total(spark, sf):
    return rollup.total(sample(spark, sf))


def findings_filtered(spark, sf):
    found = sample(spark, sf)
    return shown(rollup.by_confidence(rollup.by_module(rollup.by_severity(found, "High"), "cloud_exposure"), "High"))


# --- reports ---

def report_rows_csv(spark, sf):
    return sinks.csv_rows(sample(spark, sf))


def report_rows_json(spark, sf):
    return sinks.json_rows(sample(spark, sf)).drop("timestamp").withColumn("tags", F.to_json("tags"))


def report(make):
    return lambda spark, sf: make(sample(spark, sf))


def report_summary_md(spark, sf):
    return _counts(sinks.markdown_summary(sample(spark, sf)))


def report_bar_html(spark, sf):
    return _counts(sinks.html_bar(rollup.severity_share(sample(spark, sf))))


def report_head_md(spark, sf):
    return sinks.markdown_head(scan_stats(spark, sf))


def report_summary_json(spark, sf):
    return sinks.json_summary(scan_stats(spark, sf))


def report_summary_console(spark, sf):
    return sinks.console_summary(scan_stats(spark, sf)).withColumn("pos", F.col("pos").cast("bigint"))


GENERATED = 1704164645


def report_file(write):
    """A report written to files and read back: its lines and how often each occurs."""
    def query(spark, sf):
        folder = fresh_folder(spark, "report")
        write(sample(spark, sf), scan_stats(spark, sf), folder, F.timestamp_seconds(F.lit(GENERATED)))
        lines = spark.read.option("lineSep", "\n").text(folder)
        return lines.groupBy(F.col("value").alias("line")).agg(F.count(F.lit(1)).alias("n"))

    return query


# --- readers ---

def responses_read(spark, sf):
    """Captures written as JSON lines and read as responses."""
    folder = fresh_folder(spark, "responses")
    seeds.captures(spark, sf).write.json(folder)
    return readers.read_responses(spark, folder, "json").select(
        "target", "url", F.col("status").cast("bigint").alias("status"), F.coalesce(F.length("body"), F.lit(-1)).cast("bigint").alias("chars"),
        F.unix_timestamp("fetched_at").alias("fetched_s"))


def dns_read(spark, sf):
    folder = fresh_folder(spark, "dns")
    seeds.dns_records(spark, sf).write.parquet(folder)
    return readers.read_dns(spark, folder)


def documents_from_responses(spark, sf):
    """Files among the captures, with the type that a header names."""
    rows = seeds.documents(spark, sf).select(
        "target", "url", "status", F.create_map(F.lit("content-TYPE"), "content_type").alias("headers"), "body_bytes", "fetched_at")
    found = readers.documents_from_responses(rows)
    return found.select(
        (F.unix_timestamp("fetched_at") - 1704067200).alias("doc_id"), "target", "url", F.col("status").cast("bigint").alias("status"),
        "content_type", F.octet_length("body_bytes").cast("bigint").alias("bytes"))


OWN_RULES = [
    Rule("link_title", "Link to a page of a site", r"href=[\"']([^\"']+)[\"']", 1, ("href=",), tier="Low"),
    Rule("long_number", "Long number", r"[0-9]{6,}"),
]


def findings_roundtrip(spark, sf):
    folder = fresh_folder(spark, "roundtrip")
    sinks.write_json(sample(spark, sf), scan_stats(spark, sf), folder)
    back = readers.read_findings(spark, f"{folder}/findings")
    return back.select(*[c for c in sinks.JSON_FIELDS if c not in ("timestamp", "tags")], F.concat_ws("; ", "tags").alias("tags"))


# --- streams ---

def streamed(sf: str, name: str) -> str:
    # a glob: a stream takes a plain path for a folder, and tables may be single files
    return f"{sf}/{name}.parque[t]"


def page_stream(spark, sf) -> DataFrame:
    schema = table(spark, sf, "pages").schema
    return _timed(stream.stream_responses(spark, streamed(sf, "pages"), schema=schema))


def _timed(rows: DataFrame) -> DataFrame:
    return rows.select(
        net.origin(F.col("url")).alias("target"), "url", F.lit(200).alias("status"), F.col("html").alias("body"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("page_id") * 60).alias("fetched_at"))


def _finished(query) -> None:
    query.awaitTermination()
    if query.exception():
        raise query.exception()


def stream_findings(spark, sf):
    folder = fresh_folder(spark, "stream-findings")
    _finished(stream.write_findings(
        page_stream(spark, sf), f"{folder}/table", f"{folder}/state",
        find=lambda batch: dedup.dedup(scoring.score(run(batch, body.source_hits())))))
    return shown(spark.read.parquet(f"{folder}/table"))


def _stream_source(spark, sf):
    return stream.stream_findings(page_stream(spark, sf), [body.source_hits()])


def stream_distinct(spark, sf):
    folder = fresh_folder(spark, "stream-distinct")
    rows = stream.distinct_findings(_stream_source(spark, sf)).select("target", "module", "title", "severity", "fingerprint")
    _finished(rows.writeStream.format("parquet").option("path", f"{folder}/table").option(
        "checkpointLocation", f"{folder}/state").trigger(availableNow=True).start())
    return spark.read.parquet(f"{folder}/table")


def capture_stream(spark, sf, folder: str) -> DataFrame:
    """The seeded captures as several files, one per micro-batch."""
    rows = seeds.captures(spark, sf)
    rows.repartition(4, "url").write.parquet(folder)
    return stream.stream_responses(spark, folder, schema=rows.schema, files_per_batch=1)


def stream_counts(spark, sf):
    folder = fresh_folder(spark, "stream-counts")
    found = stream.stream_findings(
        capture_stream(spark, sf, f"{folder}/in"), [body.source_hits(), body.secret_hits(), body.error_hits()])
    _finished(stream.write_latest(stream.live_counts(found), f"{folder}/table", f"{folder}/state"))
    return spark.read.parquet(f"{folder}/table")


def stream_scripts(spark, sf):
    """Findings in scripts that arrive before or after the pages that load them."""
    folder = fresh_folder(spark, "stream-scripts")
    _finished(stream.write_findings(
        capture_stream(spark, sf, f"{folder}/in"), f"{folder}/table", f"{folder}/state", modules=["javascript"]))
    return spark.read.parquet(f"{folder}/table").select("target", "module", "title", "severity", "fingerprint")


def _latest_windows(df: DataFrame, *keys: str) -> DataFrame:
    # updates only ever raise a count
    return df.groupBy(F.unix_timestamp("window_start").alias("window_start"), *keys).agg(F.max("n").alias("n"))


def stream_windowed_counts(spark, sf):
    folder = fresh_folder(spark, "stream-windows")
    counts = stream.windowed_counts(_stream_source(spark, sf), "10 minutes", "1 hour")
    _finished(stream.write_latest(counts, f"{folder}/table", f"{folder}/state", "update"))
    return _latest_windows(spark.read.parquet(f"{folder}/table"), "severity")


def stream_event_counts(spark, sf):
    """Findings met by the events of a stream, per hour of event time."""
    folder = fresh_folder(spark, "stream-events")
    page_rows = table(spark, sf, "pages")
    by_id = page_rows.select(
        F.lit("pages").alias("target"), F.col("page_id").cast("string").alias("url"), F.lit(200).alias("status"),
        F.col("html").alias("body"), F.lit(None).cast("timestamp").alias("fetched_at"))
    per_page = scoring.score(run(by_id, body.source_hits())).groupBy(
        F.col("url").cast("bigint").alias("page_id"), "severity").agg(F.count(F.lit(1)).alias("hits"))
    # the number of pages is a part of the plan: nothing is counted while the query is built
    page_rows.createOrReplaceTempView("visited_pages")
    visited = F.expr("event_id % (SELECT count(*) FROM visited_pages)")
    events = spark.readStream.schema(table(spark, sf, "events").schema).parquet(streamed(sf, "events"))
    counts = (
        events.withColumns({"page_id": visited, "ts": F.concat(F.col("ts").cast("string"), F.lit("Z")).cast("timestamp")})
        .withWatermark("ts", "1 hour")
        .join(per_page, "page_id")
        .groupBy(F.window("ts", "1 hour").alias("w"), "severity").agg(F.sum("hits").alias("n"))
        .select(F.col("w.start").alias("window_start"), "severity", "n"))
    _finished(stream.write_latest(counts, f"{folder}/table", f"{folder}/state", "update"))
    return _latest_windows(spark.read.parquet(f"{folder}/table"), "severity")


# --- the whole job ---

def detect_all(spark, sf):
    return shown(detect(
        seeds.captures(spark, sf), dns=seeds.dns_records(spark, sf),
        documents=office_captures(spark, sf).filter(metadata.kind(F.col("url"), F.col("content_type")) == "office").unionByName(
            seeds.documents(spark, sf).drop("doc_id", "xml").filter(metadata.kind(F.col("url"), F.col("content_type")) != "office"))))


def scan_findings(spark, sf):
    """Findings of the job that also gives technologies."""
    found, _ = scan(seeds.captures(spark, sf), modules=["source_code", "errors"])
    return shown(found)


def scan_technologies(spark, sf):
    _, technologies = scan(seeds.captures(spark, sf), modules=["source_code", "errors"])
    return technologies.groupBy("target", "url", "category", "tech").agg(F.count(F.lit(1)).alias("n"))


def detect_natural(spark, sf):
    """Source text, secrets and cloud rules over the natural tables."""
    rows = pages(spark, sf).select("target", "url", "status", "body", "fetched_at")
    for more in (documents(spark, sf), conversations(spark, sf)):
        rows = rows.unionByName(more.select("target", "url", "status", "body", "fetched_at"))
    return shown(detect(rows, modules=["source_code", "secrets", "errors", "cloud_exposure"]))


def first_slice(spark, sf):
    """Comments, addresses and numbers in the pages, scored and de-duplicated."""
    rules = [r for r in source_rules.RULES if r.rule_id in ("html_comment", "email", "ip_address", "phone")]
    return findings(run(pages(spark, sf), body.source_hits(rules)))


QUERIES = {
    "first_slice": first_slice,
    "targets_clean": targets_clean,
    "targets_rejected": targets_rejected,
    "probe_sensitive": probe(paths.SENSITIVE),
    "probe_git": probe(paths.GIT),
    "probe_api_docs": probe(paths.API),
    "probe_directories": probe(paths.DIRECTORIES),
    "probe_documents": probe_documents,
    "probe_coverage": probe_coverage,
    "uncaptured_targets": uncaptured_targets,
    "sensitive_file": on_captures(files.sensitive_files),
    "disclosure_headers": on_captures(headers.disclosure_headers),
    "infrastructure_headers": on_captures(headers.infrastructure_headers),
    "source_findings": on_captures(body.source_text),
    "source_findings_pages": source_rules_on(pages),
    "source_findings_documents": source_rules_on(documents),
    "source_email": source_rules_on(documents, "email"),
    "source_private_ip": source_rules_on(seeds.captures, "ip_address"),
    "js_inputs": js_inputs,
    "js_secrets": js("secrets"),
    "js_endpoints": js("endpoints"),
    "js_env": js("env"),
    "js_config": js("config"),
    "js_cloud_refs": js("cloud"),
    "secrets_scan": on_captures(lambda c: run(c, body.secret_hits())),
    "secrets_documents": lambda spark, sf: findings(run(documents(spark, sf), body.secret_hits())),
    "entropy_tokens": on_captures(lambda c: run(c, body.token_hits())),
    "entropy_tokens_documents": lambda spark, sf: findings(run(documents(spark, sf), body.token_hits())),
    "error_pages": on_captures(body.error_pages),
    "directory_listing": on_captures(lambda c: run(c, listing.listing_hits)),
    "suspected_listing": on_captures(lambda c: run(c, listing.suspected_listing_hits)),
    "api_docs": on_captures(lambda c: run(c, files.api_marker_hits)),
    "api_spec_fallback": on_captures(files.api_specifications),
    "git_exposure": on_captures(files.git_exposure),
    "cloud_refs": on_captures(lambda c: run(c, body.cloud_hits(identifiers=[]))),
    "cloud_ids": on_captures(lambda c: run(c, body.cloud_hits(rules=[]))),
    "pdf_metadata": on_documents(metadata.pdf_metadata),
    "binary_metadata": on_documents(metadata.binary_metadata),
    "metadata_route": metadata_route,
    "office_metadata": office_metadata,
    "dns_txt": on_dns(dns.txt_records),
    "dns_mail_labels": on_dns(dns.mail_labels),
    "dns_subdomains": on_dns(dns.dns_subdomains),
    "dns_reverse": on_dns(dns.dns_reverse),
    "tech_fingerprint": tech_fingerprint,
    "tech_summary": lambda spark, sf: tech.tech_summary(seeds.captures(spark, sf)),
    "entropy": entropy_query,
    "charset_ratio": charset_ratio,
    "classify_token": classify_token,
    "likely_secret": likely_secret,
    "context_window": context_window,
    "line_context": line_context,
    "url_resolve": url_resolve,
    "private_ip": private_ip,
    "score_findings": score_findings,
    "severity_override": severity_override,
    "confidence_scores": confidence_scores,
    "dedup_findings": dedup_findings,
    "new_findings": new_findings,
    "added_findings": added_findings,
    "severity_counts": severity_counts,
    "severity_counts_by_target": severity_counts_by_target,
    "findings_by_module": findings_by_module,
    "findings_rollup": findings_rollup,
    "findings_total": findings_total,
    "findings_filtered": findings_filtered,
    "scan_stats": scan_stats,
    "severity_gate": severity_gate,
    "severity_share": severity_share,
    "report_rows_md": report(sinks.markdown_rows),
    "report_summary_md": report_summary_md,
    "report_head_md": report_head_md,
    "report_rows_html": report(sinks.html_rows),
    "report_bar_html": report_bar_html,
    "report_rows_csv": report_rows_csv,
    "report_rows_json": report_rows_json,
    "report_summary_json": report_summary_json,
    "report_rows_console": report(sinks.console_rows),
    "report_summary_console": report_summary_console,
    "report_file_md": report_file(sinks.write_markdown),
    "report_file_html": report_file(sinks.write_html),
    "responses_read": responses_read,
    "dns_read": dns_read,
    "documents_from_responses": documents_from_responses,
    "own_rules": on_captures(lambda rows: run(rows, body.source_hits(OWN_RULES))),
    "findings_roundtrip": findings_roundtrip,
    "stream_findings": stream_findings,
    "stream_distinct": stream_distinct,
    "stream_counts": stream_counts,
    "stream_scripts": stream_scripts,
    "stream_windowed_counts": stream_windowed_counts,
    "stream_event_counts": stream_event_counts,
    "scan_findings": scan_findings,
    "scan_technologies": scan_technologies,
    "detect_natural": detect_natural,
    "detect_all": detect_all,
}
