"""Sinks: JSON, CSV, Markdown, HTML and console forms of a findings table.

Every form is a table of rows that tasks write on their own; the part files
in name order, put one behind the other, are the report.  Evidence is whole; ``chars`` cuts it
for those who want short rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seepage.functions.text import html_escape, truncate
from seepage.operators.rollup import numbered, ordered, severity_counts
from seepage.rules.scoring import SEVERITIES

TOOL = "seepage"

# Columns of the forms.
JSON_FIELDS = [
    "target", "module", "title", "severity", "confidence", "evidence", "cwe", "owasp", "recommendation", "url",
    "parameter", "description", "cvss_estimate", "timestamp", "tags",
]
CSV_FIELDS = [
    ("Target", "target"), ("Module", "module"), ("Title", "title"), ("Severity", "severity"),
    ("Confidence", "confidence"), ("CWE", "cwe"), ("OWASP", "owasp"), ("URL", "url"),
    ("Description", "description"), ("Recommendation", "recommendation"), ("CVSS", "cvss_estimate"),
    ("Evidence", "evidence"), ("Tags", "tags"),
]
ICONS = {"Critical": "🔴", "High": "🟠", "Medium": "🟡", "Low": "🔵", "Informational": "⚪"}
CSS_CLASSES = {
    "Critical": "sev-critical", "High": "sev-high", "Medium": "sev-medium", "Low": "sev-low",
    "Informational": "sev-info",
}


def _text(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def _line(*parts: str | Column) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def _iso(stamp: Column) -> Column:
    return F.coalesce(F.date_format(F.to_utc_timestamp(stamp, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'+00:00'"), F.lit(""))


def json_rows(findings: DataFrame, chars: int | None = None) -> DataFrame:
    """The 15 fields of the JSON form."""
    columns = {
        "evidence": truncate(F.col("evidence"), chars),
        "timestamp": _iso(F.col("timestamp")) if dict(findings.dtypes).get("timestamp") == "timestamp" else _text("timestamp"),
        "tags": F.coalesce("tags", F.array().cast("array<string>")),
    }
    return findings.select(*[columns.get(c, _text(c)).alias(c) for c in JSON_FIELDS])


def json_summary(stats: DataFrame) -> DataFrame:
    """One JSON document with the tool and the totals."""
    counts = F.struct(*[F.col(s) for s in SEVERITIES])
    return stats.select(F.to_json(F.struct(
        F.struct(F.lit(TOOL).alias("name")).alias("tool"),
        F.struct(
            "total_urls", "completed_urls", "failed_urls", "total_findings", "duration_seconds",
            counts.alias("severity_counts"),
        ).alias("scan_summary"),
    )).alias("value"))


def write_json(findings: DataFrame, stats: DataFrame, path: str) -> None:
    """``path/findings`` (JSON lines, worst first) and ``path/summary``."""
    json_rows(ordered(findings)).write.mode("overwrite").json(f"{path}/findings")
    json_summary(stats).write.mode("overwrite").text(f"{path}/summary")


def csv_rows(findings: DataFrame, chars: int | None = None) -> DataFrame:
    columns = {
        "evidence": truncate(F.col("evidence"), chars),
        "tags": F.concat_ws("; ", "tags"),
    }
    return findings.select(*[columns.get(c, _text(c)).alias(name) for name, c in CSV_FIELDS])


def write_csv(findings: DataFrame, path: str) -> None:
    options = {
        "header": "true", "quote": '"', "escape": '"', "emptyValue": "",
        "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false",
    }
    csv_rows(ordered(findings)).write.mode("overwrite").options(**options).csv(path)


def _optional(name: str, line: Column) -> Column:
    """The line when the field is not empty; nulls are skipped by concat_ws."""
    return F.when(F.length(_text(name)) > 0, line)


def _icon() -> Column:
    return F.coalesce(F.create_map(*[F.lit(v) for p in ICONS.items() for v in p])[F.col("severity")], F.lit("⚪"))


def markdown_block(number: Column, chars: int | None = None) -> Column:
    """Heading, field table and evidence of one finding."""
    return F.concat_ws(
        "\n",
        _line("### ", number.cast("string"), ". ", _icon(), " ", _text("title")),
        F.lit(""),
        F.lit("| Field | Value |"),
        F.lit("|-------|-------|"),
        _line("| **Target** | `", _text("target"), "` |"),
        _line("| **Module** | ", _text("module"), " |"),
        _line("| **Severity** | **", _text("severity"), "** |"),
        _line("| **Confidence** | ", _text("confidence"), " |"),
        _line("| **CWE** | ", _text("cwe"), " |"),
        _line("| **OWASP** | ", _text("owasp"), " |"),
        _optional("url", _line("| **URL** | `", _text("url"), "` |")),
        _optional("cvss_estimate", _line("| **CVSS** | `", _text("cvss_estimate"), "` |")),
        _optional("description", _line("| **Description** | ", _text("description"), " |")),
        _optional("recommendation", _line("| **Recommendation** | ", _text("recommendation"), " |")),
        _optional("evidence", _line(
            "| **Evidence** | |\n\n```\n", truncate(F.col("evidence"), chars), "\n```")),
        F.lit(""), F.lit("---"), F.lit(""),
    )


def markdown_rows(findings: DataFrame, chars: int | None = None) -> DataFrame:
    """(number, value): one block per finding, numbered in report order."""
    return numbered(findings).select("number", markdown_block(F.col("number"), chars).alias("value"))


def markdown_summary(findings: DataFrame) -> DataFrame:
    """(severity_rank, value): the rows of the severity table."""
    return severity_counts(findings).select(
        "severity_rank", _line("| ", F.col("severity"), " | ", F.col("n").cast("string"), " |").alias("value"))


def _moment(generated: Column) -> Column:
    return F.date_format(F.to_utc_timestamp(generated, F.current_timezone()), "yyyy-MM-dd HH:mm:ss' UTC'")


def markdown_head(stats: DataFrame, generated: Column | None = None) -> DataFrame:
    """One row: title, time of the report, totals and severity table."""
    number = lambda c: F.col(c).cast("string")
    return stats.select(F.concat_ws(
        "\n",
        F.lit(f"# {TOOL} Scan Report"), F.lit(""),
        *([] if generated is None else [_line("**Generated:** ", _moment(generated))]),
        F.lit(f"**Tool:** {TOOL}"), F.lit(""),
        F.lit("## Executive Summary"), F.lit(""),
        _line("- **Total URLs Scanned:** ", number("completed_urls"), "/", number("total_urls")),
        _line("- **Failed URLs:** ", number("failed_urls")),
        _line("- **Total Findings:** ", number("total_findings")),
        _line("- **Scan Duration:** ", F.format_string("%.1f", F.col("duration_seconds")), "s"), F.lit(""),
        F.lit("### Severity Breakdown"), F.lit(""),
        F.lit("| Severity | Count |"), F.lit("|----------|-------|"),
        *[_line(f"| {s} | ", number(s), " |") for s in SEVERITIES], F.lit(""),
        F.lit("## Detailed Findings"), F.lit(""), F.lit("---"), F.lit(""),
        F.when(F.col("total_findings") == 0, F.lit("*No findings discovered.*\n")),
    ).alias("value"))


def write_markdown(findings: DataFrame, stats: DataFrame, path: str, generated: Column | None = None) -> None:
    """Whole report as ordered text parts, the head first; ``generated`` is the present time if it is not given."""
    _write_parts(markdown_head(stats, F.current_timestamp() if generated is None else generated), markdown_rows(findings), path)


def html_fragment(chars: int | None = None) -> Column:
    evidence = F.when(
        F.length(_text("evidence")) > 0,
        _line('<div class="finding-evidence">', html_escape(truncate(F.col("evidence"), chars)), "</div>"))
    tags = F.when(F.size("tags") > 0, _line(
        '<div class="finding-tags">',
        F.array_join(F.transform("tags", lambda t: _line(
            '<span class="tag">', html_escape(t), "</span>")), ""),
        "</div>"))

    def field(label: str, value: Column) -> Column:
        return _line(f"<span><strong>{label}:</strong> ", value, "</span>")

    return F.concat_ws(
        "\n",
        F.lit('<div class="finding">'),
        F.lit('<div class="finding-header">'),
        _line('<div class="finding-title">', html_escape(F.col("title")), "</div>"),
        _line('<span class="severity-badge sev-', _text("severity"), '">', _text("severity"), "</span>"),
        F.lit("</div>"),
        F.lit('<div class="finding-meta">'),
        field("Target", html_escape(F.col("target"))),
        field("Module", _text("module")),
        field("Confidence", _text("confidence")),
        field("CWE", _text("cwe")),
        field("OWASP", _text("owasp")),
        F.lit("</div>"),
        evidence,
        _line('<div class="finding-recommendation">💡 ', html_escape(F.col("recommendation")), "</div>"),
        tags,
        F.lit("</div>"),
    )


def html_rows(findings: DataFrame, chars: int | None = None) -> DataFrame:
    """(number, value): one fragment per finding in report order."""
    return numbered(findings).select("number", html_fragment(chars).alias("value"))


def html_bar(shares: DataFrame) -> DataFrame:
    """(severity_rank, value): the segments of the severity bar."""
    css = F.create_map(*[F.lit(v) for p in CSS_CLASSES.items() for v in p])[F.col("severity")]
    return shares.select("severity_rank", _line(
        '<div class="', css, '" style="width: ', F.format_string("%.1f", F.col("percent")), '%;"></div>').alias("value"))


def html_head(stats: DataFrame, generated: Column | None = None) -> DataFrame:
    """One row: title, time and totals, severity bar and a counter per severity."""
    number = lambda c: F.col(c).cast("string")
    share = lambda s: F.round(F.col(s) * 100.0 / F.greatest("total_findings", F.lit(1)), 1)
    facts = [
        *([] if generated is None else [_line("<span>Generated: ", _moment(generated), "</span>")]),
        _line("<span>URLs: ", number("completed_urls"), "/", number("total_urls"), "</span>"),
        _line("<span>Failed: ", number("failed_urls"), "</span>"),
        _line("<span>Duration: ", F.format_string("%.1f", F.col("duration_seconds")), "s</span>"),
        _line("<span>Findings: ", number("total_findings"), "</span>"),
    ]
    return stats.select(F.concat_ws(
        "\n",
        F.lit(f"<h1>{TOOL} Scan Report</h1>"),
        F.lit('<div class="scan-meta">'), *facts, F.lit("</div>"),
        F.lit('<div class="severity-bar">'),
        *[_line(f'<div class="{CSS_CLASSES[s]}" style="width: ', F.format_string("%.1f", share(s)), '%;"></div>') for s in SEVERITIES],
        F.lit("</div>"),
        F.lit('<div class="counters">'),
        *[_line(f'<div class="counter {CSS_CLASSES[s]}">{s}: ', number(s), "</div>") for s in SEVERITIES],
        F.lit("</div>"),
        F.when(F.col("total_findings") == 0, F.lit('<div class="no-findings"><h2>No findings discovered</h2></div>')),
    ).alias("value"))


def write_html(findings: DataFrame, stats: DataFrame, path: str, generated: Column | None = None) -> None:
    """Fragments of all findings behind the head, as ordered parts; ``generated`` is the present time if it is not given."""
    _write_parts(html_head(stats, F.current_timestamp() if generated is None else generated), html_rows(findings), path)


def console_rows(findings: DataFrame, chars: int | None = None) -> DataFrame:
    """(number, value): the lines printed for a finding."""
    lines = F.concat_ws(
        "\n",
        _line("#", F.col("number").cast("string"), " ", _text("severity"), " ", _text("title")),
        _line("      Target: ", _text("target")),
        _line("      Module: ", _text("module")),
        _optional("url", _line("      URL: ", _text("url"))),
        _line("      Confidence: ", _text("confidence")),
        _line("      CWE: ", _text("cwe"), " | OWASP: ", _text("owasp")),
        _optional("evidence", _line("      Evidence: ", truncate(F.col("evidence"), chars))),
    )
    return numbered(findings).select("number", lines.alias("value"))


def console_summary(stats: DataFrame) -> DataFrame:
    """(pos, metric, value): the summary table, then the severities."""
    number = lambda c: F.col(c).cast("string")
    rows = [
        ("URLs Scanned", _line(number("completed_urls"), "/", number("total_urls"))),
        ("Failed URLs", number("failed_urls")),
        ("Duration", _line(F.format_string("%.1f", F.col("duration_seconds")), "s")),
        ("Total Findings", number("total_findings")),
        *[(s, number(s)) for s in SEVERITIES],
    ]
    return stats.select(F.posexplode(F.array(*[
        F.struct(F.lit(name).alias("metric"), value.alias("value")) for name, value in rows
    ])).alias("pos", "row")).select("pos", "row.metric", "row.value")


def _write_parts(head: DataFrame, rows: DataFrame, path: str) -> None:
    """Text files whose order by name is that of the report.

    Numbered rows lie in partitions in report order already, so each is written
    as it is, without another sort; the head is the first partition.
    """
    head.select("value").coalesce(1).unionByName(rows.select("value")).write.mode("overwrite").text(path)
