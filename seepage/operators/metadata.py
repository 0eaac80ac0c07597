"""Properties of captured documents.

Input: (target, url, status, content_type, body_bytes, fetched_at).
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from seepage.functions.net import path_of
from seepage.functions.text import let, strip
from seepage.operators.matching import as_raw, hit, no_hits
from seepage.operators.paths import DOCUMENTS, path_position
from seepage.rules import java_pattern
from seepage.rules import metadata as rules


def extension(url: Column) -> Column:
    """``.`` and what follows the last dot of the path, lower case."""
    path = F.regexp_replace(url, r"^[a-z]+://[^/]*/?|[?#].*$", "")
    return F.when(F.contains(path, F.lit(".")), F.concat(F.lit("."), F.lower(F.substring_index(path, ".", -1)))).otherwise("")


def kind(url: Column, content_type: Column) -> Column:
    """pdf, office or other."""
    ext = extension(url)
    mime = F.lower(F.coalesce(content_type, F.lit("")))
    return (
        F.when((ext == ".pdf") | F.contains(mime, F.lit("pdf")), "pdf")
        .when(ext.isin(rules.OFFICE_EXTENSIONS) | F.contains(mime, F.lit("openxml")), "office")
        .otherwise("other")
    )


def route(docs: DataFrame) -> DataFrame:
    """Non-empty captures with ``doc_kind``."""
    return docs.filter("status = 200").filter(F.length("body_bytes") > 0).withColumn(
        "doc_kind", kind(F.col("url"), F.col("content_type")))


def decoded(content: Column) -> Column:
    """UTF-8 text with the replacement character for what is malformed."""
    return F.make_valid_utf8(content.cast("string"))


def _texts(docs: DataFrame, doc_kind: str) -> DataFrame:
    return route(docs).filter(F.col("doc_kind") == doc_kind).select(
        "target", "url", "status", "fetched_at",
        F.coalesce(path_position(path_of(F.col("url"), F.col("target")), DOCUMENTS), F.lit(len(DOCUMENTS))).alias("pos"),
        decoded(F.col("body_bytes")).alias("text"),
    )


def _raw(texts: DataFrame, hits: Column) -> DataFrame:
    # all probes of a target share one origin, their order is the list's
    return as_raw(texts.select("target", F.col("target").alias("origin"), "fetched_at", F.explode(hits).alias("hit")))


def _one(title: Column, evidence: Column, tags: list[str], section: int, pos: Column | None = None) -> Column:
    return hit(
        rules.MODULE, title, evidence, F.array(*[F.lit(t) for t in tags]), F.col("pos"), section=section, pos=pos, rule_id="-".join(tags[1:]))


def pdf_hits(text: Column) -> Column:
    def field(name: str) -> Column:
        # presence and value differ: an empty value is still a field
        found = F.regexp_extract_all(text, F.lit(java_pattern(rules.PDF_FIELD.format(field=name), "i")), F.lit(1))
        return F.when(F.contains(text, F.lit("/")), F.get(found, F.lit(0)))

    def info(values: Column) -> Column:
        lines = F.filter(
            F.transform(F.map_entries(values), lambda e: F.when(
                e["value"].isNotNull(), F.concat(e["key"], F.lit(": "), e["value"]))),
            lambda l: l.isNotNull())
        author = values["Author"]
        summary = F.when(F.size(lines) > 0, F.array(_one(
            F.lit("PDF metadata exposed"), F.array_join(lines, "\n"), ["metadata", "pdf"], 0))).otherwise(no_hits())
        named = F.when(author.isNotNull() & ~author.isin(rules.NO_AUTHOR), F.array(_one(
            F.concat(F.lit("Document author disclosed: "), author), F.concat(F.lit("Author: "), author),
            ["metadata", "pdf", "author"], 1))).otherwise(no_hits())
        return F.concat(summary, named)

    fields = F.create_map(*[c for name in rules.PDF_FIELDS for c in (F.lit(name), field(name))])
    emails = F.when(F.contains(text, F.lit("@")), F.regexp_extract_all(
        text, F.lit(java_pattern(rules.EMAIL_FAST)), F.lit(0))).otherwise(F.array().cast("array<string>"))
    emails = F.filter(
        F.array_distinct(emails), lambda e: ~F.contains(e, F.lit("example")))
    paths = F.regexp_extract_all(text, F.lit(java_pattern(rules.INTERNAL_PATH)), F.lit(0))
    source = "|".join(e.replace(".", r"\.") for e in rules.SOURCE_EXTENSIONS)
    paths = F.filter(F.array_distinct(paths), lambda p: ~p.rlike(source))
    return F.concat(
        let(fields, info),
        F.transform(emails, lambda e, i: _one(
            F.concat(F.lit("Email address in PDF metadata: "), e), F.concat(F.lit("Email: "), e),
            ["metadata", "pdf", "email"], 2, i)),
        F.transform(paths, lambda p, i: _one(
            F.concat(F.lit("Internal path in PDF metadata: "), p), F.concat(F.lit("Path: "), p),
            ["metadata", "pdf", "internal-path"], 3, i)),
    )


def pdf_metadata(docs: DataFrame) -> DataFrame:
    texts = _texts(docs, "pdf")
    # ``let`` nests arrays, so the hits of the information dictionary stay one array
    return _raw(texts, pdf_hits(F.col("text")))


def label_hits(text: Column) -> Column:
    labels = F.regexp_extract_all(text, F.lit(java_pattern(rules.LABEL, "i")), F.lit(1))
    names = F.transform(
        F.array_distinct(labels),
        lambda a: F.regexp_replace(F.regexp_replace(strip(a), r'^"+|"+\z', ""), r"^'+|'+\z", ""))
    names = F.filter(names, lambda a: ~a.isin(rules.NO_AUTHOR))
    return F.transform(names, lambda a, i: _one(
        F.concat(F.lit("Document metadata author: "), a), F.concat(F.lit("Author: "), a), ["metadata", "author"], 0, i))


def binary_metadata(docs: DataFrame) -> DataFrame:
    """Author labels in files that are neither PDF nor Office."""
    return _raw(_texts(docs, "other"), label_hits(F.col("text")))


def _core_xml(content: bytes) -> str | None:
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            if rules.OFFICE_MEMBER in archive.namelist():
                return archive.read(rules.OFFICE_MEMBER).decode("utf-8", errors="replace")
    except (zipfile.BadZipFile, zipfile.LargeZipFile, ValueError, NotImplementedError, RuntimeError, OSError, EOFError):
        pass  # not an archive, or a broken one: nothing to report
    return None


def core_properties(docs: DataFrame) -> DataFrame:
    """Office captures with the text of their property part.

    Opening an archive is the one step that Spark has no expression for.
    """

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(text=[_core_xml(bytes(b)) for b in batch["body_bytes"]]).drop(columns="body_bytes")

    office = route(docs).filter("doc_kind = 'office'").select(
        "target", "url", "status", "fetched_at",
        F.coalesce(path_position(path_of(F.col("url"), F.col("target")), DOCUMENTS), F.lit(len(DOCUMENTS))).alias("pos"),
        "body_bytes",
    )
    schema = "target string, url string, status int, fetched_at timestamp, pos int, text string"
    return office.mapInPandas(unpack, schema).filter("text is not null")


def office_hits(text: Column) -> Column:
    lines = F.filter(
        F.array(*[
            F.when(text.rlike(java_pattern(p)), F.concat(
                F.lit(f"{name}: "), F.regexp_extract(text, java_pattern(p), 1)))
            for name, p in rules.OFFICE_FIELDS
        ]),
        lambda l: l.isNotNull())
    file_type = F.replace(extension(F.col("url")), F.lit("."), F.lit(""))

    def one(found: Column) -> Column:
        return hit(
            rules.MODULE, F.concat(F.upper(file_type), F.lit(" document metadata exposed")), F.array_join(found, "\n"),
            F.array(F.lit("metadata"), file_type), F.col("pos"), rule_id=file_type)

    return F.transform(F.filter(F.array(lines), lambda f: F.size(f) > 0), one)


def office_metadata(docs: DataFrame) -> DataFrame:
    return _raw(core_properties(docs), office_hits(F.col("text")))


@F.pandas_udf(StringType())
def _core_text(content: pd.Series) -> pd.Series:
    """Property part of each Office file; null stays null."""
    return content.map(lambda b: None if b is None else _core_xml(bytes(b)))


def documents_metadata(docs: DataFrame) -> DataFrame:
    """Hits of all kinds of documents from one scan; only Office files travel to Python."""
    routed = route(docs).select(
        "target", "url", "status", "fetched_at", "doc_kind",
        F.coalesce(path_position(path_of(F.col("url"), F.col("target")), DOCUMENTS), F.lit(len(DOCUMENTS))).alias("pos"),
        F.when(F.col("doc_kind") != "office", decoded(F.col("body_bytes"))).alias("plain"),
        _core_text(F.when(F.col("doc_kind") == "office", F.col("body_bytes"))).alias("core"),
    )
    return _raw(routed, (
        F.when(F.col("doc_kind") == "pdf", pdf_hits(F.col("plain")))
        .when(F.col("doc_kind") == "other", label_hits(F.col("plain")))
        .when(F.col("core").isNotNull(), office_hits(F.col("core")))
        .otherwise(no_hits())))
