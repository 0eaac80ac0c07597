"""Sources: targets, captured responses, documents, DNS answers, findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seepage.functions.net import authority
from seepage.functions.text import strip
from seepage.rules.scoring import CONFIDENCE_SCORES, SEVERITIES
from seepage.schema import DNS, RESPONSES


def clean_targets(lines: DataFrame, column: str = "value") -> DataFrame:
    """One target per line; blank lines and comments are dropped."""
    return (
        lines.select(strip(F.col(column)).alias("target"))
        .filter((F.length("target") > 0) & ~F.startswith("target", F.lit("#")))
        .select(F.regexp_replace("target", "/+$", "").alias("target"))
    )


def read_targets(spark: SparkSession, path: str) -> DataFrame:
    return clean_targets(spark.read.text(path))


def _completed(df: DataFrame) -> DataFrame:
    url = strip(F.col("target"))
    whole = F.when(F.startswith(url, F.lit("http://")) | F.startswith(url, F.lit("https://")), url).otherwise(
        F.concat(F.lit("https://"), url))
    return df.withColumn("target", whole)


def valid_targets(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, rejected) targets, with the scheme completed.

    One bad line does not stop the job; it ends up in the second table.
    """
    completed = _completed(df)
    valid = authority(F.col("target")) != ""
    return completed.filter(valid), completed.filter(~valid)


def read_responses(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.schema(RESPONSES).format(fmt).load(path)


def spread(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """A freshly read table with at least one partition per core.

    Rules are heavy on processors, and a table in one small file is read by
    one task.  Tables with enough splits are returned as they are, so nothing
    large is ever shuffled.
    """
    wanted = partitions or df.sparkSession.sparkContext.defaultParallelism
    if df.isStreaming or df.rdd.getNumPartitions() >= wanted:
        return df
    return df.repartition(wanted)


def read_documents(spark: SparkSession, path: str, scheme: str = "https") -> DataFrame:
    """Files below ``path/<host>/...`` as captured documents."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    root = "/" + path.split("://", 1)[-1].strip("/").split("/", 1)[-1] if "://" in path else path.rstrip("/")
    relative = F.regexp_replace(F.substring_index("path", root.rstrip("/") + "/", -1), "^/+", "")
    host = F.substring_index(relative, "/", 1)
    return files.select(
        F.concat(F.lit(f"{scheme}://"), host).alias("target"),
        F.concat(F.lit(f"{scheme}://"), relative).alias("url"),
        F.lit(200).alias("status"),
        F.lit("").alias("content_type"),
        F.col("content").alias("body_bytes"),
        F.col("modificationTime").alias("fetched_at"),
    )


def documents_from_responses(responses: DataFrame) -> DataFrame:
    """Captures with a binary body as documents."""
    mime = F.get(F.filter(F.map_entries("headers"), lambda e: F.lower(e["key"]) == "content-type"), F.lit(0))["value"]
    return responses.filter("body_bytes is not null").select(
        "target", "url", "status", F.coalesce(mime, F.lit("")).alias("content_type"), "body_bytes", "fetched_at")


def read_dns(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    reader = spark.read.schema(DNS).format(fmt)
    return (reader.option("header", "true") if fmt == "csv" else reader).load(path)


_TEXTS = [
    "target", "module", "title", "severity", "confidence", "evidence", "cwe", "owasp", "recommendation", "url",
    "parameter", "description", "cvss_estimate", "timestamp",
]
# What a missing field means.
_DEFAULTS = {"severity": "Informational", "confidence": "Medium"}


def with_defaults(findings: DataFrame) -> DataFrame:
    return findings.select(
        *[F.coalesce(c, F.lit(_DEFAULTS.get(c, ""))).alias(c) for c in _TEXTS],
        F.coalesce("tags", F.array().cast("array<string>")).alias("tags"),
    )


def read_findings(spark: SparkSession, path: str, on_invalid: str = "raise") -> DataFrame:
    """Findings written as JSON lines.

    An unknown severity or confidence is an error; with ``on_invalid="mark"``
    such rows are kept and marked in the column ``invalid``.
    """
    schema = ", ".join(f"{c} string" for c in _TEXTS) + ", tags array<string>"
    found = with_defaults(spark.read.schema(schema).json(path))
    valid = F.col("severity").isin(SEVERITIES) & F.col("confidence").isin(list(CONFIDENCE_SCORES))
    if on_invalid == "mark":
        return found.withColumn("invalid", ~valid)
    if on_invalid != "raise":
        raise ValueError(f"on_invalid must be raise or mark, not {on_invalid}")
    message = F.concat(F.lit("unknown severity or confidence: "), "severity", F.lit(", "), "confidence")
    return found.withColumn("severity", F.when(valid, F.col("severity")).otherwise(F.raise_error(message)))
