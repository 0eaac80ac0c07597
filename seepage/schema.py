"""Table schemas and small adapters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seepage.functions.net import origin

RESPONSES = T.StructType([
    T.StructField("target", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("status", T.IntegerType()),
    T.StructField("headers", T.MapType(T.StringType(), T.StringType())),
    T.StructField("cookies", T.MapType(T.StringType(), T.StringType())),
    T.StructField("body", T.StringType()),
    T.StructField("body_bytes", T.BinaryType()),
    T.StructField("fetched_at", T.TimestampType()),
])

DNS = T.StructType([
    T.StructField("hostname", T.StringType()),
    T.StructField("rtype", T.StringType()),
    T.StructField("value", T.StringType()),
])

FINDINGS = T.StructType(
    [
        T.StructField(name, T.StringType())
        for name in (
            "target", "module", "title", "severity", "confidence", "evidence", "cwe", "owasp",
            "recommendation", "url", "parameter", "description", "cvss_estimate", "fingerprint",
        )
    ]
    + [T.StructField("timestamp", T.TimestampType()), T.StructField("tags", T.ArrayType(T.StringType()))]
)

# One reported match inside a response.
HIT = (
    "struct<kind:string,module:string,source_pos:int,section:int,rule_rank:int,match_pos:int,"
    "rule_id:string,rule_severity:string,title:string,evidence:string,description:string,"
    "url:string,status:int,tags:array<string>>"
)


def pages_as_responses(pages: DataFrame) -> DataFrame:
    """(url, html) pages as successful captures."""
    return pages.select(
        origin(F.col("url")).alias("target"),
        "url",
        F.lit(200).alias("status"),
        F.lit(None).cast("map<string,string>").alias("headers"),
        F.lit(None).cast("map<string,string>").alias("cookies"),
        F.col("html").alias("body"),
        F.lit(None).cast("timestamp").alias("fetched_at"),
    )


def documents_as_responses(documents: DataFrame) -> DataFrame:
    """(doc_id, text, source) documents as successful captures."""
    return documents.select(
        F.col("source").alias("target"),
        F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("url"),
        F.lit(200).alias("status"),
        F.lit(None).cast("map<string,string>").alias("headers"),
        F.lit(None).cast("map<string,string>").alias("cookies"),
        F.col("text").alias("body"),
        F.lit(None).cast("timestamp").alias("fetched_at"),
    )
