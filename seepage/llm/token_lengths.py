"""Exact histogram of encoded lengths, answering every context limit.

Documents are encoded and counted by length; only (length, documents) pairs
leave a task.  Sums over the lengths from the longest down give, for every
limit L that occurs as a length: documents and tokens in texts of at least
that length, all tokens left when texts are cut at L, and the rank of the
length, from which any quantile follows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seepage.llm.encoding import default_path, lengths
from seepage.llm.tables import stored

#: Lengths whose sums are made by one task; the sums over the strips are few.
STRIP = 4096


def histogram(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(length, n_docs) over all of ``docs`` (text); null texts count as empty."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[int] = Counter()
        for _, found in lengths(batches, path):
            counts.update(found)
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int64()), pa.array(list(counts.values()), pa.int64())], ["length", "n_docs"])

    return docs.select("text").mapInArrow(run, "length long, n_docs long").groupBy("length").agg(F.sum("n_docs").alias("n_docs"))


def limits(counts: DataFrame, strip: int = STRIP) -> DataFrame:
    """One row per length with the sums that answer it as a context limit.

    Columns: length, n_docs, n_tokens (of texts of this length), docs_at_least,
    tokens_at_least, docs_up_to, share_up_to (the quantile that the length is),
    truncated_total (all tokens when texts are cut to this length) and total.
    An empty table gives no rows.
    """
    rows = counts.select("length", "n_docs", (F.col("length") * F.col("n_docs")).alias("n_tokens"), F.expr(f"length div {strip}").alias("_strip"))
    strips = rows.groupBy("_strip").agg(F.sum("n_docs").alias("_docs"), F.sum("n_tokens").alias("_tokens"))
    above = Window.orderBy(F.col("_strip").desc()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    strips = strips.select(
        F.col("_strip"), F.coalesce(F.sum("_docs").over(above), F.lit(0)).alias("_docs_above"), F.coalesce(F.sum("_tokens").over(above), F.lit(0)).alias("_tokens_above"),
        F.sum("_docs").over(every).alias("_all_docs"), F.sum("_tokens").over(every).alias("total"))
    down = Window.partitionBy("_strip").orderBy(F.col("length").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inner = rows.select("*", F.sum("n_docs").over(down).alias("_docs_here"), F.sum("n_tokens").over(down).alias("_tokens_here"))
    summed = inner.join(strips, "_strip").select(
        "length", "n_docs", "n_tokens", (F.col("_docs_here") + F.col("_docs_above")).alias("docs_at_least"),
        (F.col("_tokens_here") + F.col("_tokens_above")).alias("tokens_at_least"), "_all_docs", "total")
    up_to = F.col("_all_docs") - F.col("docs_at_least") + F.col("n_docs")
    return summed.select(
        "length", "n_docs", "n_tokens", "docs_at_least", "tokens_at_least", up_to.alias("docs_up_to"), (up_to / F.col("_all_docs")).alias("share_up_to"),
        (F.col("total") - F.col("tokens_at_least") + F.col("length") * F.col("docs_at_least")).alias("truncated_total"), "total")


def length_report(docs: DataFrame, path: str | None = None) -> DataFrame:
    return limits(stored(histogram(docs, path), "lengths"))


def quantile(report: DataFrame, share: float) -> DataFrame:
    """The least length that at least ``share`` of the documents do not exceed."""
    return report.filter(F.col("share_up_to") >= share).agg(F.min("length").alias("length"))


def truncated_total(report: DataFrame, limit: int) -> DataFrame:
    """Tokens left when texts are cut to any ``limit``, from the next length above it."""
    above = f"filter (where length > {limit})"
    cut = F.expr(f"min_by(total - tokens_at_least + {limit} * docs_at_least, length) {above}")
    return report.agg(F.coalesce(cut, F.max("total")).alias("tokens"))
