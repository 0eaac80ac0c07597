"""Counts, statistics, gate, order and numbering of findings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seepage.operators.scoring import severity_rank
from seepage.rules.scoring import SEVERITIES
from seepage.sources.checkpoint import reliable


def _counts() -> list[Column]:
    return [F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES]


def severity_counts(findings: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """All five levels with zeros, over all findings or per group.

    Five counters in one aggregate: no dimension join, and an empty table
    still gives five zeros.
    """
    levels = F.explode(F.array(*[
        F.struct(F.lit(i).alias("severity_rank"), F.lit(s).alias("severity"), F.col(s).alias("n"))
        for i, s in enumerate(SEVERITIES)
    ]))
    return findings.groupBy(*by).agg(*_counts()).select(*by, levels.alias("l")).select(*by, "l.*")


def count_by(findings: DataFrame, *columns: str) -> DataFrame:
    return findings.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))


def findings_cube(findings: DataFrame, *columns: str) -> DataFrame:
    """Counts of every combination of the columns; ``level`` is the grouping id."""
    return findings.cube(*columns).agg(F.grouping_id().cast("bigint").alias("level"), F.count(F.lit(1)).alias("n"))


def total(findings: DataFrame) -> DataFrame:
    return findings.agg(F.count(F.lit(1)).alias("total"))


def scan_stats(targets: DataFrame, responses: DataFrame, findings: DataFrame) -> DataFrame:
    """One row: targets, completed, failed, findings, duration in seconds.

    A target is completed when one of its captures has a status above 0.
    """
    captured = responses.groupBy("target").agg(
        F.max(F.coalesce(F.col("status") > 0, F.lit(False))).alias("ok"),
        F.min("fetched_at").alias("first"),
        F.max("fetched_at").alias("last"),
    )
    done = F.coalesce("ok", F.lit(False))
    urls = targets.select("target").distinct().join(captured, "target", "left").agg(
        F.count(F.lit(1)).alias("total_urls"),
        F.count_if(done).alias("completed_urls"),
        F.count_if(~done).alias("failed_urls"),
        F.coalesce(
            F.max("last").cast("double") - F.min("first").cast("double"), F.lit(0.0)).alias("duration_seconds"),
    )
    counted = findings.agg(F.count(F.lit(1)).alias("total_findings"), *_counts())
    # two one-row tables side by side
    return urls.withColumn("_one", F.lit(1)).join(counted.withColumn("_one", F.lit(1)), "_one").drop("_one")


def gate(findings: DataFrame, worst: str = "High") -> DataFrame:
    """One row: does any finding reach the given severity?"""
    limit = SEVERITIES.index(worst)
    reached = F.coalesce(F.bool_or(severity_rank(F.col("severity")) <= limit), F.lit(False))
    return findings.agg(reached.alias("failed"), reached.cast("int").alias("exit_code"))


def severity_share(findings: DataFrame) -> DataFrame:
    """Percent of all findings per severity, one decimal."""
    whole = sum((F.col(s) for s in SEVERITIES), F.lit(0))
    levels = F.explode(F.array(*[
        F.struct(
            F.lit(i).alias("severity_rank"), F.lit(s).alias("severity"), F.col(s).alias("n"),
            F.round(F.col(s) * 100.0 / F.greatest(whole, F.lit(1)), 1).alias("percent"),
        )
        for i, s in enumerate(SEVERITIES)
    ]))
    return findings.agg(*_counts()).select(levels.alias("l")).select("l.*")


def report_order() -> list[Column]:
    """Worst first, then target and emission order; unique by fingerprint."""
    return [F.col("severity_rank"), F.col("target"), F.col("emit_seq"), F.col("fingerprint")]


def ordered(findings: DataFrame) -> DataFrame:
    return findings.orderBy(*report_order())


def by_severity(findings: DataFrame, severity: str) -> DataFrame:
    return findings.filter(F.col("severity") == severity)


def by_module(findings: DataFrame, module: str) -> DataFrame:
    return findings.filter(F.col("module") == module)


def by_confidence(findings: DataFrame, confidence: str) -> DataFrame:
    return findings.filter(F.col("confidence") == confidence)


def numbered(findings: DataFrame, partitions: int | None = None) -> DataFrame:
    """Add ``number``, 1-based in report order, without a single-task window.

    Rows are range-partitioned in report order and sorted inside partitions;
    a row's number is its place in the partition plus the sizes of the
    partitions before it.  The sorted rows are checkpointed first, so both
    steps see the same partitions even when executors are lost in between.
    """
    spark = findings.sparkSession
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = reliable(
        findings.repartitionByRange(partitions, *report_order()).sortWithinPartitions(*report_order()))
    # the lower 33 bits of the id are the place inside the partition
    placed = rows.withColumn("_id", F.monotonically_increasing_id()).withColumns({
        "_part": F.shiftright("_id", 33),
        "_place": F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)),
    })
    # one row per partition: at most ``partitions`` rows in this window
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select(
        "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    return (
        placed.join(F.broadcast(offsets), "_part")
        .withColumn("number", F.col("_offset") + F.col("_place") + 1)
        .drop("_id", "_part", "_place", "_offset")
    )
