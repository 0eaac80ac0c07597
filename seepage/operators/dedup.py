"""Repeatable removal of duplicate findings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_KEY = "fingerprint"


def dedup(findings: DataFrame) -> DataFrame:
    """First finding per fingerprint in emission order.

    An aggregate instead of a ranking window: every task keeps one candidate
    per fingerprint before the shuffle, so a fingerprint that holds a third of
    all rows arrives as one row per task.  The whole row takes part in the
    comparison, so ties do not depend on partitioning.
    """
    rest = [c for c in findings.columns if c not in (_KEY, "emit_seq")]
    return (
        findings.groupBy(_KEY)
        .agg(F.min(F.struct("emit_seq", *rest)).alias("first"))
        .select(*[F.col(_KEY) if c == _KEY else F.col(f"first.{c}").alias(c) for c in findings.columns])
    )


def new_only(findings: DataFrame, known: DataFrame) -> DataFrame:
    """First findings whose fingerprint is not in ``known``.

    The aggregate leaves them partitioned by fingerprint, so only the keys of
    ``known`` are shuffled for the join.
    """
    return dedup(findings).join(known.select(_KEY), _KEY, "left_anti")


def add_all(findings: DataFrame, known: DataFrame) -> DataFrame:
    """One row: how many findings are new."""
    return new_only(findings, known).agg(F.count(F.lit(1)).alias("added"))
