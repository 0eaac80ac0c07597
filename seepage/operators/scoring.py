"""Confidence, severity, categories and advice of raw findings."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seepage.operators.joins import salted_join
from seepage.operators.matching import literal_map
from seepage.rules import scoring as tables


def _lookup(table: Mapping[str, object], key: Column, default) -> Column:
    # a dozen entries: a literal in the plan, not a join
    found = literal_map(dict(table))[key]
    return F.coalesce(found, F.lit(default)) if default is not None else found


def confidence(module: Column, evidence: Column, status: Column) -> Column:
    size = F.coalesce(F.length(evidence), F.lit(0))
    return (
        F.when((status == 200) & module.isin(tables.CERTAIN_MODULES), "Certain")
        .when(status == 200, "High")
        .when(status.isin(tables.REDIRECTS), "Medium")
        .when(size > 50, "Medium")
        .when(size > 10, "Low")
        .otherwise("Speculative")
    )


def confidence_score(conf: Column) -> Column:
    return _lookup(tables.CONFIDENCE_SCORES, conf, None)


def severity_rank(severity: Column) -> Column:
    """0 for Critical to 4 for Informational."""
    return _lookup({s: i for i, s in enumerate(tables.SEVERITIES)}, severity, None)


def severity_name(rank: Column) -> Column:
    return literal_map(dict(enumerate(tables.SEVERITIES)))[rank]


def severity(module: Column, conf: Column | None = None, base: Column | None = None) -> Column:
    """Module default, one level milder when the confidence is low."""
    default = _lookup(tables.BASE_SEVERITY, module, tables.DEFAULT_SEVERITY)
    rank = severity_rank(default if base is None else F.coalesce(base, default))
    if conf is None:
        return severity_name(rank)
    weak = conf.isin("Low", "Speculative")
    return severity_name(F.when(weak, F.least(rank + 1, F.lit(len(tables.SEVERITIES) - 1))).otherwise(rank))


def cwe(module: Column) -> Column:
    return _lookup(tables.CWE, module, tables.DEFAULT_CWE)


def owasp(module: Column) -> Column:
    return _lookup(tables.OWASP, module, tables.DEFAULT_OWASP)


def recommendation(module: Column) -> Column:
    return _lookup(tables.ADVICE, module, tables.DEFAULT_ADVICE)


def cvss_estimate(module: Column, sev: Column) -> Column:
    table = {f"{m}|{s}": vector for (m, s), vector in tables.CVSS.items()}
    return _lookup(table, F.concat_ws("|", module, sev), tables.DEFAULT_CVSS)


def fingerprint() -> Column:
    """Identity of a finding; evidence, URL and confidence are not part of it."""
    return F.sha2(F.concat_ws("|", "target", "module", "title", "severity"), 256)


def enrich(findings: DataFrame) -> DataFrame:
    module = F.col("module")
    return findings.withColumns({
        "cwe": cwe(module),
        "owasp": owasp(module),
        "recommendation": recommendation(module),
        "cvss_estimate": cvss_estimate(module, F.col("severity")),
    })


def score(raw: DataFrame, overrides: DataFrame | Mapping[str, str] | None = None) -> DataFrame:
    """Raw findings with confidence, severity, categories and fingerprint.

    ``overrides`` replaces the base severity of modules: a dict, or a table
    (module, severity), which has at most one row per module.
    """
    module = F.col("module")
    conf = confidence(module, F.col("evidence"), F.col("status"))
    base = None
    if isinstance(overrides, Mapping):
        unknown = set(overrides.values()) - set(tables.SEVERITIES)
        if unknown:
            raise ValueError(f"unknown severity: {sorted(unknown)}")
        if overrides:
            base = _lookup(overrides, module, None)
    elif overrides is not None:
        # one row per module, so the join cannot multiply rows; a dozen modules
        # would be hot keys, so they are salted and Spark chooses the join
        given = F.col("severity")
        known = given.isNull() | given.isin(tables.SEVERITIES)
        checked = F.when(known, given).otherwise(F.raise_error(F.concat(F.lit("unknown severity: "), given)).cast("string"))
        raw = salted_join(raw, overrides.groupBy("module").agg(F.min(checked).alias("_base")), "module", "left")
        base = F.col("_base")
    scored = raw.withColumn("confidence", conf)
    scored = scored.withColumn("severity", severity(module, F.col("confidence"), base)).drop("_base")
    return enrich(scored).withColumns({
        "parameter": F.lit(""),
        "severity_rank": severity_rank(F.col("severity")),
        "fingerprint": fingerprint(),
    })
