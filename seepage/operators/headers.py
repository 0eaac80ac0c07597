"""Response headers.  Bodies are not read here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seepage.functions.text import strip
from seepage.operators.matching import as_raw, hit, literal_map, no_hits, one_of
from seepage.rules import headers as rules


def _table(names: list[str], values: list) -> Column:
    return literal_map({n.lower(): value for n, value in zip(names, values)})


def entry_rows(responses: DataFrame) -> DataFrame:
    """One row per header with its lower-cased name."""
    return responses.select(
        "target", "url", "status", "fetched_at", F.explode(F.map_entries("headers")).alias("h")
    ).select(
        "target", F.col("url").alias("origin"), "url", "status", "fetched_at",
        F.lower("h.key").alias("name"), F.coalesce("h.value", F.lit("")).alias("value"),
    )


def _disclosure() -> tuple[Column, Column]:
    """(condition, hit) for headers that name software."""
    names = [n for n, _, _ in rules.DISCLOSURE]
    name = F.col("name")
    header = _table(names, names)[name]
    one = hit(
        rules.MODULE,
        F.concat(F.lit("Information disclosure via "), header, F.lit(" header")),
        F.concat(header, F.lit(": "), F.col("value")),
        F.array(F.lit("header"), name), F.lit(0),
        rank=_table(names, list(range(len(names))))[name], rule_id=name,
        tier=_table(names, [t for _, _, t in rules.DISCLOSURE])[name],
        description=_table(names, [d for _, d, _ in rules.DISCLOSURE])[name],
    )
    return one_of("name", [n.lower() for n in names]) & (F.length(strip(F.col("value"))) > 0), one


def _infrastructure() -> tuple[Column, Column]:
    """(condition, hit) for headers that name hosts, proxies and caches."""
    names = rules.INFRASTRUCTURE
    name = F.col("name")
    header = _table(names, names)[name]
    one = hit(
        rules.MODULE,
        F.concat(F.lit("Infrastructure information disclosed via "), header),
        F.concat(header, F.lit(": "), F.col("value")),
        F.array(F.lit("header"), F.lit("infrastructure"), name), F.lit(0),
        section=1, rank=_table(names, list(range(len(names))))[name], rule_id=name,
        description=F.concat(
            F.lit("Internal infrastructure information disclosed via the "), header, F.lit(" response header")),
    )
    return one_of("name", [n.lower() for n in names]), one


def _findings(responses: DataFrame, *parts: tuple[Column, Column]) -> DataFrame:
    """One pass; the name lists share no header, so a header gives one hit at most."""
    found = no_hits()
    wanted = F.lit(False)
    for condition, one in parts:
        found = F.when(condition, F.array(one)).otherwise(found)
        wanted = wanted | condition
    return as_raw(entry_rows(responses).filter(wanted).select(
        "target", "origin", "fetched_at", F.explode(found).alias("hit")))


def disclosure_headers(responses: DataFrame) -> DataFrame:
    """Headers that name software; blank values do not count."""
    return _findings(responses, _disclosure())


def infrastructure_headers(responses: DataFrame) -> DataFrame:
    """Headers that name hosts, proxies and caches."""
    return _findings(responses, _infrastructure())


def headers(responses: DataFrame) -> DataFrame:
    return _findings(responses, _disclosure(), _infrastructure())
