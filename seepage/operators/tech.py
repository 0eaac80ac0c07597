"""Technology fingerprints from headers, page source and cookies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seepage.functions.text import let
from seepage.operators.matching import TEXT, gated, hit, with_views
from seepage.rules import java_pattern
from seepage.rules import tech as rules

# order in which categories can first appear
_CATEGORIES = ["servers", "frameworks", "cms", "infrastructure"]
_TECH = "array<struct<category:string,tech:string>>"


def _header(name: str) -> Column:
    """Value of a header whatever its case, null without it."""
    same = F.filter(F.map_entries("headers"), lambda e: F.lower(e["key"]) == name.lower())
    return F.get(same, F.lit(0))["value"]


def _named(category: str, value: Column, table: list[tuple[str, str]], searched=None) -> Column:
    searched = searched or (lambda pattern: value.rlike(java_pattern(pattern, "i")))
    found = F.array(*[F.when(searched(p), F.lit(t)) for p, t in table])
    return F.transform(
        F.filter(found, lambda t: t.isNotNull()), lambda t: F.struct(F.lit(category).alias("category"), t.alias("tech"))
    ).cast(_TECH)


def technologies() -> Column:
    """The technologies of a unit with its views, ``headers`` and ``cookies``; an array in order."""
    text = F.coalesce(TEXT, F.lit(""))

    def in_html(pattern: str) -> Column:
        if pattern.startswith("<meta"):
            return F.contains("_lower", F.lit("generator")) & text.rlike(java_pattern(pattern, "i"))
        # the other patterns are plain words: a search in the lower-cased text
        return F.contains("_lower", F.lit(pattern.lower())) | (
            F.col("_folds") & text.rlike(java_pattern(pattern, "i")))

    cookies = F.flatten(F.transform(
        F.coalesce(F.map_keys("cookies"), F.array().cast("array<string>")),
        lambda name: _named("frameworks", name, rules.COOKIES)))
    verbatim = F.array(*[
        F.when(_header(h).isNotNull(), F.concat(F.lit(f"{h}: "), _header(h))) for h in rules.INFRASTRUCTURE])
    infrastructure = F.transform(
        F.filter(verbatim, lambda t: t.isNotNull()),
        lambda t: F.struct(F.lit("infrastructure").alias("category"), t.alias("tech"))).cast(_TECH)
    return F.concat(
        _named("servers", F.coalesce(_header("Server"), F.lit("")), rules.SERVER),
        _named("frameworks", F.coalesce(_header("X-Powered-By"), F.lit("")), rules.POWERED_BY),
        _named("cms", text, rules.HTML, in_html),
        cookies,
        infrastructure,
    )


def tech_hits() -> Column:
    """One row of kind ``technology`` per technology of a fetched response: title and evidence are its name and category."""
    return gated(F.expr("unit = 'body' AND status > 0"), F.transform(technologies(), lambda t, i: hit(
        "technology", t["tech"], t["category"], F.expr("cast(null as array<string>)"), pos=i, kind="technology")))


def tech_rows(hits: DataFrame) -> DataFrame:
    """(target, url, category, tech, seq) of rows of kind ``technology``."""
    return hits.filter("hit.kind = 'technology'").select(
        "target", "hit.url", F.col("hit.evidence").alias("category"), F.col("hit.title").alias("tech"), F.col("hit.match_pos").alias("seq"))


def _found(responses: DataFrame) -> tuple[DataFrame, Column]:
    """Fetched captures and the array of their technologies; headers may be missing."""
    body = F.coalesce("body", F.lit(""))
    return with_views(responses.filter("status > 0").withColumn(TEXT, body)), technologies()


def tech(responses: DataFrame) -> DataFrame:
    """(target, url, category, tech, seq); a technology may occur repeatedly."""
    rows, found = _found(responses)
    return rows.select("target", "url", F.posexplode(found).alias("seq", "t")).select(
        "target", "url", "t.category", "t.tech", "seq")


def tech_summary(responses: DataFrame) -> DataFrame:
    """``Category: tech, tech; ...`` per capture, technologies sorted.

    The technologies of one capture are one small array, so nothing shuffles.
    """
    rows, found = _found(responses)

    def line(all_found: Column, category: str) -> Column:
        techs = F.array_sort(F.array_distinct(F.transform(
            F.filter(all_found, lambda t: t["category"] == category), lambda t: t["tech"])))
        return F.when(F.size(techs) > 0, F.concat(F.lit(f"{category.title()}: "), F.array_join(techs, ", ")))

    # null for a capture without any technology
    summary = let(found, lambda f: F.array_join(F.array(*[line(f, c) for c in _CATEGORIES]), "; "))
    return rows.select("target", "url", F.explode(F.filter(F.array(summary), lambda s: s != "")).alias("summary"))
