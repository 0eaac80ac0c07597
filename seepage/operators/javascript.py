"""Scripts: inline ones from pages, external ones from their own captures.

Script bodies are never shuffled.  Rules run where the script was captured and
give one small row per hit; pages give one small row per distinct (target,
script URL).  Only these two meet in a join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seepage.functions.entropy import is_high_entropy
from seepage.functions.net import resolve
from seepage.functions.text import let, short, strip
from seepage.operators.joins import measured_join
from seepage.operators.matching import (
    TEXT, UNIT, Detector, as_raw, body_units, explode_hits, find_all, gated, hit, per_placed_rule, placed_matches, whole_body,
)
from seepage.operators.scoring import confidence
from seepage.rules import Rule, java_pattern
from seepage.rules import javascript as js
from seepage.rules import secrets as secret_rules
from seepage.sources.checkpoint import reliable

MIN_SECRET = 8
PARTS = ("secrets", "endpoints", "env", "config", "cloud")


def is_external() -> Column:
    """The row is a captured file that a page can name as an external script."""
    return whole_body([200]) & F.endswith("url", F.lit(".js"))


def found_sources(max_scripts: int | None = None) -> Column:
    return find_all(js.SCRIPT_SRC, "i", cap=max_scripts)


def script_sources(max_scripts: int | None = None) -> Column:
    """Absolute URLs of the external scripts of a page, in page order."""
    return F.transform(found_sources(max_scripts), lambda src: resolve(F.col("target"), src))


def inline_scripts() -> Column:
    """Non-blank inline scripts of a page, in page order."""
    return F.filter(F.transform(find_all(js.INLINE_SCRIPT, "si"), strip), lambda s: F.length(s) > 0)


def with_inline_units(units: DataFrame, max_scripts: int | None = None) -> DataFrame:
    """Body units, and behind each page one unit per inline script.

    External scripts come first in a page, so inline ones are counted on from them.
    """
    gate = whole_body(js.STATUSES)

    def unit(kind: str, source_pos: Column, text: Column) -> Column:
        return F.struct(F.lit(kind), F.col("url"), F.col("status"), source_pos.cast("int"), text).cast(UNIT)

    # counted once per page, not once per inline script
    scripts = let(F.size(found_sources(max_scripts)), lambda external: F.transform(
        inline_scripts(), lambda s, i: unit("inline", i + external, s)))
    body = F.array(unit("body", F.lit(0), F.col(TEXT)))
    own = [c for c in units.columns if c not in ("unit", "url", "status", "source_pos", TEXT)]
    return units.select(
        *own, F.explode(F.when(gate, F.concat(body, scripts)).otherwise(body)).alias("u"),
    ).select(*own, "u.*")


def script_hits(
    rules: Sequence[Rule] = secret_rules.RULES,
    min_entropy: float = secret_rules.MIN_ENTROPY,
    use_entropy: bool = True,
    parts: Sequence[str] = PARTS,
    found_secrets: Column | None = None,
) -> Detector:
    """Hits of the script rules in inline units and captured script files.

    Scripts carry no status.  Hits in a file are of kind ``script``: they
    still have to be credited to the pages that load the file.
    """

    def random_enough(text: Column) -> Column:
        return is_high_entropy(text, min_entropy) if use_entropy else F.lit(True)

    def made(section: int, title: Column, context: Column, tags: Sequence[Column], pos: Column,
             rank: Column | None = None, rule_id: Column | str = "") -> Column:
        return hit(
            js.MODULE, title, context, F.array(F.lit("javascript"), *tags),
            section=section, rank=rank, pos=pos, rule_id=rule_id, with_status=False,
            kind=F.expr("CASE unit WHEN 'inline' THEN 'finding' ELSE 'script' END"),
        )

    def in_match(rule: Rule, group: int):
        # a match holds everything its groups need, so it is matched again alone
        return lambda m: F.regexp_extract(m, rule.java(), group)

    def secret_part() -> Column:
        return per_placed_rule(
            placed_matches(rules) if found_secrets is None else found_secrets, js.WINDOW,
            lambda r, m: (F.length(m) >= MIN_SECRET) & random_enough(m),
            lambda r, m, i, context: made(
                0, F.concat(r["label"], F.lit(" exposed in JavaScript")), context, [F.lit("secret"), r["id"]], i,
                r["rank"], r["id"]))

    def endpoint_part() -> Column:
        return per_placed_rule(
            placed_matches(js.ENDPOINTS), js.WINDOW, lambda r, m: F.lit(True),
            lambda r, m, i, context: made(
                1, F.concat(r["label"], F.lit(" found in JavaScript: "), short(m, js.TITLE_CHARS)), context,
                [F.lit("endpoint")], i, r["rank"], r["id"]))

    def keyed(section: int, rule: Rule, tag: str, key, keep=None) -> Column:
        return per_placed_rule(
            placed_matches([rule]), js.WINDOW, lambda r, m: keep(m) if keep else F.lit(True),
            lambda r, m, i, context: made(
                section, F.concat(F.lit(f"{rule.label}: "), key(m)), context, [F.lit(tag), F.lower(key(m))], i,
                rule_id=rule.rule_id))

    def env_part() -> Column:
        def name(m: Column) -> Column:
            return F.coalesce(*[F.nullif(in_match(js.ENV, g)(m), F.lit("")) for g in (2, 3, 4)], F.lit(""))

        return keyed(2, js.ENV, "env-var", name)

    def config_part() -> Column:
        value = in_match(js.CONFIG, 3)
        return keyed(3, js.CONFIG, "config", in_match(js.CONFIG, 2), lambda m: random_enough(value(m)))

    def cloud_part() -> Column:
        return keyed(4, js.CLOUD_CONFIG, "cloud-config",
                     lambda m: F.regexp_extract(m, java_pattern(js.CLOUD_CONFIG_KEY), 1))

    def detect() -> Column:
        builders = dict(zip(PARTS, (secret_part, endpoint_part, env_part, config_part, cloud_part)))
        arrays = [builders[part]() for part in parts]
        return gated(
            F.expr("unit = 'inline'") | is_external(), F.concat(*arrays) if len(arrays) > 1 else arrays[0])

    return detect


def reference_hits(max_scripts: int | None = None) -> Detector:
    """One row per external script of a page."""

    def detect() -> Column:
        nothing = F.expr("cast(null as string)")
        return gated(whole_body(js.STATUSES), F.transform(
            script_sources(max_scripts),
            lambda url, i: hit(js.MODULE, nothing, nothing, F.expr("cast(null as array<string>)"), source_pos=i,
                               url=url, with_status=False, kind="reference")))

    return detect


def page_references(hits: DataFrame) -> DataFrame:
    """(target, script_url, first): the first page position per target and script.

    A later one cannot come first in any ordering of findings, and a script
    that a third of all pages load meets the join once per target instead of
    once per page.
    """
    return (
        hits.filter("hit.kind = 'reference'")
        .groupBy("target", F.col("hit.url").alias("script_url"))
        .agg(F.min(F.struct("origin", F.col("hit.source_pos").alias("source_pos"), "fetched_at")).alias("first"))
    )


def script_findings(hits: DataFrame) -> DataFrame:
    """(script_url, title, confidence, found): one hit each, however often the script was captured."""
    return (
        hits.filter("hit.kind = 'script'")
        .groupBy(
            F.col("hit.url").alias("script_url"),
            F.col("hit.title").alias("title"),
            confidence(F.col("hit.module"), F.col("hit.evidence"), F.col("hit.status")).alias("confidence"),
        )
        .agg(F.min("hit").alias("found"))
    )


def credit_scripts(hits: DataFrame) -> DataFrame:
    """Turn script hits and page references into hits of the pages."""
    return credit(page_references(hits), script_findings(hits))


def credit(references: DataFrame, found: DataFrame) -> DataFrame:
    """Hits of the pages that load a script with hits."""
    return measured_join(references, found.select("script_url", "found"), "script_url").select(
        "target",
        F.col("first.origin").alias("origin"),
        F.col("first.fetched_at").alias("fetched_at"),
        F.col("found").withField("source_pos", F.col("first.source_pos")).withField("kind", F.lit("finding"))
        .alias("hit"),
    )


def js_rules(
    responses: DataFrame,
    min_entropy: float = secret_rules.MIN_ENTROPY,
    use_entropy: bool = True,
    parts: Sequence[str] = PARTS,
    materialize: bool = True,
) -> DataFrame:
    """Raw findings of inline and external scripts.

    The hits of one pass feed three branches and are checkpointed in between;
    ``materialize=False`` leaves the plan lazy and reads the captures again.
    """
    captured = responses.filter(F.col("status").isin(*js.STATUSES))
    hits = explode_hits(
        with_inline_units(body_units(captured)),
        [script_hits(min_entropy=min_entropy, use_entropy=use_entropy, parts=parts), reference_hits()])
    if materialize:
        hits = reliable(hits)
    return as_raw(hits.filter("hit.kind = 'finding'").unionByName(credit_scripts(hits)))


def js_inputs(responses: DataFrame, max_scripts: int | None = None) -> DataFrame:
    """Scripts of every page: (target, page, source_pos, script_url, chars, external).

    External scripts without a capture are not listed.  The texts stay in the
    capture table, so no body takes part in the join.
    """
    pages = body_units(responses).filter(whole_body(js.STATUSES))
    references = pages.select(
        "target", F.col("url").alias("page"), F.posexplode(script_sources(max_scripts)).alias("source_pos", "script_url"))
    captures = body_units(responses).filter(is_external()).select(
        F.col("url").alias("script_url"), F.length(TEXT).alias("chars"))
    external = measured_join(references, captures, "script_url").withColumn("external", F.lit(True))
    inline = pages.select(
        "target", F.col("url").alias("page"), F.size(found_sources(max_scripts)).alias("external"),
        F.posexplode(F.transform(inline_scripts(), F.length)).alias("i", "chars"),
    ).select(
        "target", "page", (F.col("i") + F.col("external")).alias("source_pos"), F.col("page").alias("script_url"), "chars",
        F.lit(False).alias("external"))
    return external.unionByName(inline)
