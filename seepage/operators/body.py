"""Detectors that read one body: source text, secrets, error pages, cloud."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seepage.functions.entropy import classify_string, is_high_entropy, shannon_entropy
from seepage.functions.net import private_ipv4
from seepage.functions.text import short, slug, strip
from seepage.operators.matching import Detector, gated, hit, per_placed_rule, per_rule, placed_matches, rule_matches, run, whole_body
from seepage.rules import Rule
from seepage.rules import cloud as cloud_rules
from seepage.rules import errors as error_rules
from seepage.rules import secrets as secret_rules
from seepage.rules import source as source_rules


def source_hits(rules: Sequence[Rule] = source_rules.RULES) -> Detector:
    """Comments, addresses and references in page source."""

    def detect() -> Column:
        def reported(r: Column, m: Column) -> Column:
            placeholder = F.substring_index(m, "@", -1).isin(source_rules.PLACEHOLDER_DOMAINS)
            return (
                (F.length(m) >= source_rules.MIN_CHARS)
                & ~((r["id"] == "email") & placeholder)
                & F.when(r["id"] == "ip_address", private_ipv4(m)).otherwise(True)
            )

        def make(r: Column, m: Column, i: Column, context: Column) -> Column:
            return hit(
                source_rules.MODULE,
                F.concat(r["label"], F.lit(": "), short(m, source_rules.TITLE_CHARS)),
                context,
                F.array(F.lit("source-code"), r["id"]),
                rank=r["rank"], pos=i, rule_id=r["id"], tier=r["tier"],
            )

        found = placed_matches(rules, lambda rule: "ms")
        return gated(whole_body(source_rules.STATUSES), per_placed_rule(found, source_rules.WINDOW, reported, make, strip))

    return detect


def long_enough(m: Column, least: int, most: int | None) -> Column:
    return F.length(m) >= least if most is None else F.length(m).between(least, most)


def secret_hits(
    rules: Sequence[Rule] = secret_rules.RULES,
    min_entropy: float = secret_rules.MIN_ENTROPY,
    min_length: int = secret_rules.MIN_LENGTH,
    max_length: int | None = None,
    use_entropy: bool = True,
    found: Column | None = None,
) -> Detector:
    """Credentials and tokens of a known format in any body."""

    def detect() -> Column:
        def keep(r: Column, m: Column) -> Column:
            return long_enough(m, min_length, max_length) & (is_high_entropy(m, min_entropy) if use_entropy else F.lit(True))

        def make(r: Column, m: Column, i: Column, context: Column) -> Column:
            return hit(
                secret_rules.MODULE,
                F.concat(r["label"], F.lit(" discovered")),
                context,
                F.array(F.lit("secret"), r["id"]),
                rank=r["rank"], pos=i, rule_id=r["id"],
            )

        return gated(whole_body(), per_placed_rule(
            placed_matches(rules) if found is None else found, secret_rules.WINDOW, keep, make))

    return detect


def token_hits(
    min_entropy: float = secret_rules.MIN_ENTROPY,
    min_length: int = secret_rules.MIN_LENGTH,
    max_length: int | None = None,
) -> Detector:
    """Quoted or assigned tokens that look random."""
    rule = Rule("entropy_token", "High entropy token", secret_rules.TOKEN, 1)

    def detect() -> Column:
        def random_looking(r: Column, m: Column) -> Column:
            return (
                long_enough(m, min_length, max_length)
                & (F.round(shannon_entropy(m), 10) >= min_entropy)
                & F.startswith(classify_string(m), F.lit("high_entropy"))
            )

        def make(r: Column, m: Column, i: Column, context: Column) -> Column:
            return hit(
                secret_rules.MODULE,
                F.concat(F.lit("High entropy token discovered: "), short(m, secret_rules.TOKEN_TITLE_CHARS)),
                context,
                F.array(F.lit("secret"), F.lit("entropy-token")),
                section=1, pos=i, rule_id="entropy_token",
            )

        return gated(whole_body(), per_placed_rule(placed_matches([rule]), secret_rules.WINDOW, random_looking, make))

    return detect


def error_hits(rules: Sequence[Rule] = error_rules.RULES) -> Detector:
    """Stack traces, debug pages and error messages."""

    def detect() -> Column:
        def keep(r: Column) -> Column:
            texts = F.transform(r["found"], strip)
            return F.filter(texts, lambda m: F.length(m) >= error_rules.MIN_CHARS)

        def make(r: Column, m: Column, i: Column) -> Column:
            return hit(
                error_rules.MODULE,
                F.concat(F.lit("Error disclosure: "), r["label"]),
                m,
                F.array(F.lit("error"), slug(r["id"])),
                rank=r["rank"], pos=i, rule_id=r["id"], tier=r["tier"],
            )

        found = rule_matches(rules, lambda rule: "m" if rule.rule_id in error_rules.LINE_RULES else "ms")
        return gated(whole_body(error_rules.STATUSES), per_rule(found, keep, make))

    return detect


def cloud_hits(
    rules: Sequence[Rule] = cloud_rules.RULES, identifiers: Sequence[Rule] = cloud_rules.IDENTIFIERS
) -> Detector:
    """Cloud resources, then cloud identifiers."""

    def maker(section: int, prefix: str, tags: list[str]):
        def make(r: Column, m: Column, i: Column, context: Column) -> Column:
            return hit(
                cloud_rules.MODULE,
                F.concat(F.lit(prefix), r["label"]),
                context,
                F.array(*[F.lit(t) for t in tags], slug(r["id"])),
                section=section, rank=r["rank"], pos=i, rule_id=r["id"], tier=r["tier"],
            )

        return make

    def detect() -> Column:
        def hits(some: Sequence[Rule], make) -> Column:
            return per_placed_rule(placed_matches(some, lambda rule: "i"), cloud_rules.WINDOW, lambda r, m: F.lit(True), make)

        parts = []
        if rules:
            parts.append(hits(rules, maker(0, "Cloud resource reference: ", ["cloud"])))
        if identifiers:
            parts.append(hits(identifiers, maker(1, "Sensitive cloud identifier: ", ["cloud", "sensitive"])))
        return gated(whole_body(cloud_rules.STATUSES), F.concat(*parts) if len(parts) > 1 else parts[0])

    return detect


def source_text(responses: DataFrame) -> DataFrame:
    return run(responses.filter(F.col("status").isin(*source_rules.STATUSES)), source_hits())


def secrets(
    responses: DataFrame,
    min_entropy: float = secret_rules.MIN_ENTROPY,
    min_length: int = secret_rules.MIN_LENGTH,
    max_length: int | None = None,
    use_regex: bool = True,
    use_entropy: bool = True,
) -> DataFrame:
    """Known token formats and, with ``use_entropy``, random-looking tokens."""
    detectors = []
    if use_regex:
        detectors.append(secret_hits(
            min_entropy=min_entropy, min_length=min_length, max_length=max_length, use_entropy=use_entropy))
    if use_entropy:
        detectors.append(token_hits(min_entropy, min_length, max_length))
    if not detectors:
        raise ValueError("switch on at least one of use_regex and use_entropy")
    return run(responses, *detectors)


def error_pages(responses: DataFrame) -> DataFrame:
    return run(responses.filter(F.col("status").isin(*error_rules.STATUSES)), error_hits())


def cloud(responses: DataFrame) -> DataFrame:
    return run(responses.filter(F.col("status").isin(*cloud_rules.STATUSES)), cloud_hits())
