"""The whole job: captures in, scored and de-duplicated findings out."""

from __future__ import annotations

from collections.abc import Callable, Collection, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seepage.operators.body import cloud_hits, error_hits, secret_hits, source_hits, token_hits
from seepage.operators.dedup import dedup
from seepage.operators.dns import dns as dns_findings
from seepage.operators.files import api_marker_hits, api_spec_hits, git_hits, sensitive_file_hits
from seepage.operators.headers import headers as header_findings
from seepage.operators.javascript import credit_scripts, reference_hits, script_hits, with_inline_units
from seepage.operators.joins import salted_join
from seepage.operators.listing import listing_hits, suspected_listing_hits
from seepage.operators.matching import (
    Detector, as_raw, body_units, explode_hits, placed_matches,
)
from seepage.operators.metadata import documents_metadata
from seepage.operators.scoring import score
from seepage.operators.tech import tech_hits, tech_rows
from seepage.rules import secrets as secret_rules
from seepage.rules.scoring import MODULES
from seepage.sources.checkpoint import reliable

_SECRETS = "_secrets"


def body_detectors(modules: Collection[str], found_secrets: Column | None = None) -> list[Detector]:
    """Detectors of the one pass over all captures, by module."""
    by_module: dict[str, list[Detector]] = {
        "sensitive_file": [sensitive_file_hits],
        "source_code": [source_hits()],
        "javascript": [script_hits(found_secrets=found_secrets), reference_hits()],
        "secrets": [secret_hits(found=found_secrets), token_hits()],
        "errors": [error_hits()],
        "directory_listing": [listing_hits, suspected_listing_hits],
        "api_docs": [api_marker_hits, api_spec_hits],
        "git_exposure": [git_hits],
        "cloud_exposure": [cloud_hits()],
    }
    return [d for module, detectors in by_module.items() if module in modules for d in detectors]


def body_pass(responses: DataFrame, modules: Collection[str], technologies: bool = False) -> DataFrame | None:
    """Hits of all chosen body detectors, and on request technologies, from one read of the bodies."""
    extra: list[Detector] = [tech_hits] if technologies else []
    if technologies:
        for name in ("headers", "cookies"):
            if name not in responses.columns:
                responses = responses.withColumn(name, F.lit(None).cast("map<string,string>"))
    units = body_units(responses, ("headers", "cookies") if technologies else ())
    if "javascript" not in modules:
        detectors = body_detectors(modules) + extra
        return explode_hits(units, detectors) if detectors else None
    units = with_inline_units(units)
    if "secrets" not in modules:
        return explode_hits(units, body_detectors(modules) + extra)
    # scripts and bodies are searched for the same token formats: match once
    return explode_hits(units, body_detectors(modules, F.col(_SECRETS)) + extra, {_SECRETS: placed_matches(secret_rules.RULES)})


def raw_findings(
    responses: DataFrame,
    targets: DataFrame | None = None,
    dns: DataFrame | None = None,
    documents: DataFrame | None = None,
    modules: Collection[str] = tuple(MODULES),
    materialize: bool | Callable[[DataFrame], DataFrame] = True,
    credit: Callable[[DataFrame], DataFrame] = credit_scripts,
    hits: DataFrame | None = None,
) -> DataFrame:
    """Hits of all chosen detectors.

    Bodies are read once: every body detector, the scripts and the script
    references of pages come out of one pass as small rows.  These are
    checkpointed because three branches read them; with ``materialize=False``
    the plan stays lazy and every branch reads the bodies again, and a function
    may keep the rows elsewhere.  ``credit`` turns references and script hits
    into hits of the pages.  ``hits`` are rows of ``body_pass`` that were kept
    already.
    """
    unknown = set(modules) - set(MODULES)
    if unknown:
        raise ValueError(f"unknown modules: {sorted(unknown)}")
    parts = []
    kept = hits is not None
    if not kept:
        hits = body_pass(responses, modules)
    if hits is not None:
        if "javascript" in modules:
            if materialize and not kept:
                hits = (materialize if callable(materialize) else reliable)(hits)
            parts.append(as_raw(credit(hits)))
        if kept or "javascript" in modules:
            hits = hits.filter("hit.kind = 'finding'")
        parts.append(as_raw(hits))
    if "http_header" in modules and "headers" in responses.columns:
        parts.append(header_findings(responses))
    if "metadata" in modules and documents is not None:
        parts.append(documents_metadata(documents))
    if "dns" in modules and dns is not None:
        known = targets if targets is not None else responses
        parts.append(dns_findings(dns, known.select("target").distinct()))
    if not parts:
        raise ValueError("no chosen module has an input")
    raw = reduce(DataFrame.unionByName, parts)
    if targets is not None:
        raw = salted_join(raw, targets.select("target").distinct(), "target", "left_semi")
    return raw


def detect(
    responses: DataFrame,
    targets: DataFrame | None = None,
    dns: DataFrame | None = None,
    documents: DataFrame | None = None,
    modules: Collection[str] = tuple(MODULES),
    overrides: DataFrame | Mapping[str, str] | None = None,
    materialize: bool | Callable[[DataFrame], DataFrame] = True,
    credit: Callable[[DataFrame], DataFrame] = credit_scripts,
) -> DataFrame:
    """Findings table: one row per fingerprint, first one in emission order."""
    raw = raw_findings(responses, targets, dns, documents, modules, materialize, credit)
    return dedup(score(raw, overrides))


def scan(
    responses: DataFrame,
    targets: DataFrame | None = None,
    dns: DataFrame | None = None,
    documents: DataFrame | None = None,
    modules: Collection[str] = tuple(MODULES),
    overrides: DataFrame | Mapping[str, str] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(findings, technologies) of the captures, from one read of the bodies.

    Technologies are (target, url, category, tech, seq); they are no findings
    and stand beside them.
    """
    hits = reliable(body_pass(responses, modules, technologies=True))
    raw = raw_findings(responses, targets, dns, documents, modules, hits=hits)
    return dedup(score(raw, overrides)), tech_rows(hits)
