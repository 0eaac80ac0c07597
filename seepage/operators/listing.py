"""Directory listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seepage.functions.text import let
from seepage.operators.matching import TEXT, find_all, gated, hit, literal, run, whole_body
from seepage.rules import Rule, listing

_HREF = Rule("href", "link", listing.HREF, 1, ("<a",), opener=r"<a\s", skip="[^>]*+")


def _starts(link: Column, *prefixes: str) -> Column:
    out = F.lit(False)
    for prefix in prefixes:
        out = out | F.startswith(link, F.lit(prefix))
    return out


def marker_description() -> Column:
    """Description of the first marker in the text, null without one."""
    return F.expr("CASE " + " ".join(
        f"WHEN contains({TEXT}, {literal(m)}) THEN {literal(d)}" for m, d in listing.MARKERS) + " END")


def listing_evidence(links: Column, url: Column) -> Column:
    """URL and the visible entries."""

    def render(entries: Column) -> Column:
        total = F.size(entries)
        shown = F.array_join(F.transform(entries, lambda l: F.concat(F.lit("  - "), l)), "\n")
        text = F.when(
            total > 0, F.concat(F.lit("Entries ("), total.cast("string"), F.lit("):\n"), shown)
        ).otherwise("Directory listing content shown (links not extractable)")
        return F.concat(F.lit("URL: "), url, F.lit("\n"), text)

    return let(F.filter(links, lambda l: ~_starts(l, "?", "#", "javascript")), render)


def listing_hits() -> Column:
    """Pages that carry a marker of a directory index."""

    def one(description: Column) -> Column:
        return hit(
            listing.MODULE,
            F.concat(F.lit("Directory listing enabled: "), "url"),
            listing_evidence(find_all(_HREF, "i"), F.col("url")),
            F.array(F.lit("directory-listing")),
            description=F.concat(F.lit("Directory listing is enabled at this URL. "), description),
        )

    found = F.filter(F.array(marker_description()), lambda d: d.isNotNull())
    return gated(whole_body([200]), F.transform(found, one))


def suspected_listing_hits() -> Column:
    """Pages without a marker whose links are mostly directories."""

    def counts(links: Column) -> Column:
        usable = F.filter(links, lambda l: ~_starts(l, "?", "#"))
        return F.struct(
            F.size(F.filter(usable, lambda l: F.endswith(l, F.lit("/")))).alias("directories"),
            F.size(F.filter(usable, lambda l: F.contains(F.substring_index(l, "/", -1), F.lit(".")))).alias("files"),
        )

    def one(n: Column) -> Column:
        return hit(
            listing.MODULE,
            F.concat(F.lit("Possible directory listing: "), "url"),
            F.concat(F.lit("URL: "), "url", F.lit("\nFound "), n["directories"].cast("string"),
                     F.lit(" directories and "), n["files"].cast("string"), F.lit(" files")),
            F.array(F.lit("directory-listing"), F.lit("suspected")),
            section=1,
            description="The directory appears to have directory listing enabled based on ratio of directories to files",
        )

    # links are counted once per body, and only where no marker was found
    counted = F.transform(F.array(find_all(_HREF, "i")), counts)
    found = F.filter(
        counted, lambda n: (n["directories"] > listing.MIN_DIRECTORIES) & (n["directories"] > n["files"]))
    return gated(whole_body([200]) & marker_description().isNull(), F.transform(found, one))


def directory_listing(responses: DataFrame) -> DataFrame:
    return run(responses.filter("status = 200"), listing_hits, suspected_listing_hits)
