"""URL rules and empirical-Bayes host reputation, with DataFrame functions only.

Labelled pages give each host good and bad outcomes.  The share of bad pages
is shrunk along the name: the prior of a suffix (the last label) comes from
all pages, that of a registered domain (the last two labels) from its suffix,
that of a host from its domain.  Each prior is a beta distribution with the
mean of the level above; its strength is fitted by moments from how much the
rates of the children scatter beyond what their counts explain.  A host is
blocked if the lower bound of its posterior bad share lies above the limit.

Counts are summed before they are shuffled, so a host with most of the pages
is a few rows; the tables of hosts are joined, never collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seepage.llm.tables import stored

#: Block a host if its bad share is above the limit with a certainty of about 95 % (one-sided normal quantile).
LIMIT, SURENESS = 0.5, 1.645
#: Bounds of a prior's strength in pages.
WEAKEST, STRONGEST = 1.0, 1000.0


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    found = F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(found, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null if none does.

    A rule is a host and the beginning of a path; it fits the host itself and
    its subdomains.  Of rules of one length the first given wins.
    """
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, rule in sorted(rules, key=lambda r: len(r[1])):
        at = rule.index("/") if "/" in rule else len(rule)
        own, start = rule[:at], rule[at:]
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(start)
        name, verdict = F.when(fits, rule).otherwise(name), F.when(fits, kind).otherwise(verdict)
    return name, verdict


def last_labels(host: Column, n: int) -> Column:
    return F.substring_index(host, ".", -n)


def _prior(parents: DataFrame, children: DataFrame, key: str) -> DataFrame:
    """Strength of the prior of each parent's children, by the method of moments.

    ``parents`` holds (key, mean); ``children`` holds (key, bad, total) rows.
    With the mean m, the weighted scatter of the rates exceeds m(1-m) by the
    share rho that lies between children; the strength is (1-rho)/rho.
    """
    rated = children.filter("total > 0").join(parents.select(key, "mean"), key)
    spread = rated.groupBy(key, "mean").agg(
        F.sum(F.col("total") * F.pow(F.col("bad") / F.col("total") - F.col("mean"), F.lit(2))).alias("scatter"),
        F.count("*").alias("k"), F.sum("total").alias("n"), F.sum(F.col("total") * F.col("total")).alias("squares"))
    noise = F.col("mean") * (1 - F.col("mean"))
    within = F.col("k") - F.lit(1)
    room = noise * (F.col("n") - F.col("squares") / F.col("n") - within)
    rho = F.when(room > 0, F.greatest((F.col("scatter") - noise * within) / room, F.lit(0.0))).otherwise(F.lit(0.0))
    strength = F.when(rho > 0, (1 - rho) / rho).otherwise(F.lit(STRONGEST))
    return spread.select(key, F.greatest(F.lit(WEAKEST), F.least(F.lit(STRONGEST), strength)).alias("strength"))


def _shrunk(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Children with posterior counts (a, b) and mean, from the parent's mean and fitted strength."""
    prior = parents.select(key, "mean").join(_prior(parents, children, key), key, "left").select(
        key, F.col("mean").alias("_m"), F.coalesce("strength", F.lit(STRONGEST)).alias("_s"))
    joined = children.join(prior, key)
    a, b = F.col("_m") * F.col("_s") + F.col("bad"), (1 - F.col("_m")) * F.col("_s") + F.col("total") - F.col("bad")
    return joined.select(*children.columns, a.alias("a"), b.alias("b"), (a / (a + b)).alias("mean"))


def reputations(hosts: DataFrame) -> DataFrame:
    """(host, domain, suffix, bad, total, a, b, mean, bound) for (host, bad, total) rows, one per host.

    Hosts without labelled pages (total 0) get their domain's prior.  ``bound``
    is the lower bound of the bad share.  Without any label the mean is one
    half everywhere.
    """
    hosts = hosts.select("host", last_labels(F.col("host"), 2).alias("domain"), last_labels(F.col("host"), 1).alias("suffix"), "bad", "total")
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("bad").alias("bad"), F.sum("total").alias("total"))
    suffixes = domains.groupBy("suffix").agg(F.sum("bad").alias("bad"), F.sum("total").alias("total")).withColumn("root", F.lit(""))
    root = suffixes.groupBy("root").agg(((F.sum("bad") + F.lit(0.5)) / (F.sum("total") + F.lit(1.0))).alias("mean"))
    by_suffix = _shrunk(suffixes, root, "root")
    by_domain = _shrunk(domains, by_suffix, "suffix")
    by_host = _shrunk(hosts, by_domain, "domain")
    n = F.col("a") + F.col("b")
    deviation = F.sqrt(F.col("a") * F.col("b") / (n * n * (n + 1)))
    return by_host.withColumn("bound", F.greatest(F.lit(0.0), F.col("mean") - F.lit(SURENESS) * deviation))


def judge(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str]], limit: float = LIMIT) -> DataFrame:
    """(page_id, host, path, rule, verdict, bad_share, bound) per row of ``pages`` (page_id, url).

    A page shows the document whose number is the last path segment of its
    url; ``labels`` (doc_id, bad) has outcomes of documents.  A null or broken
    url has an empty host and path and is judged like any other host.  Several
    labels of one document count as the worst; null ids and labels are left out.
    """
    parts = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    number = F.regexp_extract("path", r"/(\d{1,18})(?:\.\w+)?/?\z", 1)
    shown = parts.select("*", F.when(number != "", number.cast("long")).alias("_doc"))
    known = labels.filter("doc_id is not null and bad is not null").groupBy(F.col("doc_id").alias("_doc")).agg(F.max("bad").alias("bad"))
    # pages are counted per document and host before they meet the labels
    counted = shown.groupBy("host", "_doc").agg(F.count("*").alias("_pages"))
    met = counted.join(known, "_doc", "left").select("host", F.col("bad").cast("long"), "_pages")
    summed = met.groupBy("host").agg(
        F.coalesce(F.sum(F.col("bad") * F.col("_pages")), F.lit(0)).alias("bad"),
        F.coalesce(F.sum(F.when(F.col("bad").isNotNull(), F.col("_pages"))), F.lit(0)).alias("total"))
    standing = reputations(stored(summed, "hosts"))
    name, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("bound") > limit, F.lit("block")).otherwise(F.lit("allow"))
    return parts.join(standing.select("host", F.col("mean").alias("bad_share"), "bound"), "host").select(
        "page_id", "host", "path", name.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "bad_share", "bound")
