"""Detectors over captured DNS answers (hostname, rtype, value).

Record rules are narrow; matches, never all records, meet the targets.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seepage.functions.net import hostname, private_ipv4, valid_ipv4
from seepage.functions.text import strip
from seepage.operators.joins import measured_join
from seepage.operators.matching import as_raw, gated, hit, literal_map, one_hit
from seepage.rules import dns as rules
from seepage.rules import java_pattern
from seepage.schema import HIT
from seepage.sources.checkpoint import reliable


def hosts(targets: DataFrame) -> DataFrame:
    """(target, hostname)."""
    return targets.select("target").distinct().withColumn("hostname", hostname(F.col("target")))


def _holds(text: Column, words: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def _one(title: Column, evidence: Column, tags: list[str], section: int, pos: Column | None = None) -> Column:
    return hit(
        rules.MODULE, title, evidence, F.array(*[F.lit(t) for t in tags]), F.lit(0),
        section=section, pos=pos, rule_id="-".join(tags[1:]), url=F.lit(""), with_status=False)


def _all(text: Column, pattern: str, group: int, flags: str = "") -> Column:
    return F.regexp_extract_all(text, F.lit(java_pattern(pattern, flags)), F.lit(group))


def txt_hits(text: Column) -> Column:
    def listed(title: str, pattern: str, label: str, tag: str, section: int, flags: str = "") -> Column:
        found = _all(text, pattern, 0, flags)
        evidence = F.concat(F.lit("DNS TXT Record: "), text, F.lit(f"\n{label}: "), F.array_join(found, ", "))
        return gated(text.rlike(java_pattern(pattern, flags)), F.array(
            _one(F.lit(title), evidence, ["dns", "txt", tag], section)))

    spf = F.filter(_all(text, rules.SPF_INCLUDE, 1), lambda r: _holds(F.lower(r), rules.SPF_LABELS))
    policies = _all(text, rules.DMARC_POLICY, 1)
    return F.concat(
        listed("Internal IP address disclosed in DNS TXT record", rules.INTERNAL_IP, "Internal IP", "internal-ip", 0),
        listed("Internal hostname reference in DNS TXT record", rules.INTERNAL_HOST, "Internal hostname reference",
               "internal-host", 1, "i"),
        gated(text.rlike(java_pattern(rules.SPF, "i")) & _holds(text, rules.SPF_PARTS), F.transform(spf, lambda r, i: _one(
            F.concat(F.lit("SPF record includes internal/development reference: "), r),
            F.concat(F.lit("SPF include: "), r), ["dns", "spf", "internal"], 2, i))),
        gated(text.rlike(java_pattern(rules.DKIM, "i")), F.transform(_all(text, rules.DKIM_SELECTOR, 1), lambda s, i: _one(
            F.concat(F.lit("DKIM selector disclosed: "), s), F.concat(F.lit("DKIM Record: selector="), s),
            ["dns", "dkim"], 3, i))),
        gated(text.rlike(java_pattern(rules.DMARC, "i")), F.transform(
            F.filter(F.array(policies), lambda p: (F.size(p) > 0) & ~F.array_contains(p, "reject")),
            lambda p: _one(
                F.concat(F.lit("DMARC policy not set to reject (currently: "), p[0], F.lit(")")),
                F.concat(F.lit("DMARC Record: "), text), ["dns", "dmarc"], 4))),
    )


def _label_hits(text: Column, rtype: str, labels: Sequence[str], section: int) -> Column:
    shown = strip(text)
    return gated(_holds(F.lower(text), labels), F.array(_one(
        F.concat(F.lit(f"Development-related {rtype} record: "), shown), F.concat(F.lit(f"{rtype}: "), shown),
        ["dns", rtype.lower(), "internal"], section)))


def _raw(found: DataFrame, targets: DataFrame, counted: DataFrame | None = None) -> DataFrame:
    """Findings of (hostname, origin, hit) rows for every target on the host."""
    joined = measured_join(found, hosts(targets), "hostname", counted=counted)
    return as_raw(joined.withColumn("fetched_at", F.lit(None).cast("timestamp")))


def _exploded(records: DataFrame, hits: Column) -> DataFrame:
    return records.select("hostname", F.col("value").alias("origin"), F.explode(hits).alias("hit"))


def txt_records(dns: DataFrame, targets: DataFrame) -> DataFrame:
    return _raw(_exploded(dns.filter("rtype = 'TXT'"), txt_hits(F.col("value"))), targets)


def mail_labels(dns: DataFrame, targets: DataFrame) -> DataFrame:
    """MX and CNAME records with telling labels."""
    value = F.col("value")
    hits = F.when(F.col("rtype") == "MX", _label_hits(value, "MX", rules.MX_LABELS, 5)).otherwise(
        _label_hits(value, "CNAME", rules.CNAME_LABELS, 6))
    return _raw(_exploded(dns.filter("rtype in ('MX', 'CNAME')"), hits), targets)


def dns_records_rules(dns: DataFrame, targets: DataFrame) -> DataFrame:
    return txt_records(dns, targets).unionByName(mail_labels(dns, targets))


def _is_subdomain() -> Column:
    """The answer is for a probed label below some host."""
    label = F.substring_index("hostname", ".", 1)
    return F.coalesce(
        (F.col("rtype") == "A") & label.isin(rules.SUBDOMAINS) & F.contains("hostname", F.lit(".")) & valid_ipv4(F.col("value")), F.lit(False))


def subdomain_hit() -> Column:
    labels = literal_map({label: i for i, label in enumerate(rules.SUBDOMAINS)})
    where = F.concat("hostname", F.lit(" -> "), "value")
    evidence = F.concat(F.lit("Subdomain: "), "hostname", F.lit("\nIP: "), "value")
    pos = labels[F.substring_index("hostname", ".", 1)]
    return F.when(
        private_ipv4(F.col("value")),
        _one(F.concat(F.lit("Development subdomain resolves to internal IP: "), where), evidence, ["dns", "subdomain", "internal-ip"], 7, pos),
    ).otherwise(_one(F.concat(F.lit("Development subdomain resolves: "), where), evidence, ["dns", "subdomain"], 7, pos))


def _parent() -> Column:
    """The host that a probed label stands in front of."""
    return F.expr("substring(hostname, length(substring_index(hostname, '.', 1)) + 2)")


def dns_subdomains(dns: DataFrame, targets: DataFrame) -> DataFrame:
    """Probed labels below the host of a target that resolve.

    The label is read off the answer and looked up among the probed ones, so
    the join is on the host and no host x label product is formed.
    """
    answers = dns.filter(_is_subdomain())
    return _raw(answers.select(_parent().alias("hostname"), F.col("hostname").alias("origin"), F.explode(F.array(subdomain_hit())).alias("hit")), targets)


def _is_private() -> Column:
    return F.coalesce((F.col("rtype") == "A") & valid_ipv4(F.col("value")) & private_ipv4(F.col("value")), F.lit(False))


def private_hit() -> Column:
    return _one(
        F.concat(F.lit("Hostname resolves to internal IP: "), "hostname", F.lit(" -> "), "value"),
        F.concat(F.lit("Hostname: "), "hostname", F.lit("\nIP: "), "value"), ["dns", "internal-ip"], 8)


def _reverse(answers: DataFrame, telling: DataFrame) -> DataFrame:
    """(hostname, origin, hit) of addresses (hostname, ip) with a telling reverse name (ip, ptr)."""
    return measured_join(answers.distinct(), telling.distinct(), "ip").select(
        "hostname", F.col("ip").alias("origin"),
        one_hit(_one(
            F.concat(F.lit("Reverse DNS shows development hostname: "), "ip", F.lit(" -> "), "ptr"),
            F.concat(F.lit("IP: "), "ip", F.lit("\nPTR: "), "ptr"), ["dns", "reverse-dns", "internal"], 9)))


def _is_telling() -> Column:
    return F.coalesce((F.col("rtype") == "PTR") & _holds(F.lower("value"), rules.PTR_LABELS), F.lit(False))


def dns_reverse(dns: DataFrame, targets: DataFrame) -> DataFrame:
    """Hosts on private addresses, and addresses with telling reverse names."""
    private = dns.filter(_is_private()).select("hostname", F.col("value").alias("origin"), one_hit(private_hit()))
    answers = dns.filter("rtype = 'A'").filter(valid_ipv4(F.col("value"))).select("hostname", F.col("value").alias("ip"))
    telling = dns.filter(_is_telling()).select(F.col("hostname").alias("ip"), F.col("value").alias("ptr"))
    return _raw(private.unionByName(_reverse(answers, telling)), targets)


_ROW = f"struct<kind:string,hostname:string,origin:string,hit:{HIT}>"


def record_rows(records: DataFrame) -> DataFrame:
    """(kind, hostname, origin, hit) of every record in one pass.

    A ``finding`` belongs to its host.  Addresses (``answer``) and telling
    reverse names (``reverse``) have no hit yet: they are the two sides of the
    only join between records.
    """
    value, none = F.col("value"), F.lit(None).cast(HIT)

    def rows(host: Column, origin: Column, hits: Column) -> Column:
        return F.transform(hits, lambda h: F.struct(F.lit("finding"), host, origin, h).cast(_ROW))

    def plain(kind: str, host: Column, origin: Column) -> Column:
        return F.array(F.struct(F.lit(kind), host, origin, none).cast(_ROW))

    def only(condition: Column, some: Column) -> Column:
        return F.when(condition, some).otherwise(F.expr(f"cast(array() as array<{_ROW}>)"))

    name, rtype = F.col("hostname"), F.col("rtype")
    made = F.concat(
        only(rtype == "TXT", rows(name, value, txt_hits(value))),
        only(rtype == "MX", rows(name, value, _label_hits(value, "MX", rules.MX_LABELS, 5))),
        only(rtype == "CNAME", rows(name, value, _label_hits(value, "CNAME", rules.CNAME_LABELS, 6))),
        only(_is_subdomain(), rows(_parent(), name, F.array(subdomain_hit()))),
        only(_is_private(), rows(name, value, F.array(private_hit()))),
        only(F.coalesce((rtype == "A") & valid_ipv4(value), F.lit(False)), plain("answer", name, value)),
        only(_is_telling(), plain("reverse", name, value)),
    )
    return records.select(F.explode(made).alias("r")).select("r.*")


def dns(records: DataFrame, targets: DataFrame, materialize: bool = True) -> DataFrame:
    """Findings of all rules: the records are read once, and all hits meet the hosts in one join.

    The rows of the pass are checkpointed, because the join between addresses
    and reverse names reads them, too; ``materialize=False`` keeps the plan lazy.
    """
    rows = record_rows(records)
    if materialize:
        rows = reliable(rows)
    answers = rows.filter("kind = 'answer'").select("hostname", F.col("origin").alias("ip"))
    telling = rows.filter("kind = 'reverse'").select(F.col("hostname").alias("ip"), F.col("origin").alias("ptr"))
    found = rows.filter("kind = 'finding'").select("hostname", "origin", "hit")
    # the hits of single records tell which hosts are hot
    return _raw(found.unionByName(_reverse(answers, telling)), targets, found)
