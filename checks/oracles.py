"""Plain SQL for DuckDB that states what every query has to return.

Only rule tables are shared with the library; the logic is written again, one
rule at a time, with ranking windows and unnested lists.  RE2 runs the rules
as written, without needles, stops or faster forms.
"""

from __future__ import annotations

import re

from checks import seeds
from checks.queries import OWN_RULES
from seepage.operators.paths import API, DOCUMENTS, GIT, SENSITIVE
from seepage.rules import api, cloud, dns, errors, files, git, headers, javascript, listing, metadata, scoring, secrets, source, tech

_SPACE = (r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")

Sql = str


def q(text: str) -> Sql:
    return "'" + text.replace("'", "''") + "'"


def among(values) -> Sql:
    return "(" + ", ".join(q(v) if isinstance(v, str) else str(v) for v in values) + ")"


def strip(x: Sql) -> Sql:
    return f"regexp_replace({x}, {q(f'^{_SPACE}+|{_SPACE}+$')}, '', 'g')"


def lookup(key: Sql, table: dict, default: Sql = "NULL") -> Sql:
    branches = " ".join(f"WHEN {q(k) if isinstance(k, str) else k} THEN {q(v) if isinstance(v, str) else v}" for k, v in table.items())
    return f"CASE {key} {branches} ELSE {default} END"


def position(key: Sql, values: list[str]) -> Sql:
    return lookup(key, {v: i for i, v in enumerate(values)})


def pattern(text: str, flags: str = "") -> Sql:
    return q(f"(?{flags}){text}" if flags else text)


def short(x: Sql, chars: int) -> Sql:
    return f"CASE WHEN length({x}) > {chars} THEN left({x}, {chars}) || ' #' || left(sha256({x}), 16) ELSE {x} END"


def entropy(x: Sql) -> Sql:
    share = f"((length({x}) - length(replace({x}, c, ''))) / length({x}))"
    chars = f"list_distinct(regexp_extract_all({x}, '(?s).'))"
    return (f"(CASE WHEN length({x}) = 0 THEN 0.0::DOUBLE ELSE "
            f"coalesce(-list_sum(list_transform({chars}, lambda c: {share} * log2({share}))), 0.0) + 0.0 END)")


def context(body: Sql, match: Sql, width: int) -> Sql:
    at = f"strpos({body}, {match})"
    first = f"greatest({at} - 1 - {width}, 0)"
    last = f"least(length({body}), {at} - 1 + length({match}) + {width})"
    return (f"CASE WHEN {at} > 0 THEN CASE WHEN {first} > 0 THEN '... ' ELSE '' END || "
            f"substring({body}, {first} + 1, {last} - {first}) || "
            f"CASE WHEN {last} < length({body}) THEN ' ...' ELSE '' END ELSE {match} END")


_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"


def valid_ip(x: Sql) -> Sql:
    return f"regexp_full_match({x}, {q(rf'(?:{_OCTET}[.]){{3}}{_OCTET}')})"


def private_ip(x: Sql) -> Sql:
    n = " + ".join(f"TRY_CAST(left(split_part({x}, '.', {i + 1}), 3) AS BIGINT) * {256 ** (3 - i)}" for i in range(4))
    blocks = [
        ("0.0.0.0", 8), ("10.0.0.0", 8), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12), ("192.0.0.0", 24),
        ("192.0.2.0", 24), ("192.168.0.0", 16), ("198.18.0.0", 15), ("198.51.100.0", 24), ("203.0.113.0", 24),
        ("240.0.0.0", 4),
    ]

    def number(a: str) -> int:
        return sum(int(p) * 256 ** (3 - i) for i, p in enumerate(a.split(".")))

    inside = " OR ".join(f"({n}) BETWEEN {number(a)} AND {number(a) + 2 ** (32 - b) - 1}" for a, b in blocks)
    return f"({valid_ip(x)} AND ({inside}) AND {x} NOT IN ('192.0.0.9', '192.0.0.10'))"


# --- sources -------------------------------------------------------------

# Named tables of a statement; ``statement`` puts those in use in front of it.
NAMED: dict[str, Sql] = {
    "captures": seeds.for_duckdb(seeds.captures_sql()),
    "answers": seeds.for_duckdb(seeds.dns_sql()),
    "files": seeds.for_duckdb(seeds.documents_sql()),
}
CAPTURES, DNS, DOCUMENTS_SQL = "captures", "answers", "files"
PAGES = "(SELECT regexp_extract(url, '^https?://[^/?#]+', 0) AS target, url, 200 AS status, html AS body FROM pages)"
TEXTS = "(SELECT source AS target, source || '/' || CAST(doc_id AS VARCHAR) AS url, 200 AS status, text AS body FROM documents)"


def path() -> Sql:
    return "CASE WHEN starts_with(url, target || '/') THEN substring(url, length(target) + 2) END"


# --- raw findings ---------------------------------------------------------

RAW = ["target", "module", "title", "evidence", "url", "status", "description", "tags", "rule_id", "rule_severity",
       "origin", "source_pos", "section", "rule_rank", "match_pos"]


def raw(rows: Sql, module: str, title: Sql, evidence: Sql, tags: Sql, url: Sql = "url", status: Sql = "status",
        description: Sql = "''", rule_id: Sql = "''", tier: Sql = "''", origin: Sql = "url", source_pos: Sql = "0",
        section: int = 0, rank: Sql = "0", pos: Sql = "0", where: Sql = "true") -> Sql:
    values = {
        "target": "target", "module": q(module), "title": title, "evidence": evidence, "url": url,
        "status": f"CAST({status} AS INT)", "description": description, "tags": tags, "rule_id": rule_id,
        "rule_severity": tier, "origin": origin, "source_pos": source_pos, "section": str(section),
        "rule_rank": rank, "match_pos": pos,
    }
    return f"SELECT {', '.join(f'{values[c]} AS {c}' for c in RAW)} FROM {rows} WHERE {where}"


def union(*parts: Sql) -> Sql:
    return "\nUNION ALL\n".join(parts)



def matches(table: Sql, rules, flags, cap: int | None, where: Sql, text: Sql = "body") -> Sql:
    """One row per (row, rule) with the list of matches."""
    parts = []
    for rank, rule in enumerate(rules):
        if rule.rule_id == "aws_secret":
            # no back-references in RE2: either quote, then cut both quotes
            body = "[A-Za-z0-9/+=]{40}"
            alternatives = "(?i)'" + body + "'|\"" + body + "\""
            found = f"list_transform(regexp_extract_all({text}, {q(alternatives)}), lambda x: substring(x, 2, 40))"
        else:
            found = f"regexp_extract_all({text}, {pattern(rule.pattern, flags(rule))}, {rule.group})"
        if cap:
            found = f"list_slice({found}, 1, {cap})"
        parts.append(f"SELECT *, {rank} AS rank, {q(rule.rule_id)} AS id, {q(rule.label)} AS label, "
                     f"{q(rule.tier)} AS tier, {found} AS found FROM {table} AS t WHERE {where}")
    return f"({union(*parts)})"


def unnested(rows: Sql, items: Sql) -> Sql:
    return f"(SELECT *, unnest(items) AS m, generate_subscripts(items, 1) - 1 AS pos FROM (SELECT *, {items} AS items FROM {rows} AS r) AS r)"


def source_raw(table: Sql = CAPTURES, rules=source.RULES) -> Sql:
    rows = matches(table, rules, lambda r: "ms", None, "status IN (200, 201, 202) AND length(body) > 0")
    kept = (f"list_filter(list_transform(found, lambda x: {strip('x')}), lambda x: length(x) >= 3 "
            f"AND NOT (id = 'email' AND regexp_extract(x, '[^@]*$') IN {among(source.PLACEHOLDER_DOMAINS)}) "
            f"AND (id <> 'ip_address' OR {private_ip('x')}))")
    rows = f"(SELECT *, {kept} AS kept FROM {rows} AS k)"
    first = "list_filter(kept, lambda x, i: list_position(kept, x) = i)"
    return raw(unnested(rows, first), "source_code", f"label || ': ' || {short('m', 80)}", context("body", "m", 50),
               "['source-code', id]", rule_id="id", tier="tier", rank="rank", pos="pos")


def secrets_raw(table: Sql = CAPTURES, min_entropy: float = 3.5) -> Sql:
    rows = matches(table, secrets.RULES, lambda r: "", None, "length(body) > 0")
    kept = f"list_filter(found, lambda x: length(x) >= 8 AND round({entropy('x')}, 10) >= {min_entropy})"
    return raw(unnested(rows, kept), "secrets", "label || ' discovered'", context("body", "m", 60),
               "['secret', id]", rule_id="id", rank="rank", pos="pos")


def classify(x: Sql) -> Sql:
    e = f"round({entropy(x)}, 10)"
    return (f"CASE WHEN length({x}) = 0 THEN 'empty' "
            f"WHEN regexp_matches({x}, {q(secrets.BASE64_SHAPE)}) AND {e} > 4.0 THEN 'high_entropy_base64' "
            f"WHEN regexp_matches({x}, {q(secrets.HEX_SHAPE)}) AND length({x}) >= 16 AND {e} > 3.0 THEN 'high_entropy_hex' "
            f"WHEN {e} > 4.5 THEN 'high_entropy' WHEN {e} > 3.5 THEN 'medium_entropy' ELSE 'low_entropy' END")


def tokens_raw(table: Sql = CAPTURES) -> Sql:
    found = (f"list_filter(regexp_extract_all(body, {q(secrets.TOKEN)}, 1), lambda x: length(x) >= 8 "
             f"AND round({entropy('x')}, 10) >= 3.5 AND starts_with({classify('x')}, 'high_entropy'))")
    rows = f"(SELECT * FROM {table} AS t WHERE length(body) > 0)"
    return raw(unnested(rows, found), "secrets", f"'High entropy token discovered: ' || {short('m', 12)}",
               context("body", "m", 60), "['secret', 'entropy-token']", section=1, pos="pos", rule_id="'entropy_token'")


def errors_raw(table: Sql = CAPTURES) -> Sql:
    rows = matches(table, errors.RULES, lambda r: "m" if r.rule_id in errors.LINE_RULES else "ms", None,
                   "status IN (200, 201, 202, 403, 404, 500) AND length(body) > 0")
    kept = f"list_filter(list_transform(found, lambda x: {strip('x')}), lambda x: length(x) >= 10)"
    return raw(unnested(rows, kept), "errors", "'Error disclosure: ' || label", "m",
               "['error', replace(id, '_', '-')]", rule_id="id", tier="tier", rank="rank", pos="pos")


def cloud_raw(table: Sql = CAPTURES) -> Sql:
    where = "status IN (200, 201, 202) AND length(body) > 0"
    resources = unnested(matches(table, cloud.RULES, lambda r: "i", None, where), "found")
    identifiers = unnested(matches(table, cloud.IDENTIFIERS, lambda r: "i", None, where), "found")
    return union(
        raw(resources, "cloud_exposure", "'Cloud resource reference: ' || label", context("body", "m", 80),
            "['cloud', replace(id, '_', '-')]", rule_id="id", tier="tier", rank="rank", pos="pos"),
        raw(identifiers, "cloud_exposure", "'Sensitive cloud identifier: ' || label", context("body", "m", 80),
            "['cloud', 'sensitive', replace(id, '_', '-')]", rule_id="id", tier="tier", rank="rank", pos="pos",
            section=1))


def snippets(text: Sql, regex: Sql, around: int) -> Sql:
    lines = f"string_split({text}, chr(10))"
    hit = f"list_filter(range(1, len({lines}) + 1), lambda i: regexp_matches({lines}[i], {regex}))"
    snippet = f"array_to_string(list_slice({lines}, greatest(i - {around}, 1), least(i + {around}, len({lines}))), chr(10))"
    return f"array_to_string(list_transform({hit}, lambda i: {snippet}), chr(10) || '...' || chr(10))"


def _on(paths, table: Sql = CAPTURES, where: Sql = "true") -> Sql:
    return (f"(SELECT * FROM (SELECT *, {path()} AS path, coalesce(body, '') AS txt FROM {table} AS t WHERE status = 200) AS p "
            f"WHERE path IN {among(paths)} AND {where})")


def sensitive_raw(table: Sql = CAPTURES) -> Sql:
    described = lookup("path", files.DESCRIPTIONS, "'Sensitive file ' || path || ' is publicly accessible'")
    accessible = ("'URL: ' || url || ' returned HTTP ' || CAST(status AS VARCHAR) || ' (' || "
                  "CAST(length(txt) AS VARCHAR) || ' bytes)'")
    common = {
        "tags": "['sensitive-file', replace(replace(path, '/', '-'), '.', '-')]", "description": described,
        "rule_id": "path", "source_pos": position("path", SENSITIVE),
    }
    parts = []
    for rule in files.CONTENT:
        found = f"regexp_matches(txt, {q(rule.pattern)})"
        evidence = (f"CASE WHEN regexp_matches(txt, {pattern(rule.pattern, 'i')}) "
                    f"THEN {snippets('txt', pattern(rule.pattern, 'i'), 1)} ELSE txt END")
        rows = _on([rule.rule_id], table)
        parts.append(raw(rows, "sensitive_file", "'Sensitive file exposed: ' || path", evidence, tier=q(rule.tier),
                         where=found, **common))
        parts.append(raw(rows, "sensitive_file", "'Sensitive file accessible: ' || path", accessible,
                         where=f"NOT {found}", **common))
    unknown = [p for p in SENSITIVE if p not in {r.rule_id for r in files.CONTENT}]
    parts.append(raw(_on(unknown, table), "sensitive_file", "'Sensitive file accessible: ' || path", accessible, **common))
    return union(*parts)


def git_raw(table: Sql = CAPTURES) -> Sql:
    rows = _on(GIT, table, "length(body) > 0")
    s = strip("txt")
    lines = f"string_split({s}, chr(10))"
    settings = f"list_filter(list_transform({lines}, lambda l: {strip('l')}), lambda l: starts_with(l, '[') OR contains(l, '='))"
    shown = f"CASE WHEN len({settings}) > 0 THEN {settings} ELSE {lines} END"
    evidence = f"'Git Config Content:' || chr(10) || array_to_string({shown}, chr(10))"
    common = {"rule_id": "path", "source_pos": position("path", GIT)}

    def any_of(markers):
        return "(" + " OR ".join(f"regexp_matches(txt, {pattern(m, 'm')})" for m in markers) + ")"

    special = [".git/config", ".git/HEAD", ".git/index", ".git/"]
    return union(
        raw(rows, "git_exposure", "'Git repository configuration exposed (.git/config)'", evidence,
            "['git', 'git-config']", description="'The .git/config file is publicly accessible, exposing repository metadata'",
            where=f"path = '.git/config' AND {any_of(git.CONFIG_MARKERS)}", **common),
        raw(rows, "git_exposure",
            f"'Git HEAD reference exposed (branch: ' || replace({s}, 'ref: refs/heads/', '') || ')'",
            f"'Git HEAD exposed' || chr(10) || 'Branch: ' || replace({s}, 'ref: refs/heads/', '') || chr(10) || 'Content: ' || {s}",
            "['git', 'git-head']", where=f"path = '.git/HEAD' AND {any_of(git.HEAD_MARKERS)}", **common),
        raw(rows, "git_exposure", "'Git index file exposed (potential full repo download)'",
            "'Git index file exposed (' || CAST(length(txt) AS VARCHAR) || ' bytes)'", "['git', 'git-index']",
            where="path = '.git/index' AND length(txt) > 20", **common),
        raw(rows, "git_exposure", "'Git directory listing exposed'",
            "'URL: ' || url || chr(10) || 'Directory listing of .git available'", "['git', 'directory-listing']",
            where="path = '.git/' AND (contains(txt, 'Index of') OR contains(txt, 'HEAD') OR contains(txt, 'config'))", **common),
        raw(rows, "git_exposure", "'Git metadata exposed: ' || path",
            f"'Git reference exposed' || chr(10) || 'Path: ' || path || chr(10) || 'Content:' || chr(10) || {s}",
            "['git', 'git-metadata']", where=f"path IN {among(git.REFERENCE_PATHS)} AND length({s}) > 0", **common),
        raw(rows, "git_exposure", "'Git repository file exposed: ' || path",
            f"'Git file exposed' || chr(10) || 'Path: ' || path || chr(10) || 'Content preview: ' || {s}",
            "['git', 'git-metadata']",
            where=f"path NOT IN {among(special + git.REFERENCE_PATHS)} AND length({s}) > 0", **common),
    )


def _api_rank(text: Sql) -> Sql:
    return "CASE " + " ".join(f"WHEN regexp_matches({text}, {pattern(r.pattern, 'i')}) THEN {i}" for i, r in enumerate(api.MARKERS)) + " END"


def api_markers_raw(table: Sql = CAPTURES) -> Sql:
    rows = f"(SELECT *, {_api_rank('body')} AS rank FROM {_on(API, table, 'length(body) > 0')} AS a)"
    parts = []
    for i, rule in enumerate(api.MARKERS):
        plain = f"'API documentation exposed: {rule.label} at ' || url"
        title = {
            "graphql": f"CASE WHEN contains(lower(url), 'playground') THEN 'GraphQL Playground exposed: ' || url ELSE {plain} END",
            "graphiql": "'GraphiQL IDE exposed: ' || url", "swagger-ui": "'Swagger UI exposed: ' || url",
        }.get(rule.rule_id, plain)
        found = snippets("body", pattern(rule.pattern, "i"), 2)
        parts.append(raw(
            rows, "api_docs", title, f"CASE WHEN {found} <> '' THEN {found} ELSE body END",
            f"['api', 'api-docs', {q(rule.rule_id)}]", rule_id=q(rule.rule_id), tier=q(rule.tier), rank=str(i),
            source_pos=position("path", API), where=f"rank = {i}"))
    return union(*parts)


def api_spec_raw(table: Sql = CAPTURES) -> Sql:
    rows = f"(SELECT *, {_api_rank('body')} AS rank FROM {_on(API, table, 'length(body) > 0')} AS a)"
    spec = f"regexp_extract(body, {pattern(api.SPECIFICATION, 's')})"
    return raw(rows, "api_docs", "'API specification document exposed: ' || url", spec,
               "['api', 'api-docs', 'swagger-json']", section=1, rule_id="'specification'", tier="'High'",
               source_pos=position("path", API), where=f"rank IS NULL AND {spec} <> ''")


_HREFS = f"regexp_extract_all(body, {pattern(listing.HREF, 'i')}, 1)"


def _marker() -> Sql:
    return "CASE " + " ".join(f"WHEN contains(body, {q(m)}) THEN {q(d)}" for m, d in listing.MARKERS) + " END"


def listing_evidence(links: Sql) -> Sql:
    shown = f"list_filter({links}, lambda l: NOT (starts_with(l, '?') OR starts_with(l, '#') OR starts_with(l, 'javascript')))"
    return (f"('URL: ' || url || chr(10) || CASE WHEN len({shown}) > 0 THEN 'Entries (' || CAST(len({shown}) AS VARCHAR) || "
            f"'):' || chr(10) || array_to_string(list_transform({shown}, lambda l: '  - ' || l), chr(10)) || "
            f"'' ELSE 'Directory listing content shown (links not extractable)' END)")


def listing_raw(table: Sql = CAPTURES) -> Sql:
    rows = f"(SELECT *, {_marker()} AS marker FROM {table} AS t WHERE status = 200 AND length(body) > 0)"
    return raw(rows, "directory_listing", "'Directory listing enabled: ' || url", listing_evidence(_HREFS),
               "['directory-listing']", description="'Directory listing is enabled at this URL. ' || marker",
               where="marker IS NOT NULL")


def suspected_raw(table: Sql = CAPTURES) -> Sql:
    usable = f"list_filter({_HREFS}, lambda l: NOT (starts_with(l, '?') OR starts_with(l, '#')))"
    rows = (f"(SELECT *, {_marker()} AS marker, len(list_filter({usable}, lambda l: ends_with(l, '/'))) AS dirs, "
            f"len(list_filter({usable}, lambda l: contains(regexp_extract(l, '[^/]*$'), '.'))) AS filed "
            f"FROM {table} AS t WHERE status = 200 AND length(body) > 0)")
    return raw(rows, "directory_listing", "'Possible directory listing: ' || url",
               "'URL: ' || url || chr(10) || 'Found ' || CAST(dirs AS VARCHAR) || ' directories and ' || CAST(filed AS VARCHAR) || ' files'",
               "['directory-listing', 'suspected']", section=1,
               description="'The directory appears to have directory listing enabled based on ratio of directories to files'",
               where="marker IS NULL AND dirs > 5 AND dirs > filed")


# --- scripts ----------------------------------------------------------------

def _resolve(src: Sql) -> Sql:
    scheme = "regexp_extract(target, '^([a-z]+):', 1)"
    authority = "regexp_extract(target, '//([^/?#]*)', 1)"
    return (f"CASE WHEN starts_with({src}, 'http://') OR starts_with({src}, 'https://') THEN {src} "
            f"WHEN starts_with({src}, '//') THEN {scheme} || ':' || {src} "
            f"WHEN starts_with({src}, '/') THEN {scheme} || '://' || {authority} || {src} ELSE target || '/' || {src} END")


def _page_rows(table: Sql, pages: Sql = "true") -> Sql:
    return f"(SELECT * FROM {table} AS t WHERE status IN (200, 201, 202) AND length(body) > 0 AND {pages})"


_SOURCES = f"regexp_extract_all(body, {pattern(javascript.SCRIPT_SRC.pattern, 'i')}, 1)"


def references(table: Sql = CAPTURES, pages: Sql = "true") -> Sql:
    src = _SOURCES
    return (f"(SELECT target, url AS page, pos AS source_pos, {_resolve('m')} AS script_url "
            f"FROM {unnested(_page_rows(table, pages), src)} AS x)")


def scripts(table: Sql = CAPTURES, pages: Sql = "true") -> Sql:
    """(target, page, source_pos, script_url, script, external)."""
    inline = (f"list_filter(list_transform(regexp_extract_all(body, {pattern(javascript.INLINE_SCRIPT.pattern, 'si')}, 1), "
              f"lambda s: {strip('s')}), lambda s: length(s) > 0)")
    return (f"(SELECT r.target, r.page, r.source_pos, r.script_url, c.body AS script, true AS external "
            f"FROM {references(table, pages)} AS r JOIN {table} AS c ON c.url = r.script_url AND c.status = 200 AND length(c.body) > 0 "
            f"UNION ALL SELECT target, url, pos + len({_SOURCES}), url, m, false FROM {unnested(_page_rows(table, pages), inline)} AS x)")


def js_raw(table: Sql = CAPTURES, parts=("secrets", "endpoints", "env", "config", "cloud"), pages: Sql = "true") -> Sql:
    name = "scripts"
    NAMED.setdefault(name, f"SELECT * FROM {scripts(table, pages)} AS s")
    rows = name
    common = {"url": "script_url", "origin": "page", "source_pos": "source_pos", "status": "NULL", "pos": "pos"}

    def keyed(rule, section: int, key, tag: str, keep: Sql = "true") -> Sql:
        found = f"list_filter(regexp_extract_all(script, {q(rule.pattern)}, 0), lambda x: {keep})"
        k = key("m")
        return raw(unnested(rows, found), "javascript", f"{q(rule.label + ': ')} || {k}", context("script", "m", 60),
                   f"['javascript', {q(tag)}, lower({k})]", section=section, rule_id=q(rule.rule_id), **common)

    def group(rule, n: int):
        return lambda x: f"regexp_extract({x}, {q(rule.pattern)}, {n})"

    built = {}
    enough = f"list_filter(found, lambda x: length(x) >= 8 AND round({entropy('x')}, 10) >= 3.5)"
    built["secrets"] = raw(
        unnested(matches(rows, secrets.RULES, lambda r: "", None, "true", "script"), enough), "javascript",
        "label || ' exposed in JavaScript'", context("script", "m", 60), "['javascript', 'secret', id]",
        rule_id="id", rank="rank", **common)
    built["endpoints"] = raw(
        unnested(matches(rows, javascript.ENDPOINTS, lambda r: "", None, "true", "script"), "found"), "javascript",
        f"label || ' found in JavaScript: ' || {short('m', 80)}", context("script", "m", 60), "['javascript', 'endpoint']",
        section=1, rule_id="id", rank="rank", **common)
    env = javascript.ENV
    built["env"] = keyed(env, 2, lambda x: "coalesce(" + ", ".join(f"nullif({group(env, n)(x)}, '')" for n in (2, 3, 4)) + ", '')", "env-var")
    config = javascript.CONFIG
    built["config"] = keyed(config, 3, group(config, 2), "config", f"round({entropy(group(config, 3)('x'))}, 10) >= 3.5")
    built["cloud"] = keyed(javascript.CLOUD_CONFIG, 4, lambda x: f"regexp_extract({x}, {q(javascript.CLOUD_CONFIG_KEY)}, 1)", "cloud-config")
    return union(*[built[p] for p in parts])


# --- headers and technologies -------------------------------------------------

def header_rows(table: Sql = CAPTURES) -> Sql:
    slots = [("'Server'", "h_server"), ("'x-powered-by'", "h_powered_by"), ("h1_name", "h1_value"), ("h2_name", "h2_value")]
    return "(" + union(*[
        f"SELECT target, url, status, lower({n}) AS name, {v} AS value FROM {table} AS t WHERE {n} IS NOT NULL AND {v} IS NOT NULL"
        for n, v in slots]) + ")"


def disclosure_raw(table: Sql = CAPTURES) -> Sql:
    names = [n for n, _, _ in headers.DISCLOSURE]
    canonical = lookup("name", {n.lower(): n for n in names})
    return raw(header_rows(table), "http_header", f"'Information disclosure via ' || {canonical} || ' header'",
               f"{canonical} || ': ' || value", "['header', name]", rule_id="name",
               description=lookup("name", {n.lower(): d for n, d, _ in headers.DISCLOSURE}),
               tier=lookup("name", {n.lower(): t for n, _, t in headers.DISCLOSURE}),
               rank=lookup("name", {n.lower(): i for i, n in enumerate(names)}),
               where=f"name IN {among([n.lower() for n in names])} AND length({strip('value')}) > 0")


def infrastructure_raw(table: Sql = CAPTURES) -> Sql:
    names = headers.INFRASTRUCTURE
    canonical = lookup("name", {n.lower(): n for n in names})
    return raw(header_rows(table), "http_header", f"'Infrastructure information disclosed via ' || {canonical}",
               f"{canonical} || ': ' || value", "['header', 'infrastructure', name]", rule_id="name", section=1,
               description=f"'Internal infrastructure information disclosed via the ' || {canonical} || ' response header'",
               rank=lookup("name", {n.lower(): i for i, n in enumerate(names)}),
               where=f"name IN {among([n.lower() for n in names])}")


def tech_rows() -> Sql:
    """(target, url, category, tech, g, i): every technology with its place."""
    base = f"(SELECT * FROM {CAPTURES} AS t WHERE status > 0)"
    parts = []
    for g, (category, value, table) in enumerate((
        ("servers", "coalesce(h_server, '')", tech.SERVER), ("frameworks", "coalesce(h_powered_by, '')", tech.POWERED_BY),
        ("cms", "coalesce(body, '')", tech.HTML), ("frameworks", "coalesce(cookie_name, '')", tech.COOKIES),
    )):
        for i, (p, name) in enumerate(table):
            parts.append(f"SELECT page_id, target, url, {q(category)} AS category, {q(name)} AS tech, {g} AS g, {i} AS i "
                         f"FROM {base} AS b WHERE regexp_matches({value}, {pattern(p, 'i')})")
    for i, name in enumerate(tech.INFRASTRUCTURE):
        parts.append(f"SELECT page_id, target, url, 'infrastructure', {q(name + ': ')} || h1_value, 4, {i} "
                     f"FROM {base} AS b WHERE lower(h1_name) = {q(name.lower())}")
    return f"({union(*parts)})"


# --- documents and DNS ----------------------------------------------------------

def _extension() -> Sql:
    p = "regexp_replace(url, '^[a-z]+://[^/]*/?', '')"
    return f"CASE WHEN contains({p}, '.') THEN lower(regexp_extract({p}, '[.][^.]*$')) ELSE '' END"


def routed() -> Sql:
    mime = "lower(content_type)"
    return (f"(SELECT *, CASE WHEN ext = '.pdf' OR contains({mime}, 'pdf') THEN 'pdf' "
            f"WHEN ext IN {among(metadata.OFFICE_EXTENSIONS)} OR contains({mime}, 'openxml') THEN 'office' ELSE 'other' END AS doc_kind, "
            f"coalesce({position(path(), DOCUMENTS)}, {len(DOCUMENTS)}) AS place "
            f"FROM (SELECT *, {_extension()} AS ext FROM {DOCUMENTS_SQL} AS d WHERE status = 200) AS d)")


def pdf_raw() -> Sql:
    rows = f"(SELECT * FROM {routed()} AS d WHERE doc_kind = 'pdf')"

    def field(name: str) -> Sql:
        return f"regexp_extract_all(content, {pattern(metadata.PDF_FIELD.format(field=name), 'i')}, 1)[1]"

    lines = "list_filter([" + ", ".join(f"'{n}: ' || {field(n)}" for n in metadata.PDF_FIELDS) + "], lambda l: l IS NOT NULL)"
    common = {"origin": "target", "source_pos": "place"}
    emails = f"regexp_extract_all(content, {q(metadata.EMAIL)})"
    paths = f"regexp_extract_all(content, {q(metadata.INTERNAL_PATH)})"
    code = " OR ".join(f"contains(x, {q(e)})" for e in metadata.SOURCE_EXTENSIONS)

    def distinct(items: Sql, keep: Sql) -> Sql:
        return f"list_filter(list_filter({items}, lambda x, i: list_position({items}, x) = i), lambda x: {keep})"

    author = field("Author")
    return union(
        raw(rows, "metadata", "'PDF metadata exposed'", f"array_to_string({lines}, chr(10))", "['metadata', 'pdf']",
            rule_id="'pdf'", where=f"len({lines}) > 0", **common),
        raw(rows, "metadata", f"'Document author disclosed: ' || {author}", f"'Author: ' || {author}",
            "['metadata', 'pdf', 'author']", section=1, rule_id="'pdf-author'",
            where=f"{author} IS NOT NULL AND {author} NOT IN ('', 'Unknown', 'unknown')", **common),
        raw(unnested(rows, distinct(emails, "NOT contains(x, 'example')")), "metadata",
            "'Email address in PDF metadata: ' || m", "'Email: ' || m", "['metadata', 'pdf', 'email']", section=2,
            rule_id="'pdf-email'", pos="pos", **common),
        raw(unnested(rows, distinct(paths, f"NOT ({code})")), "metadata", "'Internal path in PDF metadata: ' || m",
            "'Path: ' || m", "['metadata', 'pdf', 'internal-path']", section=3, rule_id="'pdf-internal-path'", pos="pos",
            **common),
    )


def binary_raw() -> Sql:
    rows = f"(SELECT * FROM {routed()} AS d WHERE doc_kind = 'other')"
    labels = f"regexp_extract_all(content, {pattern(metadata.LABEL, 'i')}, 1)"
    clean = f"trim(trim({strip('x')}, '\"'), '''')"
    names = (f"list_filter(list_transform(list_filter({labels}, lambda x, i: list_position({labels}, x) = i), lambda x: {clean}), "
             f"lambda x: x NOT IN ('', 'Unknown', 'unknown'))")
    return raw(unnested(rows, names), "metadata", "'Document metadata author: ' || m", "'Author: ' || m",
               "['metadata', 'author']", rule_id="'author'", pos="pos", origin="target", source_pos="place")


def office_raw() -> Sql:
    rows = f"(SELECT * FROM {routed()} AS d WHERE doc_kind = 'office' AND xml IS NOT NULL)"
    lines = "list_filter([" + ", ".join(
        f"CASE WHEN regexp_matches(xml, {q(p)}) THEN '{n}: ' || regexp_extract(xml, {q(p)}, 1) END"
        for n, p in metadata.OFFICE_FIELDS) + "], lambda l: l IS NOT NULL)"
    kind = "replace(ext, '.', '')"
    return raw(rows, "metadata", f"upper({kind}) || ' document metadata exposed'", f"array_to_string({lines}, chr(10))",
               f"['metadata', {kind}]", rule_id=kind, origin="target", source_pos="place", where=f"len({lines}) > 0")


def hosts() -> Sql:
    return ("(SELECT DISTINCT target, lower(regexp_extract(target, '//([^/:]+)', 1)) AS host FROM "
            "(SELECT regexp_extract(url, '^https?://[^/?#]+', 0) AS target FROM pages) AS t)")


def _dns(rtype: str) -> Sql:
    return f"(SELECT h.target, h.host, d.value FROM {DNS} AS d JOIN {hosts()} AS h ON d.hostname = h.host WHERE d.rtype = {q(rtype)})"


_NOWHERE = {"url": "''", "status": "NULL", "origin": "value"}


def _contains(x: Sql, words) -> Sql:
    return "(" + " OR ".join(f"contains({x}, {q(w)})" for w in words) + ")"


def txt_raw() -> Sql:
    rows = _dns("TXT")

    def listed(title: str, p: str, flags: str, label: str, tag: str, section: int) -> Sql:
        return raw(rows, "dns", q(title),
                   f"'DNS TXT Record: ' || value || chr(10) || '{label}: ' || array_to_string(regexp_extract_all(value, {pattern(p, flags)}), ', ')",
                   f"['dns', 'txt', {q(tag)}]", section=section, rule_id=q(f"txt-{tag}"),
                   where=f"regexp_matches(value, {pattern(p, flags)})", **_NOWHERE)

    spf = f"list_filter(regexp_extract_all(value, {q(dns.SPF_INCLUDE)}, 1), lambda r: {_contains('lower(r)', dns.SPF_LABELS)})"
    policies = f"regexp_extract_all(value, {q(dns.DMARC_POLICY)}, 1)"
    return union(
        listed("Internal IP address disclosed in DNS TXT record", dns.INTERNAL_IP, "", "Internal IP", "internal-ip", 0),
        listed("Internal hostname reference in DNS TXT record", dns.INTERNAL_HOST, "i", "Internal hostname reference",
               "internal-host", 1),
        raw(unnested(rows, spf), "dns", "'SPF record includes internal/development reference: ' || m", "'SPF include: ' || m",
            "['dns', 'spf', 'internal']", section=2, rule_id="'spf-internal'", pos="pos",
            where=f"regexp_matches(value, {pattern(dns.SPF, 'i')}) AND {_contains('value', dns.SPF_PARTS)}", **_NOWHERE),
        raw(unnested(rows, f"regexp_extract_all(value, {q(dns.DKIM_SELECTOR)}, 1)"), "dns", "'DKIM selector disclosed: ' || m",
            "'DKIM Record: selector=' || m", "['dns', 'dkim']", section=3, rule_id="'dkim'", pos="pos",
            where=f"regexp_matches(value, {pattern(dns.DKIM, 'i')})", **_NOWHERE),
        raw(rows, "dns", f"'DMARC policy not set to reject (currently: ' || {policies}[1] || ')'", "'DMARC Record: ' || value",
            "['dns', 'dmarc']", section=4, rule_id="'dmarc'",
            where=f"regexp_matches(value, {pattern(dns.DMARC, 'i')}) AND len({policies}) > 0 AND NOT list_contains({policies}, 'reject')",
            **_NOWHERE),
    )


def mail_raw() -> Sql:
    return union(*[
        raw(_dns(rtype), "dns", f"'Development-related {rtype} record: ' || {strip('value')}", f"'{rtype}: ' || {strip('value')}",
            f"['dns', {q(rtype.lower())}, 'internal']", section=section, rule_id=q(f"{rtype.lower()}-internal"),
            where=_contains("lower(value)", labels), **_NOWHERE)
        for rtype, labels, section in (("MX", dns.MX_LABELS, 5), ("CNAME", dns.CNAME_LABELS, 6))])


def subdomains_raw() -> Sql:
    rows = (f"(SELECT h.target, d.hostname AS name, d.value AS ip, split_part(d.hostname, '.', 1) AS label "
            f"FROM {DNS} AS d JOIN {hosts()} AS h ON d.hostname = split_part(d.hostname, '.', 1) || '.' || h.host WHERE d.rtype = 'A')")
    private = private_ip("ip")
    return raw(
        rows, "dns",
        f"'Development subdomain resolves' || CASE WHEN {private} THEN ' to internal IP: ' ELSE ': ' END || name || ' -> ' || ip",
        "'Subdomain: ' || name || chr(10) || 'IP: ' || ip",
        f"CASE WHEN {private} THEN ['dns', 'subdomain', 'internal-ip'] ELSE ['dns', 'subdomain'] END", section=7,
        rule_id=f"CASE WHEN {private} THEN 'subdomain-internal-ip' ELSE 'subdomain' END", url="''", status="NULL",
        origin="name", pos=position("label", dns.SUBDOMAINS),
        where=f"label IN {among(dns.SUBDOMAINS)} AND {valid_ip('ip')}")


def reverse_raw() -> Sql:
    answers = f"(SELECT target, host, value AS ip FROM {_dns('A')} AS a WHERE {valid_ip('value')})"
    ptr = (f"(SELECT a.*, p.ptr FROM {answers} AS a JOIN (SELECT DISTINCT hostname, value AS ptr FROM {DNS} AS d "
           f"WHERE rtype = 'PTR' AND {_contains('lower(value)', dns.PTR_LABELS)}) AS p ON p.hostname = a.ip)")
    place = {"url": "''", "status": "NULL", "origin": "ip"}
    return union(
        raw(answers, "dns", "'Hostname resolves to internal IP: ' || host || ' -> ' || ip",
            "'Hostname: ' || host || chr(10) || 'IP: ' || ip", "['dns', 'internal-ip']", section=8, rule_id="'internal-ip'",
            where=private_ip("ip"), **place),
        raw(ptr, "dns", "'Reverse DNS shows development hostname: ' || ip || ' -> ' || ptr",
            "'IP: ' || ip || chr(10) || 'PTR: ' || ptr", "['dns', 'reverse-dns', 'internal']", section=9,
            rule_id="'reverse-dns-internal'", **place))


# --- scoring and dedup --------------------------------------------------------------

def scored(raw_sql: Sql, overrides: dict | None = None) -> Sql:
    size = "length(coalesce(evidence, ''))"
    confidence = (f"CASE WHEN status = 200 AND module IN {among(scoring.CERTAIN_MODULES)} THEN 'Certain' WHEN status = 200 THEN 'High' "
                  f"WHEN status IN (301, 302, 307, 308) THEN 'Medium' WHEN {size} > 50 THEN 'Medium' WHEN {size} > 10 THEN 'Low' ELSE 'Speculative' END")
    base = lookup("module", {**scoring.BASE_SEVERITY, **(overrides or {})}, q(scoring.DEFAULT_SEVERITY))
    rank = lookup(base, {s: i for i, s in enumerate(scoring.SEVERITIES)})
    lowered = f"CASE WHEN confidence IN ('Low', 'Speculative') THEN least({rank} + 1, 4) ELSE {rank} END"
    severity = lookup(f"({lowered})", dict(enumerate(scoring.SEVERITIES)))
    cvss = lookup("module || '|' || severity", {f"{m}|{s}": v for (m, s), v in scoring.CVSS.items()}, q(scoring.DEFAULT_CVSS))
    return (f"(SELECT *, {lookup('module', scoring.CWE, q(scoring.DEFAULT_CWE))} AS cwe, "
            f"{lookup('module', scoring.OWASP, q(scoring.DEFAULT_OWASP))} AS owasp, "
            f"{lookup('module', scoring.ADVICE, q(scoring.DEFAULT_ADVICE))} AS recommendation, {cvss} AS cvss_estimate, "
            f"{lookup('severity', {s: i for i, s in enumerate(scoring.SEVERITIES)})} AS severity_rank, "
            f"{lookup('module', {m: i + 1 for i, m in enumerate(scoring.MODULES)}, '0')} AS module_rank, "
            f"sha256(target || '|' || module || '|' || title || '|' || severity) AS fingerprint "
            f"FROM (SELECT *, {severity} AS severity FROM (SELECT *, {confidence} AS confidence FROM ({raw_sql}) AS r) AS c) AS s)")


ORDER = "module_rank, origin, source_pos, section, rule_rank, match_pos"


def deduped(scored_sql: Sql) -> Sql:
    return (f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY target, module, title, severity ORDER BY {ORDER}, "
            f"evidence NULLS FIRST, url NULLS FIRST, status NULLS FIRST) AS nth FROM {scored_sql} AS x) AS y WHERE nth = 1)")


SHOWN = ("target, module, title, severity, confidence, evidence, cwe, owasp, recommendation, url, description, "
         "cvss_estimate, fingerprint, rule_id, rule_severity, array_to_string(tags, '; ') AS tags")


def findings(raw_sql: Sql, overrides: dict | None = None) -> Sql:
    return f"SELECT {SHOWN} FROM {deduped(scored(raw_sql, overrides))} AS f"


def everything() -> Sql:
    """Raw findings of the whole job over the seeded captures and answers."""
    return union(
        sensitive_raw(), disclosure_raw(), infrastructure_raw(), source_raw(),
        js_raw(), secrets_raw(), tokens_raw(), errors_raw(), listing_raw(),
        suspected_raw(), api_markers_raw(), api_spec_raw(), git_raw(), cloud_raw(),
        pdf_raw(), binary_raw(), office_raw(), txt_raw(), mail_raw(), subdomains_raw(), reverse_raw())




# --- one statement per query ----------------------------------------------------------

TARGETS = "(SELECT DISTINCT regexp_extract(url, '^https?://[^/?#]+', 0) AS target FROM pages)"
CONVERSATIONS = ("(SELECT 'conversations' AS target, 'conversations/' || CAST(conv_id AS VARCHAR) || '/' || CAST(turn AS VARCHAR) AS url, "
                 "200 AS status, text AS body FROM conversations)")
PAGE_IDS = "(SELECT 'pages' AS target, CAST(page_id AS VARCHAR) AS url, 200 AS status, html AS body FROM pages)"


def only(sql: Sql, *rule_ids: str) -> Sql:
    return f"SELECT * FROM ({sql}) AS o WHERE rule_id IN {among(rule_ids)}"


def _lines() -> Sql:
    cleaned = f"(SELECT {strip('value')} AS line FROM ({seeds.for_duckdb(seeds.target_lines_sql())}) AS v)"
    kept = f"(SELECT regexp_replace(line, '/+$', '') AS url FROM {cleaned} AS c WHERE line <> '' AND NOT starts_with(line, '#'))"
    return (f"(SELECT CASE WHEN starts_with(url, 'http://') OR starts_with(url, 'https://') THEN url ELSE 'https://' || url END AS target "
            f"FROM {kept} AS k)")


def probe(paths: list[str]) -> Sql:
    return (f"SELECT target, path, CAST({position('path', paths)} AS BIGINT) AS path_pos, url, CAST(status AS BIGINT) AS status, "
            f"CAST(length(body) AS BIGINT) AS chars FROM (SELECT *, {path()} AS path FROM {CAPTURES} AS t) AS p WHERE path IN {among(paths)}")


def words(regex: str = "[A-Za-z0-9+/=_-]{6,}") -> Sql:
    return f"(SELECT unnest(regexp_extract_all(text, {q(regex)})) AS token FROM documents)"


NAMED["error_hits"] = errors_raw()
NAMED["scored_errors"] = f"SELECT * FROM {scored('SELECT * FROM error_hits')} AS s"
NAMED["sample"] = f"SELECT * FROM {deduped(scored(union('SELECT * FROM error_hits', cloud_raw(), sensitive_raw())))} AS s"
SAMPLE, ERRORS = "sample", "scored_errors"
KNOWN = deduped(scored("SELECT * FROM error_hits WHERE status = 200"))
NEW = f"(SELECT * FROM {deduped(ERRORS)} AS d WHERE fingerprint NOT IN (SELECT fingerprint FROM {KNOWN} AS k))"
LEVELS = "(VALUES " + ", ".join(f"({i}, {q(s)})" for i, s in enumerate(scoring.SEVERITIES)) + ")"
NUMBERED = (f"(SELECT *, row_number() OVER (ORDER BY severity_rank, target, {ORDER}, fingerprint) AS number FROM {SAMPLE} AS s)")
NAMED["counted"] = (f"SELECT CAST(l.i AS BIGINT) AS severity_rank, l.s AS severity, count(f.severity) AS n "
           f"FROM {LEVELS} AS l(i, s) LEFT JOIN {SAMPLE} AS f ON f.severity = l.s GROUP BY ALL")
COUNTED = "counted"
SHARES = f"(SELECT *, round(n * 100.0::DOUBLE / greatest((SELECT sum(n) FROM {COUNTED} AS a), 1), 1) AS percent FROM {COUNTED} AS c)"
_OK = f"(SELECT target, max(status > 0) AS ok, min(fetched_s) AS f, max(fetched_s) AS l FROM {CAPTURES} AS t GROUP BY target)"
NAMED["stats"] = (f"SELECT a.*, b.* FROM (SELECT count(*) AS total_urls, count(*) FILTER (ok) AS completed_urls, "
         f"count(*) FILTER (NOT coalesce(ok, false)) AS failed_urls, CAST(max(l) - min(f) AS DOUBLE) AS duration_seconds "
         f"FROM {TARGETS} AS t LEFT JOIN {_OK} AS o USING (target)) AS a, (SELECT count(*) AS total_findings, "
         + ", ".join(f"count(*) FILTER (severity = '{s}') AS \"{s}\"" for s in scoring.SEVERITIES) + f" FROM {SAMPLE} AS s) AS b")
STATS = "stats"


def _v(column: str) -> Sql:
    return f"CAST({column} AS VARCHAR)"


def _block() -> Sql:
    icon = lookup("severity", {"Critical": "🔴", "High": "🟠", "Medium": "🟡", "Low": "🔵"}, "'⚪'")

    def row(name: str, value: Sql) -> Sql:
        return f"'| **{name}** | ' || {value} || ' |'"

    def optional(name: str, column: str, value: Sql) -> Sql:
        return f"CASE WHEN coalesce({column}, '') <> '' THEN {row(name, value)} END"

    lines = [
        f"'### ' || {_v('number')} || '. ' || {icon} || ' ' || title", "''", "'| Field | Value |'", "'|-------|-------|'",
        row("Target", "'`' || target || '`'"), row("Module", "module"), row("Severity", "'**' || severity || '**'"),
        row("Confidence", "confidence"), row("CWE", "cwe"), row("OWASP", "owasp"),
        optional("URL", "url", "'`' || url || '`'"), optional("CVSS", "cvss_estimate", "'`' || cvss_estimate || '`'"),
        optional("Description", "description", "description"), optional("Recommendation", "recommendation", "recommendation"),
        f"CASE WHEN coalesce(evidence, '') <> '' THEN '| **Evidence** | |' || chr(10) || chr(10) || '```' || chr(10) || evidence || chr(10) || '```' END",
        "''", "'---'", "''",
    ]
    return f"concat_ws(chr(10), {', '.join(lines)})"


def _escaped(x: Sql) -> Sql:
    out = f"coalesce({x}, '')"
    for raw_char, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = f"replace({out}, {q(raw_char)}, {q(safe)})"
    return out


def _fragment() -> Sql:
    def field(label: str, value: Sql) -> Sql:
        return f"'<span><strong>{label}:</strong> ' || {value} || '</span>'"

    tags = (f"CASE WHEN len(tags) > 0 THEN '<div class=\"finding-tags\">' || array_to_string(list_transform(tags, "
            f"lambda t: '<span class=\"tag\">' || {_escaped('t')} || '</span>'), '') || '</div>' END")
    lines = [
        "'<div class=\"finding\">'", "'<div class=\"finding-header\">'",
        f"'<div class=\"finding-title\">' || {_escaped('title')} || '</div>'",
        "'<span class=\"severity-badge sev-' || severity || '\">' || severity || '</span>'", "'</div>'",
        "'<div class=\"finding-meta\">'", field("Target", _escaped("target")), field("Module", "module"),
        field("Confidence", "confidence"), field("CWE", "cwe"), field("OWASP", "owasp"), "'</div>'",
        f"CASE WHEN coalesce(evidence, '') <> '' THEN '<div class=\"finding-evidence\">' || {_escaped('evidence')} || '</div>' END",
        f"'<div class=\"finding-recommendation\">💡 ' || {_escaped('recommendation')} || '</div>'", tags, "'</div>'",
    ]
    return f"concat_ws(chr(10), {', '.join(lines)})"


def _console() -> Sql:
    pad = "      "
    lines = [
        f"'#' || {_v('number')} || ' ' || severity || ' ' || title", f"'{pad}Target: ' || target", f"'{pad}Module: ' || module",
        f"CASE WHEN coalesce(url, '') <> '' THEN '{pad}URL: ' || url END", f"'{pad}Confidence: ' || confidence",
        f"'{pad}CWE: ' || cwe || ' | OWASP: ' || owasp",
        f"CASE WHEN coalesce(evidence, '') <> '' THEN '{pad}Evidence: ' || evidence END",
    ]
    return f"concat_ws(chr(10), {', '.join(lines)})"


_JSON_COLUMNS = ("target, module, title, severity, confidence, evidence, cwe, owasp, recommendation, "
                 "coalesce(url, '') AS url, '' AS parameter, coalesce(description, '') AS description, cvss_estimate")
_SUMMARY_ROWS = [
    ("URLs Scanned", f"{_v('completed_urls')} || '/' || {_v('total_urls')}"), ("Failed URLs", _v("failed_urls")),
    ("Duration", "printf('%.1f', duration_seconds) || 's'"), ("Total Findings", _v("total_findings")),
    *[(s, _v(f'"{s}"')) for s in scoring.SEVERITIES],
]
_HEAD = [
    "'# seepage Scan Report'", "''", "'**Tool:** seepage'", "''", "'## Executive Summary'", "''",
    f"'- **Total URLs Scanned:** ' || {_v('completed_urls')} || '/' || {_v('total_urls')}",
    f"'- **Failed URLs:** ' || {_v('failed_urls')}", f"'- **Total Findings:** ' || {_v('total_findings')}",
    "'- **Scan Duration:** ' || printf('%.1f', duration_seconds) || 's'", "''", "'### Severity Breakdown'", "''",
    "'| Severity | Count |'", "'|----------|-------|'",
    *[f"""'| {s} | ' || {_v(f'"{s}"')} || ' |'""" for s in scoring.SEVERITIES],
    "''", "'## Detailed Findings'", "''", "'---'", "''", "CASE WHEN total_findings = 0 THEN '*No findings discovered.*' || chr(10) END",
]
_HEAD_AT = [*_HEAD[:2], "'**Generated:** 2024-01-02 03:04:05 UTC'", *_HEAD[2:]]
_CSS = {"Critical": "sev-critical", "High": "sev-high", "Medium": "sev-medium", "Low": "sev-low", "Informational": "sev-info"}
_HTML_HEAD = "concat_ws(chr(10), " + ", ".join([
    "'<h1>seepage Scan Report</h1>'", "'<div class=\"scan-meta\">'", "'<span>Generated: 2024-01-02 03:04:05 UTC</span>'",
    f"'<span>URLs: ' || {_v('completed_urls')} || '/' || {_v('total_urls')} || '</span>'",
    f"'<span>Failed: ' || {_v('failed_urls')} || '</span>'", "'<span>Duration: ' || printf('%.1f', duration_seconds) || 's</span>'",
    f"'<span>Findings: ' || {_v('total_findings')} || '</span>'", "'</div>'", "'<div class=\"severity-bar\">'",
    *[f"""'<div class="{c}" style="width: ' || printf('%.1f', round("{s}" * 100.0::DOUBLE / greatest(total_findings, 1), 1)) || '%;"></div>'"""
      for s, c in _CSS.items()],
    "'</div>'", "'<div class=\"counters\">'",
    *[f"""'<div class="counter {c}">{s}: ' || {_v(f'"{s}"')} || '</div>'""" for s, c in _CSS.items()],
    "'</div>'", "CASE WHEN total_findings = 0 THEN '<div class=\"no-findings\"><h2>No findings discovered</h2></div>' END",
]) + ")"


def _report_lines(head: Sql, block: Sql) -> Sql:
    """The lines of a report and how often each occurs."""
    return (f"SELECT line, count(*) AS n FROM (SELECT unnest(string_split(value, chr(10))) AS line FROM "
            f"(SELECT {head} AS value FROM {STATS} AS s UNION ALL SELECT {block} FROM {NUMBERED} AS n) AS v) AS l GROUP BY line")


_QUADS = "[0-9]{1,3}(?:[.][0-9]{1,3}){3}"
_TECH = ["servers", "frameworks", "cms", "infrastructure"]



def statement(sql: Sql) -> Sql:
    """The query with the named tables it needs, each computed once."""
    needed: list[str] = []

    def add(text: Sql) -> None:
        for name, body in NAMED.items():
            if name not in needed and re.search(rf"(?:FROM|JOIN) {name}\b", text):
                add(body)
                if name not in needed:
                    needed.append(name)

    add(sql)
    if not needed:
        return sql
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({NAMED[n]})" for n in needed) + "\n" + sql


_QUERIES: dict[str, Sql] = {
    "first_slice": findings(only(source_raw(PAGES), "html_comment", "email", "ip_address", "phone")),
    "targets_clean": f"SELECT target FROM {_lines()} AS l WHERE regexp_extract(target, '^https?://([^/?#]*)', 1) <> ''",
    "targets_rejected": f"SELECT target FROM {_lines()} AS l WHERE regexp_extract(target, '^https?://([^/?#]*)', 1) = ''",
    "probe_sensitive": probe(SENSITIVE),
    "probe_git": probe(GIT),
    "probe_api_docs": probe(API),
    "probe_directories": probe([f"{d}/" for d in listing.DIRECTORIES]),
    "probe_documents": (f"SELECT doc_id, target, path, CAST({position('path', DOCUMENTS)} AS BIGINT) AS path_pos FROM "
                        f"(SELECT *, {path()} AS path FROM {DOCUMENTS_SQL} AS d) AS p WHERE path IN {among(DOCUMENTS)}"),
    "probe_coverage": (f"SELECT t.target, p.path, t.target || '/' || p.path AS url FROM {TARGETS} AS t, "
                       f"(SELECT unnest({[p for p in SENSITIVE]}) AS path) AS p WHERE t.target || '/' || p.path NOT IN "
                       f"(SELECT url FROM {CAPTURES} AS c WHERE status > 0)"),
    "uncaptured_targets": f"SELECT target FROM {TARGETS} AS t WHERE target NOT IN (SELECT target FROM {CAPTURES} AS c WHERE status = 500)",
    "sensitive_file": findings(sensitive_raw()),
    "disclosure_headers": findings(disclosure_raw()),
    "infrastructure_headers": findings(infrastructure_raw()),
    "source_findings": findings(source_raw()),
    "source_findings_pages": findings(source_raw(PAGES)),
    "source_findings_documents": findings(source_raw(TEXTS)),
    "source_email": findings(only(source_raw(TEXTS), "email")),
    "source_private_ip": findings(only(source_raw(), "ip_address")),
    "js_inputs": (f"SELECT target, page, CAST(source_pos AS BIGINT) AS source_pos, script_url, "
                  f"CAST(length(script) AS BIGINT) AS chars, external FROM {scripts()} AS s"),
    "js_secrets": findings(js_raw(parts=["secrets"])),
    "js_endpoints": findings(js_raw(parts=["endpoints"])),
    "js_env": findings(js_raw(parts=["env"])),
    "js_config": findings(js_raw(parts=["config"])),
    "js_cloud_refs": findings(js_raw(parts=["cloud"])),
    "secrets_scan": findings(secrets_raw()),
    "secrets_documents": findings(secrets_raw(TEXTS)),
    "entropy_tokens": findings(tokens_raw()),
    "entropy_tokens_documents": findings(tokens_raw(TEXTS)),
    "error_pages": findings(errors_raw()),
    "directory_listing": findings(listing_raw()),
    "suspected_listing": findings(suspected_raw()),
    "api_docs": findings(api_markers_raw()),
    "api_spec_fallback": findings(api_spec_raw()),
    "git_exposure": findings(git_raw()),
    "cloud_refs": findings(only(cloud_raw(), *[r.rule_id for r in cloud.RULES])),
    "cloud_ids": findings(only(cloud_raw(), *[r.rule_id for r in cloud.IDENTIFIERS])),
    "pdf_metadata": findings(pdf_raw()),
    "binary_metadata": findings(binary_raw()),
    "metadata_route": f"SELECT doc_id, doc_kind FROM {routed()} AS d",
    "office_metadata": findings(office_raw()),
    "dns_txt": findings(txt_raw()),
    "dns_mail_labels": findings(mail_raw()),
    "dns_subdomains": findings(subdomains_raw()),
    "dns_reverse": findings(reverse_raw()),
    "tech_fingerprint": (f"SELECT target, url, category, tech, row_number() OVER (PARTITION BY page_id, url ORDER BY g, i) - 1 AS seq "
                         f"FROM {tech_rows()} AS t"),
    "tech_summary": ("SELECT target, url, string_agg(line, '; ' ORDER BY c) AS summary FROM (SELECT page_id, target, url, "
                     f"{position('category', _TECH)} AS c, upper(left(category, 1)) || substring(category, 2) || ': ' || "
                     f"string_agg(tech, ', ' ORDER BY tech) AS line FROM (SELECT DISTINCT page_id, target, url, category, tech "
                     f"FROM {tech_rows()} AS t) AS d GROUP BY page_id, target, url, category) AS l GROUP BY page_id, target, url"),
    "entropy": (f"SELECT token, n, round({entropy('token')}, 9) AS entropy, round({entropy('token')}, 10) >= 3.5 AS high "
                f"FROM (SELECT token, count(*) AS n FROM {words()} AS w GROUP BY token) AS g"),
    "charset_ratio": (f"SELECT token, round(len(list_distinct(regexp_extract_all(token, '(?s).'))) / length(token), 9) AS ratio "
                      f"FROM (SELECT DISTINCT token FROM {words()} AS w) AS g"),
    "classify_token": (f"SELECT label, count(*) AS n FROM (SELECT {classify('token')} AS label FROM "
                       f"(SELECT DISTINCT token FROM {words()} AS w) AS g) AS l GROUP BY label"),
    "likely_secret": (f"SELECT token, round({entropy('token')}, 9) AS entropy FROM (SELECT DISTINCT token FROM {words()} AS w) AS g "
                      f"WHERE length(token) >= 8 AND round({entropy('token')}, 10) >= 3.5"),
    "context_window": (f"SELECT doc_id, word, {context('text', 'word', 50)} AS context FROM "
                       f"(SELECT doc_id, text, unnest(list_distinct(regexp_extract_all(text, '[a-z]{{12,}}'))) AS word FROM documents) AS d"),
    "line_context": f"SELECT doc_id, {snippets('text', q('the'), 1)} AS context FROM documents",
    "url_resolve": ("SELECT url, CAST(pos AS BIGINT) AS pos, " + _resolve("m") + " AS resolved, "
                    "lower(regexp_extract(target, '//([^/:]+)', 1)) AS host, target || '/' || ltrim(m, '/') AS joined, "
                    "regexp_replace(target, '//', '//dev.') AS sub FROM "
                    + unnested(PAGES, """regexp_extract_all(body, '(?i)(?:href|src)=["'']([^"'']+)["'']', 1)""") + " AS u"),
    "private_ip": (f"SELECT ip, count(*) AS n, {valid_ip('ip')} AS valid, coalesce({private_ip('ip')}, false) AS private FROM "
                   f"(SELECT unnest(regexp_extract_all(body, '{_QUADS}')) AS ip FROM (SELECT body FROM {CAPTURES} AS c UNION ALL "
                   f"SELECT text FROM documents) AS b) AS i GROUP BY ip"),
    "score_findings": f"SELECT {SHOWN} FROM {ERRORS} AS s",
    "severity_override": findings(errors_raw(), {"errors": "Informational"}),
    "confidence_scores": (f"SELECT confidence, count(*) AS n, CAST({lookup('confidence', scoring.CONFIDENCE_SCORES)} AS DOUBLE) AS score "
                          f"FROM {ERRORS} AS s GROUP BY confidence"),
    "dedup_findings": findings(union(source_raw(), secrets_raw())),
    "new_findings": f"SELECT {SHOWN} FROM {NEW} AS n",
    "added_findings": f"SELECT count(*) AS added FROM {NEW} AS n",
    "severity_counts": f"SELECT * FROM {COUNTED} AS c",
    "severity_counts_by_target": (
        f"SELECT t.target, CAST(l.i AS BIGINT) AS severity_rank, l.s AS severity, count(f.severity) AS n FROM "
        f"(SELECT DISTINCT target FROM {SAMPLE} AS a) AS t CROSS JOIN {LEVELS} AS l(i, s) LEFT JOIN {SAMPLE} AS f "
        f"ON f.severity = l.s AND f.target = t.target GROUP BY ALL"),
    "findings_by_module": f"SELECT module, confidence, count(*) AS n FROM {SAMPLE} AS s GROUP BY module, confidence",
    "findings_rollup": (f"SELECT target, module, severity, CAST(grouping_id(target, module, severity) AS BIGINT) AS level, "
                        f"count(*) AS n FROM {SAMPLE} AS s GROUP BY CUBE (target, module, severity)"),
    "findings_total": f"SELECT count(*) AS total FROM {SAMPLE} AS s",
    "findings_filtered": (f"SELECT {SHOWN} FROM {SAMPLE} AS s WHERE severity = 'High' AND module = 'cloud_exposure' "
                          f"AND confidence = 'High'"),
    "scan_stats": f"SELECT * FROM {STATS} AS s",
    "severity_gate": (f"SELECT coalesce(bool_or(severity_rank <= 1), false) AS failed, "
                      f"CAST(coalesce(bool_or(severity_rank <= 1), false) AS BIGINT) AS exit_code FROM {SAMPLE} AS s"),
    "severity_share": f"SELECT * FROM {SHARES} AS s",
    "report_rows_md": f"SELECT number, {_block()} AS value FROM {NUMBERED} AS n",
    "report_summary_md": f"SELECT severity_rank, '| ' || severity || ' | ' || {_v('n')} || ' |' AS value FROM {COUNTED} AS c",
    "report_head_md": f"SELECT concat_ws(chr(10), {', '.join(_HEAD)}) AS value FROM {STATS} AS s",
    "report_rows_html": f"SELECT number, {_fragment()} AS value FROM {NUMBERED} AS n",
    "report_bar_html": ("SELECT severity_rank, '<div class=\"' || " + lookup("severity", {
        "Critical": "sev-critical", "High": "sev-high", "Medium": "sev-medium", "Low": "sev-low", "Informational": "sev-info"})
        + f" || '\" style=\"width: ' || printf('%.1f', percent) || '%;\"></div>' AS value FROM {SHARES} AS s"),
    "report_rows_csv": (
        "SELECT target AS \"Target\", module AS \"Module\", title AS \"Title\", severity AS \"Severity\", confidence AS \"Confidence\", "
        "cwe AS \"CWE\", owasp AS \"OWASP\", coalesce(url, '') AS \"URL\", coalesce(description, '') AS \"Description\", "
        "recommendation AS \"Recommendation\", cvss_estimate AS \"CVSS\", evidence AS \"Evidence\", "
        f"array_to_string(tags, '; ') AS \"Tags\" FROM {SAMPLE} AS s"),
    "report_rows_json": f"SELECT {_JSON_COLUMNS}, CAST(to_json(tags) AS VARCHAR) AS tags FROM {SAMPLE} AS s",
    "report_summary_json": (
        "SELECT '{\"tool\":{\"name\":\"seepage\"},\"scan_summary\":{\"total_urls\":' || " + " || ".join([
            _v("total_urls"), "',\"completed_urls\":'", _v("completed_urls"), "',\"failed_urls\":'", _v("failed_urls"),
            "',\"total_findings\":'", _v("total_findings"), "',\"duration_seconds\":'", _v("duration_seconds"),
            "',\"severity_counts\":{'",
            " || ',' || ".join(f"""'"{s}":' || {_v(f'"{s}"')}""" for s in scoring.SEVERITIES), "'}}}'"])
        + f" AS value FROM {STATS} AS s"),
    "report_rows_console": f"SELECT number, {_console()} AS value FROM {NUMBERED} AS n",
    "report_summary_console": union(*[
        f"SELECT CAST({i} AS BIGINT) AS pos, {q(name)} AS metric, {value} AS value FROM {STATS} AS s"
        for i, (name, value) in enumerate(_SUMMARY_ROWS)]),
    "report_file_md": _report_lines(f"concat_ws(chr(10), {', '.join(_HEAD_AT)})", _block()),
    "report_file_html": _report_lines(_HTML_HEAD, _fragment()),
    "responses_read": f"SELECT target, url, CAST(status AS BIGINT) AS status, coalesce(length(body), -1) AS chars, fetched_s FROM {CAPTURES} AS c",
    "dns_read": f"SELECT hostname, rtype, value FROM {DNS} AS d",
    "documents_from_responses": f"SELECT doc_id, target, url, CAST(status AS BIGINT) AS status, content_type, strlen(content) AS bytes FROM {DOCUMENTS_SQL} AS d",
    "own_rules": findings(source_raw(rules=OWN_RULES)),
    "findings_roundtrip": f"SELECT {_JSON_COLUMNS}, array_to_string(tags, '; ') AS tags FROM {SAMPLE} AS s",
    "stream_findings": findings(source_raw(PAGES)),
    "stream_distinct": f"SELECT DISTINCT target, module, title, severity, fingerprint FROM {scored(source_raw(PAGES))} AS s",
    "stream_counts": (
        "SELECT severity, count(DISTINCT fingerprint) AS n "
        f"FROM {scored(union(source_raw(), secrets_raw(), errors_raw()))} AS s GROUP BY severity"),
    "stream_scripts": f"SELECT DISTINCT target, module, title, severity, fingerprint FROM {scored(js_raw())} AS s",
    "stream_windowed_counts": (
        "SELECT (1704067200 + CAST(origin AS BIGINT) * 60) // 600 * 600 AS window_start, severity, count(*) AS n "
        f"FROM {scored(source_raw(PAGE_IDS))} AS s GROUP BY ALL"),
    "stream_event_counts": (
        "SELECT CAST(floor(epoch(e.ts) / 3600) * 3600 AS BIGINT) AS window_start, p.severity, CAST(sum(p.hits) AS BIGINT) AS n "
        "FROM events AS e JOIN (SELECT CAST(origin AS BIGINT) AS page_id, severity, count(*) AS hits FROM "
        f"{scored(source_raw(PAGE_IDS))} AS s GROUP BY ALL) AS p ON p.page_id = e.event_id % (SELECT count(*) FROM pages) GROUP BY ALL"),
    "detect_natural": findings(union(*[
        part for t in (PAGES, TEXTS, CONVERSATIONS)
        for part in (source_raw(t), secrets_raw(t), tokens_raw(t), errors_raw(t), cloud_raw(t))])),
    "scan_findings": findings(union(source_raw(), errors_raw())),
    "scan_technologies": f"SELECT target, url, category, tech, count(*) AS n FROM {tech_rows()} AS t GROUP BY ALL",
    "detect_all": findings(everything()),
}

ORACLES: dict[str, Sql] = {name: statement(sql) for name, sql in _QUERIES.items()}
