"""Sensitive files, git repositories and API documentation at known paths."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seepage.functions.text import let, line_context, strip
from seepage.operators.matching import PATH, TEXT, first_rule, gated, hit, literal, literal_map, no_hits, one_of, run
from seepage.operators.paths import API, GIT, SENSITIVE, path_position
from seepage.rules import api, files, git, java_pattern


def _text() -> Column:
    return F.coalesce(F.col(TEXT), F.lit(""))


def _by(key: Column, rules: dict, flags: str) -> Callable[[Column], Column]:
    """Whether the pattern that belongs to the row's key occurs in a text; each pattern is a literal and compiled once."""
    def occurs(text: Column) -> Column:
        out = F.lit(False)
        for name, rule in rules.items():
            out = F.when(key == name, text.rlike(rule.java(flags))).otherwise(out)
        return out

    return occurs


def sensitive_file_hits() -> Column:
    """Listed files, with content evidence where the content is recognised.

    Evidence is the flagged lines with their neighbours, or the whole text
    where the pattern spans lines and no single one is flagged.
    """
    path = F.col(PATH)
    by_path = {r.rule_id: r for r in files.CONTENT}
    flagged = _by(path, by_path, "i")

    def evidence() -> Column:
        lines = let(F.split(_text(), "\n"), lambda all_lines: line_context(all_lines, flagged, files.LINES_AROUND))
        return F.when(flagged(_text()), lines).otherwise(_text())

    def one(exposed: Column) -> Column:
        return hit(
            files.MODULE,
            F.concat(F.lit("Sensitive file "), F.when(exposed, "exposed: ").otherwise("accessible: "), path),
            F.when(exposed, evidence()).otherwise(F.concat(
                F.lit("URL: "), "url", F.lit(" returned HTTP "), F.col("status").cast("string"),
                F.lit(" ("), F.length(_text()).cast("string"), F.lit(" bytes)"))),
            F.array(F.lit("sensitive-file"), F.translate(path, "/.", "--")),
            source_pos=path_position(path, SENSITIVE), rule_id=path,
            tier=F.when(exposed, literal_map({r.rule_id: r.tier for r in files.CONTENT})[path]).otherwise(""),
            description=F.coalesce(
                literal_map(files.DESCRIPTIONS)[path],
                F.concat(F.lit("Sensitive file "), path, F.lit(" is publicly accessible"))),
        )

    exposed = F.coalesce(_by(path, by_path, "")(_text()), F.lit(False))
    listed = F.expr("unit = 'body' AND status = 200") & one_of(PATH, SENSITIVE)
    return gated(listed, F.transform(F.array(exposed), one))


def git_evidence(body: Column) -> Column:
    """Section and setting lines of a repository configuration."""

    def render(lines: Column) -> Column:
        settings = F.filter(
            F.transform(lines, strip), lambda l: F.startswith(l, F.lit("[")) | F.contains(l, F.lit("=")))
        shown = let(settings, lambda s: F.when(F.size(s) > 0, s).otherwise(lines))
        return F.concat(F.lit("Git Config Content:\n"), F.array_join(shown, "\n"))

    return let(F.split(strip(body), "\n"), render)


def git_hits() -> Column:
    """Files of an exposed repository and its directory listing."""

    def any_of(markers: list[str]) -> Column:
        return F.expr(" OR ".join(f"{TEXT} RLIKE {literal(java_pattern(m, 'm'))}" for m in markers))

    path = F.col(PATH)

    def one(title: Column, evidence: Column, tag: str, description: str = "") -> Column:
        return F.array(hit(
            git.MODULE, title, evidence, F.array(F.lit("git"), F.lit(tag)),
            source_pos=path_position(path, GIT), rule_id=path, description=description,
        ))

    def hits() -> Column:
        stripped = strip(F.col(TEXT))
        size = F.length(TEXT).cast("string")
        branch = F.replace(stripped, F.lit("ref: refs/heads/"), F.lit(""))
        preview = F.when(path.isin(git.REFERENCE_PATHS), F.concat(
            F.lit("Git reference exposed\nPath: "), path, F.lit("\nContent:\n"), stripped,
        )).otherwise(F.concat(
            F.lit("Git file exposed\nPath: "), path, F.lit("\nContent preview: "), stripped))
        heading = F.when(path.isin(git.REFERENCE_PATHS), "Git metadata exposed: ").otherwise(
            "Git repository file exposed: ")
        return (
            F.when(path == ".git/config", F.when(any_of(git.CONFIG_MARKERS), one(
                F.lit("Git repository configuration exposed (.git/config)"), git_evidence(F.col(TEXT)),
                "git-config",
                "The .git/config file is publicly accessible, exposing repository metadata")))
            .when(path == ".git/HEAD", F.when(any_of(git.HEAD_MARKERS), one(
                F.concat(F.lit("Git HEAD reference exposed (branch: "), branch, F.lit(")")),
                F.concat(F.lit("Git HEAD exposed\nBranch: "), branch, F.lit("\nContent: "), stripped),
                "git-head")))
            .when(path == ".git/index", F.when(F.length(TEXT) > git.MIN_INDEX_CHARS, one(
                F.lit("Git index file exposed (potential full repo download)"),
                F.concat(F.lit("Git index file exposed ("), size, F.lit(" bytes)")), "git-index")))
            .when(path == git.DIRECTORY, F.when(
                F.expr(" OR ".join(f"contains({TEXT}, {literal(m)})" for m in git.DIRECTORY_MARKERS)), one(
                    F.lit("Git directory listing exposed"),
                    F.concat(F.lit("URL: "), "url", F.lit("\nDirectory listing of .git available")),
                    "directory-listing")))
            .when(F.length(stripped) > 0, one(F.concat(heading, path), preview, "git-metadata"))
        )

    listed = F.expr(f"unit = 'body' AND status = 200 AND length({TEXT}) > 0") & one_of(PATH, GIT)
    return gated(listed, F.coalesce(hits(), no_hits()))


def _api_title(rank: Column, group: Column) -> Column:
    labels = literal_map({i: r.label for i, r in enumerate(api.MARKERS)})
    playground = (group == "graphql") & F.contains(F.lower("url"), F.lit("playground"))
    return (
        F.when(playground, F.concat(F.lit("GraphQL Playground exposed: "), "url"))
        .when(group == "graphiql", F.concat(F.lit("GraphiQL IDE exposed: "), "url"))
        .when(group == "swagger-ui", F.concat(F.lit("Swagger UI exposed: "), "url"))
        .otherwise(F.concat(F.lit("API documentation exposed: "), labels[rank], F.lit(" at "), "url"))
    )


def _on_api_path() -> Column:
    return F.expr(f"unit = 'body' AND status = 200 AND length({TEXT}) > 0") & one_of(PATH, API)


def api_marker_hits() -> Column:
    """Interactive documentation and specifications at listed paths."""

    def one(rank: Column) -> Column:
        group = literal_map({i: r.rule_id for i, r in enumerate(api.MARKERS)})[rank]
        flagged = _by(rank, dict(enumerate(api.MARKERS)), "i")
        snippets = let(F.split(TEXT, "\n"), lambda lines: line_context(lines, flagged, api.LINES_AROUND))
        # a marker that spans lines flags none of them
        evidence = let(snippets, lambda s: F.when(s != "", s).otherwise(F.col(TEXT)))
        return hit(
            api.MODULE, _api_title(rank, group), evidence, F.array(F.lit("api"), F.lit("api-docs"), group),
            source_pos=path_position(F.col(PATH), API), rank=rank, rule_id=group,
            tier=literal_map({i: r.tier for i, r in enumerate(api.MARKERS)})[rank],
        )

    found = F.filter(F.array(first_rule(api.MARKERS, "i")), lambda r: r.isNotNull())
    return gated(_on_api_path(), F.transform(found, one))


def api_spec_hits() -> Column:
    """A specification object in a body without any marker."""
    spec = F.regexp_extract(TEXT, java_pattern(api.SPECIFICATION_FAST, "s"), 1)

    def one(text: Column) -> Column:
        return hit(
            api.MODULE, F.concat(F.lit("API specification document exposed: "), "url"), text,
            F.array(F.lit("api"), F.lit("api-docs"), F.lit("swagger-json")),
            source_pos=path_position(F.col(PATH), API), section=1, rule_id="specification", tier="High",
        )

    named = F.expr(f"""contains({TEXT}, '"swagger"') OR contains({TEXT}, '"openapi"')""")
    possible = _on_api_path() & named & first_rule(api.MARKERS, "i").isNull()
    return gated(possible, F.transform(F.filter(F.array(spec), lambda s: s != ""), one))


def _ok(responses: DataFrame) -> DataFrame:
    return responses.filter("status = 200")


def sensitive_files(responses: DataFrame) -> DataFrame:
    return run(_ok(responses), sensitive_file_hits)


def git_exposure(responses: DataFrame) -> DataFrame:
    return run(_ok(responses), git_hits)


def api_docs(responses: DataFrame) -> DataFrame:
    return run(_ok(responses), api_marker_hits, api_spec_hits)


def api_specifications(responses: DataFrame) -> DataFrame:
    return run(_ok(responses), api_spec_hits)
