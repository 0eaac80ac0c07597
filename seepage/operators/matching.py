"""Running many rules over one text column in a single pass.

A detector turns the current row into an array of hits.  Detectors are
concatenated and exploded once, so any number of them costs one scan and no
shuffle, and only the hits leave the expression - never the body.

Patterns are literals, compiled once per task.  A rule is only run on texts
that hold one of its literals, and a rule whose matches need a closing part is
only run on the text up to the last closing part.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seepage.functions.net import path_of
from seepage.functions.text import context_window, let
from seepage.rules import GATES, Rule, java_pattern
from seepage.rules.scoring import MODULES
from seepage.schema import HIT

# Characters that equal an ASCII letter when case is ignored but do not lower
# to it; texts with one of them skip the literal test.
FOLDING = ["ſ", "İ", "ı", "\u212a"]

# A row of ``units``: the text to search and where it comes from.  ``unit`` is
# "body" for a whole response and "inline" for a script inside one.
UNIT = "struct<unit:string,url:string,status:int,source_pos:int,text:string>"
TEXT, LOWER, FOLDS, PATH = "text", "_lower", "_folds", "_path"

Detector = Callable[[], Column]


def literal(text: str) -> str:
    """A string as a SQL literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def no_hits() -> Column:
    return F.expr(f"cast(array() as array<{HIT}>)")


def ignores_case(rule: Rule, flags: str) -> bool:
    return "i" in flags or rule.pattern.startswith("(?i)")


def stop_pattern(rule: Rule, flags: str) -> str:
    """Pattern of the text up to the last closing part; empty without one."""
    case = "i" if ignores_case(rule, flags) else ""
    return java_pattern(f"^.*(?:{rule.stop})", "s" + case) if rule.stop else ""


def found_group(rule: Rule) -> int:
    return rule.group + 1 if rule.opener else rule.group


def find_all_sql(rule: Rule, flags: str = "", cap: int | None = None, skipped: bool = False) -> str:
    """SQL for all matches of ``rule`` in the text, in order.

    Written as SQL because a rule set has dozens of these and building them
    call by call takes longer than running them on a small partition.  With
    ``skipped`` an empty text stands where an opener failed.
    """
    source = TEXT
    if rule.stop:
        source = f"regexp_extract({TEXT}, {literal(stop_pattern(rule, flags))}, 0)"
    found = f"regexp_extract_all({source}, {literal(rule.java(flags))}, {found_group(rule)})"
    if rule.opener and not skipped:
        found = f"filter({found}, m -> m <> '')"
    tests = [f"_{rule.gate}"] if rule.gate else []
    if rule.needles:
        tests.append("(" + " OR ".join(f"contains({LOWER}, {literal(needle)})" for needle in rule.needles) + ")")
    if tests:
        possible = " AND ".join(tests) + (f" OR {FOLDS}" if ignores_case(rule, flags) else "")
        found = f"CASE WHEN {possible} THEN {found} ELSE cast(array() as array<string>) END"
    return f"slice({found}, 1, {cap})" if cap else found


def find_all(rule: Rule, flags: str = "", cap: int | None = None) -> Column:
    return F.expr(find_all_sql(rule, flags, cap))


def rule_matches(rules: Sequence[Rule], flags: Callable[[Rule], str] = lambda rule: "", cap: int | None = None) -> Column:
    """array<struct(rank, id, label, tier, found)>, one element per rule."""
    return F.expr("array(" + ", ".join(
        f"named_struct('rank', {rank}, 'id', {literal(rule.rule_id)}, 'label', {literal(rule.label)}, "
        f"'tier', {literal(rule.tier)}, 'found', {find_all_sql(rule, flags(rule), cap)})"
        for rank, rule in enumerate(rules)
    ) + ")")


def placed_matches(rules: Sequence[Rule], flags: Callable[[Rule], str] = lambda rule: "") -> Column:
    """As ``rule_matches``, with what is needed to find the places of the matches again.

    ``found`` has an empty text where an opener failed, so that its elements
    stand in line with the matches of the whole pattern.
    """
    return F.expr("array(" + ", ".join(
        f"named_struct('rank', {rank}, 'id', {literal(rule.rule_id)}, 'label', {literal(rule.label)}, "
        f"'tier', {literal(rule.tier)}, 'pattern', {literal(rule.java(flags(rule)))}, 'stop', {literal(stop_pattern(rule, flags(rule)))}, "
        f"'found', {find_all_sql(rule, flags(rule), skipped=True)})"
        for rank, rule in enumerate(rules)
    ) + ")")


# Up to this many matches of a rule are looked up one by one in the text.
_FEW = 256
# Characters of a match's end by which occurrences elsewhere are told, and those in front of it that are compared.
_END, _NEAR = 8, 64
_ENDS = f"(?s)(?=(.{{{_END}}}))"


def _sections(rule: Column, some: int) -> Column:
    """The text cut at the matches of one rule, in one sweep.

    ``whole`` are the matches, ``start`` the text before the first, ``item``
    the text from each match up to the next, ``head`` the last ``some``
    characters of the start and of the items, ``tail`` the first ones of the
    items.
    """
    text = F.col(TEXT)

    def cut(source: Column) -> Column:
        pieces = F.split(source, rule["pattern"], -1)
        rest = F.substring(text, F.length(source) + 1, F.length(text))
        with_rest = let(pieces, lambda p: F.concat(F.slice(p, F.lit(1), F.size(p) - 1), F.array(F.concat(F.element_at(p, -1), rest))))
        return let(F.struct(
            F.regexp_extract_all(source, rule["pattern"], F.lit(0)).alias("whole"),
            F.when(rule["stop"] == "", pieces).otherwise(with_rest).alias("piece"),
        ), items)

    def items(cut_: Column) -> Column:
        item = F.transform(cut_["whole"], lambda w, i: F.concat(w, F.get(cut_["piece"], i + 1)))
        return let(item, lambda t: F.struct(
            cut_["whole"].alias("whole"), cut_["piece"][0].alias("start"), t.alias("item"),
            F.concat(F.array(F.right(cut_["piece"][0], F.lit(some))), F.transform(t, lambda x: F.right(x, F.lit(some)))).alias("head"),
            F.transform(t, lambda x: F.left(x, F.lit(some))).alias("tail")))

    return let(F.when(rule["stop"] == "", text).otherwise(F.regexp_extract_all(text, rule["stop"], F.lit(0))[0]), cut)


def _joined(parts: Column, first: Column, count: Column) -> Column:
    return F.array_join(F.slice(parts, first + 1, count), "")


def _front(cut: Column, place: Column, chars: int) -> Column:
    """At least ``chars`` characters in front of an item, if there are so many.

    Each item has at least one character, so as many items are enough however
    dense the matches are, and one is if it is long.
    """
    near, first = F.get(cut["head"], place), F.greatest(place - chars, F.lit(0))
    return F.when(F.length(near) >= chars, near).otherwise(_joined(cut["head"], first, place - first + 1))


def _around(cut: Column, place: Column, match: Column, width: int) -> Column:
    """(before, after): the text around a match at its own place, more than ``width`` characters where there are more."""
    whole, item = F.get(cut["whole"], place), F.get(cut["item"], place)
    at = F.position(match, whole)
    own = F.substring(item, at + F.length(match), F.lit(width + 1))
    return F.struct(
        F.right(F.concat(_front(cut, place, max(width, _NEAR) + 1), F.left(whole, at - 1)), F.lit(max(width, _NEAR) + 1)).alias("before"),
        F.when(F.length(own) > width, own).otherwise(F.concat(own, _joined(cut["tail"], place + 1, F.lit(width + 1)))).alias("after"))


def _snippet(match: Column, around: Column, width: int) -> Column:
    return F.concat(
        F.when(F.length(around["before"]) > width, F.concat(F.lit("... "), F.right(around["before"], F.lit(width)))).otherwise(around["before"]),
        match,
        F.when(F.length(around["after"]) > width, F.concat(F.left(around["after"], F.lit(width)), F.lit(" ..."))).otherwise(around["after"]))


def _other_ends(cut: Column, matches: Column, kept: Callable[[Column], Column]) -> Column:
    """What stands at the end of any place of the text other than the ends of the kept matches."""
    def of_item(match: Column, place: Column) -> Column:
        front = let(_front(cut, place, _END - 1), lambda f: F.right(f, F.lit(_END - 1)))
        end = F.position(match, F.get(cut["whole"], place)) - 1 + F.length(match)
        own = F.when(kept(match), end - _END)
        return let(F.struct(front.alias("front"), own.alias("own")), lambda x: let(F.coalesce(x["own"] + F.length(x["front"]), F.lit(-1)), lambda left_out: F.filter(
            F.regexp_extract_all(F.concat(x["front"], F.get(cut["item"], place)), F.lit(_ENDS), F.lit(1)), lambda _, k: k != left_out)))

    return F.concat(F.regexp_extract_all(cut["start"], F.lit(_ENDS), F.lit(1)), F.flatten(F.transform(matches, of_item)))


def _doubtful(placed: Column) -> Column:
    """Matches that are also the end of the text up to another match's end."""
    def ending(x: Column) -> Column:
        return F.reverse(F.right(F.concat(x["around"]["before"], x["m"]), F.lit(_NEAR)))

    def beside(s: Column, x: Column, k: Column) -> Column:
        # all texts that end alike stand side by side
        own = F.reverse(F.right(x["m"], F.lit(_NEAR)))
        return F.coalesce((F.get(s, k)["m"] != x["m"]) & F.startswith(F.get(s, k)["ending"], own), F.lit(False))

    ordered = F.array_sort(F.transform(placed, lambda x: F.struct(ending(x).alias("ending"), x["m"].alias("m"))))
    return let(ordered, lambda s: F.array_distinct(F.transform(
        F.filter(s, lambda x, k: beside(s, x, k - 1) | beside(s, x, k + 1)), lambda x: x["m"])))


def _firsts(numbered: Column) -> Column:
    """The first of equal matches each, in order."""
    sorted_ = F.array_sort(F.transform(numbered, lambda x: F.struct(x["m"].alias("m"), x["n"].alias("n"), x["i"].alias("i"))))
    firsts = let(sorted_, lambda s: F.filter(s, lambda x, k: (k == 0) | (F.get(s, k - 1)["m"] != x["m"])))
    return F.array_sort(F.transform(firsts, lambda x: F.struct(x["n"].alias("n"), x["m"].alias("m"), x["i"].alias("i"))))


def _contexts(rule: Column, numbered: Column, keep: Callable[[Column], Column], clean: Callable[[Column], Column], width: int) -> Column:
    """(n, m, context) of the first of equal matches each, in time in proportion to the text.

    A match's own place is where its text occurs first, unless the text occurs
    elsewhere, too: then its end stands at a place that is no match's end, or
    it is the end of the text up to another match.  Only such matches, and
    very short ones, are searched for in the text.
    """
    def searched(cut: Column) -> Column:
        placed = F.transform(numbered, lambda x: F.struct(
            x["n"].alias("n"), x["m"].alias("m"), x["i"].alias("i"), _around(cut, x["i"], x["m"], width).alias("around")))
        ends = F.array_intersect(_other_ends(cut, F.transform(rule["found"], clean), keep), F.transform(numbered, lambda x: F.right(x["m"], F.lit(_END))))
        return let(placed, lambda p: let(F.struct(ends.alias("ends"), _doubtful(p).alias("doubtful")), lambda known: F.transform(
            _firsts(numbered), lambda x: F.struct(x["n"].alias("n"), x["m"].alias("m"), F.when(
                (F.length(x["m"]) < _END) | F.array_contains(known["ends"], F.right(x["m"], F.lit(_END))) | F.array_contains(known["doubtful"], x["m"]),
                context_window(F.col(TEXT), x["m"], width)).otherwise(
                    _snippet(x["m"], F.get(p, x["n"])["around"], width)).alias("context")))))

    return let(_sections(rule, max(width, _NEAR) + 1), searched)


def per_placed_rule(
    rules: Column,
    width: int,
    keep: Callable[[Column, Column], Column],
    make: Callable[[Column, Column, Column, Column], Column],
    clean: Callable[[Column], Column] = lambda m: m,
) -> Column:
    """Hits of every rule of ``placed_matches``, each with the text around the first place where its match occurs.

    ``clean`` trims a match, ``keep`` chooses among them, ``make`` gets rule,
    match, number and context.  Equal matches of a rule give one hit.  A few
    matches are looked up in the text one after the other; from many on the
    text is cut at all of them at once, with the same results.
    """
    def hits(rule: Column) -> Column:
        cleaned = F.filter(F.transform(rule["found"], lambda m, i: F.struct(clean(m).alias("m"), i.alias("i"))), lambda x: keep(rule, x["m"]))
        numbered = F.transform(cleaned, lambda x, n: F.struct(n.alias("n"), x["m"].alias("m"), x["i"].alias("i")))

        def made(kept: Column) -> Column:
            one_by_one = F.transform(_firsts(kept), lambda x: F.struct(
                x["n"].alias("n"), x["m"].alias("m"), context_window(F.col(TEXT), x["m"], width).alias("context")))
            found = F.when(F.size(kept) <= _FEW, one_by_one).otherwise(_contexts(rule, kept, lambda m: keep(rule, m), clean, width))
            return F.when(F.size(kept) > 0, F.transform(found, lambda x: make(rule, x["m"], x["n"], x["context"]))).otherwise(no_hits())

        return let(numbered, made)

    return F.flatten(F.transform(rules, hits))


def first_rule(rules: Sequence[Rule], flags: str = "") -> Column:
    """Rank of the first rule that occurs in the text, null without one."""
    return F.expr("CASE " + " ".join(
        f"WHEN {TEXT} RLIKE {literal(rule.java(flags))} THEN {rank}" for rank, rule in enumerate(rules)) + " END")


def literal_map(table: dict) -> Column:
    """A constant map; looked up in place of a join with a tiny table."""
    def value(v) -> str:
        return literal(v) if isinstance(v, str) else f"{v}D" if isinstance(v, float) else str(v)

    return F.expr("map(" + ", ".join(f"{value(k)}, {value(v)}" for k, v in table.items()) + ")")


def hit(
    module: str,
    title: Column,
    evidence: Column,
    tags: Column,
    source_pos: Column | None = None,
    section: int = 0,
    rank: Column | None = None,
    pos: Column | None = None,
    rule_id: Column | str = "",
    tier: Column | str = "",
    description: Column | str = "",
    url: Column | None = None,
    with_status: bool = True,
    kind: Column | str = "finding",
) -> Column:
    """One reported match; position, URL and status default to the row's."""
    def col(value: Column | str | None, default: str) -> Column:
        if isinstance(value, Column):
            return value
        return F.expr(default if value is None else literal(value))

    return F.struct(
        col(kind, ""), F.expr(literal(module)), col(source_pos, "source_pos"), F.expr(str(section)),
        col(rank, "0"), col(pos, "0"), col(rule_id, ""), col(tier, ""),
        title, evidence, col(description, ""), col(url, "url"),
        F.expr("status" if with_status else "cast(null as int)"), tags,
    ).cast(HIT)


def one_hit(hit_column: Column) -> Column:
    """A generator for a single hit; as a plain column its fields would each
    evaluate the whole struct again once projections are merged."""
    return F.explode(F.array(hit_column)).alias("hit")


def gated(condition: Column, hits: Column) -> Column:
    """``hits`` where the condition holds, otherwise none; lazily evaluated."""
    return F.when(condition, hits).otherwise(no_hits())


def per_rule(rules: Column, keep: Callable[[Column], Column], make: Callable[[Column, Column, Column], Column]) -> Column:
    """Hits of every rule: ``keep`` filters its matches, ``make`` builds hits."""
    return F.flatten(F.transform(rules, lambda r: F.transform(keep(r), lambda m, i: make(r, m, i))))


def one_of(name: str, values: Sequence[str]) -> Column:
    """The column has one of many constant values; false for null."""
    return F.expr(f"coalesce({name} IN ({', '.join(literal(v) for v in dict.fromkeys(values))}), false)")


def whole_body(statuses: Sequence[int] | None = None) -> Column:
    """The row is a non-empty response body with one of the statuses."""
    status = f" AND status IN ({', '.join(map(str, statuses))})" if statuses else ""
    return F.expr(f"unit = 'body' AND length({TEXT}) > 0{status}")


def body_units(responses: DataFrame, also: Sequence[str] = ()) -> DataFrame:
    """Every response as one unit; columns named in ``also`` stay."""
    return responses.select(
        "target", F.col("url").alias("origin"), "fetched_at", F.lit("body").alias("unit"), "url", "status",
        F.lit(0).alias("source_pos"), F.col("body").alias(TEXT), *also,
    )


def with_views(units: DataFrame) -> DataFrame:
    """Add what rules share, computed once: lower-cased text, flags, path."""
    folds = " OR ".join(f"contains({TEXT}, '{c}')" for c in FOLDING)
    rows = units.withColumns({
        LOWER: F.lower(TEXT),
        FOLDS: F.expr(f"coalesce({folds}, false)"),
        PATH: path_of(F.col("url"), F.col("target")),
    })
    return rows.withColumns({
        f"_{name}": F.expr(f"coalesce({LOWER} RLIKE {literal(pattern)}, false)") for name, pattern in GATES.items()
    })


def explode_hits(units: DataFrame, detectors: Sequence[Detector], shared: dict[str, Column] | None = None) -> DataFrame:
    """(target, origin, fetched_at, hit) rows of all detectors in one pass.

    ``shared`` names arrays that several detectors use.
    """
    arrays = [detector() for detector in detectors]
    rows = with_views(units)
    if shared:
        rows = rows.withColumns(shared)
    # the array goes straight into explode: as a named column it would be
    # computed a second time by a filter that the optimizer infers
    return rows.select(
        "target", "origin", "fetched_at",
        F.explode(F.concat(*arrays) if len(arrays) > 1 else arrays[0]).alias("hit"),
    )


def module_rank(module: Column) -> Column:
    return F.array_position(F.expr("array(" + ", ".join(literal(m) for m in MODULES) + ")"), module).cast("int")


def as_raw(hits: DataFrame) -> DataFrame:
    """Unpack hit structs into raw findings with their emission order."""
    return hits.select(
        "target", "hit.module", "hit.title", "hit.evidence", "hit.url", "hit.status", "hit.description", "hit.tags",
        "hit.rule_id", "hit.rule_severity", F.col("fetched_at").alias("timestamp"),
        F.struct(
            module_rank(F.col("hit.module")).alias("module_rank"),
            "origin", "hit.source_pos", "hit.section", "hit.rule_rank", "hit.match_pos",
        ).alias("emit_seq"),
    )


def run(responses: DataFrame, *detectors: Detector) -> DataFrame:
    """Raw findings of body detectors."""
    return as_raw(explode_hits(body_units(responses), detectors))
