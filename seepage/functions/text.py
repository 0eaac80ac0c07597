"""Text helpers on columns; every one stays inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# What str.strip() removes: Unicode white space and the four separators.
_SPACE = r"[\s\x1c-\x1f]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it several times in ``body``."""
    return F.transform(F.array(value), body)[0]


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?U)^{_SPACE}++|(?<!{_SPACE}){_SPACE}++\z", "")


def context_window(body: Column, match: Column, width: int) -> Column:
    """First place of ``match`` in ``body`` with ``width`` characters around it."""

    def cut(at: Column) -> Column:
        first = F.greatest(at - 1 - width, F.lit(0))
        # one character more than is shown tells whether the text goes on
        seen = F.substring(body, first + 1, at - 1 - first + F.length(match) + width + 1)
        shown = at - 1 - first + F.length(match) + width
        return let(seen, lambda s: F.when(at > 0, F.concat(
            F.when(first > 0, "... ").otherwise(""),
            F.when(F.length(s) > shown, F.concat(F.left(s, shown), F.lit(" ..."))).otherwise(s),
        )).otherwise(match))

    return let(F.position(match, body), cut)


def line_context(lines: Column, flagged: Callable[[Column], Column], around: int, snippets: int | None = None) -> Column:
    """Flagged lines with their neighbours, the first ``snippets`` of them; '' when no line is flagged."""
    places = F.filter(F.transform(lines, lambda line, i: F.when(flagged(line), i).otherwise(-1)), lambda i: i >= 0)

    def snippet(i: Column) -> Column:
        first = F.greatest(i - around, F.lit(0))
        return F.array_join(F.slice(lines, first + 1, F.least(F.size(lines), i + around + 1) - first), "\n")

    return F.array_join(F.transform(F.slice(places, 1, snippets) if snippets else places, snippet), "\n...\n")


def slug(text: Column) -> Column:
    return F.lower(F.translate(text, "_/.", "---"))


def html_escape(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def truncate(text: Column, chars: int | None) -> Column:
    """The first ``chars`` characters; the whole text without a limit."""
    whole = F.coalesce(text, F.lit(""))
    return whole if chars is None else F.left(whole, F.lit(chars))


def short(text: Column, chars: int) -> Column:
    """A text for titles: a longer one is cut and marked with its hash, so that different texts stay different."""
    marked = F.concat(F.left(text, F.lit(chars)), F.lit(" #"), F.left(F.sha2(text.cast("binary"), 256), F.lit(16)))
    return F.when(F.length(text) > chars, marked).otherwise(text)
