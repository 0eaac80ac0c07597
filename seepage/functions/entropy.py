"""Entropy measures of short strings, without user-defined functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from seepage.functions.text import let
from seepage.rules import java_pattern
from seepage.rules.secrets import BASE64_SHAPE, HEX_SHAPE, MIN_ENTROPY, MIN_LENGTH


def _characters(text: Column) -> Column:
    # a dot takes a whole code point, also outside the basic plane
    return F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))


def shannon_entropy(text: Column) -> Column:
    """Bits per character; 0 for the empty string."""
    size = F.length(text)
    shares = F.transform(
        F.array_distinct(_characters(text)),
        lambda c: (size - F.length(F.replace(text, c, F.lit("")))) / size,
    )
    return F.aggregate(shares, F.lit(0.0), lambda total, p: total - p * F.log2(p))


def is_high_entropy(text: Column, threshold: float | None = None) -> Column:
    # ten digits, so that a value on the threshold does not depend on the logarithm's last bit
    return F.round(shannon_entropy(text), 10) >= F.lit(float(threshold or MIN_ENTROPY))


def charset_ratio(text: Column) -> Column:
    """Distinct characters per character; 0 for the empty string."""
    return F.when(F.length(text) == 0, 0.0).otherwise(F.size(F.array_distinct(_characters(text))) / F.length(text))


def is_likely_secret(text: Column) -> Column:
    """struct(flag, entropy)."""
    return let(
        shannon_entropy(text),
        lambda e: F.struct(
            ((F.length(text) >= MIN_LENGTH) & (F.round(e, 10) >= MIN_ENTROPY)).alias("flag"), e.alias("entropy")
        ),
    )


def classify_string(text: Column) -> Column:
    def label(e: Column) -> Column:
        return (
            F.when(F.length(text) == 0, "empty")
            .when((e > 4.0) & text.rlike(java_pattern(BASE64_SHAPE)), "high_entropy_base64")
            .when((F.length(text) >= 16) & (e > 3.0) & text.rlike(java_pattern(HEX_SHAPE)), "high_entropy_hex")
            .when(e > 4.5, "high_entropy")
            .when(e > MIN_ENTROPY, "medium_entropy")
            .otherwise("low_entropy")
        )

    return let(F.round(shannon_entropy(text), 10), label)
