"""Cognitive-level labels, points and display names as Column functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from coursebank import lexicons as lx


def _by_digit(digit: Column, otherwise: Column) -> Column:
    """Canonical label of a one-character level, else ``otherwise``."""
    out = F.when(digit == "1", F.lit(lx.BLOOM_LABELS[0]))
    for i, label in enumerate(lx.BLOOM_LABELS[1:], 2):
        out = out.when(digit == str(i), F.lit(label))
    return out.otherwise(otherwise)


def normalise_bloom(label: Column) -> Column:
    """Canonical level label: parenthesised form by digit, then first known key, then bare digit."""
    low = F.trim(F.lower(label))
    digit = F.regexp_extract(low, r"bloom\s*(\d)", 1)
    keyed = reduce(
        lambda acc, kv: acc.when(low.contains(kv[0]), F.lit(lx.BLOOM_LABELS[kv[1] - 1])),
        lx.BLOOM_KEYS.items(),
        F.when((label.isNull()) | (label == ""), F.lit(lx.BLOOM_LABELS[0]))
        .when(low.startswith("bloom") & label.contains("("), _by_digit(digit, label)),
    )
    return keyed.when(digit != "", _by_digit(digit, F.lit(lx.BLOOM_LABELS[0]))).otherwise(label)


def bloom_number(label: Column) -> Column:
    """Level number of a ``Bloom d`` label, NULL if it has none."""
    return F.nullif(F.regexp_extract(label, r"Bloom\s*(\d)", 1), F.lit("")).cast("int")


def bloom_code(label: Column) -> Column:
    """``Bloom d …`` -> ``Bd``; other labels unchanged."""
    num = bloom_number(label)
    return F.when(num.isNotNull(), F.concat(F.lit("B"), num.cast("string"))).otherwise(label)


def bloom_short(label: Column) -> Column:
    """``Bloom d (name)`` -> ``Bloom d · name``; empty -> dash."""
    pattern = r"(?i)^Bloom\s*(\d)\s*\((.+)\)\s*$"
    text = F.trim(label)
    return (
        F.when(label.isNull() | (label == ""), F.lit("—"))
        .when(text.rlike(pattern), F.regexp_replace(text, pattern, "Bloom $1 · $2"))
        .otherwise(label)
    )


def points(label: Column, custom: Column | None = None) -> Column:
    """STRUCT(total_points, sub_points_count, points_breakdown) at 0.25 per point."""
    key = F.trim(F.substring_index(label, "(", 1))
    default = F.when(key == "Bloom 1", F.lit(lx.DEFAULT_POINTS[1]))
    for level, value in list(lx.DEFAULT_POINTS.items())[1:]:
        default = default.when(key == f"Bloom {level}", F.lit(value))
    total = default.otherwise(F.lit(1.0))
    if custom is not None:
        total = F.coalesce(F.nullif(custom.cast("double"), F.lit(0.0)), total)
    count = F.floor(total / lx.POINT_VALUE).cast("int")
    parts = F.when(count > 0, F.transform(
        F.sequence(F.lit(1), count), lambda i: F.concat(F.lit("Ý "), i.cast("string"), F.lit(": 0.25đ"))))
    text = F.coalesce(F.array_join(parts, " | "), F.lit(""))
    return F.struct(total.alias("total_points"), count.alias("sub_points_count"), text.alias("points_breakdown"))


def display_name(display: Column, username: Column, email: Column, user_id: Column) -> Column:
    """Display name, else user name, else e-mail prefix, else ``User <id>``; empty counts as missing."""
    blank = F.lit("")
    return F.coalesce(
        F.nullif(display, blank), F.nullif(username, blank),
        F.nullif(F.substring_index(email, "@", 1), blank),
        F.concat(F.lit("User "), user_id.cast("string")),
    )


def clean_text(col: Column, n: int = 2000) -> Column:
    """Strip, cut to ``n`` characters, and turn blank into NULL."""
    return F.nullif(F.substring(F.trim(col), 1, n), F.lit(""))
