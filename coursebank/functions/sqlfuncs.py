"""The most used functions for SQL users, as SQL functions of the session (no Python runs per row)."""

from __future__ import annotations

from pyspark.sql import SparkSession

from coursebank import lexicons as lx


def _labels() -> str:
    return "array(" + ", ".join(f"'{x}'" for x in lx.BLOOM_LABELS) + ")"


def _normalise() -> str:
    keyed = " ".join(f"WHEN contains(lower(label), '{k}') THEN '{lx.BLOOM_LABELS[v - 1]}'" for k, v in lx.BLOOM_KEYS.items())
    digit = r"try_cast(regexp_extract(lower(label), 'bloom\\s*([1-6])', 1) AS INT)"
    return (
        f"CASE WHEN label IS NULL OR label = '' THEN '{lx.BLOOM_LABELS[0]}' "
        f"WHEN startswith(trim(lower(label)), 'bloom') AND contains(label, '(') THEN coalesce(try_element_at({_labels()}, {digit}), label) "
        f"{keyed} WHEN lower(label) RLIKE 'bloom\\\\s*\\\\d' THEN coalesce(try_element_at({_labels()}, {digit}), '{lx.BLOOM_LABELS[0]}') "
        "ELSE label END")


SQL_FUNCTIONS = {
    "normalise_bloom(label STRING) RETURNS STRING": _normalise(),
    "bloom_number(label STRING) RETURNS INT": r"try_cast(nullif(regexp_extract(label, 'Bloom\\s*(\\d)', 1), '') AS INT)",
    "order_code(content STRING) RETURNS STRING": r"nullif(regexp_extract(upper(content), 'DH\\s*(\\d+)', 1), '')",
    "word_tokens(body STRING) RETURNS ARRAY<STRING>": r"regexp_extract_all(lower(body), '([\\p{L}\\p{N}_]{2,})', 1)",
    "token_share(a STRING, b STRING) RETURNS DOUBLE": (
        "coalesce(try_divide(size(array_intersect(word_tokens(a), word_tokens(b))), size(array_distinct(word_tokens(a)))), 0.0D)"),
    "default_points(level INT) RETURNS DOUBLE": "CASE WHEN level BETWEEN 1 AND 6 THEN 0.5D + 0.5D * level ELSE 1.0D END",
}


def register(spark: SparkSession) -> list[str]:
    """Create the functions for this session; returns their names."""
    for signature, body in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
    return [s.split("(")[0] for s in SQL_FUNCTIONS]
