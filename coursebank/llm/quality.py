"""Quality rules: a ledger of failure bits and measurements, and the policies applied to it."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coursebank.llm.common import SPACES, bare, words

SYMBOLS = "#*$%&|<>"
CAPITALS = string.ascii_uppercase

# Rule -> condition on the measurements that fails it; the bit of a rule is its place in this list.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 50"),
    ("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "10 * n_symbols > 3 * n_words"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 20 * n_words"),
    ("repeated_lines", "2 * n_dup_lines > n_lines"),
    ("capitals", "2 * n_capitals > word_chars"),
)

# Version -> the rules it applies. Versions are only added, so that old verdicts can be repeated from a ledger.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_words"),
    "v1": tuple(name for name, _ in RULES),
}


def mask(policy: str) -> int:
    """Bits of the rules of a policy."""
    return sum(1 << i for i, (name, _) in enumerate(RULES) if name in POLICIES[policy])


def _repeat_words(w: Column) -> Column:
    """Words covered by three-word windows that occur twice or more (windows compared by 64-bit hash)."""
    grams = F.when(F.size(w) >= 3, F.transform(
        F.sequence(F.lit(0), F.size(w) - 3),
        lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")),
    ))
    return F.sort_array(F.coalesce(grams, F.array().cast("array<struct<h:bigint,i:int>>")))


def ledger(docs: DataFrame) -> DataFrame:
    """Measurements and failure bits of every document, each rule evaluated once.

    Takes ``doc_id`` and ``text``; other columns are ignored. A null text counts as an empty one, which fails
    ``few_words`` only. Repeated rows give repeated rows. Everything is computed inside the row, without a shuffle.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: bare(x) != "")
    a = docs.select("doc_id", text.alias("t"), words(text).alias("w"), lines.alias("l"))
    a = a.select("doc_id", F.size("w").cast("long").alias("n_words"),
                 F.length(F.translate("t", SPACES, "")).cast("long").alias("word_chars"),
                 (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
                 (F.length("t") - F.length(F.translate("t", CAPITALS, ""))).cast("long").alias("n_capitals"),
                 F.size("l").cast("long").alias("n_lines"),
                 (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
                 _repeat_words(F.col("w")).alias("g"))
    g = F.col("g")
    same = F.filter(g, lambda x, k: (x["h"] == F.get(g, k - 1)["h"]) | (x["h"] == F.get(g, k + 1)["h"]))
    keep = [c for c in a.columns if c != "g"]
    a = a.select(*keep, F.sort_array(F.transform(same, lambda x: x["i"])).alias("p"))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last"))
    covered = F.aggregate("p", start, lambda s, p: F.struct(
        (s["n"] + F.least(F.lit(3), p - s["last"])).alias("n"), p.alias("last")), lambda s: s["n"])
    a = a.select(*keep, covered.alias("n_repeat_words"))
    bits = sum((F.when(F.expr(rule), F.lit(1 << i)).otherwise(F.lit(0)) for i, (_, rule) in enumerate(RULES)),
               F.lit(0)).cast("long")
    return a.withColumn("failures", bits)


def apply_policy(rows: DataFrame, policy: str = "v1") -> DataFrame:
    """Add ``base_failed`` and ``kept`` to a ledger; the base rules always hold."""
    hit = lambda name: F.col("failures").bitwiseAND(F.lit(mask(name))) != 0
    return rows.withColumns({"base_failed": hit("base"), "kept": ~hit("base") & ~hit(policy)})


def ablations(rows: DataFrame, policy: str = "v1") -> DataFrame:
    """Per rule of a policy: rows that fail it, and rows that only it rejects (kept again without it).

    One aggregate over the distinct bit patterns, which are at most two to the number of rules.
    """
    seen = rows.select(F.col("failures").bitwiseAND(F.lit(mask(policy))).alias("bits")).groupBy("bits").count()
    names = F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(1 << i).cast("long").alias("bit"))
                      for i, (n, _) in enumerate(RULES) if n in POLICIES[policy]])
    each = seen.select("bits", "count", F.inline(names))
    return each.groupBy("rule").agg(
        F.sum(F.when(F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("count")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("bits") == F.col("bit"), F.col("count")).otherwise(0)).alias("n_only"))
