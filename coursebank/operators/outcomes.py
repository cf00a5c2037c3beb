"""Learning outcomes against the sections of their documents: ranked matches, covered aspects and gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from coursebank import lexicons as lx
from coursebank.functions import scoring as sc
from coursebank.functions import text as tx
from coursebank.operators.structure import computed_once

ASPECTS = tuple(lx.CLO_ASPECTS)
SKILLS = sum(1 << i for i, name in enumerate(ASPECTS) if name in lx.SKILL_ASPECTS)


def aspect_mask(text: Column, which: int) -> Column:
    """Aspects that a lowercased text asks for (``which`` 0) or shows (1), one bit each in the order of ASPECTS."""
    bits = [F.when(tx.any_hit(text, lx.CLO_ASPECTS[name][which]), F.lit(1 << i)).otherwise(F.lit(0)) for i, name in enumerate(ASPECTS)]
    return sum(bits[1:], bits[0]).cast("long")


def aspect_names(mask: Column) -> Column:
    """Names of the bits of a mask, in order."""
    return F.array_compact(F.array(*[F.when(mask.bitwiseAND(F.lit(1 << i)) != 0, F.lit(name)) for i, name in enumerate(ASPECTS)]))


def outcome_scores(sections: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Every section of a document against each of its outcomes: doc_id, outcome_id, pos, asked, shown, score.

    ``sections``: doc_id, pos, title, content. ``outcomes``: doc_id, outcome_id, clo. A section's terms and aspects are read
    once, however many outcomes its document has, and no text is joined. ``asked`` and ``shown`` are bit masks. Null texts
    count as empty; a blank outcome asks for nothing and matches nothing.
    """
    text = lambda name: F.coalesce(F.col(name), F.lit(""))
    shown = aspect_mask(F.lower(F.concat(text("title"), F.lit("\n"), text("content"))), 1)
    left = computed_once(sections, ["doc_id", "pos"], {"section": sc.section_features(text("title"), text("content")), "shown": shown})
    clo = text("clo")
    right = computed_once(outcomes, ["doc_id", "outcome_id"], {
        "outcome": sc.outcome_features(clo), "asked": aspect_mask(F.lower(clo), 0), "blank": F.trim(clo) == ""})
    rows = left.join(right, "doc_id")
    score = F.when(F.col("blank"), F.lit(0.0)).otherwise(sc.match_score(F.col("section"), F.col("outcome")))
    return computed_once(rows, ["doc_id", "outcome_id", "pos", "asked", "shown"], {"score": score})


def ranked_matches(scores: DataFrame, min_score: float = 0.06) -> DataFrame:
    """Sections that match an outcome, best first; ties by position."""
    order = W.partitionBy("doc_id", "outcome_id").orderBy(F.desc("score"), "pos")
    return scores.where(F.col("score") >= min_score).select(
        "doc_id", "outcome_id", "pos", "score", F.row_number().over(order).alias("rank"), F.col("asked").bitwiseAND(F.col("shown")).alias("covers"))


def coverage(scores: DataFrame, min_score: float = 0.06) -> DataFrame:
    """What the matching sections of a document cover of each outcome, and what is missing.

    One row per document and outcome: matching sections, best section and score, and as names the aspects asked, covered
    and missing; ``ratio`` is the share of asked aspects covered (1 where none is asked), ``skills_missing`` counts the missing
    ones that are skills. Masks are combined by ``bit_or``, which needs no list of sections.
    """
    fits = F.col("score") >= min_score
    rows = scores.groupBy("doc_id", "outcome_id").agg(
        F.any_value("asked").alias("asked"), F.count_if(fits).alias("n_sections"),
        F.coalesce(F.bit_or(F.when(fits, F.col("shown"))), F.lit(0)).alias("shown"),
        F.min(F.when(fits, F.struct((-F.col("score")).alias("back"), "pos"))).alias("best"))
    covered = F.col("asked").bitwiseAND(F.col("shown"))
    missing = F.col("asked").bitwiseXOR(covered)
    n = F.bit_count("asked")
    return rows.select(
        "doc_id", "outcome_id", "n_sections", F.col("best.pos").alias("best_pos"), (-F.col("best.back")).alias("best_score"),
        aspect_names(F.col("asked")).alias("asked"), aspect_names(covered).alias("covered"), aspect_names(missing).alias("missing"),
        F.when(n > 0, F.round(F.bit_count(covered) / n, 4)).otherwise(F.lit(1.0)).alias("ratio"),
        F.bit_count(missing.bitwiseAND(F.lit(SKILLS))).alias("skills_missing"))
