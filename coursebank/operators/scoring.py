"""The three gates as table jobs: feasibility of sections, acceptance of replies, quality of pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coursebank import lexicons as lx
from coursebank.functions import replies as rp
from coursebank.functions import scoring as sc
from coursebank.functions import text as tx
from coursebank.operators.structure import DEFAULT_CHAPTER, computed_once, explode_chapters, explode_sections
from coursebank.session import written

c = F.col


def _lookup(level: Column, values: dict) -> Column:
    return sc.by_level(level, {k: F.lit(v) for k, v in values.items()})


def _has(df: DataFrame, name: str, kind: str) -> Column:
    """Column ``name``, or NULL of type ``kind`` where the table has none."""
    return c(name) if name in df.columns else F.lit(None).cast(kind)


GATE_FEATURES = ("n_chars", "n_words", "n_analytic", "n_basic", "clo_norm", "clo_fit")


def gate_features(sections: DataFrame, lead_chars: int | None = None) -> DataFrame:
    """What the gate needs of a section whatever the level: computed before levels are multiplied out.

    ``clo_match`` (the section's outcome score) is used where present, else plain term overlap,
    of the first ``lead_chars`` characters where given. ``word_count`` is the content's, as the splitter counts it, and
    counted here where absent.
    """
    clo = F.nullif(F.substring(F.trim(_has(sections, "clo", "string")), 1, 2000), F.lit(""))
    df = sections.withColumns({
        "_low": F.lower("content"), "clo_norm": clo, "n_chars": F.length(tx.strip(c("content"))),
        "n_words": F.coalesce(_has(sections, "word_count", "int"), tx.word_count(c("content")))})
    own = sc.clo_overlap(F.concat(c("title"), F.lit("\n"), tx.lead(c("content"), lead_chars)), c("clo_norm"))
    return df.withColumns({
        "n_analytic": tx.hits(c("_low"), lx.ANALYTIC_SIGNALS), "n_basic": tx.hits(c("_low"), lx.BASIC_SIGNALS),
        "clo_fit": F.when(c("clo_norm").isNotNull(), F.coalesce(_has(sections, "clo_match", "double"), own))}).drop("_low")


def feasibility(candidates: DataFrame) -> DataFrame:
    """Can a section carry a question of the wanted level?

    Input: level, ceiling, chapter_chars, chapter_words, and either content and title or the columns of
    ``gate_features``; optional clo and clo_verdict (an outside verdict, pass if absent).
    Adds decision, quality and reasons.
    """
    keep = [x for x in candidates.columns if x not in GATE_FEATURES]
    df = candidates if "n_chars" in candidates.columns else gate_features(candidates)
    df = df.withColumns({
        "_n": c("n_chars"), "_w": c("n_words"), "_clo": c("clo_norm"), "_match": c("clo_fit"),
        "_analytic": c("n_analytic"), "_basic": c("n_basic"),
        "_verdict": F.coalesce(_has(candidates, "clo_verdict", "boolean"), F.lit(True))})
    relief = (c("level") >= 5) & (c("chapter_chars") >= 2500)
    df = df.withColumns({
        "_len": F.when(relief, F.greatest("_n", F.least(F.floor(c("chapter_chars") / 12), F.lit(800)))).otherwise(c("_n")).cast("int"),
        "_words": F.when(relief, F.greatest("_w", F.floor(c("chapter_words") / 15))).otherwise(c("_w")).cast("int"),
        "_short": c("_n") <= 300,
    })
    df = df.withColumns({
        "_min": F.when(c("_short"), F.lit(40)).otherwise(_lookup(c("level"), lx.MIN_CHARS)),
        "_minw": F.when(c("_short"), F.lit(10)).otherwise(_lookup(c("level"), lx.MIN_WORDS)),
        "_eff": sc.effective_ceiling(c("ceiling"), c("level"), c("_n"))})
    text = lambda x: x.cast("string")
    too_short, too_few = c("_len") < c("_min"), (c("_len") >= c("_min")) & (c("_words") < c("_minw"))
    df = df.withColumn("_fit", ~too_short & ~too_few)
    high = c("level") >= 4
    q0 = (
        F.when(too_short, 0.2).when(too_few, 0.3)
        .when(high & (c("_analytic") >= 2), 0.85).when(high & (c("_analytic") >= 1), 0.70).when(high, 0.55)
        .otherwise(F.least(F.lit(0.90), F.lit(0.65) + c("_basic") * 0.04))
    )
    r0 = (
        F.when(too_short, F.concat(F.lit("content_too_short("), text(c("_len")), F.lit("<"), text(c("_min")), F.lit(")")))
        .when(too_few, F.concat(F.lit("word_count_too_low("), text(c("_words")), F.lit(")")))
        .when(high & (c("_analytic") >= 2), "rich_analytical_content")
        .when(high & (c("_analytic") >= 1), "moderate_analytical_content").when(high, "limited_analytical_signals")
    )
    # format_number rounds the binary value, as the printed logs do; format_string rounds its decimal text.
    match = F.concat(F.lit("("), F.format_number("_match", 2), F.lit(")"))
    asked = c("_fit") & c("_clo").isNotNull()
    off_topic, unsure = asked & (c("_match") < 0.08), asked & (c("_match") >= 0.08) & (c("_match") < 0.38)
    r1 = (
        F.when(off_topic, F.concat(F.lit("fail_learning_outcome_low_overlap"), match))
        .when(unsure & ~c("_verdict"), "fail_learning_outcome(section_mismatch)")
        .when(asked & (c("_match") >= 0.38), F.concat(F.lit("lo_high_overlap"), match))
    )
    df = df.withColumns({"_q0": q0, "_r0": r0, "_r1": r1})
    failed1 = F.coalesce(c("_r1").startswith("fail"), F.lit(False))
    df = df.withColumns({
        "_ok1": c("_fit") & ~failed1,
        "_q1": F.when(off_topic, F.least("_q0", F.lit(0.20))).when(failed1, F.least("_q0", F.lit(0.25))).otherwise(c("_q0"))})
    ceil, level, eff = c("ceiling"), c("level"), c("_eff")
    case = (
        F.when(~c("_ok1") | ceil.isNull(), "none")
        .when(c("_short") & (level <= 2), F.when(ceil != level, "short_exact_mismatch").otherwise("short_exact_match"))
        .when(c("_short") & level.isin(3, 4), F.when(level > eff, "short_ceiling").otherwise("short_b34_ok"))
        .when(level > eff, "semantic_ceiling").when(level == eff, "semantic_ceiling_match").otherwise("semantic_ceiling_above")
    )
    df = df.withColumn("_case", case)
    kind = c("_case")
    s_ceil, s_eff, s_lv = text(ceil), text(eff), text(level)
    r2 = (
        F.when(kind == "short_exact_mismatch", F.concat(F.lit("short_exact_mismatch(exact="), s_ceil, F.lit("!=target="), s_lv, F.lit(")")))
        .when(kind == "short_exact_match", F.concat(F.lit("short_exact_match(exact="), s_ceil, F.lit("=target="), s_lv, F.lit(")")))
        .when(kind == "short_ceiling", F.concat(F.lit("short_ceiling("), s_ceil, F.lit(",eff="), s_eff, F.lit(")<target("), s_lv, F.lit(")")))
        .when(kind == "short_b34_ok", F.concat(F.lit("short_b34_ok(ceiling="), s_ceil, F.lit(",eff="), s_eff, F.lit(")")))
        .when(kind == "semantic_ceiling", F.concat(F.lit("semantic_ceiling("), s_ceil, F.lit(")<target("), s_lv, F.lit(")")))
        .when(kind == "semantic_ceiling_match", F.concat(F.lit("semantic_ceiling_match("), s_ceil, F.lit(",eff="), s_eff, F.lit(")")))
        .when(kind == "semantic_ceiling_above", F.concat(F.lit("semantic_ceiling_above("), s_ceil, F.lit(">="), s_lv, F.lit(",eff="), s_eff, F.lit(")")))
    )
    q2 = (
        F.when(kind == "short_exact_mismatch", F.least("_q1", F.lit(0.25)))
        .when(kind.isin("short_ceiling", "semantic_ceiling"), F.least("_q1", F.lit(0.30)))
        .when(kind.isin("short_exact_match", "semantic_ceiling_match"), F.least(F.lit(1.0), c("_q1") + 0.05))
        .otherwise(c("_q1"))
    )
    ok = c("_ok1") & ~kind.isin("short_exact_mismatch", "short_ceiling", "semantic_ceiling")
    return computed_once(df, keep, {
        "decision": F.when(ok, "pass").otherwise("fail"), "quality": F.round(q2, 4),
        "reasons": F.array_compact(F.array(c("_r0"), c("_r1"), r2))})


def score_pairs(qa: DataFrame, outcome: bool = False, aspect_chars: int | None = None) -> DataFrame:
    """All measures of question-answer pairs; with ``outcome`` also the verdict on the learning outcome.

    Input: level, question, answer, source; optional title and clo. Instead of ``source`` a row may carry ``features``
    (see ``read_sources``). Texts are tokenised once and the token arrays dropped again, so a row stays as wide as its scores.
    """
    keep = [x for x in qa.columns if x != "features"]
    df = qa if "features" in qa.columns else qa.withColumn("features", sc.source_features(c("source"), aspect_chars))
    df = df.withColumns({
        "_q": F.lower("question"), "_a": F.lower("answer"), "_points": rp.answer_points(c("answer")),
        "_a3": sc.content_tokens(c("answer"), 3)})
    empty = c("features.empty")
    level = c("level")
    df = df.withColumns({
        "n_points": F.size("_points"),
        "question_overlap": F.round(tx.bind(sc.content_tokens(c("question")), lambda q: sc.set_share(q, c("features.words"))), 4),
        "ngram_score": sc.ngram_share(sc.content_tokens(tx.normalise_math(c("answer"))), c("features.tokens")),
        "concept_score": F.when((c("answer") == "") | empty, F.lit(0.0)).otherwise(
            sc.concept_share(c("_a3"), c("features.terms"))),
        "anchor": F.when(empty, F.lit(0.0)).otherwise(sc.anchor_share(c("_points"), c("features.anchors"))),
        "tautology": sc.tautology(c("_points")), "point_overlap": sc.max_point_overlap(c("_points")),
        "verb": sc.verb_score(c("_q"), level), "_rule": sc.question_rule(c("_q"), level),
        "scenario": F.when(level == 3, sc.scenario_score(c("_q"))).otherwise(F.lit(1.0)),
        "_step": sc.step_answer_rule(c("_a"), c("_points")), "action": sc.action_score(c("_points")),
        "creative": F.when((level == 6) & ~tx.any_hit(c("_a"), lx.CREATIVE_VERBS), F.lit(0.25)).otherwise(F.lit(1.0)),
    })
    weight = sc.by_level(level, {1: F.lit(0.92), 2: F.lit(0.92), 3: F.lit(0.90), 4: F.lit(0.95)})
    blended = F.round(F.greatest("ngram_score", c("concept_score") * weight), 4)
    names = ("n_points", "question_overlap", "ngram_score", "concept_score", "anchor", "tautology", "point_overlap",
             "verb", "scenario", "action", "creative")
    made = {name: c(name) for name in names} | {
        "groundedness": F.when(level >= 5, c("concept_score")).otherwise(blended),
        "key_terms": F.when(level <= 3, c("concept_score")).otherwise(F.lit(1.0)),
        "diversity": sc.diversity(c("point_overlap"), c("n_points")),
        "question_ok": c("_rule.ok"), "question_score": c("_rule.score"), "question_reason": c("_rule.reason"),
        "step_ok": c("_step.ok"), "step_reason": c("_step.reason"),
        "template": sc.is_template(c("_a"), c("_step.ok"), c("anchor"), level, ~empty),
    }
    if outcome:
        made["aspects"] = F.when(_no_outcome(qa), F.lit("ok")).otherwise(sc.aspect_verdict(sc.aspect_gap(
            c("question"), c("answer"), c("clo"), _has(qa, "title", "string"), F.lit(""), level, shown=c("features.shown")), level))
        made["source_chars"] = c("features.chars")
    return computed_once(df, keep, made) if outcome else df.select(*keep, *[v.alias(k) for k, v in made.items()])


def _no_outcome(df: DataFrame) -> Column:
    clo = _has(df, "clo", "string")
    return clo.isNull() | (F.trim(clo) == "")


def read_sources(pairs: DataFrame, sections: DataFrame) -> DataFrame:
    """``pairs`` (doc_id, section_pos, level, ...) with the ``features`` and ``title`` of the source that their level is judged by.

    Levels 3 and 4 are judged by the pair's own section, the others by the whole chapter it stands in. ``sections`` has
    doc_id and an array ``sections`` (see ``structure.sectioned``). Only the sources that some pair needs are read, each once,
    however many pairs share it. A pair without such a section has an empty source.
    """
    parts = explode_sections(sections).select(
        "doc_id", c("pos").alias("section_pos"), F.coalesce("chapter", F.lit(DEFAULT_CHAPTER)).alias("chapter"), "title", "content")
    named = pairs.drop("title", "source").join(parts.drop("content"), ["doc_id", "section_pos"], "left")
    own = c("level").isin(3, 4)
    named = named.withColumns({"at": F.when(own, c("section_pos")), "of": F.when(~own, c("chapter"))})
    wanted = named.select("doc_id", "at", "of").distinct()
    near = parts.join(wanted.where("at IS NOT NULL").select("doc_id", c("at").alias("section_pos")), ["doc_id", "section_pos"], "left_semi")
    wide = explode_chapters(sections).join(wanted.where("of IS NOT NULL").select("doc_id", c("of").alias("chapter")), ["doc_id", "chapter"], "left_semi")
    both = near.select("doc_id", c("section_pos").cast("int").alias("at"), F.lit(None).cast("string").alias("of"), "content").unionByName(
        wide.select("doc_id", F.lit(None).cast("int").alias("at"), c("chapter").alias("of"), "content"))
    read = computed_once(both, ["doc_id", "at", "of"], {"features": sc.source_features(c("content"))})
    # One key for both kinds, so that one join serves them.
    key = lambda: F.coalesce(F.concat(F.lit("#"), c("at").cast("string")), F.concat(F.lit("="), c("of")))
    read = read.select("doc_id", key().alias("source_key"), "features")
    rows = named.withColumn("source_key", key()).drop("at", "of").join(read, ["doc_id", "source_key"], "left")
    return rows.withColumns({"features": F.coalesce("features", sc.source_features(F.lit(""))), "title": F.coalesce("title", F.lit(""))}).drop("source_key", "chapter")


def judged_replies(replies: DataFrame, sections: DataFrame, aspect_chars: int | None = None) -> DataFrame:
    """Verdict of each reply (doc_id, section_pos, level, attempt, raw, required_points, clo) by both later gates.

    A reply is first read and tested against its section; a usable one is then scored against the source of its level.
    Adds ``passed`` and ``why`` (the first reason of either gate).
    """
    texts = explode_sections(sections).select("doc_id", c("pos").alias("section_pos"), "title", c("content").alias("source"))
    known = replies.join(texts, ["doc_id", "section_pos"], "left").withColumns(
        {"title": F.coalesce("title", F.lit("")), "source": F.coalesce("source", F.lit(""))})
    key = ["doc_id", "section_pos", "level", "attempt"]
    # Read for the sources that are wanted, for the scores and for the result: the first gate runs once.
    read = written(accept_replies(known, aspect_chars).select(*key, "clo", "question", "answer", "accepted", "reject_reason"), "read")
    scored = evaluate_qa(read_sources(read.where("accepted").drop("accepted", "reject_reason"), sections), aspect_chars)
    scored = scored.select(*key, (c("decision") == "pass").alias("good"), "fail_reason")
    rows = read.join(scored, key, "left")
    return rows.select(*key, F.coalesce("good", F.lit(False)).alias("passed"), F.coalesce("reject_reason", "fail_reason").alias("why"))


def evaluate_qa(qa: DataFrame, aspect_chars: int | None = None) -> DataFrame:
    """Decision, quality and first failed rule of each pair (see ``score_pairs`` for the input)."""
    qa = qa if "clo" in qa.columns else qa.withColumn("clo", F.lit(None).cast("string"))
    df = score_pairs(qa, outcome=True, aspect_chars=aspect_chars)
    keep = [x for x in df.columns if x not in ("aspects", "source_chars")]
    level = c("level")
    verdict = F.coalesce(_has(qa, "clo_verdict", "boolean"), F.lit(True))
    floor = F.when((level >= 5) & (c("source_chars") <= 300), F.lit(0.05)).otherwise(_lookup(level, lx.HARD_FLOORS))
    df = df.withColumn("_floor", floor)
    one = lambda n: level == n
    ground, terms, taut = c("groundedness"), c("key_terms"), c("tautology")
    level3_low = F.least("scenario", taut, ground, terms, "question_overlap")
    level3_bad = ((c("scenario") < 0.22) | (taut < 0.28) | (ground < 0.22) | (terms < 0.15) | (c("question_overlap") < 0.18))
    limits = lambda a, b, d, e: sc.by_level(
        level, {1: F.lit(a), 2: F.lit(a), 3: F.lit(b), 4: F.lit(d), 5: F.lit(e), 6: F.lit(e)})
    alike = ((c("point_overlap") >= limits(0.62, 0.74, 0.76, 0.78)) & (c("diversity") < limits(0.24, 0.14, 0.12, 0.10)))
    rules = (
        ((level <= 3) & ~c("question_ok"), "question_off_level", c("question_score")),
        (c("template"), "template_answer", F.lit(0.12)),
        (one(2) & (c("anchor") < 0.38), "few_source_terms", c("anchor")),
        (one(3) & (c("anchor") < 0.22), "few_source_terms", c("anchor")),
        (one(3) & (c("action") < 0.15), "no_action", c("action")),
        (one(3) & ~c("step_ok"), "answer_rule", F.lit(0.10)),
        (one(1) & (terms < 0.38), "few_key_terms", terms),
        (one(2) & (terms < 0.28), "few_key_terms", terms),
        (ground < c("_floor"), "not_grounded", ground),
        (one(1) & (taut < 0.78), "tautological", taut),
        (one(2) & (taut < 0.62), "tautological", taut),
        (one(3) & level3_bad, "level3_floor", level3_low),
        (alike, "points_alike", F.least(c("diversity"), 1.0 - c("point_overlap"))),
        (c("aspects") != "ok", "outcome_missed", F.lit(0.12)),
        (~verdict, "outcome_verdict", F.lit(0.15)),
    )
    reason, low = F.when(rules[0][0], rules[0][1]), F.when(rules[0][0], rules[0][2])
    for cond, name, value in rules[1:]:
        reason, low = reason.when(cond, name), low.when(cond, value)
    q, d, v = c("question_overlap"), c("diversity"), c("verb")
    quality = sc.by_level(level, {
        6: q * 0.18 + ground * 0.23 + v * 0.27 + c("creative") * 0.22 + d * 0.10,
        5: q * 0.22 + ground * 0.36 + v * 0.32 + d * 0.10,
        4: q * 0.22 + ground * 0.50 + v * 0.18 + d * 0.10,
        3: ground * 0.36 + terms * 0.18 + q * 0.13 + c("scenario") * 0.10 + taut * 0.08 + d * 0.10 + v * 0.05,
    }, ground * 0.38 + taut * 0.28 + terms * 0.14 + q * 0.10 + d * 0.05 + v * 0.05)
    threshold = F.when(level <= 2, 0.52).when(level <= 4, 0.44).otherwise(0.45)
    df = df.withColumns({"_reason": reason, "quality": F.round(
        F.coalesce(low, F.greatest(F.lit(0.0), F.least(F.lit(1.0), quality))), 4)})
    passed = c("_reason").isNull() & (c("quality") >= threshold)
    return df.select(
        *keep, "quality", F.when(passed, "pass").otherwise("fail").alias("decision"),
        F.when(c("_reason").isNull() & ~passed, "below_threshold").otherwise(c("_reason")).alias("fail_reason"))


def accept_replies(replies: DataFrame, aspect_chars: int | None = None) -> DataFrame:
    """Generated replies to usable pairs, with the first reason of rejection.

    Input: raw, level, source, required_points; optional title and clo.
    """
    keep = replies.columns
    df = replies.withColumn("_r", rp.read_reply(c("raw")))
    df = df.withColumns({"question": c("_r.question"), "_cut": rp.enforce_points(c("_r.answer"), c("required_points"))})
    df = df.withColumn("answer", rp.clean_answer(c("_cut.answer")))
    df = df.withColumns({
        "_points": rp.answer_points(c("answer")), "_a": F.lower("answer"), "_q": F.lower("question")})
    level = c("level")
    df = df.withColumns({
        "anchor": sc.anchor_ratio(c("_points"), c("source")), "_step": sc.step_answer_rule(c("_a"), c("_points")),
        "tautology": sc.tautology(c("_points")), "action": sc.action_score(c("_points")),
        "_rule": sc.question_rule(c("_q"), level),
        "_aspects": F.when(_no_outcome(replies), F.lit("ok")).otherwise(sc.aspect_verdict(sc.aspect_gap(
            c("question"), c("answer"), _has(replies, "clo", "string"), _has(replies, "title", "string"), c("source"), level,
            aspect_chars), level))})
    reason = (
        F.when(c("question").isNull() | c("_r.answer").isNull(), "unreadable")
        .when(c("_cut.short"), "too_few_points")
        .when(c("_aspects") != "ok", "outcome_missed")
        .when((level <= 2) & (c("tautology") < 0.65), "tautological")
        .when(sc.is_template(c("_a"), c("_step.ok"), c("anchor"), level, c("source") != ""), "template_answer")
        .when((level == 2) & (c("anchor") < 0.42), "few_source_terms")
        .when((level == 3) & (c("anchor") < 0.26), "few_source_terms")
        .when((level <= 3) & ~c("_rule.ok"), "question_off_level")
        .when((level == 3) & (c("action") < 0.20), "no_action")
    )
    out = computed_once(df, [*keep, "question", "answer"], {"reject_reason": reason})
    return out.withColumn("accepted", c("reject_reason").isNull())


def reject_report(accepted: DataFrame) -> DataFrame:
    return accepted.groupBy("level", F.coalesce("reject_reason", F.lit("accepted")).alias("outcome")).agg(F.count("*").alias("n"))
