"""Queries over question-answer pairs, replies, sections and learning outcomes."""

from __future__ import annotations

from pyspark.sql import functions as F

from coursebank import lexicons as lx
from coursebank.functions import replies as rp
from coursebank.functions import scoring as sc
from coursebank.functions import text as tx
from coursebank.operators import scoring as ops
from coursebank.operators import structure as st
from coursebank.plans import scoring_fixtures as sf
from coursebank.plans import text_fixtures as tf
from coursebank.plans.registry import query
from coursebank.sources.tables import load

c = F.col


def _score_query(name, columns):
    def run(spark, d):
        return ops.score_pairs(sf.qa_pairs(spark, d)).select("pair_id", "level", *columns)

    cast = {"ngram_score", "question_overlap", "concept_score", "verb", "scenario", "creative", "question_score",
            "tautology", "point_overlap", "diversity", "anchor", "action", "groundedness", "key_terms"}
    shown = ", ".join(f"round(CAST({x} AS DOUBLE), 6) AS {x}" if x in cast else x for x in columns)
    query(name, f"WITH {sf.SCORES_SQL} SELECT pair_id, level, {shown} FROM scores")(
        lambda spark, d: run(spark, d).select(
            "pair_id", "level", *[F.round(x, 6).alias(x) if x in cast else c(x) for x in columns]))


for _name, _columns in {
    "i1_word_overlap": ("question_overlap",), "i2_groundedness": ("ngram_score",), "i3_concept_overlap": ("concept_score", "key_terms"),
    "i4_anchor_ratio": ("anchor", "n_points"), "i6_tautology": ("tautology",), "i9_diversity": ("point_overlap", "diversity"),
    "i10_verbs": ("verb", "creative"), "i11_question_rules": ("question_ok", "question_score", "question_reason"),
    "i12_scenario": ("scenario",), "i13_step_answers": ("step_ok", "step_reason"), "i14_action": ("action",),
    "i15_template": ("template",),
}.items():
    _score_query(_name, _columns)


@query("qa_quality", f"WITH {sf.EVALUATE_SQL} SELECT pair_id, level, groundedness, quality, decision, CASE WHEN decision = 'pass' THEN NULL ELSE coalesce(hard, 'below_threshold') END AS fail_reason FROM evaluated")
def qa_quality(spark, d):
    return ops.evaluate_qa(sf.qa_pairs(spark, d)).select("pair_id", "level", "groundedness", "quality", "decision", "fail_reason")


@query("qa_pass_rate", f"""WITH {sf.EVALUATE_SQL} SELECT level, count(*) AS n, CAST(count_if(decision = 'pass') AS BIGINT) AS passed,
  round(100.0 * count_if(decision = 'pass') / count(*), 1) AS rate FROM evaluated GROUP BY level""")
def qa_pass_rate(spark, d):
    return ops.evaluate_qa(sf.qa_pairs(spark, d)).groupBy("level").agg(
        F.count("*").alias("n"), F.count_if(c("decision") == "pass").alias("passed"),
        F.round(100.0 * F.count_if(c("decision") == "pass") / F.count("*"), 1).alias("rate"))


@query("h23_answer_points", f"""WITH {sf.QA_SQL}, p AS (SELECT pair_id, {sf.sql_points('answer')} AS ps FROM pairs)
SELECT pair_id, CAST(unnest(range(0, len(ps))) AS INTEGER) AS idx, unnest(ps).t AS title, unnest(ps).c AS content FROM p""")
def h23_answer_points(spark, d):
    rows = st.explode_rows(sf.qa_pairs(spark, d), rp.answer_points(c("answer")), ("pair_id",), "idx")
    return rows.select("pair_id", "idx", "s.title", "s.content")


@query("i21_aspect_gap", f"""WITH {sf.QA_SQL}, {sf.gap_sql("pairs", "pair_id")}
SELECT pair_id, array_to_string(aspects, ',') AS aspects, array_to_string(skills, ',') AS skills, array_to_string(topics, ',') AS topics, array_to_string(q_hit, ',') AS q_hit,
  array_to_string(a_hit, ',') AS a_hit, array_to_string(content_missing, ',') AS content_missing, round(q_cov, 4) AS q_coverage, round(c_cov, 4) AS content_coverage, verdict
FROM gaps JOIN verdicts USING (pair_id)""")
def i21_aspect_gap(spark, d):
    rows = sf.qa_pairs(spark, d).select("pair_id", "level", sc.aspect_gap(
        c("question"), c("answer"), c("clo"), c("title"), c("source"), c("level")).alias("g"))
    lists = [F.array_join(c("g")[x], ",").alias(x) for x in ("aspects", "skills", "topics", "q_hit", "a_hit", "content_missing")]
    return rows.select("pair_id", *lists, F.round("g.q_coverage", 4).alias("q_coverage"),
                       F.round("g.content_coverage", 4).alias("content_coverage"),
                       sc.aspect_verdict(c("g"), c("level")).alias("verdict"))


# --- replies ----------------------------------------------------------------------------

_RAW = "concat('**BLOOM:** Bloom ', level, '\n**QUESTION:** ', question, '\nANSWER:', CASE WHEN pair_id % 3 = 0 THEN ' ' ELSE '\n' END, CASE WHEN pair_id % 7 = 3 THEN 'Theo tài liệu, ' ELSE '' END, answer)"
_NEED = "CAST(3 + pair_id % 4 AS INT)"


NEED = _NEED


def raw_reply() -> str:
    """Spark SQL of the stand-in reply of a pair."""
    return _RAW.replace("\n", "\\n")


def _replies(spark, d):
    return replies_to(sf.qa_pairs(spark, d))


def replies_to(pairs):
    """The stand-in replies of pairs."""
    return pairs.select("pair_id", "level", "source", "title", "clo", F.expr(raw_reply()).alias("raw"),
                        F.expr(_NEED).alias("required_points"))


def _clean_sql(x):
    x = f"replace(replace(replace({x}, '**', ''), '__', ''), '*', '')"
    x = f"regexp_replace({x}, '(?m)^\\[(.*?)\\]$', '\\1', 'g')"
    for word in ("Nội dung:", "NỘI DUNG:"):
        x = f"regexp_replace({x}, '(?m)^\\s*{word}\\s*', '', 'g')"
    for p in lx.LEAD_IN_PHRASES:
        x = f"regexp_replace({x}, '{p},?\\s*', '', 'g')"
    for p in lx.FILLER_SENTENCES:
        x = f"regexp_replace({x}, '{p}', '', 'g')"
    return x


_RAW_SQL = _RAW.replace("\n", "' || chr(10) || '")
_MARKED = ("array_to_string(list_transform(string_split(ans, chr(10)), lambda l: CASE WHEN regexp_matches(l, '^\\s*-\\s+\\S') THEN chr(57344) || l ELSE l END), chr(10))")
REPLY_SQL = f"""{sf.QA_SQL}, rr AS (SELECT *, {_RAW_SQL} AS raw, {_NEED} AS need FROM pairs),
r1 AS (SELECT *, replace(regexp_replace({tf.sql_strip('raw')}, '\\*\\*([A-Z]+:?)\\*\\*', '\\1', 'g'), '**', '') AS t FROM rr),
r2 AS (SELECT * EXCLUDE (question), {tf.sql_strip("regexp_extract(t, '(?is)QUESTION:\\s*(.+?)(?:\\nANSWER:|$)', 1)")} AS question,
    {tf.sql_strip("regexp_extract(t, '(?i)BLOOM:\\s*(.+?)(?:\\n|$)', 1)")} AS bloom,
    coalesce(nullif({tf.sql_strip("regexp_extract(t, '(?is)ANSWER:\\s*\\n(.+)', 1)")}, ''), nullif({tf.sql_strip("regexp_extract(t, '(?is)ANSWER:\\s*(-\\s*.+)', 1)")}, '')) AS ans FROM r1),
r3 AS (SELECT *, list_filter(list_transform(regexp_split_to_array({_MARKED}, '\\n?' || chr(57344)), lambda b, i: {{'b': b, 'i': i}}), lambda x: x.i > 1 OR x.b <> '') AS bs FROM r2),
r4 AS (SELECT *, len(bs) AS n_blocks, {tf.sql_strip("array_to_string(list_transform(bs[1:need], lambda x: x.b), chr(10))")} AS cut FROM r3),
r5 AS (SELECT * EXCLUDE (answer), {_clean_sql('cut')} AS answer FROM r4)"""


@query("h25_read_replies", f"WITH {REPLY_SQL} SELECT pair_id, bloom, question, md5(ans) AS answer_md5, CAST(n_blocks AS INTEGER) AS n_blocks, n_blocks < need AS short, md5(answer) AS clean_md5 FROM r5")
def h25_read_replies(spark, d):
    rows = _replies(spark, d).withColumn("r", rp.read_reply(c("raw")))
    rows = rows.withColumn("e", rp.enforce_points(c("r.answer"), c("required_points")))
    return rows.select("pair_id", "r.bloom", "r.question", F.md5("r.answer").alias("answer_md5"), "e.n_blocks", "e.short",
                       F.md5(rp.clean_answer(c("e.answer"))).alias("clean_md5"))


_REPLY_PAIRS = "pairs2 AS (SELECT pair_id, level, question, answer, source, title, clo, ans, n_blocks, need FROM r5)"
ACCEPT_SQL = f"""{REPLY_SQL}, {_REPLY_PAIRS}, {sf.gap_sql("pairs2", "pair_id")}, {sf.POINT_ROWS.replace("FROM pairs)", "FROM pairs2)")},
aa AS (SELECT *, list_distinct({sf.sql_content('source', 4)}) AS s4 FROM base),
ab AS (SELECT aa.*, CAST({sf.sql_anchor('points', 'source', 's4')} AS DOUBLE) AS anchor, coalesce(tautology, 1.0) AS tautology, {sf.ACTION} AS action,
    {sf.RULE_REASON} AS question_reason, {sf.STEP_REASON} AS step_reason, CASE WHEN trim(clo) = '' THEN 'ok' ELSE verdict END AS verdict
  FROM aa LEFT JOIN taut USING (pair_id) JOIN verdicts USING (pair_id)),
accepted AS (SELECT *, CASE WHEN question = '' OR ans IS NULL THEN 'unreadable' WHEN n_blocks < need THEN 'too_few_points' WHEN verdict <> 'ok' THEN 'outcome_missed'
    WHEN level <= 2 AND tautology < 0.65 THEN 'tautological' WHEN {sf.TEMPLATE} THEN 'template_answer' WHEN level = 2 AND anchor < 0.42 THEN 'few_source_terms'
    WHEN level = 3 AND anchor < 0.26 THEN 'few_source_terms' WHEN level <= 3 AND question_reason <> 'ok' THEN 'question_off_level' WHEN level = 3 AND action < 0.20 THEN 'no_action' END AS reject_reason FROM ab)"""


@query("reply_intake", f"WITH {ACCEPT_SQL} SELECT pair_id, question, md5(answer) AS answer_md5, reject_reason, reject_reason IS NULL AS accepted FROM accepted")
def reply_intake(spark, d):
    return ops.accept_replies(_replies(spark, d)).select("pair_id", "question", F.md5("answer").alias("answer_md5"), "reject_reason", "accepted")


@query("i27_reject_report", f"WITH {ACCEPT_SQL} SELECT level, coalesce(reject_reason, 'accepted') AS outcome, count(*) AS n FROM accepted GROUP BY ALL")
def i27_reject_report(spark, d):
    return ops.reject_report(ops.accept_replies(_replies(spark, d)))


@query("h26_verdicts", f"""WITH {sf.QA_SQL}, v AS (SELECT pair_id, CASE WHEN pair_id % 5 = 0 THEN answer ELSE 'Decision: ' || CASE WHEN pair_id % 3 = 0 THEN 'PASS' ELSE 'fail' END || chr(10) || 'Reason: ' || question || chr(10) || 'Feedback: ' || title END AS raw FROM pairs)
SELECT pair_id, coalesce(nullif(lower(regexp_extract(raw, '(?i)decision:\\s*(pass|fail)', 1)), ''), 'fail') AS decision,
  {tf.sql_strip("regexp_extract(raw, '(?is)reason:\\s*(.+?)(?:\\n\\s*feedback:|$)', 1)")} AS reason, {tf.sql_strip("regexp_extract(raw, '(?is)feedback:\\s*(.+)', 1)")} AS feedback FROM v""")
def h26_verdicts(spark, d):
    raw = F.when(c("pair_id") % 5 == 0, c("answer")).otherwise(F.concat(
        F.lit("Decision: "), F.when(c("pair_id") % 3 == 0, "PASS").otherwise("fail"), F.lit("\nReason: "), c("question"),
        F.lit("\nFeedback: "), c("title")))
    return sf.qa_pairs(spark, d).select("pair_id", rp.read_verdict(raw).alias("v")).select("pair_id", "v.*")


_LEVEL_RAW = "CASE pair_id % 4 WHEN 0 THEN concat('**', level, '** | ', question) WHEN 1 THEN concat('Level ', level, ' because') WHEN 2 THEN concat(level, ' - x 4') ELSE title END"


@query("h27_read_level", f"""WITH {sf.QA_SQL}, v AS (SELECT pair_id, {tf.sql_strip("regexp_replace(" + _LEVEL_RAW + ", '[*]+', '', 'g')")} AS t FROM pairs)
SELECT pair_id, CAST(coalesce(nullif(regexp_extract(t, '^([1-6])', 1), ''), nullif(regexp_extract(t, '([1-6])', 1), '')) AS INTEGER) AS level FROM v""")
def h27_read_level(spark, d):
    rows = sf.qa_pairs(spark, d).select("pair_id", F.expr(_LEVEL_RAW).alias("raw"))
    return rows.select("pair_id", rp.read_level(c("raw")).alias("level"))


# --- sections against levels and outcomes ----------------------------------------------------


def gated_sections(spark, d):
    """Sections with ceiling, outcome, outcome score and chapter size."""
    rows = st.sections_with_chapter_size(st.sectioned(tf.books(spark, d)))
    rows = rows.withColumn("clo", sf.outcome_of(c("doc_id")))
    return rows.withColumns({"clo_match": sc.clo_score(c("title"), c("content"), c("clo")),
                             "ceiling": sc.section_ceiling(c("content"))})


@query("i24_ceilings", f"""WITH {tf.SECTIONS_SQL}, {sf.gate_sql()} SELECT doc_id, pos, ceiling, chapter_chars, chapter_words FROM outcomes""")
def i24_ceilings(spark, d):
    rows = st.sections_with_chapter_size(st.sectioned(tf.books(spark, d)))
    return rows.select("doc_id", "pos", sc.section_ceiling(c("content")).alias("ceiling"),
                       c("chapter_chars").cast("bigint").alias("chapter_chars"), c("chapter_words").cast("bigint").alias("chapter_words"))


@query("i19_outcome_scores", f"""WITH {tf.SECTIONS_SQL}, {sf.gate_sql()}
SELECT doc_id, pos, round(CAST(clo_match AS DOUBLE), 6) AS clo_match, round(CAST(penalty AS DOUBLE), 4) AS penalty, round(ov_content, 6) AS overlap, CAST(n_topics AS INTEGER) AS n_topics
FROM outcomes""")
def i19_outcome_scores(spark, d):
    rows = gated_sections(spark, d)
    lo = F.lower("clo")
    lead = F.lower(F.concat(c("title"), F.lit("\n"), c("content")))
    return rows.select(
        "doc_id", "pos", F.round("clo_match", 6).alias("clo_match"),
        F.round(sc.clo_penalty(F.lower("title"), F.length(tx.strip(c("content"))), lo), 4).alias("penalty"),
        F.round(sc.clo_overlap(c("content"), c("clo")), 6).alias("overlap"),
        F.size(sc.clo_topics(lead, lo)).alias("n_topics"))


def gate(spark, d, *extra):
    """Gate decisions of all sections and levels; ``extra`` names texts of a section that are kept."""
    rows = ops.gate_features(gated_sections(spark, d)).withColumn("size_chars", c("n_chars"))
    rows = rows.drop(*{"content", "title", "clo"} - set(extra))
    return ops.feasibility(rows.withColumn("level", F.explode(F.array(*[F.lit(i) for i in range(1, 7)]))))


@query("level_gate", f"""WITH {tf.SECTIONS_SQL}, {sf.gate_sql()}, {sf.FEASIBLE_SQL}
SELECT doc_id, pos, level, CASE WHEN ok THEN 'pass' ELSE 'fail' END AS decision, quality, reasons FROM feasible""")
def level_gate(spark, d):
    return gate(spark, d).select(
        "doc_id", "pos", "level", "decision", "quality", F.array_join("reasons", " ").alias("reasons"))


@query("level_gate_report", f"""WITH {tf.SECTIONS_SQL}, {sf.gate_sql()}, {sf.FEASIBLE_SQL}
SELECT level, CASE WHEN ok THEN 'pass' ELSE 'fail' END AS decision, count(*) AS n, round(avg(quality), 4) AS mean_quality FROM feasible GROUP BY ALL""")
def level_gate_report(spark, d):
    return gate(spark, d).groupBy("level", "decision").agg(
        F.count("*").alias("n"), F.round(F.avg("quality"), 4).alias("mean_quality"))


@query("i5_boilerplate", f"WITH {tf.SECTIONS_SQL} SELECT doc_id, pos, CAST(CASE WHEN content = '' THEN 1 ELSE least(1.0, len(list_filter(string_split(lower(content), chr(10)), lambda l: {tf.sql_any('l', lx.BOILERPLATE_PHRASES)})) / 2.5) END AS DOUBLE) AS boilerplate FROM sections")
def i5_boilerplate(spark, d):
    return st.split_sections(tf.books(spark, d)).select("doc_id", "pos", st.boilerplate(c("content")).alias("boilerplate"))


@query("h29_notifications", """
WITH e AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN json_object('content', 'Thanh toan dh ' || event_id, 'transferAmount', value)
  WHEN 1 THEN json_object('description', 'chuyen tien', 'amount', 'abc') WHEN 2 THEN json_object('content', '', 'description', 'DH' || user_id, 'transferAmount', 0, 'amount', value)
  WHEN 3 THEN json_object('amount', event_id) ELSE json_object('content', event_type || ' DH  ' || event_id) END AS payload FROM events),
p AS (SELECT event_id, coalesce(nullif(payload->>'content', ''), payload->>'description', '') AS content,
  coalesce(try_cast(coalesce(nullif(nullif(payload->>'transferAmount', ''), '0'), payload->>'amount') AS DOUBLE), 0) AS amount FROM e)
SELECT event_id, content, amount, nullif(regexp_extract(upper(content), 'DH\\s*(\\d+)', 1), '') AS code FROM p""")
def h29_notifications(spark, d):
    k = c("event_id") % 5
    payload = (
        F.when(k == 0, F.to_json(F.struct(F.concat(F.lit("Thanh toan dh "), c("event_id").cast("string")).alias("content"), c("value").alias("transferAmount"))))
        .when(k == 1, F.lit('{"description":"chuyen tien","amount":"abc"}'))
        .when(k == 2, F.to_json(F.struct(F.lit("").alias("content"), F.concat(F.lit("DH"), c("user_id").cast("string")).alias("description"),
                                         F.lit(0).alias("transferAmount"), c("value").alias("amount"))))
        .when(k == 3, F.to_json(F.struct(c("event_id").alias("amount"))))
        .otherwise(F.to_json(F.struct(F.concat(c("event_type"), F.lit(" DH  "), c("event_id").cast("string")).alias("content")))))
    rows = load(spark, d, "events").select("event_id", rp.read_notification(payload).alias("n"))
    return rows.select("event_id", "n.content", "n.amount", rp.order_code(c("n.content")).alias("code"))
