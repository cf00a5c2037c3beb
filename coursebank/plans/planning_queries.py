"""Queries that plan a bank, attribute answers to sources, and evaluate experiments."""

from __future__ import annotations

from pyspark.sql import functions as F

from coursebank import lexicons as lx
from coursebank.operators import analytics as an
from coursebank.operators import grounding as gr
from coursebank.operators import outcomes as oc
from coursebank.operators import planning as pl
from coursebank.operators import relational as rel
from coursebank.operators import structure as st
from coursebank.functions import scoring as sc
from coursebank.operators import scoring as ops
from coursebank.plans import scoring_fixtures as sf
from coursebank.plans import text_fixtures as tf
from coursebank.plans.registry import query
from coursebank.plans import scoring_queries as qs
from coursebank.plans import text_queries as tq
from coursebank.plans.scoring_queries import gated_sections
from coursebank.session import written
from coursebank.sources.tables import load, spread

c = F.col

# --- plan -------------------------------------------------------------------------------



def plan(spark, d):
    """A plan per document: one row per level; counts 0 to 3, own points for some."""
    rows = load(spark, d, "documents").select("doc_id", F.explode(F.array(*[F.lit(i) for i in range(1, 7)])).alias("level"))
    return rows.select(
        "doc_id", "level", ((c("doc_id") + c("level")) % 4).cast("int").alias("count"),
        F.when(c("doc_id") % 3 == 0, F.lit(1.75)).alias("points"), sf.outcome_of(c("doc_id")).alias("clo"))


TARGETS_SQL = f"""pl0 AS (SELECT doc_id, unnest([1, 2, 3, 4, 5, 6]) AS level FROM documents),
pl1 AS (SELECT doc_id, level, (doc_id + level) % 4 AS n, coalesce(CASE WHEN doc_id % 3 = 0 THEN 1.75 END, 0.5 + 0.5 * level) AS points, {sf.quoted(sf.OUTCOMES)}[doc_id % 6 + 1] AS clo FROM pl0),
targets AS (SELECT doc_id, level, CAST(unnest(range(1, n + 1)) AS INTEGER) AS k, CAST(points AS DOUBLE) AS points,
  CAST(CASE level WHEN 3 THEN least(points // 0.25, 6) WHEN 5 THEN least(points // 0.25, 10) WHEN 6 THEN least(points // 0.25, 10) ELSE points // 0.25 END AS INTEGER) AS required_points, clo FROM pl1)"""


@query("j15_targets", f"WITH {TARGETS_SQL} SELECT * FROM targets")
def j15_targets(spark, d):
    return pl.expand_plan(plan(spark, d))


def candidates(spark, d):
    """Gate-tested, ranked candidates of every level (narrow rows)."""
    rows = gated_sections(spark, d).withColumn("boilerplate", st.boilerplate(c("content")))
    rows = ops.gate_features(rows).drop("content", "title")
    rows = rows.withColumn("size_chars", c("n_chars"))
    tested = ops.feasibility(rows.withColumn("level", F.explode(F.array(*[F.lit(i) for i in range(1, 7)]))))
    clo_match = F.when(F.trim("clo") != "", c("clo_match"))
    return pl.rank_candidates(tested.select(
        "doc_id", "pos", "level", "ceiling", "boilerplate", clo_match.alias("clo_match"), c("size_chars").alias("n_chars"),
        (c("decision") == "pass").alias("feasible")))


RANKED_SQL = f"""{tf.SECTIONS_SQL}, {sf.gate_sql()}, {sf.FEASIBLE_SQL},
ca AS (SELECT *, CASE WHEN content = '' THEN 1 ELSE least(1.0, len(list_filter(string_split(lower(content), chr(10)), lambda l: {tf.sql_any('l', lx.BOILERPLATE_PHRASES)})) / 2.5) END AS plate,
  trim(clo) <> '' AND clo_match >= 0.06 AS fits FROM feasible),
cb AS (SELECT *, max(CAST(fits AS INT)) OVER (PARTITION BY doc_id, level) = 1 AS by_clo FROM ca),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id, level ORDER BY CASE WHEN by_clo THEN -clo_match END, CASE WHEN by_clo THEN abs(ceiling - level) END, CASE WHEN by_clo THEN plate END,
    CASE WHEN ceiling = level THEN 0 ELSE 2 END, CASE WHEN level >= 3 THEN plate ELSE 0 END, pos) AS INTEGER) AS rank FROM cb WHERE fits OR NOT by_clo)"""


@query("f5_candidate_order", f"WITH {RANKED_SQL} SELECT doc_id, pos, level, rank, by_clo, ok AS feasible FROM ranked")
def f5_candidate_order(spark, d):
    return candidates(spark, d).select("doc_id", "pos", "level", "rank", "by_clo", "feasible")


ATTEMPTS = "(doc_id + pos * 3 + level * 5 + attempt) % 7 = 0"


def attempts(ranked):
    """Verdicts on up to seven replies per candidate (only the first five count)."""
    rows = ranked.select("doc_id", "pos", "level", F.explode(F.sequence(F.lit(1), F.lit(7))).alias("attempt"))
    return rows.withColumn("passed", F.expr(ATTEMPTS))


ATTEMPT_SQL = f"""at0 AS (SELECT doc_id, pos, level, unnest(range(1, 8)) AS attempt FROM ranked),
firsts AS (SELECT doc_id, pos, level, CAST(min(attempt) AS INTEGER) AS attempt FROM at0 WHERE {ATTEMPTS} AND attempt <= 5 GROUP BY ALL)"""


@query("e9_first_pass", f"WITH {RANKED_SQL}, {ATTEMPT_SQL} SELECT * FROM firsts")
def e9_first_pass(spark, d):
    return pl.first_pass(attempts(candidates(spark, d)), ["doc_id", "pos", "level"])


_CAPS = " ".join(f"WHEN {k} THEN {v}" for k, v in lx.SECTIONS_TRIED.items())
ASSIGN_SQL = f"""{RANKED_SQL}, {ATTEMPT_SQL}, {TARGETS_SQL},
wa AS (SELECT doc_id, level, any_value(by_clo) AS by_clo, list({{'pos': pos, 'heavy': level IN (3, 4) AND plate > 0.72, 'ok': ok, 'passed': attempt IS NOT NULL, 'attempt': attempt}} ORDER BY rank) AS cs
  FROM ranked LEFT JOIN firsts USING (doc_id, pos, level) WHERE n_chars >= CASE WHEN level >= 2 THEN 150 ELSE 80 END GROUP BY doc_id, level),
wb AS (SELECT *, CASE WHEN by_clo THEN least(8, CASE level {_CAPS} END) ELSE CASE level {_CAPS} END END AS cap FROM wa),
wc AS (SELECT doc_id, level, list_reduce(cs, lambda a, x:
    {{'skipped': a.skipped + CASE WHEN x.heavy AND a.skipped < 20 AND a.tried < cap - 2 THEN 1 ELSE 0 END,
      'tried': a.tried + CASE WHEN NOT (x.heavy AND a.skipped < 20 AND a.tried < cap - 2) AND x.ok AND a.tried < cap AND NOT x.passed THEN 1 ELSE 0 END,
      'hits': CASE WHEN NOT (x.heavy AND a.skipped < 20 AND a.tried < cap - 2) AND x.ok AND a.tried < cap AND x.passed THEN list_append(a.hits, {{'pos': x.pos, 'attempt': x.attempt}}) ELSE a.hits END}},
    {{'skipped': 0, 'tried': 0, 'hits': []::STRUCT(pos INTEGER, attempt INTEGER)[]}}).hits AS hits FROM wb)
SELECT t.doc_id, t.level, t.k, points, required_points, clo, hits[k].pos AS pos, hits[k].attempt AS attempt FROM targets t LEFT JOIN wc USING (doc_id, level)"""


def bank_rows(spark, d):
    # The stand-in verdicts are a function of the candidate, so its first passing attempt is a column.
    tries = F.filter(F.sequence(F.lit(1), F.lit(5)), lambda a: (c("doc_id") + c("pos") * 3 + c("level") * 5 + a) % 7 == 0)
    ranked = candidates(spark, d).withColumn("attempt", F.get(tries, F.lit(0)))
    return pl.assign(ranked, pl.expand_plan(plan(spark, d)))


@query("j14_assignment_joined", f"WITH {ASSIGN_SQL}")
def j14_assignment_joined(spark, d):
    # Read twice: the order of the sections, and the replies to them.
    ranked = written(candidates(spark, d), "ranked")
    verdicts = pl.first_pass(attempts(ranked), ["doc_id", "pos", "level"])
    return pl.assign(pl.with_verdicts(ranked, verdicts), pl.expand_plan(plan(spark, d)))


@query("j14_assignment", f"WITH {ASSIGN_SQL}")
def j14_assignment(spark, d):
    return bank_rows(spark, d)


# --- several outcomes a level -------------------------------------------------------------------


def two_row_plan(spark, d):
    """Two plan rows of each level per document, for its own outcome and the next one."""
    rows = load(spark, d, "documents").select(
        "doc_id", F.explode(F.array(*[F.lit(i) for i in range(1, 7)])).alias("level"), F.lit(0).alias("z"))
    rows = rows.select("doc_id", "level", F.explode(F.array(F.lit(0), F.lit(1))).alias("item"))
    return rows.select(
        "doc_id", "level", "item", ((c("doc_id") + c("level") * (c("item") + 1)) % 4 + 1).cast("int").alias("count"),
        F.lit(None).cast("double").alias("points"), sf.outcome_of(c("doc_id") + c("item")).alias("clo"))


def outcome_candidates(spark, d):
    """Sections of every level against both outcomes of their document (narrow rows), with stand-in verdicts."""
    rows = st.sections_with_chapter_size(st.sectioned(tf.books(spark, d)))
    rows = rows.withColumns({"ceiling": sc.section_ceiling(c("content")), "boilerplate": st.boilerplate(c("content"))})
    rows = rows.withColumn("item", F.explode(F.array(F.lit(0), F.lit(1))))
    rows = rows.withColumn("clo", sf.outcome_of(c("doc_id") + c("item")))
    rows = rows.withColumn("clo_match", sc.clo_score(c("title"), c("content"), c("clo")))
    rows = ops.gate_features(rows).drop("content", "title")
    rows = rows.withColumn("size_chars", c("n_chars"))
    tested = ops.feasibility(rows.withColumn("level", F.explode(F.array(*[F.lit(i) for i in range(1, 7)]))))
    tries = F.filter(F.sequence(F.lit(1), F.lit(5)), lambda a: (c("doc_id") + c("pos") * 3 + c("level") * 5 + a) % 7 == 0)
    return tested.select(
        "doc_id", "pos", "level", "clo", "ceiling", "boilerplate", c("size_chars").alias("n_chars"), "clo_match",
        (c("decision") == "pass").alias("feasible"), F.get(tries, F.lit(0)).alias("attempt"))


# The walk of one target: a fold over its order, which the recursion rebuilds without the sections used so far.
PLAN_ROWS_SQL = f"""{tf.SECTIONS_SQL}, twice AS (SELECT * FROM sections, (SELECT unnest([0, 1]) AS item)),
{sf.gate_sql("twice", "item")}, {sf.FEASIBLE_SQL},
cx AS (SELECT doc_id, pos, level, trim(clo) AS clo, ok, n_chars, ceiling, clo_match, list_filter([1, 2, 3, 4, 5], lambda a: (doc_id + pos * 3 + level * 5 + a) % 7 = 0)[1] AS attempt,
  CASE WHEN content = '' THEN 1 ELSE least(1.0, len(list_filter(string_split(lower(content), chr(10)), lambda l: {tf.sql_any('l', lx.BOILERPLATE_PHRASES)})) / 2.5) END AS plate FROM feasible),
cy AS (SELECT *, {{'pos': pos, 'attempt': attempt, 'ok': ok, 'heavy': level IN (3, 4) AND plate > 0.72, 'enough': n_chars >= CASE WHEN level >= 2 THEN 150 ELSE 80 END}} AS x FROM cx),
cz AS (SELECT doc_id, level, clo, list(x ORDER BY CASE WHEN ceiling = level THEN 0 ELSE 2 END, CASE WHEN level >= 3 THEN plate ELSE 0 END, pos) AS plain,
  coalesce(list(x ORDER BY -clo_match, abs(ceiling - level), plate, pos) FILTER (clo <> '' AND clo_match >= 0.06), []) AS by_clo FROM cy GROUP BY ALL),
pr AS (SELECT doc_id, level, item, CAST((doc_id + level * (item + 1)) % 4 + 1 AS INTEGER) AS n, trim({sf.quoted(sf.OUTCOMES)}[(doc_id + item) % {len(sf.OUTCOMES)} + 1]) AS clo
  FROM documents, (SELECT unnest([1, 2, 3, 4, 5, 6]) AS level), (SELECT unnest([0, 1]) AS item)),
tg AS (SELECT doc_id, level, item, clo, CAST(unnest(range(1, n + 1)) + coalesce(sum(n) OVER (PARTITION BY doc_id, level ORDER BY item ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS k FROM pr),
walks AS (
  SELECT doc_id, level, 0 AS k, []::INTEGER[] AS used, NULL::INTEGER AS pos, NULL::INTEGER AS attempt, NULL::VARCHAR AS why FROM pr WHERE item = 0
  UNION ALL
  SELECT doc_id, level, k, CASE WHEN w.pos IS NULL THEN used ELSE list_append(used, w.pos) END, w.pos, w.attempt,
    CASE WHEN w.pos IS NOT NULL THEN NULL WHEN plain IS NULL THEN 'no_sections' WHEN len(o) = 0 THEN 'used_up' WHEN w.capped THEN 'cap' ELSE 'none_passed' END
  FROM (SELECT *, list_reduce(o, lambda a, x: CASE WHEN NOT x.enough OR a.pos IS NOT NULL THEN a
      WHEN x.heavy AND a.skipped < 20 AND a.tried < most - 2 THEN {{'skipped': a.skipped + 1, 'tried': a.tried, 'capped': a.capped, 'pos': a.pos, 'attempt': a.attempt}}
      WHEN NOT x.ok THEN a WHEN a.tried >= most THEN {{'skipped': a.skipped, 'tried': a.tried, 'capped': true, 'pos': a.pos, 'attempt': a.attempt}}
      ELSE {{'skipped': a.skipped, 'tried': a.tried + 1, 'capped': a.capped, 'pos': CASE WHEN x.attempt IS NOT NULL THEN CAST(x.pos AS INTEGER) END, 'attempt': CAST(x.attempt AS INTEGER)}} END,
      {{'skipped': 0, 'tried': 0, 'capped': false, 'pos': NULL::INTEGER, 'attempt': NULL::INTEGER}}) AS w
    FROM (SELECT *, CASE WHEN len(f) > 0 THEN f ELSE list_filter(plain, lambda x: NOT list_contains(used, x.pos)) END AS o
      FROM (SELECT walks.doc_id, walks.level, tg.k, used, plain, list_filter(by_clo, lambda x: NOT list_contains(used, x.pos)) AS f,
          CASE WHEN tg.clo <> '' THEN least(8, CASE walks.level {_CAPS} END) ELSE CASE walks.level {_CAPS} END END AS most
        FROM walks JOIN tg ON tg.doc_id = walks.doc_id AND tg.level = walks.level AND tg.k = walks.k + 1
        LEFT JOIN cz ON cz.doc_id = tg.doc_id AND cz.level = tg.level AND cz.clo = tg.clo))))
SELECT doc_id, level, item, k, tg.clo, pos, attempt, why FROM tg JOIN walks USING (doc_id, level, k)"""


def plan_rows_assigned(spark, d):
    targets = pl.expand_plan(two_row_plan(spark, d)).withColumn("clo", F.trim("clo"))
    return pl.assign_plan(outcome_candidates(spark, d), targets).select("doc_id", "level", "item", "k", "clo", "pos", "attempt", "why")


@query("j14_plan_rows", "WITH RECURSIVE " + PLAN_ROWS_SQL)
def j14_plan_rows(spark, d):
    return plan_rows_assigned(spark, d)


@query("j14_empty_targets", f"WITH a AS (WITH RECURSIVE {PLAN_ROWS_SQL}) SELECT level, coalesce(why, 'filled') AS outcome, count(*) AS n FROM a GROUP BY ALL")
def j14_empty_targets(spark, d):
    return plan_rows_assigned(spark, d).groupBy("level", F.coalesce("why", F.lit("filled")).alias("outcome")).agg(F.count("*").alias("n"))


# --- outcomes -----------------------------------------------------------------------------------


def _outcome_scores(spark, d):
    """Sections against two outcomes of their document."""
    sections = st.split_sections(tf.books(spark, d)).select("doc_id", "pos", "title", "content")
    asked = load(spark, d, "documents").select("doc_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("outcome_id"))
    return oc.outcome_scores(sections, asked.withColumn("clo", sf.outcome_of(c("doc_id") + c("outcome_id"))))


def _mask_sql(x, which):
    return "CAST(" + " + ".join(f"CASE WHEN {tf.sql_any(x, v[which])} THEN {1 << i} ELSE 0 END" for i, v in enumerate(lx.CLO_ASPECTS.values())) + " AS BIGINT)"


def _names_sql(x):
    return "array_to_string(list_filter([" + ", ".join(f"CASE WHEN ({x}) & {1 << i} <> 0 THEN '{k}' END" for i, k in enumerate(lx.CLO_ASPECTS)) + "], lambda z: z IS NOT NULL), ' ')"


MATCH_SQL = f"""{tf.SECTIONS_SQL}, twice AS (SELECT * FROM sections, (SELECT unnest([0, 1]) AS item)), {sf.gate_sql("twice", "item")},
scored AS (SELECT doc_id, item AS outcome_id, pos, CAST(CASE WHEN trim(clo) = '' THEN 0 ELSE clo_match END AS DOUBLE) AS score, {_mask_sql("lower(clo)", 0)} AS asked,
  {_mask_sql("lower(title || chr(10) || content)", 1)} AS shown FROM outcomes)"""


@query("outcome_match", f"""WITH {MATCH_SQL}, g AS (SELECT doc_id, outcome_id, any_value(asked) AS asked, count(*) FILTER (score >= 0.06) AS n_sections, coalesce(bit_or(shown) FILTER (score >= 0.06), 0) AS shown,
  arg_min(pos, (-score, pos)) FILTER (score >= 0.06) AS best_pos, max(score) FILTER (score >= 0.06) AS best_score FROM scored GROUP BY ALL)
SELECT doc_id, outcome_id, n_sections, best_pos, round(best_score, 6) AS best_score, {_names_sql("asked")} AS asked, {_names_sql("asked & shown")} AS covered, {_names_sql("xor(asked, asked & shown)")} AS missing,
  CASE WHEN asked = 0 THEN 1.0 ELSE round(bit_count(asked & shown) / bit_count(asked), 4) END AS ratio, CAST(bit_count(xor(asked, asked & shown) & {oc.SKILLS}) AS INTEGER) AS skills_missing FROM g""")
def outcome_match(spark, d):
    rows = oc.coverage(_outcome_scores(spark, d))
    names = {x: F.array_join(x, " ") for x in ("asked", "covered", "missing")}
    return rows.withColumns(names | {"best_score": F.round("best_score", 6)})


@query("i19_ranked_matches", f"""WITH {MATCH_SQL} SELECT doc_id, outcome_id, pos, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY doc_id, outcome_id ORDER BY score DESC, pos) AS INTEGER) AS rank,
  {_names_sql("asked & shown")} AS covers FROM scored WHERE score >= 0.06""")
def i19_ranked_matches(spark, d):
    rows = oc.ranked_matches(_outcome_scores(spark, d))
    return rows.withColumns({"score": F.round("score", 6), "covers": F.array_join(oc.aspect_names(c("covers")), " ")})


_CHAPTER_NO = "nullif(regexp_extract({x}, '(?i)^Chapter\\s+(\\d+)', 1), '')"
BANK_SQL = f"""assigned AS (WITH {ASSIGN_SQL}), {tf.SECTIONS_SQL},
titles AS (SELECT doc_id, pos, chapter, title, {tq.TITLE_LINE_SQL} AS t FROM sections), {tq.REPAIRED_SQL},
shown_titles AS (SELECT doc_id, pos, num, coalesce(nullif({tq._SHOWN}, ''), title) AS shown FROM repaired_titles),
labelled AS (SELECT a.*, {tq._english_sql("coalesce(s.chapter, 'Nội dung')")} AS chap, {tq._english_sql("coalesce(num, '')")} AS sec, num, shown
  FROM assigned a JOIN sections s ON s.doc_id = a.doc_id AND s.pos = a.pos JOIN shown_titles h ON h.doc_id = a.doc_id AND h.pos = a.pos)"""


@query("bank_plan", f"""WITH {BANK_SQL} SELECT doc_id, level, k, pos, attempt, points AS total_points, CAST(floor(points / 0.25) AS INTEGER) AS sub_points_count,
  array_to_string(list_transform(range(1, CAST(floor(points / 0.25) AS BIGINT) + 1), lambda i: 'Ý ' || i || ': 0.25đ'), ' | ') AS points_breakdown,
  CASE WHEN num IS NULL OR {_CHAPTER_NO.format(x="chap")} = {_CHAPTER_NO.format(x="sec")} THEN chap || ': ' || shown ELSE chap || ' - Section ' || sec || ': ' || shown END AS section_info, clo FROM labelled""")
def bank_plan(spark, d):
    sections = st.split_sections(tf.books(spark, d))
    return pl.assemble_results(bank_rows(spark, d), sections, "en")


@query("bank_fill_rate", f"WITH a AS (WITH {ASSIGN_SQL}) SELECT level, count(*) AS targets, count(pos) AS filled FROM a GROUP BY level")
def bank_fill_rate(spark, d):
    return bank_rows(spark, d).groupBy("level").agg(F.count("*").alias("targets"), F.count("pos").alias("filled"))


PSEUDO_SQL = f"""{tf.SECTIONS_SQL}, pc AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM sections),
pseudo AS (SELECT doc_id, pos, coalesce('Chương ' || nullif(regexp_extract(title, '^(\\d+)\\.', 1), ''), nullif(CASE WHEN chapter <> 'Unknown' THEN chapter END, ''),
  'Chương ' || CASE WHEN n >= 15 THEN CASE WHEN pos / n < 0.25 THEN 1 WHEN pos / n < 0.5 THEN 2 WHEN pos / n < 0.75 THEN 3 ELSE 4 END
    WHEN n >= 6 THEN CASE WHEN pos / n < 0.4 THEN 1 WHEN pos / n < 0.75 THEN 2 ELSE 3 END ELSE pos + 1 END) AS slot_chapter FROM pc)"""


def _slotted(spark, d):
    return pl.pseudo_chapter(st.split_sections(tf.books(spark, d))).select("doc_id", "pos", "slot_chapter")


@query("e8_pseudo_chapters", f"WITH {PSEUDO_SQL} SELECT * FROM pseudo")
def e8_pseudo_chapters(spark, d):
    return _slotted(spark, d)


ROBIN_SQL = f"""{PSEUDO_SQL}, ix AS (SELECT *, row_number() OVER (PARTITION BY doc_id, slot_chapter ORDER BY pos) - 1 AS idx FROM pseudo),
cs AS (SELECT doc_id, slot_chapter, count(*) AS m, row_number() OVER (PARTITION BY doc_id ORDER BY slot_chapter) - 1 AS ci, count(*) OVER (PARTITION BY doc_id) AS nc FROM pseudo GROUP BY doc_id, slot_chapter),
sl AS (SELECT d.doc_id, s.slot FROM (SELECT DISTINCT doc_id FROM pseudo) d, (SELECT unnest(range(0, 12)) AS slot) s),
robin AS (SELECT sl.doc_id, CAST(slot AS INTEGER) AS slot, cs.slot_chapter, pos FROM sl JOIN cs ON cs.doc_id = sl.doc_id AND ci = slot % nc
  JOIN ix ON ix.doc_id = sl.doc_id AND ix.slot_chapter = cs.slot_chapter AND idx = (slot // nc) % m)"""


@query("e11_round_robin", f"WITH {ROBIN_SQL} SELECT * FROM robin")
def e11_round_robin(spark, d):
    return pl.round_robin(_slotted(spark, d), 12).drop("level")


@query("j20_slot_levels", f"WITH {ROBIN_SQL} SELECT *, CAST(CAST('0x' || left(md5('7/' || doc_id || '/' || slot), 15) AS BIGINT) % 6 + 1 AS INTEGER) AS level FROM robin")
def j20_slot_levels(spark, d):
    return pl.round_robin(_slotted(spark, d), 12, seed=7)


@query("d21_questions_per_chapter", f"""WITH {ROBIN_SQL} SELECT p.doc_id, p.slot_chapter AS chapter, n_sections, coalesce(n_questions, 0) AS n_questions
FROM (SELECT doc_id, slot_chapter, count(*) AS n_sections FROM pseudo GROUP BY ALL) p LEFT JOIN (SELECT doc_id, slot_chapter, count(*) AS n_questions FROM robin GROUP BY ALL) r USING (doc_id, slot_chapter)""")
def d21_questions_per_chapter(spark, d):
    rows = _slotted(spark, d)
    slots = pl.round_robin(rows, 12).withColumnRenamed("slot_chapter", "chapter")
    return an.questions_per_chapter(slots, rows.withColumnRenamed("slot_chapter", "chapter"))


# --- attribution ------------------------------------------------------------------------------

GRAMS4 = "list_distinct(" + sf.sql_grams("ws", 4) + ")"


@query("c16_corpus_attribution", f"""
WITH pg AS (SELECT item_id, unnest({GRAMS4}) AS gram FROM (SELECT item_id, {sf.sql_content(tf.sql_math('text'), 2)} AS ws FROM benchmark)),
dg AS (SELECT doc_id, unnest({GRAMS4}) AS gram FROM (SELECT doc_id, {sf.sql_content(tf.sql_math('text'), 2)} AS ws FROM documents)),
s AS (SELECT item_id, doc_id, count(*) AS shared FROM pg JOIN dg USING (gram) GROUP BY ALL),
n AS (SELECT item_id, CAST(count(*) AS INTEGER) AS n_grams FROM pg GROUP BY 1),
b AS (SELECT item_id, doc_id AS best_doc, shared, count(*) OVER (PARTITION BY item_id) AS n_sources FROM s QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY shared DESC, doc_id) = 1)
SELECT item_id, best_doc, coalesce(shared, 0) AS shared, coalesce(n_grams, 0) AS n_grams, coalesce(round(shared / n_grams, 4), 0) AS share, coalesce(n_sources, 0) AS n_sources
FROM benchmark LEFT JOIN b USING (item_id) LEFT JOIN n USING (item_id)""")
def c16_corpus_attribution(spark, d):
    docs = spread(load(spark, d, "documents").select("doc_id", "text"))
    return gr.corpus_attribution(load(spark, d, "benchmark"), docs)


def _chapters(spark, d):
    """Chapters of the documents that have answers; the others are not split at all."""
    asked = load(spark, d, "conversations").select(c("conv_id").alias("doc_id")).distinct()
    return st.explode_chapters(st.sectioned(tf.books(spark, d, asked)))


def _answers(spark, d):
    return sf.qa_pairs(spark, d).select("pair_id", "doc_id", "answer")


_WS = "list_filter(regexp_split_to_array(lower({x}), '\\s+'), lambda w: w <> '')"
_SENT = ("list_filter(list_transform(string_split(regexp_replace(content, '([.!?\\n])\\s+', '\\1' || chr(57344), 'g'), chr(57344)), lambda s: "
         + tf.sql_strip("s") + "), lambda s: length(s) >= 10)")


def bleu_ctes(name: str, rows: str, key: str, text: str, content: str, top: int) -> str:
    """CTEs that end in ``name``: ``key``, word counts and BLEU-1, 2, 4 of ``text`` against the ``top`` nearest sentences of ``content``."""
    p, kinds = name, "(SELECT unnest([1, 2, 3, 4]) AS n)"
    grams = "unnest(list_transform(range(1, greatest(len({x}) - n + 2, 1)), lambda i: array_to_string({x}[i:i + n - 1], ' ')))"
    log = "ln(coalesce(max(CASE WHEN m = 0 THEN 0.1 ELSE m END / greatest(t, 1)) FILTER (n = {n}), 0.1)) AS l{n}"
    return f"""{p}_p AS (SELECT {key}, {_WS.format(x=text)} AS hyp, {content} AS content,
    list_filter(list_distinct({_WS.format(x=text)}), lambda w: NOT list_contains({tf.quoted(lx.BLEU_STOP_WORDS)}, w)) AS hw FROM {rows}),
{p}_s AS (SELECT *, list_sort(list_transform({_SENT}, lambda s, i: {{'r': -len(list_intersect({_WS.format(x='s')}, hw)), 'i': i, 'ws': {_WS.format(x='s')}}}))[1:{top}] AS top FROM {p}_p),
{p}_r AS (SELECT {key}, hyp, CASE WHEN len(flatten(list_transform(top, lambda t: t.ws))) > 0 THEN flatten(list_transform(top, lambda t: t.ws)) ELSE {_WS.format(x='content')} END AS ref FROM {p}_s),
{p}_g AS (SELECT {key}, n, {grams.format(x="hyp")} AS g, 1 AS h, 0 AS r FROM {p}_r, {kinds} UNION ALL SELECT {key}, n, {grams.format(x="ref")}, 0, 1 FROM {p}_r, {kinds}),
{p}_c AS (SELECT {key}, n, g, sum(h) AS h, sum(r) AS r FROM {p}_g GROUP BY ALL),
{p}_m AS (SELECT {key}, n, sum(least(h, r)) AS m, sum(h) AS t FROM {p}_c GROUP BY ALL),
{p}_l AS (SELECT {key}, sum(m) FILTER (n = 1) AS m1, {", ".join(log.format(n=n) for n in (1, 2, 3, 4))} FROM {p}_m GROUP BY ALL),
{p} AS (SELECT {key}, CAST(len(hyp) AS INTEGER) AS hyp_len, CAST(len(ref) AS INTEGER) AS ref_len,
  CASE WHEN coalesce(m1, 0) = 0 OR len(ref) < 1 THEN 0 ELSE round(b * exp(l1), 4) END AS bleu1, CASE WHEN coalesce(m1, 0) = 0 OR len(ref) < 2 THEN 0 ELSE round(b * exp((l1 + l2) / 2), 4) END AS bleu2,
  CASE WHEN coalesce(m1, 0) = 0 OR len(ref) < 4 THEN 0 ELSE round(b * exp((l1 + l2 + l3 + l4) / 4), 4) END AS bleu4
  FROM (SELECT *, CASE WHEN len(hyp) > len(ref) THEN 1.0 ELSE exp(1 - len(ref) / greatest(len(hyp), 1)) END AS b FROM {p}_r LEFT JOIN {p}_l USING ({key})))"""


CHAPTERS_SQL = "chapters AS (SELECT doc_id, coalesce(chapter, 'Nội dung') AS chapter, min(pos) AS first_pos, string_agg(content, chr(10) || chr(10) ORDER BY pos) AS content FROM sections GROUP BY 1, 2)"
_EVERY = "(SELECT p.doc_id, pair_id, chapter, first_pos, answer, content FROM pairs p JOIN chapters c ON p.doc_id = c.doc_id)"
BLEU_SQL = f"""{sf.QA_SQL}, {tf.SECTIONS_SQL}, {CHAPTERS_SQL},
{bleu_ctes("bleu", _EVERY, "doc_id, pair_id, chapter, first_pos", "answer", "content", lx.BLEU_SENTENCES)}"""


@query("i29_bleu", f"WITH {BLEU_SQL} SELECT doc_id, pair_id, chapter, hyp_len, ref_len, bleu1, bleu2, bleu4 FROM bleu")
def i29_bleu(spark, d):
    return gr.chapter_scores(_answers(spark, d), _chapters(spark, d), lx.BLEU_SENTENCES).drop("chapter_pos")


@query("i30_attribution", f"""WITH {BLEU_SQL}, own AS (SELECT p.doc_id, p.pair_id, c.chapter AS source_chapter FROM pairs p JOIN (SELECT doc_id, arg_min(chapter, first_pos) AS chapter FROM chapters GROUP BY 1) c USING (doc_id)),
b AS (SELECT doc_id, pair_id, chapter AS best_chapter, bleu4 AS best_score FROM bleu QUALIFY row_number() OVER (PARTITION BY doc_id, pair_id ORDER BY bleu4 DESC, first_pos) = 1)
SELECT doc_id, pair_id, source_chapter, best_chapter, best_score, best_chapter = source_chapter AS is_correct FROM own JOIN b USING (doc_id, pair_id)""")
def i30_attribution(spark, d):
    # The stand-in's own chapter is the first one of its document.
    scores = gr.chapter_scores(_answers(spark, d), _chapters(spark, d), lx.BLEU_SENTENCES, orders=(4,))
    return gr.attribute_chapter(scores, F.min_by("chapter", "chapter_pos"))


# Rows of the experiment: a pair belongs to one section of its document; models are told apart by the pair's number.
_OWN = "(SELECT p.*, s.content AS own, s.title AS section_title, coalesce(s.chapter, 'Nội dung') AS source_chapter FROM asked p LEFT JOIN sections s ON s.doc_id = p.doc_id AND s.pos = section_pos)"
_KEY = "doc_id, pair_id"
ANSWERS_SQL = f"""{BLEU_SQL}, asked AS (SELECT p.*, CAST(pair_id % n AS INTEGER) AS section_pos FROM pairs p JOIN (SELECT doc_id, count(*) AS n FROM sections GROUP BY 1) USING (doc_id)),
named AS {_OWN},
{bleu_ctes("near", "named", _KEY, "answer", "own", lx.BLEU_SECTION_SENTENCES)},
{bleu_ctes("qs", "(SELECT n.doc_id, pair_id, question, c.content FROM named n JOIN chapters c ON c.doc_id = n.doc_id AND c.chapter = source_chapter)", _KEY, "question", "content", lx.BLEU_SENTENCES)},
bests AS (SELECT doc_id, pair_id, chapter AS best_bleu_chapter, bleu4 AS best_bleu_score FROM bleu QUALIFY row_number() OVER (PARTITION BY doc_id, pair_id ORDER BY bleu4 DESC, first_pos) = 1),
answers AS (SELECT doc_id, pair_id, n.source_chapter, section_title, b.bleu1 AS bleu1_ans_chapter, b.bleu2 AS bleu2_ans_chapter, b.bleu4 AS bleu4_ans_chapter, best_bleu_chapter, best_bleu_score,
    best_bleu_chapter = n.source_chapter AS is_correct, near.bleu4 AS bleu4_ans_section, qs.bleu4 AS bleu4_q_chapter, b.hyp_len AS answer_words, qs.hyp_len AS question_words,
    CAST(len({_WS.format(x="c.content")}) AS INTEGER) AS chapter_words, CAST(len({_WS.format(x="own")}) AS INTEGER) AS section_words, level
  FROM named n JOIN bests USING ({_KEY}) JOIN near USING ({_KEY}) JOIN qs USING ({_KEY}) JOIN bleu b USING ({_KEY}) JOIN chapters c USING (doc_id)
  WHERE b.chapter = n.source_chapter AND c.chapter = n.source_chapter)"""
_MODEL = ("CASE pair_id % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'N' ELSE 'R' END AS model", "concat('B', level) AS bloom_short", "CAST(doc_id % 4 AS INT) AS pdf",
          "CAST(pair_id % 50 AS DOUBLE) AS process_time_s")


def _reported(spark, d):
    pairs = sf.qa_pairs(spark, d).select("doc_id", "pair_id", "level", "question", "answer")
    books = written(st.sectioned(tf.books(spark, d, pairs.select("doc_id").distinct())), "sectioned")
    n = books.select("doc_id", F.size("sections").alias("n")).where("n > 0")
    asked = pairs.join(n, "doc_id").withColumn("section_pos", (c("pair_id") % c("n")).cast("int")).drop("n")
    report = gr.answer_report(asked, books)
    return report.join(pairs.select("doc_id", "pair_id", "level"), ["doc_id", "pair_id"])


@query("i29_answer_report", f"WITH {ANSWERS_SQL} SELECT * FROM answers")
def i29_answer_report(spark, d):
    return _reported(spark, d)


# --- verdicts -----------------------------------------------------------------------------------


def _placed(spark, d):
    """Pairs with the section they belong to, and the sectioned documents."""
    pairs = written(sf.qa_pairs(spark, d).select("doc_id", "pair_id", "level", "question", "answer", "clo"), "pairs")
    books = written(st.sectioned(tf.books(spark, d, pairs.select("doc_id").distinct())), "sectioned")
    n = books.select("doc_id", F.size("sections").alias("n")).where("n > 0")
    return pairs.join(n, "doc_id").withColumn("section_pos", (c("pair_id") % c("n")).cast("int")).drop("n"), books


def judged_sql(pairs: str) -> str:
    """The evaluation of ``pairs``, whose sources are the own section at levels 3 and 4 and the whole chapter else."""
    rest = sf.EVALUATE_SQL.removeprefix(sf.QA_SQL)
    return f"""{sf.QA_SQL.replace("pairs AS (SELECT", "all_pairs AS (SELECT", 1)}, book_sections AS (WITH {tf.SECTIONS_SQL} SELECT * FROM sections),
book_chapters AS (SELECT doc_id, coalesce(chapter, 'Nội dung') AS chapter, string_agg(content, chr(10) || chr(10) ORDER BY pos) AS content FROM book_sections GROUP BY 1, 2),
placed AS (SELECT p.*, CAST(pair_id % n AS INTEGER) AS section_pos FROM all_pairs p JOIN (SELECT doc_id, count(*) AS n FROM book_sections GROUP BY 1) USING (doc_id)),
{pairs}{rest}"""


_SOURCED = """pairs AS (SELECT p.pair_id, p.doc_id, p.level, p.question, p.answer, CASE WHEN level IN (3, 4) THEN s.content ELSE h.content END AS source, s.title AS title, p.clo
  FROM {rows} p JOIN book_sections s ON s.doc_id = p.doc_id AND s.pos = section_pos JOIN book_chapters h ON h.doc_id = p.doc_id AND h.chapter = coalesce(s.chapter, 'Nội dung'))"""


@query("i28_by_level", f"""WITH {judged_sql(_SOURCED.format(rows="placed"))} SELECT pair_id, level, question_overlap, groundedness, quality, decision,
  CASE WHEN decision = 'pass' THEN NULL ELSE coalesce(hard, 'below_threshold') END AS fail_reason FROM evaluated""")
def i28_by_level(spark, d):
    pairs, books = _placed(spark, d)
    return ops.evaluate_qa(ops.read_sources(pairs, books)).select(
        "pair_id", "level", "question_overlap", "groundedness", "quality", "decision", "fail_reason")


# A pair is a reply to its section and level, the n-th by pair number is the n-th attempt.
_ATTEMPT = "CAST(row_number() OVER (PARTITION BY doc_id, section_pos, level ORDER BY pair_id) AS INTEGER)"
_USABLE = f"""replies AS (SELECT *, {_ATTEMPT} AS attempt FROM placed),
gated AS (WITH pairs AS (SELECT p.* EXCLUDE (source, title), s.content AS source, s.title AS title FROM placed p JOIN book_sections s ON s.doc_id = p.doc_id AND s.pos = section_pos)
  {qs.ACCEPT_SQL.removeprefix(sf.QA_SQL)} SELECT pair_id, question, answer, reject_reason FROM accepted),
usable AS (SELECT p.* REPLACE (g.question AS question, g.answer AS answer) FROM placed p JOIN gated g USING (pair_id) WHERE g.reject_reason IS NULL), {_SOURCED.format(rows="usable")}"""
JUDGED_REPLIES_SQL = f"""judged_replies AS (WITH {judged_sql(_USABLE)} SELECT r.doc_id, r.section_pos, r.level, r.attempt, coalesce(e.decision = 'pass', false) AS passed,
  coalesce(g.reject_reason, CASE WHEN e.decision = 'fail' THEN coalesce(e.hard, 'below_threshold') END) AS why FROM replies r JOIN gated g USING (pair_id) LEFT JOIN evaluated e USING (pair_id))"""


def _judged(spark, d):
    pairs, books = _placed(spark, d)
    return ops.judged_replies(pairs.selectExpr(
        "doc_id", "section_pos", "level", "clo", f"{_ATTEMPT} AS attempt", f"{qs.raw_reply()} AS raw", f"{qs.NEED} AS required_points"), books)


@query("j14_verdicts", f"WITH {JUDGED_REPLIES_SQL} SELECT * FROM judged_replies")
def j14_verdicts(spark, d):
    return _judged(spark, d)


@query("j14_judged_assignment", f"WITH {JUDGED_REPLIES_SQL}, " + ASSIGN_SQL.replace(
    ATTEMPT_SQL, "firsts AS (SELECT doc_id, section_pos AS pos, level, min(attempt) AS attempt FROM judged_replies WHERE passed AND attempt <= 5 GROUP BY ALL)"))
def j14_judged_assignment(spark, d):
    """Sections go to targets by what the gates say of their replies."""
    verdicts = pl.first_pass(_judged(spark, d).withColumnRenamed("section_pos", "pos"), ["doc_id", "pos", "level"])
    return pl.assign(pl.with_verdicts(candidates(spark, d), verdicts), pl.expand_plan(plan(spark, d)))


# --- experiment reports --------------------------------------------------------------------------

EVAL = ("l_returnflag AS model", "concat('B', least(l_linenumber, 6)) AS bloom_short", "CAST(l_partkey % 4 AS INT) AS pdf",
        "concat('Chương ', l_suppkey % 5) AS source_chapter", "concat('Chương ', l_partkey % 5) AS best_bleu_chapter",
        "l_discount AS best_bleu_score", "l_discount AS bleu1_ans_chapter", "l_tax AS bleu2_ans_chapter",
        "round(l_discount * l_tax, 4) AS bleu4_ans_chapter", "round(l_tax / 2, 4) AS bleu4_ans_section",
        "l_quantity AS process_time_s", "l_suppkey % 5 = l_partkey % 5 AS is_correct")
EVAL_SQL = f"ev AS (SELECT {', '.join(EVAL)} FROM lineitem)"


def evaluated(spark, d):
    return load(spark, d, "lineitem").selectExpr(*EVAL)


_KEYS = "model, bloom_short, pdf, source_chapter"


@query("d8_bleu_report", f"""WITH {EVAL_SQL} SELECT {_KEYS}, CAST(GROUPING_ID({_KEYS}) AS INTEGER) AS "grouping", count(*) AS n, round(avg(bleu1_ans_chapter), 4) AS bleu1, round(avg(bleu2_ans_chapter), 4) AS bleu2,
  round(avg(bleu4_ans_chapter), 4) AS bleu4, round(avg(bleu4_ans_section), 4) AS bleu4_section, round(avg(process_time_s), 4) AS seconds
FROM ev GROUP BY GROUPING SETS ((model), (model, bloom_short), (model, pdf), (pdf, source_chapter), ())""")
def d8_bleu_report(spark, d):
    return an.bleu_report(evaluated(spark, d))


@query("d9_bleu_matrix", f"""WITH {EVAL_SQL} SELECT bloom_short, round(avg(bleu4_ans_chapter) FILTER (model = 'A'), 4) AS "A", round(avg(bleu4_ans_chapter) FILTER (model = 'N'), 4) AS "N",
  round(avg(bleu4_ans_chapter) FILTER (model = 'R'), 4) AS "R" FROM ev GROUP BY 1""")
def d9_bleu_matrix(spark, d):
    return an.bleu_matrix(evaluated(spark, d), "bleu4_ans_chapter", ["A", "N", "R"])


@query("d10_success_rate", f"""WITH {EVAL_SQL}, p AS (SELECT CASE p_size % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'N' ELSE 'R' END AS model, sum(p_size) AS target FROM part GROUP BY 1),
r AS (SELECT model, target, coalesce(done, 0) AS done FROM p LEFT JOIN (SELECT model, count(*) AS done FROM ev GROUP BY 1) USING (model))
SELECT model, CAST(sum(target) AS BIGINT) AS target, CAST(sum(done) AS BIGINT) AS done, CASE WHEN sum(target) > 0 THEN round(100.0 * sum(done) / sum(target), 1) ELSE 0 END AS rate
FROM r GROUP BY GROUPING SETS ((model), ())""")
def d10_success_rate(spark, d):
    plan_rows = load(spark, d, "part").selectExpr(
        "CASE p_size % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'N' ELSE 'R' END AS model", "p_size AS target")
    return an.success_rate(evaluated(spark, d), plan_rows)


@query("d11_attribution_accuracy", f"""WITH {EVAL_SQL} SELECT {_KEYS}, CAST(GROUPING_ID({_KEYS}) AS INTEGER) AS "grouping", count(*) AS n, CAST(count_if(is_correct) AS BIGINT) AS correct,
  round(100.0 * count_if(is_correct) / count(*), 1) AS accuracy FROM ev GROUP BY GROUPING SETS ((model), (model, bloom_short), (pdf, source_chapter), ())""")
def d11_attribution_accuracy(spark, d):
    return an.attribution_accuracy(evaluated(spark, d))


@query("d11_attribution_errors", f"""WITH {EVAL_SQL} SELECT model, pdf, bloom_short, source_chapter, best_bleu_chapter, best_bleu_score FROM ev WHERE NOT is_correct""")
def d11_attribution_errors(spark, d):
    return an.attribution_errors(evaluated(spark, d))


# The same reports over the scored answers.
SCORED_SQL = f"{ANSWERS_SQL}, ev AS (SELECT *, {', '.join(_MODEL)} FROM answers)"


def _scored(spark, d):
    return _reported(spark, d).selectExpr("*", *_MODEL)


@query("d8_answer_bleu", f"""WITH {SCORED_SQL} SELECT {_KEYS}, CAST(GROUPING_ID({_KEYS}) AS INTEGER) AS "grouping", count(*) AS n, round(avg(bleu1_ans_chapter), 10) AS bleu1, round(avg(bleu2_ans_chapter), 10) AS bleu2,
  round(avg(bleu4_ans_chapter), 10) AS bleu4, round(avg(bleu4_ans_section), 10) AS bleu4_section, round(avg(process_time_s), 10) AS seconds
FROM ev GROUP BY GROUPING SETS ((model), (model, bloom_short), (model, pdf), (pdf, source_chapter), ())""")
def d8_answer_bleu(spark, d):
    return an.bleu_report(_scored(spark, d), 10)


@query("d9_answer_matrix", f"""WITH {SCORED_SQL} SELECT bloom_short, round(avg(bleu4_q_chapter) FILTER (model = 'A'), 10) AS "A", round(avg(bleu4_q_chapter) FILTER (model = 'N'), 10) AS "N",
  round(avg(bleu4_q_chapter) FILTER (model = 'R'), 10) AS "R" FROM ev GROUP BY 1""")
def d9_answer_matrix(spark, d):
    return an.bleu_matrix(_scored(spark, d), "bleu4_q_chapter", ["A", "N", "R"], 10)


@query("d11_answer_accuracy", f"""WITH {SCORED_SQL} SELECT {_KEYS}, CAST(GROUPING_ID({_KEYS}) AS INTEGER) AS "grouping", count(*) AS n, CAST(count_if(is_correct) AS BIGINT) AS correct,
  round(100.0 * count_if(is_correct) / count(*), 1) AS accuracy FROM ev GROUP BY GROUPING SETS ((model), (model, bloom_short), (pdf, source_chapter), ())""")
def d11_answer_accuracy(spark, d):
    return an.attribution_accuracy(_scored(spark, d))


_SYS = "CAST(1 + doc_id % 6 AS INT)"
JUDGED = ("doc_id", f"{_SYS} AS sys_bloom_int", "CAST(quality AS INT) AS quality",
          *[f"CASE WHEN doc_id % 17 = {j} THEN NULL WHEN (doc_id * {j + 3}) % 5 < 3 THEN {_SYS} ELSE 1 + ({_SYS} % 6) END AS bloom_pred_{j}" for j in range(3)])
PREDS = [f"bloom_pred_{j}" for j in range(3)]
JUDGED_SQL = f"""ju AS (SELECT {', '.join(JUDGED)} FROM labels),
jv AS (SELECT *, {", ".join(f"coalesce(bloom_pred_{j} = sys_bloom_int, false) AS agree_{j}" for j in range(3))} FROM ju),
jw AS (SELECT *, CAST(CAST(agree_0 AS INT) + CAST(agree_1 AS INT) + CAST(agree_2 AS INT) AS INTEGER) AS n_agree FROM jv)"""
_AGREE = ("count(*) AS n, " + ", ".join(f"CAST(count_if(n_agree = {k}) AS BIGINT) AS agree_{k}" for k in range(4))
          + ", round(100.0 * count_if(n_agree >= 2) / count(*), 1) AS acc2, round(100.0 * count_if(n_agree = 3) / count(*), 1) AS acc3")


def judged(spark, d):
    return an.judge_agreement(load(spark, d, "labels").selectExpr(*JUDGED), PREDS)


@query("d12_judge_agreement", f"WITH {JUDGED_SQL} SELECT doc_id, sys_bloom_int, agree_0, agree_1, agree_2, n_agree, n_agree >= 2 AS is_2llm, n_agree = 3 AS is_3llm FROM jw")
def d12_judge_agreement(spark, d):
    return judged(spark, d).select("doc_id", "sys_bloom_int", "agree_0", "agree_1", "agree_2", "n_agree", "is_2llm", "is_3llm")


@query("d13_agreement_per_level", f"WITH {JUDGED_SQL} SELECT sys_bloom_int, {_AGREE} FROM jw GROUP BY 1")
def d13_agreement_per_level(spark, d):
    return an.agreement_report(judged(spark, d), ["sys_bloom_int"])


@query("d13_agreement_per_document", f"WITH {JUDGED_SQL} SELECT quality, {_AGREE} FROM jw GROUP BY 1")
def d13_agreement_per_document(spark, d):
    return an.agreement_report(judged(spark, d), ["quality"])


_JUDGES = " UNION ALL ".join(f"SELECT sys_bloom_int, {j} AS judge, agree_{j} AS agree FROM jw" for j in range(3))


@query("d13_judges", f"WITH {JUDGED_SQL}, u AS ({_JUDGES}) SELECT judge, count(*) AS n, CAST(count_if(agree) AS BIGINT) AS agreed, round(100.0 * count_if(agree) / count(*), 1) AS rate FROM u GROUP BY 1")
def d13_judges(spark, d):
    return an.judge_report(judged(spark, d), 3, [])


@query("d13_judges_per_level", f"WITH {JUDGED_SQL}, u AS ({_JUDGES}) SELECT judge, sys_bloom_int, count(*) AS n, CAST(count_if(agree) AS BIGINT) AS agreed, round(100.0 * count_if(agree) / count(*), 1) AS rate FROM u GROUP BY ALL")
def d13_judges_per_level(spark, d):
    return an.judge_report(judged(spark, d), 3, ["sys_bloom_int"])
