"""Question-answer pairs made from conversations and documents, and scoring SQL for the oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coursebank import lexicons as lx
from coursebank.functions.text import lit_array
from coursebank.operators.structure import computed_once
from coursebank.plans.text_fixtures import quoted, sql_any, sql_hits, sql_math, sql_strip, sql_tokens
from coursebank.sources.tables import dealt, load, spread

STEMS = (
    "Liệt kê các thành phần của", "Nêu định nghĩa", "Phân tích các", "Tại sao", "Giải thích ý nghĩa của", "Mô tả",
    "So sánh ưu nhược điểm", "Giả sử một doanh nghiệp, áp dụng", "Vận dụng quy trình", "Hãy mô tả",
    "Trong trường hợp nào", "Phân tích mối quan hệ", "Đánh giá hiệu quả", "Nhận xét về", "Đề xuất giải pháp cho",
    "Thiết kế hệ thống", "List and define", "Explain", "Xây dựng bộ câu hỏi về", "Apply, in order to solve,",
)
TITLES = (
    "Khái niệm", "Bước 1 chuẩn bị", "Bước 2 phân tích định tính", "Bước 3 chỉ số KPI", "Vai trò chính",
    "Khả năng mở rộng", "Ý nghĩa", "Phân tích định lượng", "Lợi ích", "Đề xuất cải tiến", "Hạn chế", "Thang đo Bloom",
    "Thực hiện",
)
OUTCOMES = (
    "", "Trình bày khái niệm và mô hình cơ bản", "Phân tích rủi ro an ninh trong thanh toán", "  ",
    "Vận dụng quy trình và đánh giá lợi ích, hạn chế", "So sánh thuật ngữ with model the and ertion",
)


def qa_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs (pair_id, level, question, answer, source, title, clo): a talk's turns against the document of its number."""
    talk, docs = spread(load(spark, sf_dir, "conversations")), load(spark, sf_dir, "documents")
    asked = talk.where("role = 'user'").select("conv_id", "turn")
    said = talk.where("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("said"))
    rows = asked.join(said, ["conv_id", "turn"]).join(
        docs.select(F.col("doc_id").alias("conv_id"), F.col("text").alias("source")), "conv_id")
    rows = computed_once(dealt(rows), ["conv_id", "turn", "said", "source"], {
        "k": F.col("conv_id") + F.floor(F.col("turn") / 2),
        "ss": F.regexp_extract_all("source", F.lit(r"([^.!?\n:]+[.!?])"), F.lit(1)),
        "aa": F.regexp_extract_all("said", F.lit(r"([^.!?\n:]+[.!?])"), F.lit(1))})
    k = F.col("k")

    def pick(values, index):
        return F.get(lit_array(values), (index % len(values)).cast("int"))

    def point(i):
        title = pick(TITLES, k * 3 + i * 5)
        same = F.get("ss", F.floor((i + 1) / 2).cast("int"))
        own, other = F.get("ss", i), F.get("aa", i)
        body = F.when(k % 5 == 2, same).when((k + i) % 4 == 0, other).when((k + i) % 7 == 1, title).otherwise(own)
        return F.concat(F.lit("- "), title, F.lit(": "), F.trim(F.coalesce(body, F.lit("bao gồm các hoạt động như"))))

    points = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(5)), point), "\n")
    lead = F.trim(F.substring(F.replace("source", F.lit("\n"), F.lit(" ")), 1, 60))
    return rows.select(
        (F.col("conv_id") * 8 + F.col("turn")).alias("pair_id"), F.col("conv_id").alias("doc_id"),
        ((k * 7 + F.floor(k / 6)) % 6 + 1).cast("int").alias("level"),
        F.concat(pick(STEMS, k * 3 + F.floor(k / 20)), F.lit(" "), lead, F.lit("?")).alias("question"),
        F.when(k % 11 == 0, F.col("said")).otherwise(points).alias("answer"), "source",
        pick(TITLES, k).alias("title"), pick(OUTCOMES, k).alias("clo"))


_BODY = ("CASE WHEN k % 5 = 2 THEN ss[(i + 1) // 2 + 1] WHEN (k + i) % 4 = 0 THEN aa[i + 1] "
         "WHEN (k + i) % 7 = 1 THEN {t} ELSE ss[i + 1] END")
_TITLE = f"{quoted(TITLES)}[(k * 3 + i * 5) % {len(TITLES)} + 1]"

QA_SQL = f"""qa0 AS (SELECT u.conv_id, u.turn, a.text AS said, d.text AS source, u.conv_id + u.turn // 2 AS k,
    regexp_extract_all(d.text, '[^.!?\\n:]+[.!?]') AS ss, regexp_extract_all(a.text, '[^.!?\\n:]+[.!?]') AS aa
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 JOIN documents d ON d.doc_id = u.conv_id
  WHERE u.role = 'user' AND a.role = 'assistant'),
pairs AS (SELECT conv_id * 8 + turn AS pair_id, conv_id AS doc_id, CAST((k * 7 + k // 6) % 6 + 1 AS INTEGER) AS level,
    {quoted(STEMS)}[(k * 3 + k // 20) % {len(STEMS)} + 1] || ' ' || trim(substring(replace(source, chr(10), ' '), 1, 60)) || '?' AS question,
    CASE WHEN k % 11 = 0 THEN said ELSE array_to_string(list_transform(range(1, 6), lambda i: '- ' || {_TITLE} || ': '
      || trim(coalesce({_BODY.format(t=_TITLE)}, 'bao gồm các hoạt động như'))), chr(10)) END AS answer, source,
    {quoted(TITLES)}[k % {len(TITLES)} + 1] AS title, {quoted(OUTCOMES)}[k % {len(OUTCOMES)} + 1] AS clo FROM qa0)"""


def sql_content(x: str, k: int) -> str:
    return f"list_filter({sql_tokens(x, k)}, lambda w: NOT list_contains({quoted(lx.STOP_WORDS)}, w))"


def sql_grams(toks: str, n: int) -> str:
    return f"list_transform(range(1, greatest(len({toks}) - {n - 2}, 1)), lambda i: array_to_string({toks}[i:i + {n - 1}], ' '))"


def sql_share(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) > 0 THEN len(list_intersect({a}, {b})) / len(list_distinct({a})) ELSE 0 END"


def sql_plain(x: str) -> str:
    return sql_strip(f"regexp_replace(lower({x}), '\\s+', ' ', 'g')")


def sql_points(x: str) -> str:
    pat = "^-\\s*([^:]+):\\s*(.+)"
    line = f"list_filter(list_transform(regexp_split_to_array({x}, '\\r\\n|\\r|\\n'), lambda l: {sql_strip('l')}), lambda l: l LIKE '-%')"
    return (f"list_transform({line}, lambda l: {{'t': CASE WHEN regexp_matches(l, '{pat}') THEN {sql_strip(f'regexp_extract(l, {chr(39)}{pat}{chr(39)}, 1)')} ELSE '' END, "
            f"'c': CASE WHEN regexp_matches(l, '{pat}') THEN {sql_strip(f'regexp_extract(l, {chr(39)}{pat}{chr(39)}, 2)')} ELSE {sql_strip('regexp_replace(l, ' + chr(39) + '^[- ]+' + chr(39) + ', ' + chr(39) * 2 + ')')} END}})")


def sql_anchor(points: str, source: str, terms: str) -> str:
    blob = "lower(p.t || ' ' || p.c)"
    return (f"CASE WHEN {source} = '' OR len({points}) = 0 THEN 0 WHEN len({terms}) = 0 THEN 0.5 ELSE "
            f"len(list_filter({points}, lambda p: len(list_filter({terms}, lambda t: length(t) >= 5 AND contains({blob}, t))) > 0 "
            f"OR len(list_filter({terms}, lambda t: contains({blob}, t))) >= 2)) / len({points}) END")


# Points as rows, with what the tautology rule needs.
POINT_ROWS = f"""
base AS (SELECT *, lower(question) AS q, lower(answer) AS a, {sql_points('answer')} AS points FROM pairs),
pr AS (SELECT pair_id, unnest(range(1, len(points) + 1)) AS i, unnest(points) AS p FROM base),
pr2 AS (SELECT pair_id, i, p.t AS title, p.c AS content, {sql_plain('p.t')} AS t, {sql_plain('p.c')} AS c FROM pr),
pr3 AS (SELECT *, CASE WHEN t <> '' AND contains(c, t) THEN substring(c, 1, strpos(c, t) - 1) || ' ' || substring(c, strpos(c, t) + length(t)) ELSE c END AS r0 FROM pr2),
pr4 AS (SELECT *, trim(regexp_replace(trim(regexp_replace(r0, '^({"|".join(lx.FILLER_HEADS)})\\s+', ''), ' .,:;-'), '({"|".join(lx.FILLER_TAILS)})\\.?$', ''), ' .,:;-') AS r FROM pr3),
pr5 AS (SELECT *, len(list_filter({sql_tokens('r', 2)}, lambda w: NOT list_contains({quoted(lx.STOP_WORDS + lx.FILLER_WORDS)}, w))) AS nw FROM pr4),
pr6 AS (SELECT *, t <> '' AND c <> '' AND t <> c AND ((length(r) >= 10 AND nw >= 2) OR (length(c) >= 35 AND nw >= 3)) AS info FROM pr5),
pr7 AS (SELECT *, t = '' OR c = '' OR t = c OR (c LIKE '{lx.SUCH_AS_FILLER}%' AND contains(c, t)) OR (length(c) <= length(t) + 5 AND contains(c, t)) OR NOT info AS bad FROM pr6),
taut AS (SELECT pair_id, greatest(0.1, 1 - count_if(bad) / count(*) * 0.92) AS tautology FROM pr7 GROUP BY pair_id)"""

_PHRASE = ("list_filter(list_transform(range(1, greatest(len(x.ws) - {m}, 1)), lambda i: array_to_string(x.ws[i:i + {l}], ' ')), lambda h: length(h) >= 8 "
           f"AND NOT list_contains({quoted(lx.GENERIC_PHRASES)}, h) AND contains(y.tx, h) "
           f"AND len(list_filter(string_split(h, ' '), lambda w: length(w) >= 4 AND NOT list_contains({quoted(lx.STOP_WORDS)}, w))) > 0)[1]")

OVERLAP_ROWS = f"""
pf AS (SELECT pair_id, i, {sql_plain("title || ' ' || content")} AS tx,
    list_distinct(list_filter({sql_tokens('content', 3)}, lambda w: NOT list_contains({quoted(lx.STOP_WORDS + lx.WEAK_CONTENT_WORDS)}, w))) AS body,
    list_distinct(list_filter({sql_tokens('title', 3)}, lambda w: NOT list_contains({quoted(lx.WEAK_TITLE_WORDS)}, w))) AS head FROM pr2),
pf2 AS (SELECT *, list_filter(regexp_split_to_array(tx, '\\s+'), lambda w: w <> '') AS ws FROM pf),
po AS (SELECT x.pair_id, x.tx = '' OR y.tx = '' AS blank, least(1.0, coalesce({", ".join("length(" + _PHRASE.format(m=n - 2, l=n - 1) + ")" for n in (5, 4, 3, 2))}, 0) / 28) AS phrase,
    CASE WHEN len(x.body) > 0 AND len(y.body) > 0 THEN len(list_intersect(x.body, y.body)) / len(list_distinct(list_concat(x.body, y.body))) ELSE 0 END AS jb,
    CASE WHEN len(x.head) > 0 AND len(y.head) > 0 THEN len(list_intersect(x.head, y.head)) / len(list_distinct(list_concat(x.head, y.head))) ELSE 0 END AS jh,
    least(0.55, len(list_filter(list_intersect(x.body, y.body), lambda w: length(w) >= 5)) * 0.22) AS theme,
    len(x.head) > 0 AND len(y.head) > 0 AS heads FROM pf2 x JOIN pf2 y ON x.pair_id = y.pair_id AND x.i < y.i),
po2 AS (SELECT *, greatest(phrase, CASE WHEN jb >= 0.38 THEN jb * 0.82 ELSE 0 END, CASE WHEN jh >= 0.55 THEN jh * 0.40 ELSE 0 END, CASE WHEN theme >= 0.30 THEN theme ELSE 0 END) AS raised FROM po),
po3 AS (SELECT pair_id, CASE WHEN blank THEN 0 ELSE round(least(CASE WHEN heads AND jh < 0.32 THEN round(CAST(raised * 0.58 AS DOUBLE), 4) ELSE raised END, 1.0), 4) END AS ov FROM po2),
ovl AS (SELECT pair_id, CAST(max(ov) AS DOUBLE) AS point_overlap FROM po3 GROUP BY pair_id)"""

DIVERSITY = ("round(CASE WHEN n_points < 2 THEN 1.0 WHEN o >= 0.72 THEN 0.20 WHEN o >= 0.55 THEN greatest(0.30, 0.98 - o * 0.80) "
             "WHEN o >= 0.40 THEN greatest(0.45, 1 - o * 0.60) WHEN o >= 0.28 THEN greatest(0.58, 0.95 - o * 0.50) ELSE greatest(0.78, 1 - o * 0.35) END, 4)")

_END = "(?:[^\\p{L}\\p{N}_]|$)"
DRIFT = "(" + " OR ".join(f"regexp_matches(q, '{p}{_END}')" for p in lx.LEVEL3_DRIFT) + ")"
SCENARIO = (f"CASE WHEN {DRIFT} THEN 0.25 WHEN {sql_any('q', lx.LEVEL3_VERBS)} AND {sql_any('q', lx.LEVEL3_SCENARIOS)} THEN 1.0 "
            f"WHEN {sql_any('q', lx.LEVEL3_VERBS)} THEN 0.58 WHEN {sql_any('q', lx.LEVEL3_SCENARIOS)} THEN 0.5 ELSE 0.38 END")
_START = f"regexp_matches(trim(q), '^(phân tích|đánh giá|so sánh){_END}')"
RULE_REASON = (
    f"CASE WHEN level = 1 THEN CASE WHEN {sql_any('q', lx.LEVEL1_OFF_LEVEL)} THEN 'off_level' WHEN {_START} THEN 'off_level_start' "
    f"WHEN contains(' ' || trim(q), ' tại sao') THEN 'asks_why' WHEN NOT {sql_any('trim(q)', lx.LEVEL1_VERBS)} THEN 'verb_missing' ELSE 'ok' END "
    f"WHEN level = 2 THEN CASE WHEN {sql_any('q', lx.LEVEL2_OFF_LEVEL)} THEN 'off_level' WHEN {_START} THEN 'off_level_start' "
    f"WHEN NOT {sql_any('q', lx.LEVEL2_VERBS)} THEN 'verb_missing' ELSE 'ok' END "
    f"WHEN level = 3 THEN CASE WHEN {sql_any('q', lx.LEVEL3_OFF_LEVEL)} THEN 'off_level' WHEN {sql_any('q', lx.LEVEL3_META)} THEN 'meta' "
    f"WHEN {DRIFT} THEN 'describes_only' ELSE 'ok' END ELSE 'ok' END")
RULE_SCORE = ("CASE WHEN level = 1 THEN CASE question_reason WHEN 'off_level' THEN 0.12 WHEN 'off_level_start' THEN 0.15 WHEN 'asks_why' THEN 0.15 WHEN 'verb_missing' THEN 0.22 ELSE 0.95 END "
              "WHEN level = 2 THEN CASE question_reason WHEN 'off_level' THEN 0.18 WHEN 'off_level_start' THEN 0.15 WHEN 'verb_missing' THEN 0.22 ELSE 0.95 END "
              "WHEN level = 3 THEN CASE question_reason WHEN 'off_level' THEN 0.15 WHEN 'meta' THEN 0.12 WHEN 'describes_only' THEN 0.20 ELSE scenario0 END ELSE 1.0 END")

_T = "lower(p.t)"
_STEP = "^bước\\s*\\d+\\s*(.*)$"
_NAMED = " OR ".join(f"{_T} = '{b}' OR {_T} LIKE '{b}:%' OR {_T} LIKE '{b} %'" for b in lx.LEVEL3_FORBIDDEN_TITLES)
_STARTED = " OR ".join(f"{_T} LIKE '{s}%'" for s in lx.LEVEL3_TITLE_STARTS)
_BARE = f"trim(regexp_extract({_T}, '{_STEP}', 1))"
STEP_REASON = (
    f"CASE WHEN len(points) = 0 THEN 'no_points' WHEN {sql_any('a', lx.ANSWER_META)} THEN 'meta' "
    f"WHEN len(list_filter(points, lambda p: NOT regexp_matches({_T}, '{_STEP}') AND ({_NAMED} OR {_STARTED}))) > 0 THEN 'template_title' "
    f"WHEN len(list_filter(points, lambda p: regexp_matches({_T}, '{_STEP}') AND (list_contains({quoted(lx.LEVEL3_BARE_TITLES)}, {_BARE}) OR {_BARE} LIKE '{lx.LEVEL3_TITLE_STARTS[0]}%'))) "
    f">= greatest(2, len(points) // 2) THEN 'template_steps' ELSE 'ok' END")
VERB = "CASE WHEN " + " OR ".join(f"(level = {k} AND {sql_any('q', v)})" for k, v in lx.LEVEL_VERBS.items()) + " THEN 0.9 ELSE 0.35 END"
ACTION = ("CASE WHEN len(points) = 0 THEN 0 ELSE len(list_filter(points, lambda p: "
          + sql_any("lower(p.t || ' ' || p.c)", lx.ACTION_MARKERS) + ")) / len(points) END")
_N = sql_hits("a", lx.TEMPLATE_MARKERS)
TEMPLATE = (
    f"CASE WHEN level = 3 THEN step_reason <> 'ok' WHEN level >= 5 THEN {sql_any('a', lx.ANSWER_META)} "
    f"WHEN level = 4 THEN {_N} >= 5 OR ({_N} >= 4 AND anchor < 0.22) OR ({_N} >= 3 AND anchor < 0.24) "
    f"ELSE (contains(a, 'phân tích định tính') AND contains(a, 'phân tích định lượng')) OR (contains(a, 'qualitative analysis') AND contains(a, 'quantitative analysis')) "
    f"OR {sql_hits('a', lx.GENERIC_TEMPLATES)} >= 3 OR {_N} >= 4 OR ({_N} >= 2 AND anchor < 0.34) END")

SCORES_SQL = f"""{QA_SQL}, {POINT_ROWS}, {OVERLAP_ROWS},
tk AS (SELECT *, {sql_content(sql_math('answer'), 2)} AS a2, {sql_content(sql_math('source'), 2)} AS s2, {sql_content('question', 2)} AS q2, {sql_content('source', 2)} AS sp2,
    {sql_content('answer', 3)} AS a3, {sql_content('source', 3)} AS s3, list_distinct({sql_content('source', 4)}) AS s4 FROM base),
st AS (SELECT pair_id, list(w) AS rep FROM (SELECT pair_id, unnest(s3) AS w FROM tk GROUP BY pair_id, s3, w HAVING true) GROUP BY pair_id),
rep AS (SELECT pair_id, list(w) AS terms FROM (SELECT pair_id, w FROM (SELECT pair_id, unnest(s3) AS w FROM tk) GROUP BY pair_id, w HAVING count(*) >= 2) GROUP BY pair_id),
tm AS (SELECT tk.*, coalesce(rep.terms, list_distinct(list_filter(s3, lambda w: length(w) >= 4))) AS terms FROM tk LEFT JOIN rep USING (pair_id)),
sc1 AS (SELECT tm.*, CAST(len(points) AS INTEGER) AS n_points, round({sql_share('q2', 'sp2')}, 4) AS question_overlap,
    round(least(0.20 * ({sql_share('a2', 's2')}) + 0.30 * ({sql_share(sql_grams('a2', 2), sql_grams('s2', 2))}) + 0.30 * ({sql_share(sql_grams('a2', 3), sql_grams('s2', 3))})
      + 0.20 * ({sql_share(sql_grams('a2', 4), sql_grams('s2', 4))}), 1.0), 4) AS ngram_score,
    CASE WHEN len(terms) = 0 THEN 0.5 WHEN len(a3) = 0 THEN 0 ELSE round(len(list_filter(a3, lambda w: list_contains(terms, w))) / len(a3), 4) END AS concept_score,
    CAST({sql_anchor('points', 'source', 's4')} AS DOUBLE) AS anchor, coalesce(tautology, 1.0) AS tautology, coalesce(point_overlap, 0) AS o,
    {VERB} AS verb, {SCENARIO} AS scenario0, CAST({ACTION} AS DOUBLE) AS action,
    CASE WHEN level = 6 AND NOT {sql_any('a', lx.CREATIVE_VERBS)} THEN 0.25 ELSE 1.0 END AS creative, {RULE_REASON} AS question_reason, {STEP_REASON} AS step_reason
  FROM tm LEFT JOIN taut USING (pair_id) LEFT JOIN ovl USING (pair_id)),
scores AS (SELECT *, CASE WHEN level = 3 THEN scenario0 ELSE 1.0 END AS scenario, o AS point_overlap, {DIVERSITY} AS diversity, question_reason = 'ok' AS question_ok,
    {RULE_SCORE} AS question_score, {TEMPLATE} AS template, step_reason = 'ok' AS step_ok, CASE WHEN level <= 3 THEN concept_score ELSE 1.0 END AS key_terms,
    CASE WHEN level >= 5 THEN concept_score ELSE round(greatest(ngram_score, concept_score * CASE WHEN level <= 2 THEN 0.92 WHEN level = 3 THEN 0.90 ELSE 0.95 END), 4) END AS groundedness FROM sc1)"""
SCORES_SQL = "\n".join(line for line in SCORES_SQL.split("\n") if not line.startswith("st AS"))


def _aspect_list(x: str, which: int) -> str:
    return ("list_filter([" + ", ".join(f"CASE WHEN {sql_any(x, v[which])} THEN '{k}' END" for k, v in lx.CLO_ASPECTS.items())
            + "], lambda z: z IS NOT NULL)")


_SKILLS = quoted(lx.SKILL_ASPECTS)


def gap_sql(table: str, key: str) -> str:
    """CTEs from ``table`` (question, answer, clo, title, source, level) to ``gaps`` and ``verdicts``."""
    return f"""
ga AS (SELECT *, {_aspect_list('lower(clo)', 0)} AS aspects, {_aspect_list("lower(coalesce(question, ''))", 1)} AS gq, {_aspect_list("lower(coalesce(answer, ''))", 1)} AS gan,
    {_aspect_list("lower(coalesce(question, '') || chr(10) || coalesce(answer, ''))", 1)} AS gqa,
    {_aspect_list("lower(title || chr(10) || source)", 1)} AS gs FROM {table}),
gb AS (SELECT *, list_filter(aspects, lambda z: list_contains({_SKILLS}, z)) AS skills, list_filter(aspects, lambda z: NOT list_contains({_SKILLS}, z)) AS t0 FROM ga),
gc AS (SELECT *, list_filter(t0, lambda z: list_contains(gqa, z) OR list_contains(gs, z)) AS rel FROM gb),
gd AS (SELECT *, CASE WHEN level > 2 OR len(t0) = 0 THEN t0 WHEN len(rel) > 0 THEN rel
    WHEN list_contains(t0, 'khai_niem') AND {sql_any('lower(title)', lx.CONCEPT_FALLBACK_TITLES)} THEN ['khai_niem']
    WHEN list_contains(t0, 'mo_hinh') AND contains(lower(title), 'mô hình') THEN ['mo_hinh']
    WHEN list_contains(t0, 'thuat_ngu') AND contains(lower(title), 'thuật ngữ') THEN ['thuat_ngu'] ELSE t0[1:1] END AS topics FROM gc),
ge AS (SELECT *, list_filter(aspects, lambda z: list_contains(gq, z)) AS q_hit, list_filter(aspects, lambda z: list_contains(gan, z)) AS a_hit,
    list_filter(topics, lambda z: list_contains(gq, z) OR list_contains(gan, z)) AS content_hit FROM gd),
gaps AS (SELECT *, list_filter(topics, lambda z: NOT list_contains(content_hit, z)) AS content_missing,
    CASE WHEN len(aspects) > 0 THEN len(q_hit) / len(aspects) ELSE 0 END AS q_cov, CASE WHEN len(topics) > 0 THEN len(content_hit) / len(topics) ELSE 1 END AS c_cov,
    CASE WHEN len(topics) > 0 THEN len(list_intersect(topics, a_hit)) / len(topics) ELSE 1 END AS ac_cov FROM ge),
verdicts AS (SELECT {key}, CASE WHEN len(aspects) = 0 THEN 'ok'
  WHEN len(list_filter(skills, lambda z: NOT (list_contains(q_hit, z) OR (level = 3 AND z = 'van_dung') OR (level = 4 AND z = 'phan_tich') OR (level >= 5 AND z = 'danh_gia')
    OR (level >= 4 AND z IN ('phan_tich', 'so_sanh'))))) > 0 THEN 'skill_missing'
  WHEN len(topics) = 0 THEN 'ok' WHEN level <= 2 THEN CASE WHEN len(content_hit) < 1 THEN 'topic_missing' ELSE 'ok' END
  WHEN c_cov < 0.34 THEN 'topic_missing'
  WHEN level <= 4 THEN CASE WHEN ac_cov < 0.34 AND len(content_hit) < greatest(1, len(topics) // 2) THEN 'answer_topic_missing' ELSE 'ok' END
  WHEN ac_cov < 0.34 THEN 'answer_topic_missing' WHEN len(list_intersect(q_hit, topics)) = 0 AND q_cov < 0.34 THEN 'question_topic_missing' ELSE 'ok' END AS verdict FROM gaps)"""


EVALUATE_SQL = f"""{SCORES_SQL}, {gap_sql("pairs", "pair_id")},
ev0 AS (SELECT s.*, CASE WHEN trim(s.clo) = '' THEN 'ok' ELSE verdict END AS verdict,
    CASE WHEN level >= 5 AND length({sql_strip('source')}) <= 300 THEN 0.05 ELSE CASE level {" ".join(f"WHEN {k} THEN {v}" for k, v in lx.HARD_FLOORS.items())} END END AS floor,
    CASE WHEN level <= 2 THEN o >= 0.62 AND diversity < 0.24 WHEN level = 3 THEN o >= 0.74 AND diversity < 0.14 WHEN level = 4 THEN o >= 0.76 AND diversity < 0.12 ELSE o >= 0.78 AND diversity < 0.10 END AS alike
  FROM scores s JOIN verdicts USING (pair_id)),
ev1 AS (SELECT *, CASE WHEN level <= 3 AND NOT question_ok THEN 'question_off_level' WHEN template THEN 'template_answer'
    WHEN level = 2 AND anchor < 0.38 THEN 'few_source_terms' WHEN level = 3 AND anchor < 0.22 THEN 'few_source_terms' WHEN level = 3 AND action < 0.15 THEN 'no_action'
    WHEN level = 3 AND NOT step_ok THEN 'answer_rule' WHEN (level = 1 AND key_terms < 0.38) OR (level = 2 AND key_terms < 0.28) THEN 'few_key_terms'
    WHEN groundedness < floor THEN 'not_grounded' WHEN (level = 1 AND tautology < 0.78) OR (level = 2 AND tautology < 0.62) THEN 'tautological'
    WHEN level = 3 AND (scenario < 0.22 OR tautology < 0.28 OR groundedness < 0.22 OR key_terms < 0.15 OR question_overlap < 0.18) THEN 'level3_floor'
    WHEN alike THEN 'points_alike' WHEN verdict <> 'ok' THEN 'outcome_missed' END AS hard FROM ev0),
ev2 AS (SELECT *, round(CAST(CASE hard WHEN 'question_off_level' THEN question_score WHEN 'template_answer' THEN 0.12 WHEN 'few_source_terms' THEN anchor WHEN 'no_action' THEN action
    WHEN 'answer_rule' THEN 0.10 WHEN 'few_key_terms' THEN key_terms WHEN 'not_grounded' THEN groundedness WHEN 'tautological' THEN tautology
    WHEN 'level3_floor' THEN least(scenario, tautology, groundedness, key_terms, question_overlap) WHEN 'points_alike' THEN least(diversity, 1 - o) WHEN 'outcome_missed' THEN 0.12
    ELSE greatest(0, least(1, CASE level WHEN 6 THEN question_overlap * 0.18 + groundedness * 0.23 + verb * 0.27 + creative * 0.22 + diversity * 0.10
      WHEN 5 THEN question_overlap * 0.22 + groundedness * 0.36 + verb * 0.32 + diversity * 0.10 WHEN 4 THEN question_overlap * 0.22 + groundedness * 0.50 + verb * 0.18 + diversity * 0.10
      WHEN 3 THEN groundedness * 0.36 + key_terms * 0.18 + question_overlap * 0.13 + scenario * 0.10 + tautology * 0.08 + diversity * 0.10 + verb * 0.05
      ELSE groundedness * 0.38 + tautology * 0.28 + key_terms * 0.14 + question_overlap * 0.10 + diversity * 0.05 + verb * 0.05 END)) END AS DOUBLE), 4) AS quality FROM ev1),
evaluated AS (SELECT *, CASE WHEN hard IS NULL AND quality >= CASE WHEN level <= 2 THEN 0.52 WHEN level <= 4 THEN 0.44 ELSE 0.45 END THEN 'pass' ELSE 'fail' END AS decision FROM ev2)"""


def outcome_of(doc_id):
    """Learning outcome attached to a document."""
    return F.get(lit_array(OUTCOMES), (doc_id % len(OUTCOMES)).cast("int"))


_CT = "regexp_extract_all(lower({x}), '[\\p{{L}}\\p{{N}}_À-ỹ]{{3,}}')"


def clo_terms_sql(x: str) -> str:
    return f"list_distinct(list_filter({_CT.format(x=x)}, lambda w: NOT list_contains({quoted(lx.CLO_STOP_WORDS)}, w)))"


# ``gated`` sections with outcome, ceiling and chapter size; built on the CTE ``sections``.
_LT, _LO = "lower(title)", "lower(clo)"
_TOPICS = "(" + " + ".join(
    f"CAST({sql_any(_LO, v[0])} AND {sql_any('lower(title || chr(10) || content)', v[0])} AS INT)" for v in lx.CLO_TOPICS.values()) + ")"
_PENALTY = (
    f"(CASE WHEN regexp_matches({_LT}, '^(chương|chapter)\\s*[\\divxlcdm]+') AND length({sql_strip('content')}) < 1500 THEN 0.40 ELSE 0 END "
    f"+ CASE WHEN {sql_any(_LO, lx.CLO_CONCEPT)} AND {sql_any(_LT, lx.CLO_BUILD_TITLES)} THEN 0.30 ELSE 0 END "
    f"+ CASE WHEN {sql_any(_LO, lx.CLO_CONCEPT)} AND {sql_any(_LT, lx.CLO_ADVANCED_TITLES)} AND NOT {sql_any(_LT, lx.CLO_BASIC_TITLES)} THEN 0.35 ELSE 0 END "
    f"+ CASE WHEN {sql_any(_LO, lx.CLO_RISK)} AND {sql_any(_LT, lx.CLO_SALES_TITLES)} AND NOT contains({_LT}, 'rủi ro') AND NOT contains({_LT}, 'an ninh') THEN 0.20 ELSE 0 END)")


def _ceiling_sql() -> str:
    low = "lower(content)"
    exact = "CASE " + " ".join(f"WHEN {sql_any('lower(sc)', v)} THEN {k}" for k, v in lx.EXACT_KEYWORDS.items()) + " ELSE 1 END"
    keyed = " ".join(f"WHEN {sql_any(low, v)} THEN {'CASE WHEN n_chars >= 400 THEN 5 ELSE 4 END' if k == 5 else k}"
                     for k, v in lx.CEILING_KEYWORDS.items())
    return f"CASE WHEN n_chars < 50 THEN 1 WHEN n_chars <= 300 THEN {exact} {keyed} WHEN n_chars >= 800 THEN 5 WHEN n_chars >= 400 THEN 4 ELSE 3 END"


def gate_sql(sections: str = "sections", shift: str = "") -> str:
    """``shift``: a column that moves a document's outcome on, for sections that are taken once per outcome."""
    move, each = (f" + {shift}", f", {shift}") if shift else ("", "")
    return f"""
ot AS (SELECT *, {quoted(OUTCOMES)}[(doc_id{move}) % {len(OUTCOMES)} + 1] AS clo, {sql_strip('content')} AS sc,
    CAST(sum(char_count) OVER w + 2 * (count(*) OVER w - 1) AS BIGINT) AS chapter_chars, CAST(sum(word_count) OVER w AS BIGINT) AS chapter_words FROM {sections}
    WINDOW w AS (PARTITION BY doc_id{each}, coalesce(chapter, 'Nội dung'))),
ot2 AS (SELECT *, length(sc) AS n_chars, {clo_terms_sql('clo')} AS lot, {clo_terms_sql('title')} AS tt, {clo_terms_sql('content')} AS ct FROM ot),
ot3 AS (SELECT *, CAST({_ceiling_sql()} AS INTEGER) AS ceiling, {sql_share('lot', 'tt')} AS ov_title, {sql_share('lot', 'ct')} AS ov_content FROM ot2),
ot4 AS (SELECT *, CASE WHEN contains({_LO}, 'khái niệm') AND contains({_LT}, 'khái niệm') THEN least(1.0, ov_title * 0.55 + ov_content * 0.45 + 0.12) ELSE ov_title * 0.55 + ov_content * 0.45 END AS r1 FROM ot3),
ot5 AS (SELECT *, CASE WHEN contains({_LO}, 'mô hình') AND contains({_LT}, 'mô hình') THEN least(1.0, r1 + 0.10) ELSE r1 END AS r2 FROM ot4),
ot6 AS (SELECT *, CASE WHEN contains({_LO}, 'thuật ngữ') AND {sql_any(_LT, lx.CLO_TERM_TITLES)} THEN least(1.0, r2 + 0.08) ELSE r2 END AS r3, {_TOPICS} AS n_topics, {_PENALTY} AS penalty FROM ot5),
outcomes AS (SELECT *, CASE WHEN clo = '' THEN 0 ELSE greatest(0, CASE WHEN n_topics > 0 THEN least(1.0, r3 + 0.06 * n_topics) ELSE r3 END - penalty) END AS clo_match FROM ot6)"""


_EFF = ("CASE WHEN n_chars <= 300 THEN CASE WHEN level >= 4 THEN least(6, ceiling + 1) ELSE least(6, ceiling) END "
        "ELSE least(6, ceiling + CASE level WHEN 4 THEN 1 WHEN 5 THEN 2 WHEN 6 THEN 2 ELSE 0 END) END")

FEASIBLE_SQL = f"""
fa AS (SELECT o.*, unnest([1, 2, 3, 4, 5, 6]) AS level FROM outcomes o),
fb AS (SELECT *, nullif(trim(clo), '') AS clon, CASE WHEN level >= 5 AND chapter_chars >= 2500 THEN greatest(n_chars, least(chapter_chars // 12, 800)) ELSE n_chars END AS el,
    CASE WHEN level >= 5 AND chapter_chars >= 2500 THEN greatest(word_count, chapter_words // 15) ELSE word_count END AS ew,
    CASE WHEN n_chars <= 300 THEN 40 ELSE CASE level {" ".join(f"WHEN {k} THEN {v}" for k, v in lx.MIN_CHARS.items())} END END AS ml,
    CASE WHEN n_chars <= 300 THEN 10 ELSE CASE level {" ".join(f"WHEN {k} THEN {v}" for k, v in lx.MIN_WORDS.items())} END END AS mw,
    {sql_hits('lower(content)', lx.ANALYTIC_SIGNALS)} AS na, {sql_hits('lower(content)', lx.BASIC_SIGNALS)} AS nb, {_EFF} AS eff FROM fa),
fc AS (SELECT *, el >= ml AND ew >= mw AS fit,
    CASE WHEN el < ml THEN 0.2 WHEN ew < mw THEN 0.3 WHEN level >= 4 THEN CASE WHEN na >= 2 THEN 0.85 WHEN na >= 1 THEN 0.70 ELSE 0.55 END ELSE least(0.90, 0.65 + nb * 0.04) END AS q0,
    CASE WHEN el < ml THEN 'content_too_short(' || el || '<' || ml || ')' WHEN ew < mw THEN 'word_count_too_low(' || ew || ')'
      WHEN level >= 4 THEN CASE WHEN na >= 2 THEN 'rich_analytical_content' WHEN na >= 1 THEN 'moderate_analytical_content' ELSE 'limited_analytical_signals' END END AS r0 FROM fb),
fd AS (SELECT *, CASE WHEN NOT fit OR clon IS NULL THEN NULL WHEN clo_match < 0.08 THEN 'fail_learning_outcome_low_overlap' || printf('(%.2f)', clo_match)
      WHEN clo_match >= 0.38 THEN 'lo_high_overlap' || printf('(%.2f)', clo_match) END AS r1x FROM fc),
fe AS (SELECT *, fit AND coalesce(r1x NOT LIKE 'fail%', true) AS ok1, CASE WHEN r1x LIKE 'fail%' THEN least(q0, 0.20) ELSE q0 END AS q1 FROM fd),
ff AS (SELECT *, CASE WHEN NOT ok1 THEN 'none' WHEN n_chars <= 300 AND level <= 2 THEN CASE WHEN ceiling <> level THEN 'short_exact_mismatch' ELSE 'short_exact_match' END
      WHEN n_chars <= 300 AND level <= 4 THEN CASE WHEN level > eff THEN 'short_ceiling' ELSE 'short_b34_ok' END
      WHEN level > eff THEN 'semantic_ceiling' WHEN level = eff THEN 'semantic_ceiling_match' ELSE 'semantic_ceiling_above' END AS kind FROM fe),
feasible AS (SELECT *, ok1 AND kind NOT IN ('short_exact_mismatch', 'short_ceiling', 'semantic_ceiling') AS ok,
    round(CAST(CASE WHEN kind = 'short_exact_mismatch' THEN least(q1, 0.25) WHEN kind IN ('short_ceiling', 'semantic_ceiling') THEN least(q1, 0.30)
      WHEN kind IN ('short_exact_match', 'semantic_ceiling_match') THEN least(1.0, q1 + 0.05) ELSE q1 END AS DOUBLE), 4) AS quality,
    array_to_string(list_filter([r0, r1x, CASE kind WHEN 'short_exact_mismatch' THEN kind || '(exact=' || ceiling || '!=target=' || level || ')'
      WHEN 'short_exact_match' THEN kind || '(exact=' || ceiling || '=target=' || level || ')' WHEN 'short_ceiling' THEN kind || '(' || ceiling || ',eff=' || eff || ')<target(' || level || ')'
      WHEN 'short_b34_ok' THEN kind || '(ceiling=' || ceiling || ',eff=' || eff || ')' WHEN 'semantic_ceiling' THEN kind || '(' || ceiling || ')<target(' || level || ')'
      WHEN 'semantic_ceiling_match' THEN kind || '(' || ceiling || ',eff=' || eff || ')' WHEN 'semantic_ceiling_above' THEN kind || '(' || ceiling || '>=' || level || ',eff=' || eff || ')' END],
      lambda x: x IS NOT NULL), ' ') AS reasons FROM ff)"""
