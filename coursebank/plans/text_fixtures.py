"""Headed books, pages and question-answer pairs derived from the text tables, with DuckDB CTEs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from coursebank import lexicons as lx
from coursebank.functions.text import bind
from coursebank.functions.text import strip as tx_strip  # noqa: F401
from coursebank.operators.relational import keep_matching
from coursebank.sources.tables import dealt, load, spread

# Sentences put into the invented text, so that keyword rules have something to find.
PHRASES = (
    "so sánh và phân tích mối quan hệ giữa các yếu tố", "các bước thực hiện quy trình tính toán",
    "khái niệm bao gồm định nghĩa và ý nghĩa", "đề xuất giải pháp và thiết kế hệ thống",
    "ưu điểm và hạn chế của mô hình, tiêu chí đánh giá", "phân tích định tính, chỉ số kpi",
    "rủi ro thanh toán và an ninh", "",
)


def book_text() -> Column:
    """Text of a document with headings put in; the heading style depends on the document."""
    text, style = F.col("text"), F.col("doc_id") % 7
    # Cut in one pass: a substring per part would count the characters from the start each time.
    cut = F.regexp_extract_all(text, F.lit("(?s)(.{1,600})"), F.lit(1))
    chunks = bind(cut, lambda x: F.when(F.size(x) > 0, x).otherwise(F.array(text)))

    def part(chunk: Column, i: Column) -> Column:
        title = F.concat(F.lit("Tiêu đề "), F.trim(F.substring(F.replace(chunk, F.lit("\n"), F.lit(" ")), 1, 40)))
        number = (i + 1).cast("string")
        dotted = F.concat((F.floor(i / 5) + 1).cast("string"), F.lit("."), (i % 5 + 1).cast("string"))
        head = (
            F.when((style == 0) & (i % 5 == 3), F.concat(F.lit("Mục "), dotted, F.lit(": "), title, F.lit("\n")))
            .when(style == 0, F.concat(dotted, F.lit(" "), title, F.lit("\n")))
            .when(style == 1, F.concat(F.lit("Chương "), number, F.lit(": "), title, F.lit("\n")))
            .when(style == 2, F.concat(F.lit("Bài "), number, F.lit(". "), title, F.lit("\n")))
            .when((style == 3) & (i == 0), F.concat(F.lit("Chapter 1: "), title, F.lit("\n")))
            .when(style == 4, F.concat(number, F.lit(".\n")))
            .when(style == 6, F.concat(F.lit("Học Bài "), number, F.lit(": "), title, F.lit("\n")))
            .otherwise(F.lit(""))
        )
        phrase = F.get(F.array(*[F.lit(p) for p in PHRASES]), ((F.col("doc_id") + i) % 8).cast("int"))
        return F.concat(head, chunk, F.lit("\n"), phrase)

    return F.when(style == 5, text).otherwise(F.array_join(F.transform(chunks, part), "\n"))


def books(spark: SparkSession, sf_dir: str, asked: DataFrame | None = None) -> DataFrame:
    """Headed texts of all documents, or of those in ``asked`` (doc_id), which are dealt out before they are worked on."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    docs = spread(docs) if asked is None else dealt(keep_matching(docs, asked, ["doc_id"]))
    return docs.select("doc_id", book_text().alias("text"))


def quoted(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


BOOKS_SQL = f"""books AS (SELECT doc_id, CASE WHEN doc_id % 7 = 5 THEN text ELSE
  array_to_string(list_transform(range(0, greatest(CAST(ceil(length(text) / 600.0) AS BIGINT), 1)), lambda i:
    CASE WHEN doc_id % 7 = 0 AND i % 5 = 3 THEN 'Mục ' || (i // 5 + 1) || '.' || (i % 5 + 1) || ': '
         WHEN doc_id % 7 = 0 THEN (i // 5 + 1) || '.' || (i % 5 + 1) || ' '
         WHEN doc_id % 7 = 1 THEN 'Chương ' || (i + 1) || ': '
         WHEN doc_id % 7 = 2 THEN 'Bài ' || (i + 1) || '. '
         WHEN doc_id % 7 = 3 AND i = 0 THEN 'Chapter 1: '
         WHEN doc_id % 7 = 4 THEN (i + 1) || '.' || chr(10)
         WHEN doc_id % 7 = 6 THEN 'Học Bài ' || (i + 1) || ': ' ELSE '' END
    || CASE WHEN doc_id % 7 IN (0, 1, 2, 6) OR (doc_id % 7 = 3 AND i = 0)
       THEN 'Tiêu đề ' || trim(substring(replace(substring(text, i * 600 + 1, 600), chr(10), ' '), 1, 40)) || chr(10) ELSE '' END
    || substring(text, i * 600 + 1, 600) || chr(10) || {quoted(PHRASES)}[(doc_id + i) % 8 + 1]), chr(10)) END AS text
  FROM documents)"""

SP = r"[\s\x1C-\x1F\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^{SP}+|{SP}+$', '', 'g')"


def sql_words(x: str) -> str:
    return f"len(list_filter(regexp_split_to_array({x}, '{SP}+'), lambda w: w <> ''))"


def sql_normalise(x: str) -> str:
    x = f"regexp_replace(replace({x}, chr(160), ' '), '[\\x{{200B}}\\x{{200C}}\\x{{200D}}\\x{{FEFF}}]', '', 'g')"
    for tag, chars in (("sub", lx.SUBSCRIPTS), ("sup", lx.SUPERSCRIPTS)):
        x = reduce(lambda t, kv: f"replace({t}, '{kv[0]}', '<{tag}>{kv[1]}</{tag}>')", chars.items(), x)
    return (f"regexp_replace({x}, '[ \\t\\r\\f\\x0B\\x1C-\\x1F\\x{{0085}}\\x{{00A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}"
            f"\\x{{202F}}\\x{{205F}}\\x{{3000}}]+', ' ', 'g')")


def sql_break(x: str) -> str:
    cap = f"[{lx.VI_UPPER}]"
    x = f"regexp_replace({x}, '([.!?])\\s+(\\d+\\.\\d+\\.\\d+(?:\\.\\d+)?)\\s+({cap})', '\\1' || chr(10) || '\\2 \\3', 'g')"
    x = f"regexp_replace({x}, '([.!?])\\s+(\\d+\\.\\d+)\\s+({cap})', '\\1' || chr(10) || '\\2 \\3', 'g')"
    return f"regexp_replace({x}, '(\\n)(\\d+\\.\\d+(?:\\.\\d+)?)\\s+({cap})', '\\1\\2 \\3', 'g')"


def sql_long_lines(x: str) -> str:
    return (f"array_to_string(list_transform(string_split({x}, chr(10)), lambda l: CASE WHEN length(l) <= 400 THEN l "
            f"WHEN length({sql_break('l')}) <= 400 THEN {sql_break('l')} ELSE regexp_replace({sql_break('l')}, "
            "'(?i)(\\s)((?:Chương|Phần|Chapter|Bài|Mục)\\s+\\d+)', chr(10) || '\\2', 'g') END), chr(10))")


PREP_SQL = f"""{BOOKS_SQL},
prep1 AS (SELECT doc_id, {sql_break(sql_normalise('text'))} AS text FROM books),
prep AS (SELECT doc_id, {sql_long_lines('text')} AS text FROM prep1)"""


def _starts(patterns) -> str:
    return "(?i)^(?:" + "|".join(p.replace("'", "''") for p in patterns) + ")"


ROMAN_MAP = "MAP {" + ", ".join(f"'{r}': '{i}'" for i, r in enumerate(lx.ROMAN, 1)) + "}"
ROMAN12_MAP = "MAP {" + ", ".join(f"'{r}': '{i}'" for i, r in enumerate(lx.ROMAN[:12], 1)) + "}"


def sql_topic(x: str) -> str:
    return f"trim(regexp_replace(trim({x}), '\\.+$', ''))"


_LES = "(?i)^(?:Bài|Bai|Lesson)\\s+(\\d+)[.:;)\\s]\\s*(.*)"
_ENG = "(?i)^(?:Chapter|Chap)\\s+([IVX\\d]+)[:.\\s]\\s*(.*)"
_PRT = "(?i)^(?:Phần|PHAN|Chương|CHUONG)\\s+([IVX]+|\\d+)"
CHAPTER_SQL = f"""CASE WHEN regexp_matches(line, '{_LES}') THEN
    CASE WHEN {sql_topic(f"regexp_extract(line, '{_LES}', 2)")} <> '' THEN 'Chủ đề: ' || {sql_topic(f"regexp_extract(line, '{_LES}', 2)")}
    ELSE 'Bài ' || CAST(regexp_extract(line, '{_LES}', 1) AS BIGINT) END
  WHEN regexp_matches(line, '{_ENG}') THEN 'Chapter ' || coalesce({ROMAN12_MAP}[upper(regexp_extract(line, '{_ENG}', 1))], regexp_extract(line, '{_ENG}', 1))
    || CASE WHEN {sql_topic(f"regexp_extract(line, '{_ENG}', 2)")} <> '' THEN ': ' || substring({sql_topic(f"regexp_extract(line, '{_ENG}', 2)")}, 1, 50) ELSE '' END
  WHEN regexp_matches(line, '{_PRT}') THEN 'Chương ' || coalesce({ROMAN_MAP}[upper(regexp_extract(line, '{_PRT}', 1))], upper(regexp_extract(line, '{_PRT}', 1)))
  WHEN regexp_matches(line, '^\\d+\\.') THEN 'Chương ' || regexp_extract(line, '^(\\d+)\\.', 1) END"""

TITLE_SQL = """CASE WHEN length(t) <= 150 THEN t
  WHEN least(CASE WHEN strpos(substring(t, 51), '.') > 0 THEN 49 + strpos(substring(t, 51), '.') ELSE 999 END,
             CASE WHEN strpos(substring(t, 51), ':') > 0 THEN 49 + strpos(substring(t, 51), ':') ELSE 999 END) < 150
  THEN trim(substring(t, 1, least(CASE WHEN strpos(substring(t, 51), '.') > 0 THEN 49 + strpos(substring(t, 51), '.') ELSE 999 END,
             CASE WHEN strpos(substring(t, 51), ':') > 0 THEN 49 + strpos(substring(t, 51), ':') ELSE 999 END)))
  WHEN length(regexp_extract(substring(t, 1, 100), '^(.*) ', 1)) > 50 THEN regexp_extract(substring(t, 1, 100), '^(.*) ', 1)
  ELSE substring(t, 1, 100) END"""

HEADER_SQL = f"""{PREP_SQL},
lines0 AS (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS ln, trim(unnest(ls)) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM prep)),
lines1 AS (SELECT *, regexp_matches(line, '{_starts(lx.HEADER_STARTS)}') AND regexp_matches(line, '{_starts(lx.VALID_STARTS)}')
    AND length(line) BETWEEN 4 AND 199 AS hdr FROM lines0 WHERE line <> ''),
lines2 AS (SELECT *, CASE WHEN hdr THEN {CHAPTER_SQL} END AS ck FROM lines1),
lines3 AS (SELECT *, sum(CAST(hdr AS INT)) OVER w AS sid, last_value(ck IGNORE NULLS) OVER w AS chapter FROM lines2
    WINDOW w AS (PARTITION BY doc_id ORDER BY ln)),
by_header AS (SELECT doc_id, sid AS p, first(chapter ORDER BY ln) AS chapter,
    regexp_replace(first(line ORDER BY ln), ' {{2,}}', ' ', 'g') AS t, string_agg(line, chr(10) ORDER BY ln) FILTER (NOT hdr) AS content
    FROM lines3 WHERE sid > 0 GROUP BY doc_id, sid),
header_sections AS (SELECT doc_id, p, chapter, {TITLE_SQL} AS title, content FROM by_header WHERE length(content) > 100)"""

_LESSON = "(?i)Bài\\s+(\\d+)[.:;)\\s]\\s*([^\\n]{3,80})"
_LESSON_AT = "(?i)^Bài\\s+(\\d+)[.:;)\\s]\\s*([^\\n]{3,80})"
LESSON_SQL = f"""
lp AS (SELECT doc_id, string_split(regexp_replace(text, '{_LESSON}', chr(57344) || '\\0', 'g'), chr(57344))[2:] AS ps FROM prep),
lp2 AS (SELECT doc_id, unnest(range(1, len(ps) + 1)) AS p, unnest(ps) AS piece FROM lp),
lesson_all AS (SELECT doc_id, p, 'Chủ đề: ' || {sql_topic(f"regexp_extract(piece, '{_LESSON_AT}', 2)")} AS chapter,
    'Bài ' || CAST(regexp_extract(piece, '{_LESSON_AT}', 1) AS BIGINT) || '. ' || {sql_topic(f"regexp_extract(piece, '{_LESSON_AT}', 2)")} AS title,
    {sql_strip("regexp_replace(" + sql_strip("piece") + ", '\\n—\\s*$', '')")} AS content FROM lp2),
lesson_sections AS (SELECT * FROM lesson_all WHERE length(content) > 50)"""

_QUO = '(?s)^(\\d{1,3})\\.\\s*\\n?[“"' + "''" + '](.+)[”"' + "''" + ']\\s*$'
_FRE = "(?s)^(\\d{1,3})\\.\\s*\\n(.+)$"
NUMBERED_SQL = f"""
np AS (SELECT doc_id, string_split(regexp_replace(chr(10) || text, '\\n(\\d{{1,3}}\\.\\s)', chr(57344) || '\\1', 'g'), chr(57344)) AS ps FROM prep),
np2 AS (SELECT doc_id, unnest(range(1, len(ps) + 1)) AS p, unnest(ps) AS piece FROM np),
np3 AS (SELECT *, regexp_matches(piece, '{_QUO}') AS q, max(CAST(regexp_matches(piece, '{_QUO}') AS INT)) OVER (PARTITION BY doc_id) = 1 AS any_q FROM np2),
np4 AS (SELECT doc_id, p, CAST(regexp_extract(piece, CASE WHEN any_q THEN '{_QUO}' ELSE '{_FRE}' END, 1) AS BIGINT) AS num,
    regexp_extract(piece, CASE WHEN any_q THEN '{_QUO}' ELSE '{_FRE}' END, 2) AS body FROM np3
    WHERE CASE WHEN any_q THEN q ELSE regexp_matches(piece, '{_FRE}') END),
np5 AS (SELECT *, {sql_strip("regexp_replace(" + sql_strip("regexp_replace(body, '\\s+', ' ', 'g')") + ", '\\s*\\[Bloom\\s*\\d+[^\\]]*\\]\\s*$', '')")} AS content
    FROM np4 QUALIFY row_number() OVER (PARTITION BY doc_id, num ORDER BY p) = 1),
numbered_sections AS (SELECT doc_id, p, 'Đoạn ' || num AS chapter, 'Đoạn ' || num || ': ' || substring(content, 1, 60)
    || CASE WHEN length(content) > 60 THEN '...' ELSE '' END AS title, content FROM np5 WHERE length(content) > 50)"""

# A letter border written out: this dialect has no lookaround, and its own border knows ASCII only.
NO_LETTER = r"[^\p{L}\p{M}\p{N}_]"


def sql_title_rule(text: str, rule: str, gap: str, fold: bool = True) -> str:
    """One rule of the title repair as a replacement; borders become groups of their own."""
    rule = rule.replace(r"\s", r"[\s\p{Z}]")
    new = rf"\1{gap}\2"
    if rule.startswith(r"\b"):
        rule, new = f"(^|{NO_LETTER}){rule[2:]}", rf"\1\2{gap}\3"
    if rule.endswith(r"\b"):
        rule, new = f"{rule[:-2]}({NO_LETTER}|$)", rf"{new}\3"
    return f"regexp_replace({text}, '{'(?i)' if fold else ''}{rule}', '{new}', 'g')"


def sql_repair(source: str, name: str) -> str:
    """Tables that end in ``name``: the rows of ``source`` with the title ``t`` repaired."""
    joins, splits = "t", "t"
    for rule in lx.TITLE_JOINS:
        joins = sql_title_rule(joins, rule, "")
    for rule, fold in lx.TITLE_SPLITS:
        splits = sql_title_rule(splits, rule, " ", fold)
    pairs = "t"
    for a, b in lx.TITLE_PAIRS:
        pairs = sql_title_rule(pairs, rf"\b({a})({b})", " ")
    last = sql_title_rule("t", lx.TITLE_LAST_SPLIT, " ")
    steps = [f"CASE WHEN regexp_matches(t, '[\\x{{00C0}}-\\x{{1EF9}}] | [\\x{{00C0}}-\\x{{1EF9}}]') THEN {joins} ELSE t END"] * lx.TITLE_JOIN_ROUNDS
    steps += [splits, pairs, f"trim(regexp_replace({last}, ' {{2,}}', ' ', 'g'))"]
    names = [source, *(f"{name}{i}" for i in range(1, len(steps))), name]
    return ", ".join(f"{b} AS (SELECT * REPLACE ({s} AS t) FROM {a})" for a, b, s in zip(names, names[1:], steps))


def sql_cut(t: str, n: int) -> str:
    """A repaired title cut at the last space past 70 % of ``n`` characters, else at ``n``."""
    upto = f"regexp_extract(left({t}, {n}), '^(.*) ', 1)"
    return f"CASE WHEN length({t}) <= {n} THEN {t} WHEN length({upto}) > {n} * 0.7 THEN trim({upto}) ELSE trim(left({t}, {n})) END"


CHUNK_SQL = f"""
cp AS (SELECT doc_id, list_filter(list_transform(range(0, greatest(length(text), 1), 2000), lambda i: {sql_strip('substring(text, i + 1, 2000)')}),
    lambda c: length(c) > 300) AS cs FROM prep),
cq AS (SELECT doc_id, unnest(range(1, len(cs) + 1)) AS p, unnest(cs) AS content FROM cp),
cl AS (SELECT *, trim(regexp_replace({sql_strip("string_split(content, chr(10))[1]")}, ' {{2,}}', ' ', 'g')) AS t FROM cq),
{sql_repair('cl', 'cr')},
fixed_chunks AS (SELECT doc_id, p, 'Tài liệu' AS chapter, 'Đoạn ' || p || ': ' || {sql_cut('t', 300)} AS title, content FROM cr)"""

SECTIONS_SQL = f"""{HEADER_SQL}, {LESSON_SQL}, {NUMBERED_SQL}, {CHUNK_SQL},
methods AS (SELECT 1 AS m, * FROM header_sections UNION ALL SELECT 2, * FROM lesson_sections UNION ALL SELECT 3, * FROM numbered_sections
    UNION ALL SELECT 4, * FROM fixed_chunks),
chosen AS (SELECT * FROM methods QUALIFY m = min(m) OVER (PARTITION BY doc_id)),
sized AS (SELECT *, length(trim(content)) > 12000 OR (length(trim(content)) > 6000 AND NOT regexp_matches(title, '^\\d+\\.\\d+')
    AND regexp_matches(title, '(?i)^(Chương|Phần|Chapter|Part|Bài)\\s+')) AS big FROM chosen),
cutup AS (SELECT *, list_filter(list_transform(range(0, length(content), 5500), lambda i: {sql_strip('substring(content, i + 1, 5500)')}), lambda c: c <> '') AS cs
    FROM sized),
refined AS (SELECT doc_id, p, 0 AS p2, chapter, title, content FROM cutup WHERE NOT big
    UNION ALL SELECT doc_id, p, unnest(range(1, len(cs) + 1)), chapter, title || ' — đoạn ' || unnest(range(1, len(cs) + 1)) || '/' || len(cs), unnest(cs) FROM cutup WHERE big),
sections AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY p, p2) - 1 AS INTEGER) AS pos, chapter, title, content,
    CAST({sql_words('content')} AS INTEGER) AS word_count, CAST(length(content) AS INTEGER) AS char_count FROM refined)"""


def marked_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with formula symbols or wrongly decoded text added to some."""
    extra = (F.when(F.col("doc_id") % 3 == 0, F.lit("\n  H₂SO₄ + x² → α·β ± 5° \n")).when(
        F.col("doc_id") % 3 == 1, F.lit("\nGiÃ¡o trÃ¬nh Ä‘iá»‡n tá»…")).otherwise(F.lit("")))
    return spread(load(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")).withColumn(
        "text", F.concat("text", extra))


MARKED_SQL = """marked AS (SELECT doc_id, source, lang, text || CASE WHEN doc_id % 3 = 0 THEN chr(10) || '  H₂SO₄ + x² → α·β ± 5° ' || chr(10)
  WHEN doc_id % 3 = 1 THEN chr(10) || 'GiÃ¡o trÃ¬nh Ä‘iá»‡n tá»…' ELSE '' END AS text FROM documents)"""


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents cut into pages of 1500 characters, with an alternate layer and a recognised text."""
    docs = spread(load(spark, sf_dir, "documents").select("doc_id", "text"))
    n = F.greatest(F.ceil(F.length("text") / 1500.0), F.lit(1)).cast("int")
    rows = docs.select("doc_id", "text", F.explode(F.sequence(F.lit(1), n)).alias("page_num"))
    p, raw = F.col("page_num"), F.expr("substring(text, (page_num - 1) * 1500 + 1, 1500)")
    broken = F.regexp_replace(raw, "([a-z][a-z])", "$1 ")
    return rows.select(
        "doc_id", "page_num",
        F.when(p % 5 == 0, F.lit("")).when(p % 4 == 3, broken).when(
            p % 3 == 1, F.concat(raw, F.lit(" x² y³"))).otherwise(raw).alias("layer_text"),
        F.when(p % 2 == 0, F.concat(raw, F.lit(" α β γ"))).when(
            p % 4 == 3, raw).when(p == 1, F.concat(raw, F.lit(" x² y³ ±"))).alias("alt_text"),
        F.when(p % 2 == 0, raw).alias("ocr_text"))


PAGES_SQL = """pages0 AS (SELECT doc_id, text, unnest(range(1, greatest(CAST(ceil(length(text) / 1500.0) AS BIGINT), 1) + 1)) AS p FROM documents),
pages1 AS (SELECT doc_id, CAST(p AS INTEGER) AS page_num, p, substring(text, (p - 1) * 1500 + 1, 1500) AS raw FROM pages0),
page_text AS (SELECT doc_id, page_num,
  CASE WHEN p % 5 = 0 THEN '' WHEN p % 4 = 3 THEN regexp_replace(raw, '([a-z][a-z])', '\\1 ', 'g') WHEN p % 3 = 1 THEN raw || ' x² y³' ELSE raw END AS layer_text,
  CASE WHEN p % 2 = 0 THEN raw || ' α β γ' WHEN p % 4 = 3 THEN raw WHEN p = 1 THEN raw || ' x² y³ ±' END AS alt_text,
  CASE WHEN p % 2 = 0 THEN raw END AS ocr_text FROM pages1)"""


def sql_tokens(x: str, k: int) -> str:
    return f"regexp_extract_all(lower({x}), '[\\p{{L}}\\p{{N}}_]{{{k},}}')"


def sql_hits(x: str, lex) -> str:
    return "(" + " + ".join(f"CAST(contains({x}, '{p}') AS INT)" for p in lex) + ")"


def sql_any(x: str, lex) -> str:
    return "(" + " OR ".join(f"contains({x}, '{p}')" for p in lex) + ")"


def sql_class_count(x: str, char_class: str) -> str:
    return f"length(regexp_replace({x}, '[^{char_class}]', '', 'g'))"


def sql_garbled(x: str) -> str:
    high = sql_class_count(x, r"\x{0080}-\x{10FFFF}")
    legit = f"({sql_class_count(x, lx.VI_EXTENDED)} + {sql_class_count(x, lx.STEM_WIDE)})"
    return (f"CASE WHEN length({sql_strip(x)}) < 20 THEN true WHEN {high} / length({x}) < 0.03 THEN false "
            f"WHEN {high} >= 5 AND {legit} / {high} < 0.25 THEN true ELSE false END")


def sql_english(x: str) -> str:
    lead = f"substring({x}, 1, 500)"
    letters = sql_class_count(lead, r"\p{L}")
    return (f"CASE WHEN length({x}) < 30 OR {letters} = 0 THEN false "
            f"ELSE {sql_class_count(lead, lx.VI_EXTENDED)} / {letters} < 0.01 END")


def sql_math(x: str) -> str:
    x = f"translate({x}, '{''.join(lx.MATH_SINGLE)}', '{''.join(lx.MATH_SINGLE.values())}')"
    return reduce(lambda t, kv: f"replace({t}, '{kv[0]}', '{kv[1]}')", lx.MATH_WORDS.items(), x)


def sql_snippets(x: str, n: int, max_len: int) -> str:
    """Scalar subquery-free list expression of the best sentences of ``x``."""
    parts = (f"list_transform(string_split(regexp_replace(regexp_replace({sql_strip(x)}, "
             f"'([.!?…])\\s+', '\\1' || chr(57344), 'g'), '\\n+', chr(57344), 'g'), chr(57344)), "
             f"lambda s: regexp_replace({sql_strip('s')}, '\\s+', ' ', 'g'))")
    toks = f"list_filter({sql_tokens('s', 3)}, lambda w: NOT list_contains({quoted(lx.STOP_WORDS)}, w))"
    rows = (f"list_sort(list_filter(list_transform({parts}, lambda s, i: {{'r': -(len({toks}) + len(list_distinct({toks}))), 'i': i, "
            f"'h': substring(s, 1, 35), 't': s, 'n': len({toks}), 'l': length(s)}}), "
            f"lambda x: x.n >= 4 AND x.l BETWEEN 28 AND {max_len}))")
    firsts = (f"list_reduce({rows}, lambda a, x: CASE WHEN len(a) >= {n} OR list_contains(list_transform(a, lambda y: y.h), x.h) THEN a "
              f"ELSE list_append(a, x) END, ({rows})[1:0])")
    return f"list_transform({firsts}, lambda x: x.t)"
