"""Queries over whole texts: cleaning, page assembly, sectioning and inventories."""

from __future__ import annotations

from pyspark.sql import functions as F

from coursebank import lexicons as lx
from coursebank.functions import text as tx
from coursebank.operators import terms as tm
from coursebank.operators import structure as st
from coursebank.plans import text_fixtures as tf
from coursebank.plans.registry import query
from coursebank.sources import pages as pg
from coursebank.sources.tables import load, spread

c = F.col


def _short(df):
    return df.select("doc_id", "pos", "chapter", "title",
                     F.md5("content").alias("content_md5"), "word_count", "char_count")


SHORT_SQL = ("SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY p) - 1 AS INTEGER) AS pos, chapter, title, "
             "md5(content) AS content_md5, CAST({w} AS INTEGER) AS word_count, CAST(length(content) AS INTEGER) AS char_count FROM {t}")


def _method(spark, d, maker):
    docs = tf.books(spark, d).select("doc_id", tx.prepared(c("text")).alias("text"))
    return _short(st.explode_sections(docs.select("doc_id", maker(c("text")).alias("sections"))))


def _short_sql(table):
    return SHORT_SQL.format(w=tf.sql_words("content"), t=table)


@query("j1_header_sections", f"WITH {tf.HEADER_SQL} {_short_sql('header_sections')}")
def j1_header_sections(spark, d):
    return _method(spark, d, st.header_sections)


@query("j4_lesson_sections", f"WITH {tf.PREP_SQL}, {tf.LESSON_SQL} {_short_sql('lesson_sections')}")
def j4_lesson_sections(spark, d):
    return _method(spark, d, st.lesson_sections)


@query("j5_numbered_sections", f"WITH {tf.PREP_SQL}, {tf.NUMBERED_SQL} {_short_sql('numbered_sections')}")
def j5_numbered_sections(spark, d):
    return _method(spark, d, st.numbered_sections)


@query("j7_fixed_chunks", f"WITH {tf.PREP_SQL}, {tf.CHUNK_SQL} {_short_sql('fixed_chunks')}")
def j7_fixed_chunks(spark, d):
    return _method(spark, d, st.fixed_chunks)


@query("j8_sectioning", f"""WITH {tf.SECTIONS_SQL}
SELECT doc_id, pos, chapter, title, md5(content) AS content_md5, word_count, char_count FROM sections""")
def j8_sectioning(spark, d):
    return _short(st.split_sections(tf.books(spark, d)))


# --- cleaning -----------------------------------------------------------------


@query("corpus_clean", f"""
WITH {tf.MARKED_SQL}, n AS (SELECT doc_id, text, {tf.sql_normalise('text')} AS norm FROM marked), b AS (SELECT *, {tf.sql_break('norm')} AS broken FROM n)
SELECT doc_id, md5({tf.sql_strip("array_to_string(list_transform(string_split(text, chr(10)), lambda l: " + tf.sql_strip('l') + "), chr(10))")}) AS stripped,
  md5(norm) AS normalised, md5({tf.sql_math('text')}) AS math, md5({tf.sql_long_lines('broken')}) AS prepared,
  CAST(length(text) AS INTEGER) AS chars_before, CAST(length(norm) AS INTEGER) AS chars_after FROM b""")
def corpus_clean(spark, d):
    t = c("text")
    docs = tf.marked_documents(spark, d).withColumn("norm", tx.normalise_text(t))
    return docs.select(
        "doc_id", F.md5(tx.strip_lines(t)).alias("stripped"), F.md5("norm").alias("normalised"),
        F.md5(tx.normalise_math(t)).alias("math"), F.md5(tx.prepared(t)).alias("prepared"),
        F.length(t).alias("chars_before"), F.length("norm").alias("chars_after"))


@query("encoding_health", f"""
WITH {tf.MARKED_SQL}, f AS (SELECT source, lang, {tf.sql_garbled('text')} AS garbled, {tf.sql_class_count('text', lx.STEM_NARROW)} >= 2 AS stem,
  {tf.sql_english('text')} AS english FROM marked)
SELECT source, lang, count(*) AS n, CAST(count_if(garbled) AS BIGINT) AS garbled, CAST(count_if(stem) AS BIGINT) AS stem_heavy,
  CAST(count_if(english) AS BIGINT) AS english, CAST(count_if(NOT english) AS BIGINT) AS to_translate FROM f GROUP BY ALL""")
def encoding_health(spark, d):
    t = c("text")
    return tf.marked_documents(spark, d).groupBy("source", "lang").agg(
        F.count("*").alias("n"), F.count_if(tx.is_garbled(t)).alias("garbled"),
        F.count_if(tx.stem_count(t) >= 2).alias("stem_heavy"), F.count_if(tx.is_english(t)).alias("english"),
        F.count_if(tx.needs_translation(t, "en")).alias("to_translate"))


@query("h7_mojibake", """SELECT doc_id, doc_id % 3 = 1 AS repaired, md5(text || CASE WHEN doc_id % 3 = 0 THEN chr(10) || '  H₂SO₄ + x² → α·β ± 5° ' || chr(10)
  WHEN doc_id % 3 = 1 THEN chr(10) || 'Giáo trình điện tễ' ELSE '' END) AS fixed_md5 FROM documents""")
def h7_mojibake(spark, d):
    fixed = tx.fix_mojibake(c("text"))
    docs = tf.marked_documents(spark, d).select("doc_id", "text", fixed.alias("fixed"))
    return docs.select("doc_id", (c("fixed") != c("text")).alias("repaired"), F.md5("fixed").alias("fixed_md5"))


SECTION_NO_SQL = """coalesce(nullif(regexp_extract(t, '^(\\d+\\.\\d+\\.\\d+\\.\\d+(?:\\.\\d+)?)\\s+', 1), ''), nullif(regexp_extract(t, '^(\\d+\\.\\d+\\.\\d+)\\s+', 1), ''),
  nullif(regexp_extract(t, '^(\\d+\\.\\d+)\\s+', 1), ''), nullif(regexp_extract(substring(t, 1, 50), '(\\d+\\.\\d+\\.\\d+(?:\\.\\d+)?)\\s+', 1), ''),
  nullif(regexp_extract(substring(t, 1, 50), '(\\d+\\.\\d+)\\s+', 1), ''),
  'Phần ' || upper(nullif(regexp_extract(t, '(?i)^(?:Ph\\s*ần|PHAN)\\s+([IVX]+|\\d+)', 1), '')),
  'Chương ' || nullif(regexp_extract(t, '(?i)^(?:Ch\\s*ương|CHUONG)\\s+(\\d+)', 1), ''),
  'Mục ' || nullif(regexp_extract(t, '(?i)^(?:Mục|MUC)\\s+(\\d+(?:\\.\\d+)*)', 1), ''),
  nullif(regexp_extract(t, '(?i)^(\\d+)\\s+[a-zA-Z""" + lx._V + """đ]', 1), ''))"""

# The title as its number is read from it.
TITLE_LINE_SQL = r"regexp_replace(regexp_replace(trim(regexp_replace(title, '\s+', ' ', 'g')), '(\d+)\.\s+(\d+)', '\1.\2', 'g'), '(\d+)\.\s+(\d+)', '\1.\2', 'g')"
TITLES_SQL = f"""{tf.HEADER_SQL}, titles AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY p) - 1 AS INTEGER) AS pos, chapter, title, content,
  {TITLE_LINE_SQL} AS t FROM header_sections)"""


def _headed(spark, d):
    docs = tf.books(spark, d).select("doc_id", tx.prepared(c("text")).alias("text"))
    return st.explode_sections(docs.select("doc_id", st.header_sections(c("text")).alias("sections")))


def _usable_sql():
    return "(?i)^(?:" + "|".join(lx.USABLE_TITLES) + ")"


@query("h8_title_tests", f"""WITH {TITLES_SQL}
SELECT doc_id, pos, {SECTION_NO_SQL} AS section_no, NOT regexp_matches(title, '^\\d+\\.\\d+') AND regexp_matches(title, '(?i)^(Chương|Phần|Chapter|Part|Bài)\\s+') AS is_chapter,
  regexp_matches(title, '{_usable_sql()}') AS usable FROM titles""")
def h8_title_tests(spark, d):
    t = c("title")
    return _headed(spark, d).select("doc_id", "pos", tx.section_number(t).alias("section_no"),
                                    tx.is_chapter_title(t).alias("is_chapter"), tx.is_usable_title(t).alias("usable"))


def _english_sql(t):
    """Section words in English; words are bounded as in Unicode."""
    for pattern, word in lx.LOCALISED:
        bound = pattern.removeprefix(r"\b")
        tail = ""
        if bound.endswith(r"\b"):
            bound, tail = bound.removesuffix(r"\b"), f"({tf.NO_LETTER}|$)"
        for _ in range(2):  # neighbours share a border
            t = f"regexp_replace({t}, '(?i)(^|{tf.NO_LETTER}){bound}{tail}', '\\1{word}{chr(92) * 1 + '2' if tail else ''}', 'g')"
    return t


_DOUBLED = r"(?i)^(Chapter\s+\d+)\s*-\s*Section\s+(Chapter\s+\d+)\s*:\s*"
_SHOWN = ("trim(regexp_replace(trim(regexp_replace(CASE WHEN num IS NOT NULL AND starts_with(s, num) THEN trim(regexp_replace(trim(substring(s, length(num) + 1)), '^:+', '')) ELSE s END, "
          "'(?i)^Chương\\s*\\d+\\s*[:.]?\\s*', '')), '(?i)^Bài\\s+\\d+[:.\\s]+\\s*', ''))")
REPAIRED_SQL = f"""numbered_titles AS (SELECT *, {SECTION_NO_SQL} AS num FROM titles), whole AS (SELECT doc_id, pos, title, num, title AS t FROM numbered_titles), {tf.sql_repair('whole', 'rw')},
trimmed AS (SELECT doc_id, pos, trim(title) AS t FROM titles), {tf.sql_repair('trimmed', 'rt')},
repaired_titles AS (SELECT rw.doc_id, rw.pos, rw.t AS repaired, {tf.sql_cut('rt.t', 40)} AS cut, title, num, rw.t AS s FROM rw JOIN rt USING (doc_id, pos)),
english_titles AS (SELECT *, {_english_sql('title')} AS e FROM repaired_titles)"""


@query("h9_title_repair", f"""WITH {TITLES_SQL}, {REPAIRED_SQL}
SELECT doc_id, pos, repaired, cut, coalesce(nullif({_SHOWN}, ''), title) AS shown,
  CASE WHEN lower(regexp_extract(e, '{_DOUBLED}', 1)) = lower(regexp_extract(e, '{_DOUBLED}', 2)) AND regexp_matches(e, '{_DOUBLED}') THEN regexp_replace(e, '{_DOUBLED}', '\\1: ') ELSE e END AS english
FROM english_titles""")
def h9_title_repair(spark, d):
    t = c("title")
    return _headed(spark, d).select("doc_id", "pos", tx.repair_title(t).alias("repaired"), tx.cut_title(t, 40).alias("cut"),
                                    tx.display_title(t).alias("shown"), tx.localise_section(t, "en").alias("english"))


@query("h15_strict_headers", f"""WITH {tf.BOOKS_SQL}
SELECT doc_id, CAST(len(regexp_extract_all(text, '(?m)^[ \\t]*\\d+\\.\\d+(?:\\.\\d+)*[ \\t]+\\S+')) AS INTEGER) AS n_headers FROM books""")
def h15_strict_headers(spark, d):
    return tf.books(spark, d).select("doc_id", tx.strict_header_count(c("text")).alias("n_headers"))


# Odd documents also name parts, in digits, in numerals and in lower case.
NAMED = "text || CASE WHEN doc_id % 2 = 1 THEN chr(10) || 'PHẦN ' || (CASE doc_id % 5 WHEN 0 THEN 'IV' WHEN 1 THEN 'xii' WHEN 2 THEN 'XIX' WHEN 3 THEN 'IIII' ELSE 'X' END) || ' và chapter 0' || (doc_id % 9) ELSE '' END"


# Numerals of part lines that are added to the books (see NAMED), and what follows "Chương" in the books.
_FOUND = r"(?i)(?:PHẦN|Chương)\s+([A-Za-z]+|\d+)"


@query("h16_roman", f"""WITH {tf.BOOKS_SQL}, b AS (SELECT doc_id, {NAMED} AS text FROM books),
r AS (SELECT doc_id, unnest(regexp_extract_all(text, '{_FOUND}', 1)) AS r FROM b) SELECT doc_id, coalesce({tf.ROMAN_MAP}[upper(r)], r) AS n, count(*) AS times FROM r GROUP BY ALL""")
def h16_roman(spark, d):
    named = tf.books(spark, d).select("doc_id", F.expr(NAMED.replace("chr(10)", "'\\n'")).alias("text"))
    found = F.regexp_extract_all("text", F.lit(_FOUND.replace("(?i)", "(?iu)")), F.lit(1))
    rows = named.select("doc_id", F.explode(found).alias("r"))
    return rows.select("doc_id", tx.roman_to_int(c("r")).alias("n")).groupBy("doc_id", "n").agg(F.count("*").alias("times"))


@query("h18_section_label", f"""WITH {TITLES_SQL}, n AS (SELECT *, {SECTION_NO_SQL} AS num FROM titles)
SELECT doc_id, pos, CASE WHEN num IS NOT NULL THEN chapter || ' - Mục ' || num || ': ' || title
  WHEN pos > 0 THEN 'Trang ' || pos || ': ' || title ELSE chapter || ': ' || title END AS label FROM n""")
def h18_section_label(spark, d):
    rows = _headed(spark, d).withColumn("num", tx.section_number(c("title")))
    return rows.select("doc_id", "pos", tx.section_label(c("chapter"), c("num"), c("title"), c("pos")).alias("label"))


@query("h32_source_excerpt", f"""WITH {tf.SECTIONS_SQL}, lv AS (SELECT *, unnest([2, 3]) AS level, {tf.sql_strip('content')} AS t FROM sections),
q AS (SELECT *, CASE WHEN level = 3 AND length(t) > 4000 THEN {tf.sql_snippets('t', 8, 160)} END AS qs FROM lv)
SELECT doc_id, pos, level, md5(CASE WHEN level = 3 AND length(t) > 4000 THEN substring(concat_ws(chr(10), {tf.sql_strip('substring(t, 1, 2200)')},
    chr(10) || '[...]' || chr(10) || {tf.sql_strip('right(t, 1800)')},
    CASE WHEN len(qs) > 0 THEN chr(10) || 'CÁC CÂU TRÍCH TỪ MỤC (bắt buộc dùng thuật ngữ trong đáp án):' || chr(10) || array_to_string(list_transform(qs, lambda s: '  • ' || s), chr(10)) END), 1, 5200)
  WHEN level = 3 THEN substring(t, 1, 4500) ELSE substring(t, 1, 3000) END) AS excerpt_md5 FROM q""")
def h32_source_excerpt(spark, d):
    rows = st.split_sections(tf.books(spark, d))
    leveled = rows.select("doc_id", "pos", "content", F.explode(F.array(F.lit(2), F.lit(3))).alias("level"))
    return leveled.select("doc_id", "pos", "level", F.md5(tx.source_excerpt(c("content"), c("level"))).alias("excerpt_md5"))


@query("h33_stem_sections", f"""WITH {tf.MARKED_SQL}
SELECT doc_id, {tf.sql_hits(tf.sql_strip('text'), lx.STEM_SIGNALS)} >= 3
  OR regexp_matches(text, '[A-Z][a-z]?\\d+[A-Z]?') OR regexp_matches(text, '\\^\\{{|\\\\frac|\\\\sum|\\\\int|\\\\sqrt') AS is_stem FROM marked""")
def h33_stem_sections(spark, d):
    return tf.marked_documents(spark, d).select("doc_id", tx.is_stem(c("text")).alias("is_stem"))


SENTENCES_SQL = ("list_filter(list_transform(string_split(regexp_replace(text, '([.!?\\n])\\s+', '\\1' || chr(57344), 'g'), chr(57344)), lambda s: "
                 + tf.sql_strip("s") + "), lambda s: length(s) >= 10)")


@query("h35_sentences", f"""SELECT doc_id, unnest(range(0, len(ss)))::INTEGER AS at, md5(unnest(ss)) AS sentence_md5
FROM (SELECT doc_id, {SENTENCES_SQL} AS ss FROM documents)""")
def h35_sentences(spark, d):
    docs = spread(load(spark, d, "documents").select("doc_id", "text"))
    return st.explode_rows(docs, tx.sentences(c("text")), ("doc_id",), "at").select(
        "doc_id", "at", F.md5("s").alias("sentence_md5"))


# --- pages -----------------------------------------------------------------------

_MEAN = "(list_sum(list_transform({w}, lambda x: length(x))) / len({w}))"
PAGE_TEXT_SQL = f"""{tf.PAGES_SQL}, pa AS (SELECT *, {tf.sql_strip("coalesce(layer_text, '')")} AS a, {tf.sql_strip("coalesce(alt_text, '')")} AS b FROM page_text),
pb AS (SELECT *, list_filter(regexp_split_to_array(a, '{tf.SP}+'), lambda w: w <> '') AS wa, list_filter(regexp_split_to_array(b, '{tf.SP}+'), lambda w: w <> '') AS wb,
  {tf.sql_class_count('a', lx.STEM_NARROW)} AS sa, {tf.sql_class_count('b', lx.STEM_NARROW)} AS sb FROM pa),
pc AS (SELECT *, CASE WHEN len(wa) > 10 THEN {_MEAN.format(w='wa')} ELSE 99 END AS mean, CASE WHEN len(wb) > 0 THEN {_MEAN.format(w='wb')} ELSE 0 END AS mean_b FROM pb),
pd AS (SELECT *, mean < 4.5 AND len(wa) > 15 AS broken FROM pc),
pe AS (SELECT doc_id, page_num, a, b, CASE WHEN a = '' AND b = '' THEN 'none' WHEN a = '' THEN 'alternate'
  WHEN (sa >= 2 OR broken) AND b <> '' AND (sb > sa OR (broken AND mean_b > mean + 0.5)) THEN 'alternate' ELSE 'primary' END AS page_source FROM pd),
chosen_pages AS (SELECT doc_id, page_num, page_source, {tf.sql_normalise("CASE WHEN page_source = 'alternate' THEN b ELSE a END")} AS text FROM pe)"""


@query("a4_page_text", f"WITH {PAGE_TEXT_SQL} SELECT doc_id, page_num, page_source, md5(text) AS text_md5 FROM chosen_pages")
def a4_page_text(spark, d):
    rows = pg.choose_page_text(tf.pages(spark, d), "layer_text", "alt_text")
    return rows.select("doc_id", "page_num", "page_source", F.md5("text").alias("text_md5"))


PAGE_OCR_SQL = f"""{tf.PAGES_SQL}, po AS (SELECT *, {tf.sql_strip("layer_text")} <> '' AS has_layer, {tf.sql_garbled('layer_text')} AS garbled,
  {tf.sql_words('layer_text')} AS n FROM page_text),
ocr_pages AS (SELECT *, CASE WHEN has_layer AND NOT garbled AND n >= 30 THEN 'clean_layer' WHEN coalesce(ocr_text, '') <> '' THEN 'ocr'
  WHEN has_layer AND NOT garbled THEN 'layer' WHEN has_layer THEN 'skipped_garbled' ELSE 'none' END AS page_source FROM po)"""


@query("a5_page_ocr", f"""WITH {PAGE_OCR_SQL} SELECT doc_id, page_num, page_source, garbled,
  md5({tf.sql_normalise("CASE WHEN page_source IN ('clean_layer', 'layer') THEN layer_text WHEN page_source = 'ocr' THEN ocr_text ELSE '' END")}) AS text_md5 FROM ocr_pages""")
def a5_page_ocr(spark, d):
    rows = pg.choose_page_ocr(tf.pages(spark, d), "layer_text", "ocr_text")
    return rows.select("doc_id", "page_num", "page_source", "garbled", F.md5("text").alias("text_md5"))


MERGED_SQL = f"""{PAGE_TEXT_SQL}, off AS (SELECT *, coalesce(sum(length(text) + 2) OVER (PARTITION BY doc_id ORDER BY page_num ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM chosen_pages WHERE text <> '')"""


@query("a6_merged_pages", f"""WITH {MERGED_SQL}
SELECT doc_id, md5({tf.sql_strip("string_agg(text, chr(10) || chr(10) ORDER BY page_num)")}) AS text_md5, count(*) AS n_pages, CAST(max(start) AS BIGINT) AS last_start FROM off GROUP BY doc_id""")
def a6_merged_pages(spark, d):
    docs = pg.merge_pages(pg.choose_page_text(tf.pages(spark, d), "layer_text", "alt_text"))
    return docs.select("doc_id", F.md5("text").alias("text_md5"), F.size("page_boundaries").cast("bigint").alias("n_pages"),
                       F.element_at("page_boundaries", -1)["offset"].alias("last_start"))


@query("e2_page_offsets", f"WITH {MERGED_SQL} SELECT doc_id, page_num, CAST(start AS BIGINT) AS start FROM off")
def e2_page_offsets(spark, d):
    rows = pg.choose_page_text(tf.pages(spark, d), "layer_text", "alt_text").where("text <> ''")
    return pg.running_offset(rows, ["doc_id"], "page_num", F.length("text") + 2).select("doc_id", "page_num", "start")


@query("a7_page_stats", f"""WITH {PAGE_OCR_SQL} SELECT doc_id, count(*) AS total_pages, CAST(count_if(has_layer) AS BIGINT) AS pages_with_text_layer,
  CAST(count_if(page_source <> 'clean_layer' AND coalesce(ocr_text, '') <> '') AS BIGINT) AS pages_with_ocr_text, CAST(count_if(has_layer AND garbled) AS BIGINT) AS garbled_pages,
  CAST(count_if(page_source = 'clean_layer') AS BIGINT) AS pages_skipped_clean FROM ocr_pages GROUP BY doc_id""")
def a7_page_stats(spark, d):
    return pg.page_stats(pg.choose_page_ocr(tf.pages(spark, d), "layer_text", "ocr_text"))


@query("a8_low_yield", f"""SELECT doc_id, n_words, n_pages, n_words / n_pages < 100 AS low_yield FROM (
  SELECT doc_id, CAST({tf.sql_words('text')} AS INTEGER) AS n_words, greatest(length(text) // 3000, 1) AS n_pages FROM documents)""")
def a8_low_yield(spark, d):
    docs = spread(load(spark, d, "documents").select("doc_id", "text"))
    return pg.low_yield(docs).select("doc_id", "n_words", "n_pages", "low_yield")


@query("a9_merge_layers", f"""WITH {tf.PAGES_SQL}, l AS (SELECT doc_id, page_num, regexp_split_to_array(concat_ws(chr(10), layer_text, alt_text), '\\r\\n|\\r|\\n') AS ls FROM page_text),
u AS (SELECT doc_id, page_num, unnest(range(0, len(ls))) AS i, {tf.sql_strip('unnest(ls)')} AS line FROM l),
k AS (SELECT *, regexp_replace(lower(line), '[^\\p{{L}}\\p{{N}}_]+', '', 'g') AS key FROM u WHERE length(line) >= 2),
f AS (SELECT * FROM k WHERE key <> '' QUALIFY row_number() OVER (PARTITION BY doc_id, page_num, key ORDER BY i) = 1)
SELECT doc_id, page_num, md5(coalesce(string_agg(line, chr(10) ORDER BY i), '')) AS merged_md5 FROM page_text LEFT JOIN f USING (doc_id, page_num) GROUP BY ALL""")
def a9_merge_layers(spark, d):
    merged = pg.merge_layers(c("layer_text"), c("alt_text"))
    return tf.pages(spark, d).select("doc_id", "page_num", F.md5(merged).alias("merged_md5"))


@query("c12_page_of_offset", f"""WITH {MERGED_SQL}, pos AS (SELECT doc_id, unnest([0, 700, 1600, 5000, 20000]) AS char_offset FROM documents)
SELECT doc_id, char_offset, coalesce((SELECT max_by(page_num, start) FROM off WHERE off.doc_id = pos.doc_id AND start <= char_offset),
  (SELECT min_by(page_num, start) FROM off WHERE off.doc_id = pos.doc_id)) AS page_num FROM pos""")
def c12_page_of_offset(spark, d):
    docs = pg.merge_pages(pg.choose_page_text(tf.pages(spark, d), "layer_text", "alt_text"))
    positions = load(spark, d, "documents").select(
        "doc_id", F.explode(F.array(*[F.lit(x) for x in (0, 700, 1600, 5000, 20000)])).alias("char_offset"))
    return pg.page_of_offset(positions, docs)


# Pages packed by a fold over their places in the merged text; the text is prepared after the places were taken.
PAGE_CHUNK_SQL = f"""{MERGED_SQL}, mg AS (SELECT doc_id, {tf.sql_strip("string_agg(text, chr(10) || chr(10) ORDER BY page_num)")} AS text,
  list({{'page': CAST(page_num AS INTEGER), 'start': CAST(start AS INTEGER)}} ORDER BY page_num) AS bs FROM off GROUP BY doc_id),
mg1 AS (SELECT doc_id, bs, {tf.sql_break(tf.sql_normalise('text'))} AS text FROM mg), mg2 AS (SELECT doc_id, bs, {tf.sql_long_lines('text')} AS text FROM mg1),
mp AS (SELECT doc_id, text, list_transform(bs, lambda b, i: {{'page': b.page, 'start': b.start, 'stop': CAST(coalesce(bs[i + 1].start - 2, length(text)) AS INTEGER)}}) AS ps FROM mg2),
mf AS (SELECT doc_id, text, list_reduce(ps, lambda a, p: CASE WHEN a.cur IS NULL THEN {{'done': a.done, 'cur': {{'f': p.page, 'l': p.page, 's': p.start, 'e': p.stop, 'n': p.stop - p.start}}}}
  WHEN a.cur.n > 0 AND a.cur.n + (p.stop - p.start) > 2500 THEN {{'done': list_append(a.done, a.cur), 'cur': {{'f': p.page, 'l': p.page, 's': p.start, 'e': p.stop, 'n': p.stop - p.start}}}}
  ELSE {{'done': a.done, 'cur': {{'f': a.cur.f, 'l': p.page, 's': a.cur.s, 'e': p.stop, 'n': a.cur.n + (p.stop - p.start)}}}} END,
  {{'done': []::STRUCT(f INTEGER, l INTEGER, s INTEGER, e INTEGER, n INTEGER)[], 'cur': NULL::STRUCT(f INTEGER, l INTEGER, s INTEGER, e INTEGER, n INTEGER)}}) AS z FROM mp),
mu AS (SELECT doc_id, text, unnest(list_append(z.done, z.cur)) AS g FROM mf),
mc AS (SELECT doc_id, g.s AS p, g.f AS f, g.l AS l, {tf.sql_strip("substring(text, g.s + 1, greatest(g.e - g.s, 0))")} AS content FROM mu),
ml AS (SELECT *, trim(regexp_replace({tf.sql_strip("string_split(content, chr(10))[1]")}, ' {{2,}}', ' ', 'g')) AS t FROM mc), {tf.sql_repair('ml', 'mr')},
page_sections AS (SELECT doc_id, p, 'Tài liệu' AS chapter, 'Trang ' || f || CASE WHEN f <> l THEN '-' || l ELSE '' END || ': ' || {tf.sql_cut('t', 300)} AS title, content FROM mr WHERE length(content) > 200)"""


@query("j6_page_chunks", f"WITH {PAGE_CHUNK_SQL} {_short_sql('page_sections')}")
def j6_page_chunks(spark, d):
    docs = pg.merge_pages(pg.choose_page_text(tf.pages(spark, d), "layer_text", "alt_text"))
    rows = docs.select("doc_id", tx.prepared(c("text")).alias("text"), "page_boundaries")
    packed = rows.select("doc_id", st.page_chunks(c("text"), c("page_boundaries")).alias("sections"))
    return _short(st.explode_sections(packed))


# Documents as they come have no headers, so what is left out of them are the short chunks.
@query("j7_left_out", f"""WITH ld1 AS (SELECT doc_id, {tf.sql_break(tf.sql_normalise('text'))} AS text FROM documents), ld AS (SELECT doc_id, {tf.sql_long_lines('text')} AS text FROM ld1),
lc AS (SELECT doc_id, list_filter(list_transform(range(0, greatest(length(text), 1), 2000), lambda i: {tf.sql_strip('substring(text, i + 1, 2000)')}), lambda x: x <> '') AS cs FROM ld),
lu AS (SELECT doc_id, unnest(range(1, len(cs) + 1)) AS p, unnest(cs) AS content FROM lc), ls AS (SELECT * FROM lu WHERE length(content) <= 300),
ll AS (SELECT *, trim(regexp_replace({tf.sql_strip("string_split(content, chr(10))[1]")}, ' {{2,}}', ' ', 'g')) AS t FROM ls), {tf.sql_repair('ll', 'lr')}
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY p) - 1 AS INTEGER) AS pos, 'short' AS reason, 'Đoạn ' || p || ': ' || {tf.sql_cut('t', 300)} AS title, md5(content) AS content_md5, CAST(length(content) AS INTEGER) AS char_count FROM lr""")
def j7_left_out(spark, d):
    rows = st.left_out(load(spark, d, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "pos", "reason", "title", F.md5("content").alias("content_md5"), "char_count")


# --- structure ---------------------------------------------------------------------


@query("d14_chapter_context", f"""WITH {tf.SECTIONS_SQL}
SELECT doc_id, coalesce(chapter, 'Nội dung') AS chapter, md5(string_agg(content, chr(10) || chr(10) ORDER BY pos)) AS content_md5, count(*) AS n_sections FROM sections GROUP BY 1, 2""")
def d14_chapter_context(spark, d):
    sections = st.split_sections(tf.books(spark, d))
    context = st.chapter_context(sections).select("doc_id", "chapter", F.md5("content").alias("content_md5"))
    counts = sections.groupBy("doc_id", F.coalesce("chapter", F.lit(st.DEFAULT_CHAPTER)).alias("chapter")).agg(F.count("*").alias("n_sections"))
    return context.join(counts, ["doc_id", "chapter"])


@query("d14_chapters_row_local", f"""WITH {tf.SECTIONS_SQL}
SELECT doc_id, coalesce(chapter, 'Nội dung') AS chapter, md5(string_agg(content, chr(10) || chr(10) ORDER BY pos)) AS content_md5 FROM sections GROUP BY 1, 2""")
def d14_chapters_row_local(spark, d):
    return st.explode_chapters(st.sectioned(tf.books(spark, d))).select("doc_id", "chapter", F.md5("content").alias("content_md5"))


@query("d15_section_counts", f"""WITH {tf.SECTIONS_SQL}
SELECT doc_id, count(DISTINCT chapter) AS n_chapters, count(*) AS n_sections FROM sections GROUP BY doc_id""")
def d15_section_counts(spark, d):
    return st.known_chapters(st.split_sections(tf.books(spark, d)))


@query("d15_sections_per_chapter", f"""WITH {tf.SECTIONS_SQL}
SELECT doc_id, coalesce(chapter, 'Unknown') AS chapter, count(*) AS n_sections FROM sections GROUP BY 1, 2""")
def d15_sections_per_chapter(spark, d):
    return st.section_counts(st.split_sections(tf.books(spark, d)))


PLAN_SQL = f"""{tf.SECTIONS_SQL}, us AS (SELECT *, regexp_matches(title, '{_usable_sql()}') AS usable FROM sections),
u2 AS (SELECT * FROM us QUALIFY usable OR max(CAST(usable AS INT)) OVER (PARTITION BY doc_id) = 0),
ks AS (SELECT *, CASE WHEN regexp_matches(title, '^\\d+\\.\\d+') THEN CAST(regexp_extract(title, '^(\\d+)\\.(\\d+)', 1) AS BIGINT)
    WHEN regexp_matches(title, '(?i)^(?:Chương|Phần|Bài|Đoạn|Trang)\\s+\\d+') THEN CAST(regexp_extract(title, '(?i)^(?:Chương|Phần|Bài|Đoạn|Trang)\\s+(\\d+)', 1) AS BIGINT) ELSE 999 END AS major,
  CASE WHEN regexp_matches(title, '^\\d+\\.\\d+') THEN CAST(regexp_extract(title, '^(\\d+)\\.(\\d+)', 2) AS BIGINT) ELSE 0 END AS minor FROM u2),
plan_sections AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY major, minor, pos) - 1 AS INTEGER) AS pos, chapter, title, content, word_count, char_count,
  CAST(CASE WHEN content = '' THEN 1 ELSE least(1.0, len(list_filter(string_split(lower(content), chr(10)), lambda l: {tf.sql_any('l', lx.BOILERPLATE_PHRASES)})) / 2.5) END AS DOUBLE) AS boilerplate FROM ks)"""


@query("j12_plan_sections", f"WITH {PLAN_SQL} SELECT doc_id, pos, chapter, title, md5(content) AS content_md5, boilerplate FROM plan_sections")
def j12_plan_sections(spark, d):
    rows = st.plan_sections(st.sectioned(tf.books(spark, d)))
    return rows.select("doc_id", "pos", "chapter", "title",
                       F.md5("content").alias("content_md5"), "boilerplate")


@query("f4_section_order", f"""WITH {PLAN_SQL} SELECT doc_id, pos, major, minor FROM ks""")
def f4_section_order(spark, d):
    rows = st.split_sections(tf.books(spark, d)).withColumn("usable", tx.is_usable_title(c("title")))
    found = rows.select("doc_id", "pos", "usable", st.order_key(c("title")).alias("k"))
    # All rows of a document without usable titles count; its share is one flag per document.
    flags = found.groupBy("doc_id").agg(F.max("usable").alias("any_usable"))
    kept = found.join(flags, "doc_id").where("usable OR NOT any_usable")
    return kept.select("doc_id", "pos", "k.major", "k.minor")


def _cnt(p):
    return f"least(len(regexp_extract_all(lead, '(?i){p}')), 3)"


@query("j17_structure", f"""WITH {tf.BOOKS_SQL}, l AS (SELECT doc_id, {tf.sql_normalise('text')} AS lead FROM books),
m AS (SELECT doc_id, CAST({_cnt(r'\b\d+\.\d+(?:\.\d+)?\b')} + {_cnt(r'mục\s+\d+\.\d+')} + {_cnt(r'\d+\.\d+\.\d+')} + {_cnt(r'section\s+\d+(?:\.\d+)?')} AS INTEGER) AS decimal_matches,
  CAST(len(regexp_extract_all(lead, '(?i)Bài\\s+\\d+[.:;)\\s]')) AS INTEGER) AS lesson_matches FROM l)
SELECT *, CASE WHEN decimal_matches > 0 THEN 'decimal' WHEN lesson_matches >= 2 THEN 'lesson' ELSE 'none' END AS kind,
  decimal_matches > 0 OR lesson_matches >= 2 AS has_sections FROM m""")
def j17_structure(spark, d):
    return st.detect_structure(tf.books(spark, d))


LESSON_LINES_SQL = f"""{tf.BOOKS_SQL}, bl AS (SELECT doc_id, unnest(range(0, len(ls))) AS i, {tf.sql_strip('unnest(ls)')} AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM books)),
topics AS (SELECT doc_id, i, CAST(regexp_extract(line, '(?i)^(?:Bài|Bai)\\s+(\\d+)[.:;)\\s]\\s*(.*)', 1) AS BIGINT) AS lesson,
  {tf.sql_topic("regexp_extract(line, '(?i)^(?:Bài|Bai)\\s+(\\d+)[.:;)\\s]\\s*(.*)', 2)")} AS topic FROM bl WHERE regexp_matches(line, '(?i)^(?:Bài|Bai)\\s+(\\d+)[.:;)\\s]\\s*(.*)'))"""


@query("d19_lesson_topics", f"""WITH {LESSON_LINES_SQL} SELECT doc_id, topic, min(lesson) AS first_lesson, max(lesson) AS last_lesson, CAST(min(i) AS INTEGER) AS first_pos
FROM topics WHERE topic <> '' GROUP BY 1, 2""")
def d19_lesson_topics(spark, d):
    return st.lesson_topics(st.lesson_lines(tf.books(spark, d)))


# Chapter and part lines by first appearance, else topics of lesson lines, else of lessons inside lines, else one chapter.
_ROMAN_SQL = "MAP {" + ", ".join(f"'{r}': '{i}'" for i, r in enumerate(lx.ROMAN[:6], 1)) + "}"


def _first_seen(xs: str) -> str:
    return f"list_filter({xs}, lambda x, i: list_position({xs}, x) = i)"


def _topics_sql(pairs: str) -> str:
    """Topics of (lesson, topic) rows by their least lesson, ties by first appearance."""
    seen = f"list_filter({pairs}, lambda p, i: list_position(list_transform({pairs}, lambda q: q.topic), p.topic) = i)"
    return (f"list_transform(list_sort(list_transform({seen}, lambda p, i: {{'lesson': list_min(list_transform(list_filter({pairs}, lambda q: q.topic = p.topic), "
            "lambda q: q.lesson)), 'i': i, 't': p.topic})), lambda z: 'Chủ đề: ' || z.t)")


def _pair_sql(x: str, pattern: str) -> str:
    topic = tf.sql_strip(f"regexp_replace({tf.sql_strip(f"regexp_extract({x}, '{pattern}', 2)")}, '\\.+$', '')")
    return f"{{'lesson': try_cast(regexp_extract({x}, '{pattern}', 1) AS BIGINT), 'topic': {topic}}}"


_LESSON_RE = r"(?i)^(?:Bài|Bai)\s+(\d+)[.:;)\s]\s*(.*)"
_INLINE_RE = r"(?i)^Bài\s+(\d+)[.:;)\s]\s*([^\n]{3,60})"
INVENTORY_SQL = f"""{tf.BOOKS_SQL}, n AS (SELECT doc_id, {tf.sql_normalise('text')} AS text FROM books),
l AS (SELECT doc_id, text, list_transform(string_split(text, chr(10)), lambda x: {tf.sql_strip('x')}) AS ls FROM n),
k AS (SELECT doc_id, list_filter(list_transform(ls, lambda x: coalesce(nullif(regexp_extract(x, '(?i)^Chương\\s+(\\d+)', 1), ''),
    coalesce(element_at({_ROMAN_SQL}, upper(regexp_extract(x, '(?i)^Phần\\s+([IVX]+)', 1)))[1], nullif(regexp_extract(x, '(?i)^Phần\\s+([IVX]+)', 1), '')))), lambda x: x IS NOT NULL) AS nums,
  list_filter(list_transform(list_filter(ls, lambda x: regexp_matches(x, '{_LESSON_RE}')), lambda x: {_pair_sql('x', _LESSON_RE)}), lambda p: p.topic <> '') AS lines,
  list_filter(list_transform(regexp_extract_all(text, '(?i)(Bài\\s+\\d+[.:;)\\s]\\s*[^\\n]{{3,60}})', 1), lambda x: {_pair_sql('x', _INLINE_RE)}), lambda p: p.topic <> '') AS inl FROM l),
v AS (SELECT doc_id, CASE WHEN len(nums) > 0 THEN list_transform({_first_seen('nums')}, lambda x: 'Chương ' || x) WHEN len(lines) > 0 THEN {_topics_sql('lines')}
  WHEN len(inl) > 0 THEN {_topics_sql('inl')} ELSE ['Chương 1'] END AS chapters FROM k)"""


@query("j18_chapter_inventory", f"WITH {INVENTORY_SQL} SELECT doc_id, CAST(len(chapters) AS INTEGER) AS n_chapters, array_to_string(chapters, ' | ') AS chapters FROM v")
def j18_chapter_inventory(spark, d):
    return st.chapter_inventory(tf.books(spark, d)).select("doc_id", "n_chapters", F.array_join("chapters", " | ").alias("chapters"))


_NUMERALS = "MAP {" + ", ".join(f"'{r}': {i}" for i, r in enumerate(lx.ROMAN[:lx.CHAPTER_ROMANS], 1)) + "}"


@query("j18_chapter_numbers", f"""WITH {tf.BOOKS_SQL}, b AS (SELECT doc_id, {NAMED} AS text FROM books),
n AS (SELECT doc_id, list_sort(list_distinct(list_concat(
  list_transform(regexp_extract_all(text, '{lx.CHAPTER_NUMBERS[0].replace("(?iu)", "(?i)")}', 1), lambda x: CAST(x AS BIGINT)), list_transform(regexp_extract_all(text, '{lx.CHAPTER_NUMBERS[1].replace("(?iu)", "(?i)")}', 1), lambda x: CAST(x AS BIGINT)),
  list_filter(list_transform(regexp_extract_all(text, '{lx.CHAPTER_NUMERALS[0].replace("(?iu)", "(?i)")}', 1), lambda x: CAST(element_at({_NUMERALS}, x)[1] AS BIGINT)), lambda x: x IS NOT NULL)))) AS numbers FROM b)
SELECT doc_id, array_to_string(numbers, ',') AS numbers, CAST(greatest(len(numbers), 1) AS INTEGER) AS n_chapters,
  CASE WHEN len(numbers) = 0 THEN 'Chương 1' ELSE array_to_string(list_transform(numbers, lambda x: 'Chương ' || x), ' | ') END AS chapters FROM n""")
def j18_chapter_numbers(spark, d):
    named = tf.books(spark, d).select("doc_id", F.expr(NAMED.replace("chr(10)", "'\n'")).alias("text"))
    return st.chapter_numbers(named).select(
        "doc_id", F.array_join(c("numbers").cast("array<string>"), ",").alias("numbers"), "n_chapters", F.array_join("chapters", " | ").alias("chapters"))


@query("j19_outline", f"""WITH {tf.BOOKS_SQL}, l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM books),
t AS (SELECT doc_id, ls, coalesce(list_filter(list_transform(ls[1:10], lambda x: {tf.sql_strip('x')}), lambda x: length(x) > 5 AND length(x) < 100 AND x = upper(x) AND x <> lower(x))[1], '') AS title,
  unnest(range(0, least(len(ls), 200))) AS i FROM l)
SELECT doc_id, title, CAST(i AS INTEGER) AS line_no, {tf.sql_strip('ls[i + 1]')} AS heading, substring(array_to_string(ls[i + 1:i + 20], chr(10)), 1, 500) AS excerpt FROM t
WHERE regexp_matches({tf.sql_strip('ls[i + 1]')}, '(?i)CH[UƯ][ƠƯO]NG\\s+[IVX\\d]+|M[UỤ]C\\s+[\\d.]+|PH[AẦ]N\\s+[IVX\\d]+|^\\d+\\.\\s+[{lx.VI_UPPER}]')""")
def j19_outline(spark, d):
    return st.outline(tf.books(spark, d))


@query("i37_section_usable", f"""WITH {tf.SECTIONS_SQL}
SELECT doc_id, pos, CASE WHEN length(title) < 5 THEN 'short_title' WHEN {tf.sql_any('lower(title)', lx.UNUSABLE_KEYWORDS)} THEN 'title_keyword'
  WHEN {tf.sql_hits('lower(substring(content, 1, 500))', lx.UNUSABLE_KEYWORDS)} >= 3 THEN 'content_keywords'
  WHEN NOT (regexp_matches(title, '^\\d+\\.') OR regexp_matches(title, '(?i)^(Bài|Bai|Lesson)\\s+\\d+')) AND length(title) < 50
    AND ({" OR ".join(f"regexp_matches(lower(title), '(?i){p}')" for p in lx.INTRO_TITLES).replace(chr(92), chr(92))}) THEN 'intro_title'
  WHEN len(regexp_extract_all(substring(content, 1, 800), '\\b\\d{{1,3}}\\s*\\n')) > 5 THEN 'page_numbers' WHEN length(content) < 100 THEN 'short_content'
  WHEN length(content) > 20000 THEN 'long_content' WHEN len(regexp_split_to_array(content, '[.!?]+')) < 2 THEN 'few_sentences' END AS reason
FROM sections""")
def i37_section_usable(spark, d):
    rows = st.split_sections(tf.books(spark, d))
    return rows.select("doc_id", "pos", tx.section_usable(c("title"), c("content")).alias("reason"))


# --- terms and sentences --------------------------------------------------------------

_NOT_STOP = f"NOT list_contains({tf.quoted(lx.STOP_WORDS)}, {{w}})"


@query("d18_top_terms", f"""WITH {tf.SECTIONS_SQL}, w AS (SELECT doc_id, pos, unnest(range(0, len(ws))) AS i, unnest(ws) AS term FROM (SELECT doc_id, pos, {tf.sql_tokens('content', 4)} AS ws FROM sections)),
k AS (SELECT doc_id, pos, term, count(*) AS n, min(i) AS f FROM w WHERE {_NOT_STOP.format(w='term')} GROUP BY ALL)
SELECT doc_id, pos, CAST(row_number() OVER (PARTITION BY doc_id, pos ORDER BY n DESC, f) AS INTEGER) AS rank, term, n FROM k QUALIFY rank <= 10""")
def d18_top_terms(spark, d):
    return tm.top_terms(st.split_sections(tf.books(spark, d)), ["doc_id", "pos"], "content", 10)


@query("i32_snippets", f"""WITH {tf.SECTIONS_SQL} SELECT doc_id, pos, array_to_string({tf.sql_snippets('content', 4, 140)}, ' | ') AS snippets FROM sections""")
def i32_snippets(spark, d):
    rows = st.split_sections(tf.books(spark, d))
    return rows.select("doc_id", "pos", F.array_join(tx.ranked_snippets(c("content")), " | ").alias("snippets"))


@query("i33_key_phrases", f"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(regexp_replace(text, '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '{tf.SP}+'),
  lambda w: length(w) BETWEEN 3 AND 25 AND NOT regexp_matches(w, '^\\d+$') AND NOT list_contains({tf.quoted(lx.KEYWORD_STOP_WORDS)}, lower(w))) AS ws FROM documents),
g AS (SELECT doc_id, list_concat(list_transform(range(1, len(ws)), lambda i: {{'g': lower(ws[i] || ' ' || ws[i + 1]), 'z': 2}}),
   list_transform(range(1, greatest(len(ws) - 1, 1)), lambda i: {{'g': lower(ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]), 'z': 3}})) AS gs FROM w),
ge AS (SELECT doc_id, unnest(range(0, len(gs))) AS i, unnest(gs) AS x FROM g),
gc AS (SELECT doc_id, x.g AS gram, x.z AS z, count(*) AS n, min(i) AS f FROM ge GROUP BY doc_id, x.g, x.z HAVING count(*) >= 3 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, f) <= 8),
ph AS (SELECT doc_id, list(gram ORDER BY n DESC, f)[1:5] AS ps FROM gc WHERE NOT {tf.sql_any('gram', lx.KEYWORD_BLACKLIST)}
  AND (z = 3 OR (regexp_matches(split_part(gram, ' ', 1), '^\\p{{Ll}}') AND regexp_matches(split_part(gram, ' ', 2), '^\\p{{Ll}}'))) GROUP BY doc_id),
se AS (SELECT doc_id, unnest(range(0, len(ws))) AS i, lower(unnest(ws)) AS wd FROM w),
sc AS (SELECT doc_id, wd, count(*) AS n, min(i) AS f FROM se GROUP BY doc_id, wd HAVING count(*) >= 5 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, f) <= 30),
sw AS (SELECT doc_id, list(wd ORDER BY n DESC, f) AS wl FROM sc GROUP BY doc_id),
j AS (SELECT doc_id, coalesce(ps, []::VARCHAR[]) AS ps, coalesce(wl, []::VARCHAR[]) AS wl FROM ph FULL JOIN sw USING (doc_id))
SELECT doc_id, array_to_string(list_reduce(wl, lambda a, x: CASE WHEN len(a) >= 5 OR len(list_filter(a, lambda k: contains(k, x))) > 0 THEN a ELSE list_append(a, x) END, ps), ' | ') AS phrases
FROM j""")
def i33_key_phrases(spark, d):
    docs = spread(load(spark, d, "documents").select("doc_id", "text"))
    return tm.key_phrases(docs, "doc_id", "text").select("doc_id", F.array_join("phrases", " | ").alias("phrases"))


KEYWORDS = ("the", "with", "des", "und")


@query("i34_sentence_score", f"""
WITH {tf.MARKED_SQL}, s AS (SELECT doc_id, unnest(range(0, len(ss))) AS "at", unnest(ss) AS s FROM (SELECT doc_id, {SENTENCES_SQL} AS ss FROM marked)),
v AS (SELECT doc_id, "at", s, lower(s) AS low, {tf.sql_words('s')} AS nw, {tf.sql_hits('lower(s)', KEYWORDS)} AS kw FROM s)
SELECT doc_id, CAST("at" AS INTEGER) AS "at", CAST(CASE WHEN regexp_matches(s, '(?i)^(?:{"|".join(lx.METADATA_STARTS)})') THEN -100 WHEN nw < 20 THEN 0 ELSE
  len(regexp_extract_all(low, '\\d+[.,]?\\d*\\s*%|\\d+[.,]\\d+|\\d{{4}}|\\d+ [a-zà-ỹ]+')) * 10 + len(regexp_extract_all(s, '[A-ZÀ-Ỹ][a-zà-ỹ]+(?:\\s+[A-ZÀ-Ỹ][a-zà-ỹ]+)+')) * 6
  + {tf.sql_hits('low', lx.EXAMPLE_MARKERS)} * 8 - {tf.sql_hits('low', lx.GENERIC_SENTENCE_PHRASES)} * 8 + kw * 12 + CASE WHEN kw >= 2 THEN 8 ELSE 0 END
  + CASE WHEN nw BETWEEN 30 AND 120 THEN 6 WHEN nw BETWEEN 20 AND 29 OR nw BETWEEN 121 AND 150 THEN 3 ELSE 0 END + CASE WHEN "at" < 2 THEN 5 WHEN "at" < 5 THEN 3 ELSE 0 END
  + {tf.sql_hits('low', lx.DEFINITION_MARKERS)} * 3 - CASE WHEN length(s) - length(regexp_replace(s, '[|*#]', '', 'g')) > 3 THEN 5 ELSE 0 END END AS INTEGER) AS score FROM v""")
def i34_sentence_score(spark, d):
    rows = st.explode_rows(tf.marked_documents(spark, d), tx.sentences(c("text")), ("doc_id",), "at")
    return rows.select("doc_id", "at", tm.sentence_score(c("s"), c("at"), tx.lit_array(KEYWORDS)).alias("score"))


@query("i35_extractive_answer", f"""
WITH {tf.SECTIONS_SQL}, s AS (SELECT doc_id, pos, title, chapter, pos % 6 + 1 AS level, 4 + pos % 3 AS np,
  list_filter(list_transform(regexp_split_to_array({tf.sql_strip('content')}, '[.!?]+\\s+'), lambda x: {tf.sql_strip('x')}), lambda x: length(x) > 30) AS ss FROM sections),
r AS (SELECT *, greatest(2, len(ss) // np) AS run, CASE level {" ".join(f"WHEN {k} THEN {tf.quoted(v)}" for k, v in lx.ANSWER_TITLES.items())} END AS ts FROM s)
SELECT doc_id, pos, md5(array_to_string(list_transform(range(0, np), lambda i: '- ' || coalesce(ts[i + 1], 'Nội dung ' || (i + 1)) || chr(10)
  || coalesce(nullif(array_to_string(ss[i * run + 1:(i + 1) * run], ' '), ''), 'Nội dung liên quan được trình bày trong mục ' || chr(39) || title || chr(39) || ', bao gồm các khái niệm và phương pháp cụ thể.') || chr(10)), chr(10))) AS answer_md5 FROM r""")
def i35_extractive_answer(spark, d):
    rows = st.split_sections(tf.books(spark, d))
    drafts = tm.extractive_answer(rows, c("pos") % 6 + 1, c("pos") % 3 + 4)
    return drafts.select("doc_id", "pos", F.md5("answer").alias("answer_md5"))


_SCORE = f"""CASE WHEN regexp_matches(s, '(?i)^(?:{"|".join(lx.METADATA_STARTS)})') THEN -100 WHEN nw < 20 THEN 0 ELSE
  len(regexp_extract_all(lower(s), '\\d+[.,]?\\d*\\s*%|\\d+[.,]\\d+|\\d{{4}}|\\d+ [a-zà-ỹ]+')) * 10 + len(regexp_extract_all(s, '[A-ZÀ-Ỹ][a-zà-ỹ]+(?:\\s+[A-ZÀ-Ỹ][a-zà-ỹ]+)+')) * 6
  + {tf.sql_hits('lower(s)', lx.EXAMPLE_MARKERS)} * 8 - {tf.sql_hits('lower(s)', lx.GENERIC_SENTENCE_PHRASES)} * 8 + kw * 12 + CASE WHEN kw >= 2 THEN 8 ELSE 0 END
  + CASE WHEN nw BETWEEN 30 AND 120 THEN 6 WHEN nw BETWEEN 20 AND 29 OR nw BETWEEN 121 AND 150 THEN 3 ELSE 0 END + CASE WHEN i < 2 THEN 5 WHEN i < 5 THEN 3 ELSE 0 END
  + {tf.sql_hits('lower(s)', lx.DEFINITION_MARKERS)} * 3 - CASE WHEN length(s) - length(regexp_replace(s, '[|*#]', '', 'g')) > 3 THEN 5 ELSE 0 END END"""
_TITLES = f"CASE level {' '.join(f'WHEN {k} THEN {tf.quoted(v)}' for k, v in lx.ANSWER_TITLES.items())} END"


@query("i35_structured_answer", f"""
WITH {tf.MARKED_SQL}, d AS (SELECT doc_id, doc_id % 6 + 1 AS level, doc_id % 6 + 1 AS np, doc_id % 2 = 0 AS keyed, {SENTENCES_SQL} AS ss FROM marked),
u AS (SELECT doc_id, unnest(range(0, len(ss))) AS k, {tf.sql_strip('unnest(ss)')} AS s FROM d),
g AS (SELECT doc_id, s, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS i, {tf.sql_words('s')} AS nw, {tf.sql_hits('lower(s)', KEYWORDS)} AS kw FROM u
  WHERE NOT regexp_matches(s, '(?i)^(?:{"|".join(lx.DRAFT_METADATA_STARTS)})') AND length(s) > 50 AND {tf.sql_words('s')} >= 25),
h AS (SELECT doc_id, list(s ORDER BY i) AS plain, list(s ORDER BY {_SCORE} DESC, i) AS best FROM g GROUP BY doc_id),
p AS (SELECT d.doc_id, np, {_TITLES} AS ts, CASE WHEN keyed AND len(plain) > np * 2 THEN best[1:np * 3] ELSE coalesce(plain, []) END AS ss FROM d LEFT JOIN h USING (doc_id)),
q AS (SELECT *, greatest(2, len(ss) // np) AS run FROM p),
r AS (SELECT doc_id, i, ts, list_slice(ss, i * run + 1, (i + 1) * run) AS part FROM (SELECT *, unnest(range(0, np)) AS i FROM q)),
t AS (SELECT doc_id, i, ts, list_filter(part, lambda x, j: list_position(list_transform(part, lambda y: lower(y)), lower(x)) = j) AS us FROM r),
a AS (SELECT doc_id, i, CASE WHEN len(us) > 0 THEN '- ' || coalesce(ts[i + 1], 'Chi tiết bổ sung ' || (i - len(ts) + 1)) || array_to_string(list_transform(us, lambda x, j: CASE WHEN j = 1 THEN x
  WHEN {" OR ".join(f"starts_with(x, '{w}')" for w in lx.DRAFT_LINKED_STARTS)} THEN ' ' || x ELSE ' ' || {tf.quoted(lx.DRAFT_CONNECTORS)}[(j - 1) % 7 + 1] || ' ' || x END), '') ELSE '' END AS piece FROM t)
SELECT doc_id, md5(string_agg(piece, '' ORDER BY i)) AS answer_md5, CAST(count(*) FILTER (piece <> '') AS INTEGER) AS n_points FROM a GROUP BY doc_id""")
def i35_structured_answer(spark, d):
    level = c("doc_id") % 6 + 1
    titles = F.create_map(*[x for lv, names in lx.ANSWER_TITLES.items() for x in (F.lit(lv).cast("bigint"), tx.lit_array(names))])
    keywords = F.when(c("doc_id") % 2 == 0, tx.lit_array(KEYWORDS)).otherwise(F.array().cast("array<string>"))
    rows = tf.marked_documents(spark, d).select("doc_id", tx.sentences(c("text")).alias("ss"))
    answer = tm.structured_answer(c("ss"), level.cast("int"), F.element_at(titles, level), keywords)
    rows = st.computed_once(rows, ["doc_id"], {"answer": answer})
    # Sentences hold no dash after their start of the form that begins a point.
    points = F.size(F.regexp_extract_all("answer", F.lit(_POINT_STARTS), F.lit(0)))
    return rows.select("doc_id", F.md5("answer").alias("answer_md5"), points.cast("int").alias("n_points"))


_POINT_STARTS = "- (?:" + "|".join([*sorted({t for ts in lx.ANSWER_TITLES.values() for t in ts}, key=len, reverse=True), r"Chi tiết bổ sung \d"]) + ")"


@query("i36_unsupported_lines", f"""
WITH qa AS (SELECT c.conv_id, c.turn, c.conv_id * 8 + c.turn AS pair_id, c.text AS answer, d.text AS source FROM conversations c JOIN documents d ON d.doc_id = c.conv_id WHERE role = 'assistant'),
l AS (SELECT pair_id, source, unnest(range(0, len(ls))) AS line_no, {tf.sql_strip('unnest(ls)')} AS line FROM (SELECT pair_id, source, string_split(answer, chr(10)) AS ls FROM qa)),
w AS (SELECT *, list_distinct(list_filter({tf.sql_tokens('line', 2)}, lambda x: NOT list_contains({tf.quoted(lx.SUPPORT_STOP_WORDS)}, x))) AS ws FROM l WHERE line NOT LIKE '-%' AND length(line) >= 20),
z AS (SELECT pair_id, CAST(line_no AS INTEGER) AS line_no, line, CAST(len(ws) AS INTEGER) AS n_words, CAST(len(list_intersect(ws, {tf.sql_tokens('source', 2)})) AS INTEGER) AS n_known FROM w)
SELECT * FROM z WHERE n_words > 0 AND n_known / n_words < 0.5""")
def i36_unsupported_lines(spark, d):
    talk = load(spark, d, "conversations").where("role = 'assistant'").selectExpr(
        "conv_id AS doc_id", "conv_id * 8 + turn AS pair_id", "text AS answer")
    docs = load(spark, d, "documents").selectExpr("doc_id", "text AS source")
    return tm.unsupported_lines(talk.join(docs, "doc_id"), "pair_id", "answer", "source")
