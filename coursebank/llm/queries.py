"""One query per operator over its whole table, and the DuckDB statements of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coursebank.llm import (byte_bpe, common, hard_negatives, jaccard, lines, mixing, near_vectors, prefix_trie, quality, repeats,
                            tiles, token_counts, token_files, top_search, toxicity)

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query and its DuckDB statement."""

    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


@query("op1_ngram_jaccard", r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 4 THEN list_aggregate(w, 'string_agg', ' ')
    ELSE w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] END AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM w WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc_id)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, min(root) AS component_id
FROM r LEFT JOIN n USING (doc_id) GROUP BY doc_id, n
""")
def ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents by 85 % of common four-word shingles."""
    return jaccard.jaccard_components(common.table(spark, sf_dir, "documents"))


@query("op2_token_files")
def token_file_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written as packed token files and read back."""
    return token_files.token_files(common.table(spark, sf_dir, "documents"), WORD_BPE)


# The mix depends on a hash order; SQL gives what doesn't: sizes, targets and the rows.
@query("op3_source_mix")
def source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    mixed = mixing.mix(common.table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


@query("op4_repeated_bytes")
def repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the 50-byte strings that an earlier document has."""
    out = repeats.without_repeats(common.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query("op5_toxicity")
def toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model learned from the labels outside the held-out third."""
    docs = common.table(spark, sf_dir, "documents")
    return toxicity.train(docs, common.table(spark, sf_dir, "labels")).score(docs)


@query("op6_quality_rules", r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), m AS (
  SELECT doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_capitals,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM d
), g AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS gram
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)
), twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM g) WHERE c > 1
), r AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY doc_id
), x AS (
  SELECT doc_id, n_words, word_chars, n_symbols, n_capitals, len(l) AS n_lines,
    len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words
  FROM m LEFT JOIN r USING (doc_id)
), f AS (
  SELECT *, n_words < 50 AS f0, 100 * n_repeat_words > 50 * n_words AS f1, 10 * n_symbols > 3 * n_words AS f2,
    word_chars < 2 * n_words AS f3, word_chars > 20 * n_words AS f4, 2 * n_dup_lines > n_lines AS f5,
    2 * n_capitals > word_chars AS f6
  FROM x
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, f0 OR f1 AS base_failed,
  NOT (f0 OR f1 OR f2 OR f3 OR f4 OR f5 OR f6) AS kept, n_lines, n_capitals,
  (f0::INT + 2 * f1::INT + 4 * f2::INT + 8 * f3::INT + 16 * f4::INT + 32 * f5::INT + 64 * f6::INT)::BIGINT AS failures
FROM f
""")
def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledger of all documents with the verdict of the current policy."""
    rows = quality.apply_policy(quality.ledger(common.table(spark, sf_dir, "documents")))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                       "kept", "n_lines", "n_capitals", "failures")


@query("op7_byte_bpe")
def byte_bpe_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents and the bytes decoded from them, as digests."""
    coded = byte_bpe.encode_documents(common.table(spark, sf_dir, "documents"), BYTE_RANKS, public_tokenizers.PATTERN)
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op8_edited_counts")
def edited_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents before and after their personal data are replaced by marks."""
    edited = token_counts.redactions(common.table(spark, sf_dir, "documents"))
    return token_counts.count_edited(edited, BYTE_RANKS, public_tokenizers.PATTERN)


@query("op9_site_lines", rf"""
WITH p AS (
  SELECT page_id, nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)', 1)), '') AS site,
    regexp_replace(regexp_replace(regexp_replace(html,
      '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->', '', 'g'),
      '(?i)<(?:/p|/h[1-6]|/li|/div|/title|br|/tr)[^>]*>', chr(10), 'g'), '<[^>]*>', '', 'g') AS t
  FROM pages
), l AS (
  SELECT page_id, site, unnest(string_split(t, chr(10))) AS line, unnest(range(len(string_split(t, chr(10))))) AS pos
  FROM p WHERE t IS NOT NULL
), k AS (SELECT *, nullif(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '') AS key FROM l),
h AS (SELECT site, count(*) AS n FROM p GROUP BY site),
bad AS (
  SELECT c.site, c.key FROM (SELECT site, key, count(DISTINCT page_id) AS c FROM k WHERE key IS NOT NULL GROUP BY ALL) c
  JOIN h ON h.site IS NOT DISTINCT FROM c.site WHERE c.c >= {lines.MIN_PAGES} AND c.c > {lines.MAX_RATIO} * h.n
), m AS (
  SELECT k.*, bad.key IS NOT NULL AS gone
  FROM k LEFT JOIN bad ON k.key = bad.key AND k.site IS NOT DISTINCT FROM bad.site
)
SELECT p.page_id, p.site, coalesce(s.n_lines, 0)::BIGINT AS n_lines, coalesce(s.n_dropped, 0)::BIGINT AS n_dropped,
  CASE WHEN p.t IS NULL THEN NULL ELSE coalesce(s.kept, '') END AS clean_text
FROM p LEFT JOIN (
  SELECT page_id, count(key) AS n_lines, count(*) FILTER (gone) AS n_dropped,
    string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone) AS kept
  FROM m GROUP BY page_id) s USING (page_id)
""")
def site_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All web pages without the lines that most pages of their host repeat."""
    pages = common.table(spark, sf_dir, "pages")
    bodies = common.staged(pages.select("page_id", "url", lines.page_text(F.col("html")).alias("body")), "bodies")
    out = lines.drop_boilerplate(bodies, lines.host_of(F.col("url")), F.col("body"))
    return out.select("page_id", "site", "n_lines", "n_dropped", "clean_text")


@query("op10_near_vectors")
def near_vector_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings at a cosine of 0.95."""
    return near_vectors.near_vectors(common.table(spark, sf_dir, "embeddings"))


GOOD = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"


@query("op11_top_search", f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND {GOOD}
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM (SELECT * FROM v WHERE vec_id % 20 = 0) q JOIN v c ON q.vec_id <> c.vec_id
)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM s) WHERE r <= 20
""")
def top_search_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 highest integer inner products among all embeddings for each 20th."""
    rows = common.table(spark, sf_dir, "embeddings").where(tiles.finite(F.col("embedding")))
    rows = rows.select("vec_id", tiles.whole(F.col("embedding"), 64).alias("v"))
    return top_search.top_search(rows, rows.where("vec_id % 20 = 0"), 20)


@query("op12_hard_negatives", f"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND {GOOD}
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same,
    CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM (SELECT * FROM v WHERE vec_id % 50 = 0) a JOIN v b ON a.vec_id <> b.vec_id
), p AS (
  SELECT anchor_id, id, score
  FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS r FROM s WHERE same) WHERE r <= 5
), n AS (
  SELECT p.anchor_id, p.id AS positive_id, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id) AS r
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
    AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
)
SELECT anchor_id, positive_id, CAST(r AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE r <= 3
""")
def hard_negative_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Negatives between 50 and 95 percent of the positives' scores for each 50th embedding."""
    rows = common.table(spark, sf_dir, "embeddings").where(tiles.finite(F.col("embedding")))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = rows.select("vec_id", label.alias("label"), tiles.whole(F.col("embedding"), 256).alias("v"))
    return hard_negatives.hard_negatives(rows, rows.where("vec_id % 50 = 0"))


# CRC-32 of the decimal id, bit by bit.
CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
      lambda a, z: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END)))"""


@query("op13_prefix_trie", f"""
WITH t AS (
  SELECT conv_id, {{'role': coalesce(role, ''), 'text': coalesce(text, '')}} AS x,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(coalesce(role, ''))::VARCHAR || ':' ||
      coalesce(role, '') || coalesce(text, ''))) AS r
  FROM conversations WHERE conv_id IS NOT NULL
), c AS (SELECT conv_id, list(x ORDER BY r) AS own FROM t GROUP BY conv_id),
h AS (SELECT *, conv_id - conv_id % 20 AS base, {CRC} % 4 AS h FROM c),
b AS (
  SELECT h.conv_id, list_concat(coalesce(list_slice(c.own, 1, h.h), []), list_slice(h.own, h.h + 1, len(h.own))) AS s
  FROM h LEFT JOIN c ON c.conv_id = h.base
), p AS (SELECT conv_id, unnest(range(len(s) + 1)) AS depth, s FROM b),
q AS (SELECT conv_id, depth, CASE WHEN depth = 0 THEN [] ELSE list_slice(s, 1, depth) END AS pre, len(s) AS n FROM p),
m AS (SELECT conv_id, depth, n, pre, min(conv_id) OVER (PARTITION BY depth, pre) AS owner FROM q),
g AS (
  SELECT owner, depth, count(*) AS n_convs, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = depth), '') AS ends
  FROM m GROUP BY owner, depth
), o AS (
  SELECT g.*, up.owner AS parent, coalesce(len(regexp_extract_all(m.pre[g.depth].text, '[^\x20\x09-\x0D]+')), 0) AS words
  FROM g JOIN m ON m.conv_id = g.owner AND m.depth = g.depth
  LEFT JOIN m up ON up.conv_id = g.owner AND up.depth = g.depth - 1
), k AS (SELECT parent AS owner, depth - 1 AS depth, count(*) AS n_children FROM o WHERE depth > 0 GROUP BY ALL),
x AS (SELECT o.*, coalesce(k.n_children, 0) AS n_children FROM o LEFT JOIN k USING (owner, depth)),
down AS (
  SELECT m.owner, m.depth, count(*) FILTER (x.n_children = 0) AS n_leaves, sum((x.n_convs - 1) * x.words) AS saved_tokens
  FROM x JOIN m ON m.conv_id = x.owner AND m.depth <= x.depth GROUP BY ALL
)
SELECT owner AS conv_id, depth::BIGINT AS depth, parent AS parent_conv_id, n_convs, n_children, n_leaves,
  saved_tokens::BIGINT AS saved_tokens, sha256(ends) AS ends_sha256
FROM x JOIN down USING (owner, depth)
""")
def prefix_trie_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the trie of all conversations, each rebuilt on the first turns of the one it belongs to."""
    turns = common.staged(prefix_trie.turn_rows(common.table(spark, sf_dir, "conversations")), "turns")
    convs = common.staged(turns.select("conv").distinct(), "conversations")
    return prefix_trie.prefix_trie(prefix_trie.with_shared_heads(turns, convs), convs)
