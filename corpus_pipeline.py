"""Pipeline of the training corpus over the documents table.

Each stage takes (spark, docs, sf_dir), works on all rows of its predecessor and returns the columns of documents; the
last returns tokens. run() writes every stage's rows to the shared folder and reads them back as the next one's.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coursebank.llm import byte_bpe, common, jaccard, lines, mixing, toxicity

# Models, whole-corpus order and hashes have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
# Near copies of the corpus; the op1 query has its own values.
NEAR_WORDS = 5
NEAR_PERCENT = 80


def clean_of_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model accepts, as they are."""
    model = toxicity.train(docs, common.table(spark, sf_dir, "labels"))
    return model.accepted(docs).select(*COLUMNS)


def without_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that their source repeats on more than a tenth of its different texts."""
    out = lines.drop_boilerplate(docs.select(*COLUMNS), F.col("source"), F.col("text"), copies_count=False)
    return out.select("doc_id", F.col("clean_text").alias("text"), "lang", "source", F.coalesce(
        F.length("clean_text").cast("long"), "n_chars").alias("n_chars"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of every group of near copies: that of smallest doc_id, then text hash; rows without an id stay.

    Near copies have at least 80 % of their five-word shingles in common. Rows are told apart by doc_id and text, so
    different texts with one doc_id are different documents; rows without words each form a group of their own.
    """
    rows = jaccard.component_rows(docs, words=NEAR_WORDS, percent=NEAR_PERCENT).where("doc_id IS NOT NULL")
    keep = rows.where("root IS NOT NULL").groupBy("root").agg(F.min(F.struct("doc_id", "th")).alias("k")).select("k.*")
    keep = keep.union(rows.where("root IS NULL").select("doc_id", "th").distinct())
    keep = common.staged(keep, "kept")
    th = F.xxhash64("text")
    one = docs.select(*COLUMNS, th.alias("th")).join(keep, ["doc_id", "th"], "left_semi")
    one = one.dropDuplicates(["doc_id", "th"])
    return one.select(*COLUMNS).union(docs.where("doc_id IS NULL").select(*COLUMNS))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document once for every pass of the mix that takes its first word; those without words take none."""
    taken = mixing.mix(docs).groupBy("doc_id", "source", "size").agg(F.max("copies").cast("int").alias("copies"))
    taken = taken.where("copies > 0").select(F.col("doc_id").alias("d"), F.col("source").alias("s"), "size", "copies")
    rows = docs.select(*COLUMNS, common.n_words(F.col("text")).alias("n"))
    rows = rows.join(taken, F.col("doc_id").eqNullSafe(F.col("d")) & F.col("source").eqNullSafe(F.col("s"))
                     & (F.col("n") == F.col("size")))
    return rows.select(*COLUMNS, F.explode(F.array_repeat(F.lit(0), F.col("copies"))).alias("copy")).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, and digests of the ids and of the bytes decoded from them."""
    coded = byte_bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
                                      public_tokenizers.PATTERN)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids",
                        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", clean_of_toxicity),
    ("line_dedup", without_boilerplate),
    ("ngram_jaccard", one_of_each_group),
    ("source_mix", mixed),
    ("byte_bpe", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.staged(stage(spark, docs, sf_dir), name)
    return docs
