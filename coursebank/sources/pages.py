"""Page texts: choice of layer, merging into documents, statistics and page lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from coursebank.functions import text as tx
from coursebank.operators.structure import computed_once


def list_corpus(spark: SparkSession, path: str, glob: str = "*.pdf") -> DataFrame:
    """Files of a corpus folder by name; contents are never read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return files.select("path", F.substring_index("path", "/", -1).alias("name"), "length").orderBy("name")


def corpus_contents(df: DataFrame, text: str, suffix: str = ".parquet") -> DataFrame:
    """What each file, or directory of part files, of a table holds: name, rows and characters of its text."""
    name = F.regexp_extract(F.col("_metadata.file_path"), rf"([^/]+{suffix})(?:/|$)", 1)
    return df.select(name.alias("name"), F.length(F.coalesce(F.col(text), F.lit(""))).cast("long").alias("n")).groupBy("name").agg(
        F.count("*").alias("n_rows"), F.sum("n").alias("n_chars"))


def check_corpus_paths(paths: DataFrame, suffix: str = ".pdf") -> DataFrame:
    """Explicitly listed paths that have the wanted suffix, whatever its case."""
    return paths.where(F.lower("path").endswith(suffix))


def choose_page_text(pages: DataFrame, primary: str, alternate: str) -> DataFrame:
    """Text of a page with two text layers, without recognition.

    The alternate layer wins if it has more formula characters, or repairs words broken apart.
    """
    first = tx.strip(F.coalesce(primary, F.lit("")))
    second = tx.strip(F.coalesce(alternate, F.lit("")))
    rows = pages.withColumns({"_a": first, "_b": second})
    # Letters of all words are what is left without white space, so no word is measured on its own.
    letters = lambda x: F.length(F.regexp_replace(x, tx.ANY_SPACE, ""))
    rows = rows.withColumns({"_wa": tx.word_count(F.col("_a")), "_wb": tx.word_count(F.col("_b")),
                             "_sa": tx.stem_count(F.col("_a")), "_sb": tx.stem_count(F.col("_b"))})
    mean = F.when(F.col("_wa") > 10, letters(F.col("_a")) / F.col("_wa")).otherwise(F.lit(99.0))
    rows = rows.withColumn("_mean", mean)
    broken = (F.col("_mean") < 4.5) & (F.col("_wa") > 15)
    mean_b = F.when(F.col("_wb") > 0, letters(F.col("_b")) / F.col("_wb")).otherwise(F.lit(0.0))
    better = (F.col("_sb") > F.col("_sa")) | (broken & (mean_b > F.col("_mean") + 0.5))
    source = (
        F.when((F.col("_a") == "") & (F.col("_b") == ""), "none")
        .when(F.col("_a") == "", "alternate")
        .when(((F.col("_sa") >= 2) | broken) & (F.col("_b") != "") & better, "alternate")
        .otherwise("primary")
    )
    rows = rows.withColumn("page_source", source)
    chosen = F.when(F.col("page_source") == "alternate", F.col("_b")).otherwise(F.col("_a"))
    return computed_once(rows, pages.columns, {"page_source": F.col("page_source"), "text": tx.normalise_text(chosen)})


def choose_page_ocr(pages: DataFrame, layer: str, ocr: str) -> DataFrame:
    """Text of a page with a text layer and a recognised text.

    A clean layer wins; else the recognised text; else a layer that is not garbled; else nothing.
    """
    rows = pages.withColumns({
        "_l": F.coalesce(layer, F.lit("")), "_o": F.coalesce(ocr, F.lit("")),
    }).withColumns({"_has": tx.strip(F.col("_l")) != "", "garbled": tx.is_garbled(F.col("_l")), "_n": tx.word_count(F.col("_l"))})
    source = (
        F.when(F.col("_has") & ~F.col("garbled") & (F.col("_n") >= 30), "clean_layer")
        .when(F.col("_o") != "", "ocr")
        .when(F.col("_has") & ~F.col("garbled"), "layer")
        .when(F.col("_has"), "skipped_garbled")
        .otherwise("none")
    )
    rows = rows.withColumn("page_source", source)
    chosen = (F.when(F.col("page_source").isin("clean_layer", "layer"), F.col("_l"))
              .when(F.col("page_source") == "ocr", F.col("_o")).otherwise(F.lit("")))
    return computed_once(rows, pages.columns, {
        "page_source": F.col("page_source"), "garbled": F.col("garbled"), "has_layer": F.col("_has"),
        "text": tx.normalise_text(chosen)})


def running_offset(df: DataFrame, partition: list[str], order: str, size: Column, name: str = "start") -> DataFrame:
    """Sum of ``size`` over the rows before each row of its partition."""
    before = W.partitionBy(*partition).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return df.withColumn(name, F.coalesce(F.sum(size).over(before), F.lit(0)))


def merge_pages(pages: DataFrame) -> DataFrame:
    """Pages (doc_id, page_num, text) to documents (doc_id, text, page_boundaries).

    The merged text is one value per document, so its pages meet in one row; a fold over them
    yields the start offset of each page.
    """
    # Empty pages are left out by the aggregate: a filter would be pushed below the page choice and repeat it.
    page = F.when(F.col("text") != "", F.struct("page_num", "text"))
    rows = pages.groupBy("doc_id").agg(F.array_sort(F.collect_list(page)).alias("pages"))
    bound = "array<struct<offset:bigint,page:int>>"
    zero = F.struct(F.lit(0).cast("bigint").alias("next"), F.array().cast(bound).alias("out"))

    def step(acc: Column, p: Column) -> Column:
        entry = F.struct(acc["next"].alias("offset"), p["page_num"].cast("int").alias("page"))
        return F.struct((acc["next"] + F.length(p["text"]) + 2).cast("bigint").alias("next"),
                        F.array_append(acc["out"], entry).alias("out"))

    merged = tx.strip(F.array_join(F.transform("pages", lambda p: p["text"]), "\n\n"))
    return rows.select("doc_id", merged.alias("text"), F.aggregate("pages", zero, step)["out"].alias("page_boundaries"))


def page_stats(pages: DataFrame) -> DataFrame:
    """Extraction statistics per document, from pages with ``page_source``, ``garbled`` and ``has_layer``."""
    src = F.col("page_source")
    return pages.groupBy("doc_id").agg(
        F.count("*").alias("total_pages"), F.count_if("has_layer").alias("pages_with_text_layer"),
        F.count_if((src != "clean_layer") & (F.coalesce("ocr_text", F.lit("")) != "")).alias("pages_with_ocr_text"),
        F.count_if(F.col("has_layer") & F.col("garbled")).alias("garbled_pages"),
        F.count_if(src == "clean_layer").alias("pages_skipped_clean"))


def low_yield(docs: DataFrame, text: str = "text", pages: str | None = None) -> DataFrame:
    """Flag documents with under 100 words per page; the page count of stored text is estimated."""
    n_pages = F.col(pages) if pages else F.greatest(F.floor(F.length(text) / 3000), F.lit(1))
    rows = docs.withColumns({"n_words": tx.word_count(F.col(text)), "n_pages": n_pages.cast("bigint")})
    return rows.withColumn("low_yield", F.col("n_words") / F.greatest("n_pages", F.lit(1)) < 100)


def merge_layers(a: Column, b: Column) -> Column:
    """Lines of two text layers in order; of lines equal up to case and punctuation the first stays."""
    lines = F.transform(F.split(F.concat_ws("\n", a, b), r"\r\n|\r|\n"), tx.strip)
    keyed = F.transform(F.filter(lines, lambda x: F.length(x) >= 2), lambda x: F.struct(
        F.regexp_replace(F.lower(x), r"[^\p{L}\p{N}_]+", "").alias("key"), x.alias("line")))
    firsts = tx.first_of_equal(F.filter(keyed, lambda x: x["key"] != ""), lambda x: x["key"])
    return F.array_join(F.transform(firsts, lambda x: x["line"]), "\n")


def page_of_offset(positions: DataFrame, documents: DataFrame) -> DataFrame:
    """Page of each (doc_id, char_offset): the last one that starts at or before it, else the first page."""
    bounds = documents.select("doc_id", "page_boundaries")
    b, at = F.col("page_boundaries"), F.col("char_offset")
    before = F.filter(b, lambda x: x["offset"] <= at)
    page = F.coalesce(F.try_element_at(before, F.lit(-1))["page"], F.get(b, F.lit(0))["page"])
    return positions.join(bounds, "doc_id", "left").withColumn("page_num", page).drop("page_boundaries")
