"""Line dedup by the share of a site's pages that carry a line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coursebank.llm.common import SPACES, bare, staged

MADE = ("site", "clean_text", "n_lines", "n_dropped")
MIN_PAGES = 5
MAX_RATIO = 0.1


def host_of(url: Column) -> Column:
    """Lower-case host of a URL without its port; null where there is none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)", 1))
    return F.when(host != "", host)


def page_text(html: Column) -> Column:
    """Text of a page: scripts, styles, comments and tags go, block elements end a line."""
    text = F.regexp_replace(html, r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->", "")
    text = F.regexp_replace(text, r"(?i)<(?:/p|/h[1-6]|/li|/div|/title|br|/tr)[^>]*>", "\n")
    return F.regexp_replace(text, r"<[^>]*>", "")


def _keys(text: Column) -> Column:
    """One digest per line in order; null for a line without a word. White space at both ends doesn't count."""
    return F.transform(F.split(text, "\n", -1),
                       lambda x: F.when(bare(x) != "", F.unhex(F.md5(F.btrim(x, F.lit(SPACES))))))


def boilerplate(lines: DataFrame, max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """Lines to drop per host: ``host``, ``line``, ``n_pages``, ``host_pages``.

    ``lines`` has ``host`` and ``keys`` (line digests of a page). A line counts once a page. Both counts are
    combined before their shuffles, so neither a hot host nor a hot line meets in one task.
    """
    totals = lines.groupBy("host").agg(F.count("*").alias("host_pages"))
    once = F.array_distinct(F.filter("keys", lambda k: k.isNotNull()))
    counts = (lines.select("host", F.explode(once).alias("line"))
              .groupBy("host", "line").agg(F.count("*").alias("n_pages"))
              .where(F.col("n_pages") >= min_pages))
    totals = totals.withColumnRenamed("host", "h")
    both = counts.join(totals, F.col("host").eqNullSafe(F.col("h"))).drop("h")
    return both.where(F.col("n_pages") > max_ratio * F.col("host_pages"))


def drop_boilerplate(docs: DataFrame, host: Column, text: Column, max_ratio: float = MAX_RATIO,
                     min_pages: int = MIN_PAGES, copies_count: bool = True) -> DataFrame:
    """``docs`` with ``site``, ``clean_text``, ``n_lines`` and ``n_dropped``; own columns of these names give way to them.

    A line goes from all pages of its host when at least ``min_pages`` of them and more than ``max_ratio`` of them
    have it. Pages without a host form one group of their own. Lines without a word stay and aren't counted; a null
    text stays null; what is left keeps its order. Repeated rows stay and count as pages; with ``copies_count`` false
    all rows of a host with the same text count as one page, in both numbers, so copies alone never drop a line. Only
    line digests are shuffled for the counts; each page meets its own drop list by a digest of the page.
    """
    names = docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), host.alias("host"),
                       text.alias("text"))
    rows = rows.withColumn("page", F.unhex(F.md5(F.concat_ws("\x00", F.coalesce("host", F.lit("")), "text"))))
    slim = rows.select("host", "page", _keys(F.coalesce("text", F.lit(""))).alias("keys"))
    slim = staged(slim if copies_count else slim.dropDuplicates(["host", "page"]), "lines")
    bad = boilerplate(slim, max_ratio, min_pages).select(F.col("host").alias("h"), "line")
    once = slim.dropDuplicates(["host", "page"]) if copies_count else slim
    at = once.select("host", "page", F.posexplode("keys").alias("pos", "line"))
    at = at.where("line IS NOT NULL").join(
        bad.withColumnRenamed("line", "l"), F.col("host").eqNullSafe(F.col("h")) & (F.col("line") == F.col("l")))
    drops = at.groupBy("host", "page").agg(F.collect_list("pos").alias("drops"))
    drops = drops.select(F.col("host").alias("h"), F.col("page").alias("p"), "drops")
    out = rows.join(drops, (F.col("page") == F.col("p")) & F.col("host").eqNullSafe(F.col("h")), "left")
    kept = F.array_join(F.filter(F.split("text", "\n", -1),
                                 lambda x, i: F.coalesce(~F.array_contains("drops", i), F.lit(True))), "\n")
    kept = F.when(F.col("drops").isNull(), F.col("text")).otherwise(kept)
    n_lines = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda x: bare(x) != ""))
    kept_names = [c for c in names if c.lower() not in MADE]
    return out.select(*[F.col("row")[c].alias(c) for c in kept_names], F.col("host").alias("site"),
                      kept.alias("clean_text"), n_lines.cast("long").alias("n_lines"),
                      F.coalesce(F.size("drops"), F.lit(0)).cast("long").alias("n_dropped"))
