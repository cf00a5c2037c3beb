"""Mixing sources to target weights by a golden-ratio schedule of equal-token blocks."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from coursebank.llm.common import n_words, partitions, staged

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_PASSES = 2
BLOCK = 1024
SEED = 17


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE) -> DataFrame:
    """Per source: ``source``, ``source_size``, ``target``.

    Weights repeat over the sources by code point, null last. The targets share ``share`` times all words by
    weight; none exceeds MOST_PASSES times its source, and the excess goes to the others by weight. Sorted by
    size / weight, the capped sources come first, so one pass over running sums finds the common level. The windows
    run over one row per source.
    """
    src = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = Window.orderBy(F.col("source").asc_nulls_last())
    src = src.withColumn("w", F.element_at(
        F.array(*map(F.lit, weights)), (F.row_number().over(rank) - 1) % len(weights) + 1).cast("double"))
    src = src.withColumn("cap", F.col("source_size") * float(MOST_PASSES))
    src = src.withColumn("ratio", F.col("cap") / F.col("w"))
    line = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    upto = line.rowsBetween(Window.unboundedPreceding, -1)
    rest = line.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("source_size").over(whole) * share
    src = src.withColumn("level", (total - F.coalesce(F.sum("cap").over(upto), F.lit(0.0))) / F.sum("w").over(rest))
    src = src.withColumn("n", F.row_number().over(line))
    first = F.min(F.when(F.col("ratio") > F.col("level"), F.struct("n", "level"))).over(whole)
    src = src.withColumn("first", first)
    free = F.col("first").isNotNull() & (F.col("n") >= F.col("first.n"))
    return src.select("source", "source_size",
                      F.when(free, F.col("first.level") * F.col("w")).otherwise(F.col("cap")).alias("target"))


def streams(sizes: DataFrame) -> DataFrame:
    """``sizes`` with ``at``: the place of a document's first word in its source's shuffled stream.

    Order within a source is by a seeded hash of doc_id. Running sums go in two steps, over hash buckets and
    inside each bucket, so a hot source is spread over many tasks.
    """
    fan = 8 * partitions(sizes.sparkSession)
    rows = sizes.withColumn("h", F.xxhash64("doc_id", F.lit(SEED))).withColumn("b", F.pmod("h", F.lit(fan)))
    base = rows.groupBy("source", "b").agg(F.sum("size").alias("s"))
    before = Window.partitionBy("source").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    base = base.select(F.col("source").alias("bs"), F.col("b").alias("bb"),
                       F.coalesce(F.sum("s").over(before), F.lit(0)).alias("base"))
    inner = (Window.partitionBy("source", "b").orderBy("h", "doc_id", "size")
             .rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("inside", F.coalesce(F.sum("size").over(inner), F.lit(0)))
    rows = rows.join(base, F.col("source").eqNullSafe(F.col("bs")) & (F.col("b") == F.col("bb")))
    return rows.select("doc_id", "source", "size", (F.col("base") + F.col("inside")).alias("at"))


def schedule(src: DataFrame, block: int = BLOCK) -> DataFrame:
    """The slots of the mix: ``slot``, ``source``, ``rank``, ``pass``, ``block``, ``take``.

    Slot i is the point frac(i * g / N), with g / N next to the golden ratio and g prime to N: the N points are a
    permutation of 0..N-1, and source s owns as many consecutive points as its target has blocks, so every source
    gets exactly its share and is spread evenly. A source's slots are ranked by i and take its blocks in order,
    pass by pass; the last slot takes what is left to the target. Ranks go in two steps over chunks of slots.
    """
    t = F.floor(F.col("target") + 0.5).cast("long")
    src = src.select("source", "source_size", F.least(t, MOST_PASSES * F.col("source_size")).alias("goal"))
    src = src.where("goal > 0").withColumn("nb", F.ceil(F.col("source_size") / block).cast("long"))
    src = src.withColumn("passes", F.floor(F.col("goal") / F.col("source_size")).cast("long"))
    src = src.withColumn("rest", F.col("goal") - F.col("passes") * F.col("source_size"))
    src = src.withColumn("slots", F.col("passes") * F.col("nb") + F.ceil(F.col("rest") / block).cast("long"))
    order = Window.orderBy(F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    src = src.withColumn("first", F.coalesce(F.sum("slots").over(order), F.lit(0)))
    n = src.agg(F.sum("slots")).first()[0] or 1
    g = max(1, round(n * (math.sqrt(5) - 1) / 2))
    while math.gcd(g, n) > 1:
        g += 1
    back = pow(g, -1, n) if n > 1 else 0
    step = 4096
    runs = src.select("*", F.explode(F.sequence(F.lit(0), F.col("slots") - 1, F.lit(step))).alias("run"))
    runs = runs.repartition(partitions(src.sparkSession), "source", "run")
    rows = runs.select("*", F.explode(F.sequence("run", F.least(F.col("run") + step, F.col("slots")) - 1)).alias("k"))
    point = (F.col("first") + F.col("k")).cast("decimal(19,0)") * F.lit(back).cast("decimal(19,0)")
    rows = rows.withColumn("slot", (point % F.lit(n).cast("decimal(19,0)")).cast("long"))
    chunk = max(step, math.isqrt(n))
    rows = rows.withColumn("chunk", F.floor(F.col("slot") / chunk).cast("long"))
    counts = rows.groupBy("source", "chunk").agg(F.count("*").alias("c"))
    before = Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(F.col("source").alias("cs"), F.col("chunk").alias("cc"),
                           F.coalesce(F.sum("c").over(before), F.lit(0)).alias("base"))
    rows = rows.withColumn("inside", F.row_number().over(Window.partitionBy("source", "chunk").orderBy("slot")) - 1)
    rows = rows.join(counts, F.col("source").eqNullSafe(F.col("cs")) & (F.col("chunk") == F.col("cc")))
    rows = rows.withColumn("rank", F.col("base") + F.col("inside"))
    rows = rows.withColumn("pass", F.floor(F.col("rank") / F.col("nb")).cast("long"))
    rows = rows.withColumn("block", F.col("rank") % F.col("nb"))
    left = F.col("rest") - F.col("block") * block
    take = F.when(F.col("pass") < F.col("passes"), F.lit(block)).otherwise(F.least(F.lit(block), left))
    return rows.select("slot", "source", "rank", "pass", "block", take.cast("long").alias("take"))


def pieces(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """Parts of documents by block: ``doc_id``, ``source``, ``size``, ``at``, ``block``, ``lo``, ``len``.

    ``lo`` is the place of the part's first word in its block. Documents without words have no part.
    """
    first, last = F.floor(F.col("at") / block), F.floor((F.col("at") + F.col("size") - 1) / block)
    rows = rows.where("size > 0").select("*", F.explode(F.sequence(first, last)).alias("block"))
    lo = F.greatest(F.col("at"), F.col("block") * block)
    hi = F.least(F.col("at") + F.col("size"), (F.col("block") + 1) * block)
    return rows.select("*", (lo - F.col("block") * block).alias("lo"), (hi - lo).alias("len"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, block: int = BLOCK) -> DataFrame:
    """``doc_id``, ``source``, ``size``, ``source_size``, ``target``, ``taken`` and ``copies`` of every document.

    Takes ``doc_id``, ``text`` and ``source``. ``taken`` counts the words that the schedule's blocks hold of the
    document, repeats included; ``copies`` counts the passes that take its first word. Documents without words take
    none and have no copy. Null sources form one source, last in order. Repeated rows are documents of their own.
    """
    sizes = staged(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")), "mix-sizes")
    src = staged(targets(sizes, weights, share), "mix-sources")
    rows = staged(streams(sizes), "mix-streams")
    slots = schedule(src, block).select(F.col("source").alias("ss"), F.col("block").alias("sb"), "take")
    parts = pieces(rows, block).join(
        slots, F.col("source").eqNullSafe(F.col("ss")) & (F.col("block") == F.col("sb")), "left")
    got = F.greatest(F.lit(0), F.least(F.col("len"), F.coalesce("take", F.lit(0)) - F.col("lo")))
    opens = (F.col("block") == F.floor(F.col("at") / block)) & (F.coalesce("take", F.lit(0)) > F.col("lo"))
    taken = parts.groupBy("doc_id", "source", "size", "at").agg(
        F.sum(got).cast("long").alias("taken"), F.sum(opens.cast("long")).alias("copies")).drop("at")
    none = rows.where("size = 0").select("doc_id", "source", "size", F.lit(0).cast("long").alias("taken"),
                                         F.lit(0).cast("long").alias("copies"))
    src = src.withColumnRenamed("source", "ss")
    return taken.union(none).join(src, F.col("source").eqNullSafe(F.col("ss"))).drop("ss")
