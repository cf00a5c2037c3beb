"""Scans, written intermediate tables and components, shared by the operators of this package."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# ASCII white space, the separators of words.
SPACES = " \t\n\x0b\x0c\r"
SLICE_BYTES = 4_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that driver and executors share.

    The session's ``spark.checkpoint.dir`` names it; where that is unset, a folder beside the warehouse is set.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "-checkpoints"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, so a lost executor costs no rerun."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bare(text: Column) -> Column:
    """The text without ASCII white space."""
    return F.translate(text, SPACES, "")


def words(text: Column) -> Column:
    """Words of the text: runs of anything but ASCII white space; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def n_words(text: Column) -> Column:
    """Number of words; 0 for null."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, r"[\x20\x09-\x0D]+"))).cast("long")


def slices(batches: Iterator[pa.RecordBatch], column: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows in slices of about ``most`` bytes of text, so that memory doesn't follow the batch."""
    for batch in batches:
        size = np.cumsum([len(x.as_buffer()) if x.is_valid else 0 for x in batch.column(column)])
        lo = 0
        while lo < batch.num_rows:
            hi = int(np.searchsorted(size, (size[lo - 1] if lo else 0) + most, "right"))
            hi = max(hi, lo + 1)
            yield batch.slice(lo, hi - lo)
            lo = hi


def give_back() -> None:
    """Return a worker's freed memory to the machine: workers live on between tasks, beside the next stage's."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Smallest reachable id of every id that has an edge: columns ``id``, ``root``.

    ``edges`` has long columns ``a`` and ``b``. Alternates the two star steps of large-scale label contraction:
    every node links its larger neighbours, then its smaller ones, to the smallest id it knows. Each round is
    written to the shared folder. Minima are combined before the shuffle, so a hub is no single large group; the
    number of rounds grows with the logarithm of the longest path.
    """
    links = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                   .distinct(), name)
    before = None
    while True:
        both = links.union(links.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.union(low.where("m < u").select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = (small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(low.select("u", F.col("m").alias("v")))).distinct()
        links = staged(small, name)
        state = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return links.select(F.col("u").alias("id"), F.col("v").alias("root")).union(
                links.select("v", "v").distinct())
        before = state
