"""Embedding near-dedup by randomised-rotation binary codes with correction factors and confidence bounds."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coursebank.llm.common import components, staged

COSINE = 0.95
MISS = 0.02  # chance that a pair just at the threshold shares no band
BLOCK = 512
SURE = 4.0  # deviations of the estimate beyond which a pair needs no exact value
SEED = 23
BATCH = 4000  # rows compared at a time, besides the rest of a bucket
GROUP = ["dim", "band", "key", "bi", "bj"]


def bands_for(n: int, cosine: float = COSINE, miss: float = MISS) -> tuple[int, int]:
    """Bits a band and number of bands for ``n`` vectors.

    A bit of the code differs with probability angle / pi. Bands two bits longer than log2(n) hold few chance meetings
    a vector at any size; so many bands are taken that a pair at the threshold misses all with probability ``miss``.
    """
    bits = min(60, max(8, math.ceil(math.log2(max(n, 2))) + 2))
    meet = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(miss) / math.log(1 - meet)))


@functools.lru_cache(8)
def rotation(dim: int, bits: int) -> np.ndarray:
    """``bits`` x ``dim`` part of a random rotation: orthonormal columns where bits >= dim."""
    size = max(dim, bits)
    q, r = np.linalg.qr(np.random.default_rng(SEED + dim).standard_normal((size, size)))
    return (q * np.sign(np.diag(r)))[:bits, :dim]


def band_keys(rotated: np.ndarray, bits: int) -> np.ndarray:
    """Sign bits of the rotated vectors as one integer per band."""
    signs = (rotated >= 0).reshape(len(rotated), -1, bits)
    return (signs * (1 << np.arange(bits, dtype=np.int64))).sum(2)


def classes(rows: DataFrame, bits: int, bands: int) -> DataFrame:
    """One row per distinct vector: ``rep`` (least id), ``copies``, ``vec`` (packed unit vector), ``keys``.

    Null ids, null, zero or non-finite vectors are left out.
    """
    v = F.col("embedding")
    good = (F.col("vec_id").isNotNull() & (F.size(v) > 0)
            & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
            & F.exists(v, lambda x: x != 0))
    one = rows.where(good).select(F.col("vec_id").cast("long").alias("vec_id"), v.cast("array<double>").alias("v"))
    one = one.groupBy("v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vecs, keys = [], []
            for x in batch.column(0):
                x = np.array(x.as_py(), np.float64)
                x = x / np.abs(x).max()
                x = x / np.sqrt(x @ x)
                vecs.append(x.tobytes())
                keys.append(band_keys((rotation(len(x), bits * bands) @ x)[None], bits)[0])
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(vecs, pa.binary()),
                                              pa.array(keys, pa.list_(pa.int64()))], names=names)

    names = ["rep", "copies", "vec", "keys"]
    return staged(one.mapInArrow(run, "rep long, copies long, vec binary, keys array<bigint>"), "vectors")


def _pairs(run: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of all pairs of rows in the same run, by distance; the runs stand one after another."""
    for step in range(1, len(run)):
        x = np.flatnonzero(run[:-step] == run[step:])
        if not len(x):
            return
        yield x, x + step


def bucket_links(rows: pd.DataFrame, bits: int, bands: int, cosine: float) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Links inside whole buckets: per row the copies that it newly links with, and a spanning forest of the links.

    Rows stand sorted by bucket and block pair, and their vectors have one length. A pair belongs to the first band in
    which its keys meet, so it is counted in one band only. The estimate <code_x, y> / <code_x, x> of the inner
    product is unbiased under the rotation, and its deviation follows from the correction <code_x, x>; only pairs
    whose bound reaches the threshold get an exact inner product.
    """
    vec = np.frombuffer(b"".join(rows["vec"]), np.float64).reshape(len(rows), -1)
    rep, copies, block, band = (rows[c].to_numpy() for c in ("rep", "copies", "block", "band"))
    same = (rows["bi"] == rows["bj"]).to_numpy()
    run = rows.groupby(GROUP, sort=False).ngroup().to_numpy()
    rotated = vec @ rotation(vec.shape[1], bits * bands).T
    width = rotated.shape[1]
    code = np.where(rotated >= 0, 1.0, -1.0) / math.sqrt(width)
    fix = (code * rotated).sum(1)
    length = (rotated ** 2).sum(1)
    keys = band_keys(rotated, bits)
    spread = SURE * np.sqrt(np.maximum(length / fix ** 2 - 1, 0)) / math.sqrt(max(width - 1, 1))
    xs, ys = [], []
    for x, y in _pairs(run):
        x, y = ((z[same[x] | (block[x] != block[y])]) for z in (x, y))
        estimate = np.einsum("ij,ij->i", code[x], rotated[y]) / fix[x] * length[x]
        maybe = estimate + spread[x] + (1 - length[y]) >= cosine
        x, y = x[maybe], y[maybe]
        x, y = (z[np.einsum("ij,ij->i", vec[x], vec[y]) >= cosine] for z in (x, y))
        if len(x):
            earlier = np.arange(bands)[None] < band[x][:, None]
            fresh = ~((keys[x] == keys[y]) & earlier).any(1)
            xs.append(x[fresh])
            ys.append(y[fresh])
    x = np.concatenate(xs) if xs else np.zeros(0, np.int64)
    y = np.concatenate(ys) if ys else np.zeros(0, np.int64)
    n = np.zeros(len(rows), np.int64)
    np.add.at(n, x, copies[y])
    np.add.at(n, y, copies[x])
    root: dict[int, int] = {}

    def find(i: int) -> int:
        while root.get(i, i) != i:
            root[i] = i = root.get(root[i], root[i])
        return i

    edges = []
    for i, j in zip(rep[x].tolist(), rep[y].tolist()):
        i, j = find(i), find(j)
        if i != j:
            root[max(i, j)] = min(i, j)
            edges.append((i, j))
    return n, edges


def near_vectors(rows: DataFrame, cosine: float = COSINE) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id``, ``kept`` of every row.

    Takes ``vec_id`` and ``embedding``. Vectors link at a cosine of at least ``cosine``; vectors of different length
    don't. Equal vectors are one row with a count from the start. A row meets others in the buckets of its bands;
    buckets above BLOCK rows are cut into blocks and each pair of blocks is one small group, so no bucket is capped
    and none meets in one task. Groups give counts per row and a spanning forest, never all pairs. Null, zero or
    non-finite vectors, and rows without an id, link with nothing; repeated rows are vectors of their own.
    """
    bits, bands = bands_for(rows.count(), cosine)
    cls = classes(rows, bits, bands)
    at = cls.select("rep", "copies", "vec", F.posexplode("keys").alias("band", "key"))
    at = at.withColumn("dim", F.length("vec"))
    sizes = at.groupBy("dim", "band", "key").agg(F.count("*").alias("c")).where("c > 1")
    at = at.join(sizes, ["dim", "band", "key"]).withColumn("nb", F.ceil(F.col("c") / BLOCK).cast("int"))
    at = at.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("nb")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("nb") - 1))
    at = at.select("*", other.alias("o")).withColumns({"bi": F.least("block", "o"), "bj": F.greatest("block", "o")})
    at = at.select(*GROUP, "block", "rep", "copies", "vec").repartition(*GROUP).sortWithinPartitions(*GROUP)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pd.DataFrame] = []

        def links(df: pd.DataFrame) -> Iterator[pa.RecordBatch]:
            for _, some in df.groupby("dim", sort=False):
                n, edges = bucket_links(some, bits, bands, cosine)
                kept = np.flatnonzero(n)
                rep, ends = some["rep"].to_numpy()[kept], np.array(edges, np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate([rep, ends[:, 0]])), pa.array(np.concatenate([rep, ends[:, 1]])),
                    pa.array(np.concatenate([n[kept], np.zeros(len(ends), np.int64)]))], names=["a", "b", "n"])

        for batch in batches:
            held.append(batch.to_pandas())
            if sum(map(len, held)) < BATCH:
                continue
            df = pd.concat(held, ignore_index=True)
            # The last bucket may go on in the next batch.
            last = (df[GROUP] == df[GROUP].iloc[-1]).all(axis=1).to_numpy()
            held = [df[last]]
            if not last.all():
                yield from links(df[~last])
        if held:
            yield from links(pd.concat(held, ignore_index=True))

    found = staged(at.mapInArrow(run, "a long, b long, n long"), "vector-links")
    counts = found.where("a = b").groupBy("a").agg(F.sum("n").alias("n")).withColumnRenamed("a", "rep")
    roots = components(found.where("a <> b").select("a", "b")).select(F.col("id").alias("rep"), "root")
    known = cls.select("rep", "copies", "vec").join(counts, "rep", "left").join(roots, "rep", "left")
    known = known.select("rep", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"),
                         F.coalesce("root", "rep").alias("component_id"))
    v = F.col("embedding").cast("array<double>")
    reps = rows.select("vec_id", v.alias("v")).where("vec_id IS NOT NULL")
    reps = reps.join(reps.groupBy("v").agg(F.min("vec_id").cast("long").alias("rep")), "v", "left").drop("v")
    out = reps.join(known, "rep", "left").union(
        rows.where("vec_id IS NULL").select(*[F.lit(None).alias(c) for c in ("rep", "vec_id", "n_links", "component_id")]))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"),
                      F.coalesce("component_id", "vec_id").cast("long").alias("component_id"),
                      F.coalesce(F.col("vec_id") == F.coalesce("component_id", "vec_id"), F.lit(False)).alias("kept"))
