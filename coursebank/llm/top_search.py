"""Exact top-k search by inner product: blocks in the order of their bounds, until no bound reaches the k-th score."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from coursebank.llm import tiles
from coursebank.llm.common import staged

K = 20
KEY_BITS = 24
SEED = 11
LEAST = np.iinfo(np.int64).min


@functools.lru_cache(8)
def _planes(dim: int) -> np.ndarray:
    """Fixed directions whose signs order the vectors, so that a block holds similar ones."""
    return np.random.default_rng([SEED, dim]).standard_normal((dim, KEY_BITS))


def _with_key(rows: DataFrame) -> DataFrame:
    """Adds ``key``, the signs of a vector along fixed directions as one integer."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column(2)
            sizes = lists.value_lengths().to_numpy().astype(np.int64)
            m = tiles.matrix(lists.flatten().to_numpy(zero_copy_only=False), sizes)
            signs = m @ _planes(m.shape[1]) > 0 if m.shape[1] else np.zeros((len(m), KEY_BITS), bool)
            key = signs @ (1 << np.arange(KEY_BITS, dtype=np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(key.astype(np.int64))],
                                             names=["id", "label", "v", "key"])

    return rows.select("id", "label", "v").mapInArrow(run, "id long, label long, v array<bigint>, key long")


def bounds(q: np.ndarray, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """Greatest score that a query can have in a block: the summed greatest contributions of its components.

    Where 64 bits may not hold the sum, it is computed in doubles and rounded up.
    """
    parts = (np.maximum(q, 0), hi), (np.minimum(q, 0), lo)
    dim = min(q.shape[1], hi.shape[1])
    most = sum(float(np.abs(x).max(initial=0)) * float(np.abs(y).max(initial=0)) * dim for x, y in parts)
    if most < 2.0 ** 62:
        return sum(tiles.dot(x, y) for x, y in parts)
    near = sum(x[:, :dim].astype(np.float64) @ y[:, :dim].T.astype(np.float64) for x, y in parts)
    return np.clip(near + most * 1e-12, -2.0 ** 62, 2.0 ** 63 - 1024).astype(np.int64)


def search(blocks: list[tiles.Block], batch: tiles.Batch, k: int) -> list[np.ndarray]:
    """The first ``k`` rows of the blocks for each query by (score, smaller id), without the query's own id.

    Each query visits its blocks by falling bound, one at first and twice as many at each further turn, and ends when
    the next bound is below its k-th score; a bound equal to it counts only for blocks with a smaller id. ``extra``
    may bring the k-th score and id that are known from elsewhere; rows behind that are left out.
    """
    n = len(batch.ids)
    floor = np.array([x or [LEAST, LEAST] for x in batch.extra], np.int64).reshape(n, 2)
    kth, kth_id = floor[:, 0].copy(), floor[:, 1].copy()
    first = np.array([b.first_id for b in blocks])
    bound = bounds(batch.vals, *tiles.boxes([(b.hi, b.lo) for b in blocks]))
    order = np.argsort(-bound, axis=1, kind="stable")
    top = [np.zeros(0, np.int64)] * 3  # query, score, id
    at, width = 0, 1
    while at < len(blocks):
        turn = order[:, at:at + width]
        best = np.take_along_axis(bound, turn, 1)
        open_ = (best > kth[:, None]) | ((best == kth[:, None]) & (first[turn] < kth_id[:, None]))
        if not (best[:, 0] >= kth).any():
            break
        rows, cols = np.nonzero(open_)
        found = [top]
        which = turn[rows, cols]
        for b in np.unique(which):
            q, block = rows[which == b], blocks[b]
            s = tiles.dot(batch.vals[q], block.vals)
            good = (s > kth[q, None]) | ((s == kth[q, None]) & (block.ids[None] < kth_id[q, None]))
            good &= block.ids[None] != batch.ids[q, None]
            x, y = np.nonzero(good)
            found.append([q[x], s[x, y], block.ids[y]])
        top = [np.concatenate(x) for x in zip(*found)]
        place = np.lexsort((top[2], -top[1], top[0]))
        top = [x[place] for x in top]
        rank = np.arange(len(top[0])) - np.searchsorted(top[0], top[0])
        top = [x[rank < k] for x in top]
        last = rank[rank < k] == k - 1
        q, score, ident = (x[last] for x in top)
        kth[q], kth_id[q] = score, ident
        at, width = at + width, width * 2
    return [batch.ids[top[0]], batch.twins[top[0]], top[2], top[1]]


def _open_shards(shards: list[tiles.Block], batch: tiles.Batch) -> list[np.ndarray]:
    """Shards in which a query may still find something, with its bound there; ``extra``: k-th score and id so far."""
    floor = np.array([x or [LEAST, LEAST] for x in batch.extra], np.int64)
    bound = bounds(batch.vals, *tiles.boxes([(b.hi, b.lo) for b in shards]))
    first = np.array([b.first_id for b in shards])
    q, s = np.nonzero((bound > floor[:, :1]) | ((bound == floor[:, :1]) & (first[None] < floor[:, 1:])))
    return [batch.ids[q], batch.twins[q], np.array([b.ids[0] for b in shards], np.int64)[s], bound[q, s]]


def top_search(rows: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: the ``k`` rows with the highest inner product for each query.

    Both tables have ``vec_id`` and ``v``, an array of integers; further columns are ignored. Ties go to the smaller
    id. Rows with the query's own id are no answers. Rows without an id or vector take no part, nor do vectors with a
    null component; components beyond a vector's end count as zero, so an empty vector scores 0 with all. Rows that
    share an id are answers of their own; equal query rows (id and vector) are answered once, and rows of one id
    with different vectors each give a list. Scores must fit into 64 bits. An empty table gives no rows.

    Rows are ordered by the signs of fixed projections and cut into ranges of blocks. A query first searches the shard
    with the greatest bound; its k-th score there closes most other shards before the query is sent to them.
    """
    rows, queries = (t.select(F.col("vec_id").cast("long").alias("id"), F.lit(0).cast("long").alias("label"),
                              F.col("v").cast("array<bigint>").alias("v"))
                     .where("id IS NOT NULL AND v IS NOT NULL AND NOT exists(v, x -> x IS NULL)") for t in (rows, queries))
    index = tiles.blocks(_with_key(rows), ["key", "id"])
    shards = tiles.summaries(index)
    queries = staged(tiles.query_rows(queries), "queries")

    def answer(blocks: list[tiles.Block], batch: tiles.Batch) -> list[np.ndarray]:
        return search(blocks, batch, k)

    schema = "query_id long, twin long, vec_id long, score long"
    queries = queries.withColumn("extra", F.lit(None).cast("array<bigint>"))
    route = "id long, twin long, shard long, bound long"
    home = tiles.to_groups(shards, queries, _open_shards, route).groupBy("id", "twin").agg(
        F.max_by("shard", F.struct("bound", "shard")).alias("shard"))
    home = staged(home.join(queries, ["id", "twin"]).select("shard", "id", "twin", "v", "extra"), "home")
    seeds = staged(tiles.deliver(index, home, answer, schema), "seeds")
    floors = seeds.groupBy("query_id", "twin").agg(
        F.count("*").alias("n"), F.min(F.struct("score", (-F.col("vec_id")).alias("back"))).alias("last")).where(f"n = {k}")
    floors = floors.select(F.col("query_id").alias("id"), "twin", F.array("last.score", -F.col("last.back")).alias("extra"))
    known = staged(home.drop("extra").withColumnRenamed("shard", "at").join(floors, ["id", "twin"], "left"), "floors")
    routes = tiles.to_groups(shards, known, _open_shards, route).join(known, ["id", "twin"]).where("shard <> at")
    routes = staged(routes.select("shard", "id", "twin", "v", "extra"), "routes")
    found = seeds.union(tiles.deliver(index, routes, answer, schema))
    rank = F.row_number().over(Window.partitionBy("query_id", "twin").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
