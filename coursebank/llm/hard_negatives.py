"""Hard negatives of anchors: scores sorted by a shuffle, windows opened by the positives as the rows stream past."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from coursebank.llm import tiles
from coursebank.llm.common import staged

POSITIVES = 5
NEGATIVES = 3
LOW, HIGH = 50, 95  # percent of the positive's score


def _best(scores: np.ndarray, allowed: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the ``most`` highest allowed scores of each row; equal scores by column, which are sorted by id."""
    n = scores.shape[1]
    # One integer holds score and place. Scores beyond 2^48 in a shard are ordered in two steps instead.
    if np.abs(scores).max(initial=0) < 2 ** 62 // max(n, 1):
        packed = np.where(allowed, scores * n + (n - 1 - np.arange(n)), np.iinfo(np.int64).min)
        if n > most:
            least = np.partition(packed, n - most, axis=1)[:, n - most]
            allowed = allowed & (packed >= least[:, None])
        return np.nonzero(allowed)
    rows, cols = [], []
    for i in range(len(scores)):
        place = np.flatnonzero(allowed[i])
        place = place[np.argsort(-scores[i][place], kind="stable")][:most]
        rows.append(np.full(len(place), i))
        cols.append(place)
    return np.concatenate(rows), np.concatenate(cols)


def _shard(blocks: list[tiles.Block]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, labels and vectors of a shard by id."""
    ids, labels = (np.concatenate([getattr(b, c) for b in blocks]) for c in ("ids", "labels"))
    sizes = np.concatenate([np.full(len(b.ids), b.vals.shape[1]) for b in blocks])
    vals = tiles.matrix(np.concatenate([b.vals.ravel() for b in blocks]), sizes)
    place = np.argsort(ids, kind="stable")
    return ids[place], labels[place], vals[place]


def positives_in(blocks: list[tiles.Block], batch: tiles.Batch, most: int) -> list[np.ndarray]:
    """The ``most`` highest rows of the anchor's label in the blocks; ``extra`` is the anchor's label."""
    ids, labels, vals = _shard(blocks)
    s = tiles.dot(batch.vals, vals)
    label = np.array([x[0] for x in batch.extra], np.int64)
    q, d = _best(s, (labels[None] == label[:, None]) & (ids[None] != batch.ids[:, None]), most)
    return [batch.ids[q], batch.twins[q], s[q, d], ids[d]]


def negatives_in(blocks: list[tiles.Block], batch: tiles.Batch, most: int, low: int, high: int) -> list[np.ndarray]:
    """For each window the ``most`` highest rows of other labels in the blocks, each row once an anchor.

    ``extra`` is the anchor's label, then the scores of its positives.
    """
    ids, labels, vals = _shard(blocks)
    s = tiles.dot(batch.vals, vals)
    label = np.array([x[0] for x in batch.extra], np.int64)
    other = labels[None] != label[:, None]
    taken = np.zeros(s.shape, bool)
    for j in range(1, max(map(len, batch.extra))):
        has = np.array([len(x) > j for x in batch.extra])
        p = np.array([x[j] if len(x) > j else 0 for x in batch.extra], np.int64)
        lo, hi = -(-low * p // 100), high * p // 100
        inside = other & (s >= lo[:, None]) & (s <= hi[:, None]) & has[:, None]
        taken[_best(s, inside, most)] = True
    q, d = np.nonzero(taken)
    return [batch.ids[q], batch.twins[q], s[q, d], ids[d]]


def windows(batches: Iterator[pa.RecordBatch], most: int, low: int, high: int) -> Iterator[pa.RecordBatch]:
    """Negatives of each positive from rows sorted by (anchor, falling score, positives first, id).

    A positive opens its window; a negative goes to every open window that it falls into and that isn't full. The
    state is the open windows of one anchor.
    """
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    key, open_ = None, []
    for batch in batches:
        out = []
        for anchor, twin, back, kind, ident in zip(*(c.to_pylist() for c in batch.columns)):
            if (anchor, twin) != key:
                key, open_ = (anchor, twin), []
            score = -back
            if kind == 0:
                open_.append([ident, score, 0])
                continue
            for window in open_:
                positive, p, n = window
                if n < most and low * p <= 100 * score <= high * p:
                    window[2] = n + 1
                    out.append((anchor, positive, n + 1, ident, p, score))
            # Scores fall: what lies below a window's end never comes back, and a full one takes no more.
            open_ = [w for w in open_ if w[2] < most and 100 * score >= low * w[1]]
        cols = list(zip(*out)) or [()] * 6
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], names=names)


def hard_negatives(rows: DataFrame, anchors: DataFrame, n_positives: int = POSITIVES, n_negatives: int = NEGATIVES,
                   low: int = LOW, high: int = HIGH) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Both tables have ``vec_id``, ``label`` (integer) and ``v`` (array of integers); further columns are ignored. An
    anchor's positives are its first ``n_positives`` other rows of the same label by (inner product, smaller id). For
    each positive the first ``n_negatives`` rows of other labels come back whose score lies between ``low`` and
    ``high`` percent of the positive's, numbered by ``rank``; the window of a negative positive score is empty. Rows
    without an id, label or vector, or with a null component, take no part. Components beyond a vector's end count as
    zero. Rows that share an id are rows of their own, but none is a partner of an anchor of that id; equal anchor
    rows count once. Scores must fit into 64 bits. An empty table gives no rows.

    Every anchor meets every shard of rows, first for the highest of its own label, then, with its windows known, for
    the highest of other labels in each window; nothing else of a shard can be in the result. What is left is packed
    into (anchor, falling score, id) keys, sorted by one shuffle and read as a stream, so no anchor is held whole.
    """
    rows, anchors = (t.select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("label"),
                              F.col("v").cast("array<bigint>").alias("v"))
                     .where("id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL AND NOT exists(v, x -> x IS NULL)")
                     for t in (rows, anchors))
    index = tiles.blocks(rows, ["id"])
    anchors = tiles.query_rows(anchors).select("id", "twin", "v", F.array("label").alias("extra"))
    anchors = staged(anchors, "anchors")
    routes = tiles.to_groups(tiles.summaries(index), anchors, tiles.all_shards, "id long, twin long, shard long")
    routes = staged(routes, "routes")
    schema = "anchor long, twin long, score long, id long"

    def same(blocks: list[tiles.Block], batch: tiles.Batch) -> list[np.ndarray]:
        return positives_in(blocks, batch, n_positives)

    def other(blocks: list[tiles.Block], batch: tiles.Batch) -> list[np.ndarray]:
        return negatives_in(blocks, batch, n_negatives, low, high)

    found = tiles.deliver(index, routes.join(anchors, ["id", "twin"]), same, schema)
    rank = F.row_number().over(Window.partitionBy("anchor", "twin").orderBy(F.desc("score"), "id"))
    positives = staged(found.withColumn("rank", rank).where(F.col("rank") <= n_positives).drop("rank"), "positives")
    # Windows of anchors with a positive: its label, then at most ``n_positives`` scores.
    open_ = positives.groupBy(F.col("anchor").alias("id"), "twin").agg(F.collect_set("score").alias("scores"))
    open_ = staged(anchors.join(open_, ["id", "twin"]).select("id", "twin", "v", F.concat("extra", "scores").alias("extra")), "windows")
    negatives = tiles.deliver(index, routes.join(open_, ["id", "twin"]), other, schema)
    both = positives.withColumn("kind", F.lit(0)).union(negatives.withColumn("kind", F.lit(1)))
    keys = both.select(F.struct("anchor", "twin", (-F.col("score")).alias("back"), "kind", "id").alias("key"))
    keys = keys.repartition(F.col("key.anchor"), F.col("key.twin")).sortWithinPartitions("key").select("key.*")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return windows(batches, n_negatives, low, high)

    return keys.mapInArrow(run, "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, "
                                "negative_score long")
