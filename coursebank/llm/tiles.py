"""Integer vectors packed into blocks and shards, and the delivery of queries to the shards that they need.

A block is one row with up to BLOCK vectors side by side: a forward index with the greatest and least value of every
component. A shard is SHARD_BLOCKS blocks of one range. A task meets one shard at a time, then the queries sent to
it as a stream, so its memory is one shard and one batch of queries.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coursebank.llm.common import staged

BLOCK = 256
SHARD_BLOCKS = 64
SUMMARIES = 512  # shards whose bounds are computed together
QUERIES = 64  # answered together
GROUP_QUERIES = 2048  # a shard with more queries is repeated, a share of the queries each
EXACT = 2 ** 53  # integers that a double holds
BLOCK_SCHEMA = ("shard long, block long, n int, dim int, first_id long, ids binary, labels binary, vals binary, "
                "hi binary, lo binary")


def finite(v: Column) -> Column:
    """True for a vector that is not null and holds no null or non-finite component."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~bad, F.lit(False))


def whole(v: Column, scale: int) -> Column:
    """floor(scale * x) of every component x, computed in double precision."""
    return F.transform(v, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))


def dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of two integer matrices; components that one side lacks count as zero.

    Exact as long as they fit into 64 bits: by doubles where these hold every possible sum, else by 64-bit integers.
    """
    dim = min(a.shape[1], b.shape[1])
    a, b = a[:, :dim], b[:, :dim]
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    if float(np.abs(a).max()) * float(np.abs(b).max()) * dim < EXACT:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


def matrix(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Rows of the given sizes from one run of values, padded with zeros."""
    out = np.zeros((len(sizes), int(sizes.max(initial=0))), np.int64)
    out[np.arange(out.shape[1])[None] < sizes[:, None]] = values
    return out


def pack(m: np.ndarray) -> bytes:
    """The matrix in 32-bit integers where they hold it, else in 64 bits."""
    small = not m.size or (m.min() >= -2 ** 31 and m.max() < 2 ** 31)
    return m.astype("<i4" if small else "<i8").tobytes()


def unpack(data: bytes, n: int, dim: int) -> np.ndarray:
    """The matrix of ``n`` rows that ``pack`` wrote."""
    kind = "<i4" if len(data) == 4 * n * dim else "<i8"
    return np.frombuffer(data, kind).reshape(n, dim).astype(np.int64)


def boxes(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Greatest and least values one below the other; a component that a block lacks is zero there."""
    sizes = np.array([len(h) for h, _ in parts], np.int64)
    return tuple(matrix(np.concatenate([p[i] for p in parts]), sizes) for i in (0, 1))


def _row(row: list) -> pa.RecordBatch:
    """One row of BLOCK_SCHEMA."""
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 5]
    return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)],
                                      names=[x.split()[0] for x in BLOCK_SCHEMA.split(", ")])


def blocks(rows: DataFrame, order: list[str]) -> DataFrame:
    """``id``, ``label`` and ``v`` (array of integers) packed into blocks of ranges by ``order``, as a written table.

    The range partitioning takes ``id`` last, so that any number of equal vectors is split too; copies stand by id.
    """
    rows = rows.select("id", "label", "v", *[c for c in order if c not in ("id", "label", "v")])
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("id", "label", "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = 0, None

        def out(t: pa.RecordBatch) -> pa.RecordBatch:
            nonlocal at
            lists = t.column(2)
            m = matrix(lists.flatten().to_numpy(zero_copy_only=False), lists.value_lengths().to_numpy().astype(np.int64))
            ids, labels = (t.column(i).to_numpy(zero_copy_only=False).astype("<i8") for i in (0, 1))
            shard = (TaskContext.get().partitionId() << 32) + at // SHARD_BLOCKS
            row = [shard, at, len(ids), m.shape[1], int(ids.min()), ids.tobytes(), labels.tobytes(), pack(m),
                   m.max(0).tobytes(), m.min(0).tobytes()]
            at += 1
            return _row(row)

        for batch in batches:
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            whole_blocks = batch.num_rows // BLOCK * BLOCK
            for lo in range(0, whole_blocks, BLOCK):
                yield out(batch.slice(lo, BLOCK))
            held = batch.slice(whole_blocks) if whole_blocks < batch.num_rows else None
        if held is not None:
            yield out(held)

    return staged(rows.mapInArrow(run, BLOCK_SCHEMA), "blocks")


@dataclass
class Block:
    """Vectors of one block in the order of the range."""

    first_id: int
    ids: np.ndarray
    labels: np.ndarray
    vals: np.ndarray
    hi: np.ndarray
    lo: np.ndarray


@dataclass
class Batch:
    """Queries answered together; ``extra`` holds whatever longs the caller sent with each."""

    ids: np.ndarray
    twins: np.ndarray
    vals: np.ndarray
    extra: list[list[int] | None]


def query_rows(rows: DataFrame) -> DataFrame:
    """Distinct queries of ``id``, ``label`` and ``v``: adds ``twin``, which tells rows of one id apart."""
    return rows.select("id", "label", "v", F.xxhash64("label", "v").alias("twin")).dropDuplicates(["id", "twin"])


def deliver(index: DataFrame, routes: DataFrame, answer: Callable[[list[Block], Batch], list[np.ndarray]],
            schema: str) -> DataFrame:
    """``answer(blocks of a shard, batch of queries)`` for all ``routes``: columns of arrays named by ``schema``.

    ``routes`` has ``shard``, ``id``, ``twin``, ``v`` and ``extra`` (array of longs or null). Blocks and queries of a
    shard meet by one shuffle, sorted so that the blocks come first; a shard with more than GROUP_QUERIES queries is
    split, each part with its own copy of the blocks.
    """
    spark = index.sparkSession
    parts = staged(routes.groupBy("shard").agg(F.ceil(F.count("*") / GROUP_QUERIES).cast("int").alias("parts")), "parts")
    groups = parts.agg(F.sum("parts")).first()[0] or 1
    none = [F.lit(None).cast(t).alias(n) for n, t in (("twin", "long"), ("v", "array<bigint>"), ("extra", "array<bigint>"))]
    left = index.join(parts, "shard").select(
        "shard", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("kind"),
        F.col("block").alias("id"), *none, "n", "dim", "first_id", "ids", "labels", "vals", "hi", "lo")
    empty = [F.lit(None).cast(t).alias(n) for n, t in
             (("n", "int"), ("dim", "int"), ("first_id", "long"), *[(c, "binary") for c in ("ids", "labels", "vals", "hi", "lo")])]
    right = routes.join(parts, "shard").select(
        "shard", F.pmod(F.xxhash64("id", "twin"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("kind"),
        "id", "twin", "v", "extra", *empty)
    order = ["shard", "part", "kind", "id", "twin"]
    rows = left.union(right).repartition(max(1, groups), "shard", "part").sortWithinPartitions(*order)
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, shard, held = None, [], []

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held
            if held and shard:
                sizes = np.array([len(x[2]) for x in held], np.int64)
                flat = np.concatenate([np.asarray(x[2], np.int64) for x in held])
                batch = Batch(np.array([x[0] for x in held], np.int64), np.array([x[1] for x in held], np.int64),
                              matrix(flat, sizes), [x[3] for x in held])
                found = answer(shard, batch)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=names)
            held = []

        for batch in batches:
            kinds = batch.column(2).to_numpy()
            for i, (s, p) in enumerate(zip(batch.column(0).to_numpy(), batch.column(1).to_numpy())):
                if (s, p) != key:
                    yield from flush()
                    key, shard = (s, p), []
                if kinds[i]:
                    held.append(tuple(batch.column(c)[i].as_py() for c in (3, 4, 5, 6)))
                    if len(held) == QUERIES:
                        yield from flush()
                else:
                    n, dim, first, ids, labels, vals, hi, lo = (batch.column(c)[i].as_py() for c in range(7, 15))
                    ids, labels, hi, lo = (np.frombuffer(x, "<i8") for x in (ids, labels, hi, lo))
                    shard.append(Block(first, ids, labels, unpack(vals, n, dim), hi, lo))
        yield from flush()

    return rows.mapInArrow(run, schema)


def summaries(index: DataFrame) -> DataFrame:
    """The shards as blocks of one id each with their greatest and least values, about SUMMARIES in a group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, first, parts = None, 0, []

        def out() -> pa.RecordBatch:
            his, los = boxes(parts)
            row = [0, shard, 0, 0, first, np.array([shard], "<i8").tobytes(), b"", b"", his.max(0).tobytes(), los.min(0).tobytes()]
            return _row(row)

        for batch in batches:
            for s, f, hi, lo in zip(*(c.to_pylist() for c in batch.columns)):
                if s != shard and parts:
                    yield out()
                if s != shard:
                    shard, first, parts = s, f, []
                first = min(first, f)
                parts.append((np.frombuffer(hi, "<i8"), np.frombuffer(lo, "<i8")))
        if parts:
            yield out()

    rows = index.select("shard", "first_id", "hi", "lo").repartition("shard").sortWithinPartitions("shard")
    found = staged(rows.mapInArrow(run, BLOCK_SCHEMA), "summaries")
    n = max(1, -(-found.count() // SUMMARIES))
    return found.withColumn("shard", F.pmod(F.xxhash64("block"), F.lit(n)))


def to_groups(shards: DataFrame, queries: DataFrame, answer: Callable[[list[Block], Batch], list[np.ndarray]],
              schema: str) -> DataFrame:
    """``answer`` for every query on every group of ``shards`` (from ``summaries``): decides which shards it is sent to.

    ``queries`` has ``id``, ``twin``, ``v`` and ``extra``; each is sent once to each group.
    """
    n = (shards.agg(F.max("shard")).first()[0] or 0) + 1
    every = queries.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("shard"), "id", "twin", "v", "extra")
    return deliver(shards, every, answer, schema)


def all_shards(shards: list[Block], batch: Batch) -> list[np.ndarray]:
    """``id``, ``twin`` and every ``shard``."""
    names = np.array([b.ids[0] for b in shards], np.int64)
    return [np.repeat(batch.ids, len(names)), np.repeat(batch.twins, len(names)), np.tile(names, len(batch.ids))]
