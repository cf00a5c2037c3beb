"""Token ids in files of fixed-width packed blocks: encode, write, read back at random."""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from coursebank.llm.common import folder, partitions, slices, staged

END_ID = 2
BLOCK_IDS = 1 << 14  # a multiple of 8, so that every block starts on a byte
SHARD_IDS = 1 << 20
SLICE = 8_000_000
CACHE_WORDS = 400_000
MAGIC = b"TKS1"
_HEAD = struct.Struct("<4sIIIQQ")  # magic, bits, ids a block, 0, documents, ids

_loaded: dict[str, tuple] = {}


def _encoder(path: str):
    """The tokenizer of a file and its ids by white-space-free chunk, kept by the worker process."""
    if path not in _loaded:
        from tokenizers import Tokenizer

        _loaded[path] = (Tokenizer.from_file(path), {"": b""})
    return _loaded[path]


def _chunks(texts: pa.Array) -> pa.Array:
    """Lists of chunks that can be encoded alone, one list per text.

    The tokenizer composes characters, lower-cases them, drops white space, and splits by a pattern no match of which
    spans white space or runs from an ASCII letter into one of ``.,!%&#$*``. So a text may be cut at both, and its ASCII
    letters may be lowered before. Texts with combining marks, or with what may open a special token, are only cut at
    spaces and line ends.
    """
    texts = pc.fill_null(texts, "")
    lowered = pc.replace_substring_regex(pc.ascii_lower(texts), r"([a-z])([.,!%&#$*]+)", r"\1 \2")
    texts = pc.if_else(pc.match_substring_regex(texts, r"\p{M}|<\|"), texts, lowered)
    return pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")


def encode_texts(path: str, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of whole texts one after another, as the library gives them without special tokens, and each text's number.

    The library encodes each distinct chunk once.
    """
    tok, known = _encoder(path)
    if len(known) > CACHE_WORDS:
        known.clear()
        known[""] = b""
    flat = _chunks(texts)
    coded = flat.flatten().dictionary_encode()
    distinct = coded.dictionary.to_pylist()
    found = [*map(known.get, distinct)]
    new = [i for i, ids in enumerate(found) if ids is None]
    for lo in range(0, len(new), 20_000):
        some = [distinct[i] for i in new[lo:lo + 20_000]]
        for i, chunk, enc in zip(new[lo:], some, tok.encode_batch_fast(some, add_special_tokens=False)):
            found[i] = known[chunk] = array("I", enc.ids).tobytes()
    n_of = np.fromiter(map(len, found), np.int64, len(found)) // 4
    at_of = np.cumsum(n_of) - n_of
    codes = coded.indices.to_numpy()
    n = n_of[codes]
    ends = np.cumsum(n)
    take = np.repeat(at_of[codes] - ends + n, n) + np.arange(int(ends[-1]) if len(ends) else 0)
    ids = np.frombuffer(b"".join(found), "<u4")[take]
    stops = flat.offsets.to_numpy()[1:] - flat.offsets[0].as_py()
    return ids, np.diff(ends[stops - 1], prepend=0) if len(stops) else np.zeros(0, np.int64)


def _lanes(bits: int) -> Iterator[tuple[int, int, int, int]]:
    """Eight ids fill ``bits`` bytes: for each, its place, first byte, shift inside it, and number of bytes."""
    for lane in range(8):
        yield lane, lane * bits // 8, lane * bits % 8, -(-(lane * bits % 8 + bits) // 8)


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids in ``bits`` bits each, lowest bit first."""
    n = len(ids)
    wide = np.zeros((-(-n // 8), 8), np.uint64)
    wide.reshape(-1)[:n] = ids
    out = np.zeros((len(wide), bits), np.uint8)
    for lane, first, shift, count in _lanes(bits):
        value = wide[:, lane] << np.uint64(shift)
        for k in range(count):
            out[:, first + k] |= (value >> np.uint64(8 * k)).astype(np.uint8)
    return out.tobytes()[:-(-n * bits // 8)]


def unpack(data: bytes, n: int, bits: int) -> np.ndarray:
    """The first ``n`` ids of packed bytes."""
    rows = np.zeros((-(-n // 8), bits), np.uint8)
    rows.reshape(-1)[:len(data)] = np.frombuffer(data, np.uint8)[:rows.size]
    out = np.empty((len(rows), 8), "<u4")
    for lane, first, shift, count in _lanes(bits):
        value = np.zeros(len(rows), np.uint64)
        for k in range(count):
            value |= rows[:, first + k].astype(np.uint64) << np.uint64(8 * k)
        out[:, lane] = (value >> np.uint64(shift)) & np.uint64((1 << bits) - 1)
    return out.reshape(-1)[:n]


def shard_bytes(doc_ids: list[int | None], docs: list[np.ndarray], bits: int, block: int = BLOCK_IDS) -> bytes:
    """A shard: header, document ids, their presence, lengths, block offsets, packed blocks."""
    ids = np.concatenate(docs) if docs else np.zeros(0, "<u4")
    blocks = [pack(ids[i:i + block], bits) for i in range(0, len(ids), block)]
    ends = np.cumsum([0, *map(len, blocks)]).astype("<u8")
    return b"".join([
        _HEAD.pack(MAGIC, bits, block, 0, len(docs), len(ids)),
        np.array([0 if x is None else x for x in doc_ids], "<i8").tobytes(),
        np.array([x is not None for x in doc_ids], "<u1").tobytes(),
        np.array([len(d) for d in docs], "<u8").tobytes(), ends.tobytes(), *blocks])


class Shard:
    """Random access to the bytes of a shard; a read touches only the blocks that it needs."""

    def __init__(self, data: bytes):
        magic, self.bits, self.block, _, n, self.n_ids = _HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a token shard")
        at = _HEAD.size
        ids = np.frombuffer(data, "<i8", n, at)
        has = np.frombuffer(data, "<u1", n, at + 8 * n)
        self.doc_ids = [int(x) if y else None for x, y in zip(ids, has)]
        self.starts = np.concatenate([[0], np.cumsum(np.frombuffer(data, "<u8", n, at + 9 * n).astype(np.int64))])
        n_blocks = -(-self.n_ids // self.block)
        self.offsets = np.frombuffer(data, "<u8", n_blocks + 1, at + 17 * n).astype(np.int64)
        self.payload = memoryview(data)[at + 17 * n + 8 * (n_blocks + 1):]

    def read(self, start: int, stop: int) -> np.ndarray:
        """Ids of places start..stop-1."""
        if start >= stop:
            return np.zeros(0, "<u4")
        first, last = start // self.block, (stop - 1) // self.block
        parts = [unpack(self.payload[self.offsets[b]:self.offsets[b + 1]],
                        min(self.block, self.n_ids - b * self.block), self.bits) for b in range(first, last + 1)]
        return np.concatenate(parts)[start - first * self.block:stop - first * self.block]


def open_store(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI; a plain path or a file: URI is a folder that all machines mount."""
    if "://" in path and not path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), re.sub(r"^file:/+", "/", path)


def write_shards(docs: DataFrame, tokenizer: str, path: str, end_id: int | None = END_ID,
                 shard_ids: int = SHARD_IDS) -> DataFrame:
    """Encode and write all documents in ascending doc_id order; returns the manifest of the shards.

    Takes ``doc_id`` and ``text``; a null text is empty, a null doc_id comes first. Documents are dealt by ranges of
    doc_id and sorted inside them; a document is never cut. Each shard is written under a temporary name and then
    moved, under a name fixed by partition and number, so a task that runs twice leaves the same files.
    Manifest: ``part``, ``shard``, ``file``, ``n_docs``, ``n_ids``, ``base`` (ids of all shards before).
    """
    from tokenizers import Tokenizer

    bits = max(1, (Tokenizer.from_file(tokenizer).get_vocab_size() - 1).bit_length())
    tail = np.array([] if end_id is None else [end_id], "<u4")
    rows = docs.select("doc_id", "text").repartitionByRange(
        partitions(docs.sparkSession), F.col("doc_id").asc_nulls_first())
    rows = rows.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        store, top = open_store(path)
        store.create_dir(top, recursive=True)
        ids, held, size, n = [], [], 0, 0

        def close() -> pa.RecordBatch:
            name = f"part-{part:06d}-{n:06d}.tks"
            temp = f"{top}/_{name}.{uuid.uuid4().hex}"
            with store.open_output_stream(temp) as out:
                out.write(shard_bytes(ids, held, bits))
            store.move(temp, f"{top}/{name}")
            return pa.RecordBatch.from_pylist([{"part": part, "shard": n, "file": name, "n_docs": len(ids),
                                                "n_ids": size}], schema=shape)

        for some in slices(batches, 1, SLICE):
            flat, lens = encode_texts(tokenizer, some.column(1))
            for i, got in zip(some.column(0).to_pylist(), np.split(flat, np.cumsum(lens)[:-1])):
                got = np.concatenate([got, tail])
                ids.append(i)
                held.append(got)
                size += len(got)
                if size >= shard_ids:
                    yield close()
                    ids, held, size, n = [], [], 0, n + 1
        if ids:
            yield close()

    shape = pa.schema([("part", pa.int64()), ("shard", pa.int64()), ("file", pa.string()), ("n_docs", pa.int64()),
                       ("n_ids", pa.int64())])
    manifest = staged(rows.mapInArrow(write, "part long, shard long, file string, n_docs long, n_ids long"), "manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    by_part = manifest.groupBy("part").agg(F.sum("n_ids").alias("s"))
    by_part = by_part.select("part", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("b"))
    return (manifest.withColumn("i", F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).join(by_part, "part")
            .withColumn("base", F.col("b") + F.col("i")).drop("b", "i"))


def read_shards(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """Read the files back: ``doc_id``, ``start``, ``n_tokens``, ``ids_crc32``, from the files' ids alone."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.tks").load(path)
    files = files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), "content")
    rows = files.join(manifest.select("file", "base"), "file").select("base", "content")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                shard = Shard(data.as_py())
                docs = np.split(shard.read(0, shard.n_ids), shard.starts[1:-1])
                yield pa.RecordBatch.from_arrays([
                    pa.array(shard.doc_ids, pa.int64()), pa.array(shard.starts[:-1] + base, pa.int64()),
                    pa.array([len(d) for d in docs], pa.int64()),
                    pa.array([zlib.crc32(d.astype("<u4").tobytes()) for d in docs], pa.int64())], names=names)

    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
    return rows.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write all documents to a fresh shared folder and return what the files hold."""
    spark = docs.sparkSession
    path = folder(spark, "tokens")
    manifest = write_shards(docs, tokenizer, path)
    if manifest.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    return read_shards(spark, path, manifest)
