"""Removal of repeated byte windows by a depth-limited radix sort of the suffixes that may repeat."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coursebank.llm.common import partitions, slices, staged

DEPTH = 50
GRAM = 25
COPY_BITS = 1 << 23
LAST = (1 << 63) - 1  # stands for a null doc_id, which comes after all others

_rng = np.random.default_rng(11)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x5851F42D4C957F2D
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base))
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(29))) | np.uint64(1)


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """Hash of the ``gram`` bytes from each place on."""
    n = len(data) - gram + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * _powers(_INVERSE, len(data)), dtype=np.uint64)])
    return _mixed((sums[gram:] - sums[:-gram]) * _powers(_BASE, n))


def _sliding(x: np.ndarray, width: int, best) -> np.ndarray:
    """``best`` (np.minimum or np.maximum) over ``width`` neighbours from each place on."""
    size = 1
    while 2 * size <= width:
        x = best(x[:-size], x[size:])
        size *= 2
    rest = width - size
    return best(x[:-rest], x[rest:]) if rest else x


def anchors(data: np.ndarray, stops: np.ndarray, depth: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Places whose gram has the least hash of a window of ``depth`` bytes inside one text, and these hashes.

    The choice depends on the window's bytes alone, so equal windows have an anchor at the same offset: a window that
    repeats is found at its anchor, and all other suffixes may be left out.
    """
    x = gram_hashes(data, gram)
    width = depth - gram + 1
    if len(x) < width:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    low = _sliding(x, width, np.minimum)
    across = (stops[:, None] - np.arange(1, depth)[None]).reshape(-1)
    low[across[(across >= 0) & (across < len(low))]] = 0
    pad = np.zeros(width - 1, np.uint64)
    high = _sliding(np.concatenate([pad, low, pad]), width, np.maximum)
    at = np.flatnonzero(x == high)
    return at, x[at]


def equal_windows(context: np.ndarray, group: np.ndarray, low: np.ndarray, high: np.ndarray, ok: np.ndarray, depth: int,
                  gram: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For every offset, the rows whose window stands in several documents, and the smallest of these.

    ``context`` holds the bytes before and after the gram, which is equal inside a group; a row stands for documents
    from ``low`` to ``high``. Radix passes from the most significant digit, eight bytes each, go down to ``depth`` bytes:
    groups of one document leave after each pass; what is equal to the end is a repeated window.
    """
    side = depth - gram
    for offset in range(depth - gram + 1):
        rows = np.flatnonzero(ok[:, offset])
        key = group[rows]
        window = context[:, offset:offset + side]
        for digit in range(-1, -(-side // 8)):
            if digit >= 0:
                part = np.zeros((len(rows), 8), np.uint8)
                some = window[rows, 8 * digit:8 * digit + 8]
                part[:, :some.shape[1]] = some
                value = part.view(">u8").reshape(-1).astype(np.uint64)
                order = np.lexsort((value, key))
                k, v = key[order], value[order]
                new = np.concatenate([[0], np.cumsum((k[1:] != k[:-1]) | (v[1:] != v[:-1]))]) if len(k) else k
                key = np.empty(len(rows), np.int64)
                key[order] = new
            if not len(rows):
                break
            n = int(key.max()) + 1
            least, most = np.full(n, LAST), np.full(n, -LAST - 1)
            np.minimum.at(least, key, low[rows])
            np.maximum.at(most, key, high[rows])
            keep = least[key] != most[key]
            rows, key = rows[keep], key[keep]
        if len(rows):
            yield offset, rows, least[key]


def _classes(h: np.ndarray, clip: np.ndarray, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of the rows, and which of them start a class of equal gram, limits and context, compared byte by byte."""
    wide = np.zeros((len(h), -(-context.shape[1] // 8) * 8), np.uint8)
    wide[:, :context.shape[1]] = context
    digits = wide.view(np.uint64)
    mark = _mixed((digits * _powers(_BASE, digits.shape[1] + 1)[1:]).sum(axis=1, dtype=np.uint64))
    order = np.lexsort((clip, mark, h))
    a, b = order[1:], order[:-1]
    new = (h[a] != h[b]) | (clip[a] != clip[b]) | (digits[a] != digits[b]).any(axis=1)
    return order, np.concatenate([[True], new])


def _by_bucket(buckets: np.ndarray, columns: dict[str, np.ndarray]) -> Iterator[tuple[int, dict[str, np.ndarray]]]:
    order = np.argsort(buckets, kind="stable")
    cuts = np.flatnonzero(np.diff(buckets[order])) + 1
    for some in np.split(order, cuts):
        if len(some):
            yield int(buckets[some[0]]), {k: v[some] for k, v in columns.items()}


def _flat(table: pa.Table, name: str) -> np.ndarray:
    return np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in table.column(name).chunks] or [[]])


def _texts(part: pa.RecordBatch, column: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts of a slice and where each ends."""
    raw = [b"" if not x.is_valid else x.as_buffer().to_pybytes() for x in part.column(column)]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([len(b) for b in raw])


def _lists(doc: np.ndarray, th: np.ndarray, values: list[np.ndarray], kind: pa.DataType) -> tuple[np.ndarray, np.ndarray, list[pa.Array]]:
    """Values gathered by (doc, th)."""
    order = np.lexsort((values[0], th, doc))
    doc, th = doc[order], th[order]
    first = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (th[1:] != th[:-1])])) if len(doc) else order
    at = pa.array(np.concatenate([first, [len(doc)]]).astype(np.int32))
    return doc[first], th[first], [pa.ListArray.from_arrays(at, pa.array(v[order], kind)) for v in values]


def _low(h: np.ndarray) -> np.ndarray:
    return (h & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32)


def repeated_grams(rows: DataFrame, buckets: int, depth: int, gram: int) -> DataFrame:
    """``key``, ``grams`` (array): low digits of the anchors' grams of a text that stand under two keys or more.

    The first radix pass deals grams to buckets by the top digit of their hash; a bucket sorts the low digit and answers
    every key. A gram that only shares its bucket and digit lets an anchor through that the sort of the windows then
    drops; none is missed.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1):
            data, stops = _texts(part, 1)
            at, h = anchors(data, stops, depth, gram)
            if not len(h):
                continue
            key = part.column(0).to_numpy()[np.searchsorted(stops, at, "right")]
            order = np.lexsort((key, h))
            h, key = h[order], key[order]
            new = np.concatenate([[True], (h[1:] != h[:-1]) | (key[1:] != key[:-1])])
            h, key = h[new], key[new]
            edge = h[1:] != h[:-1]
            inner = ~(np.concatenate([[True], edge]) | np.concatenate([edge, [True]]))
            # A bucket needs the least and the greatest key of a slice; those between are repeated, and dealt by key.
            bucket = (h >> np.uint64(32)).astype(np.int64) % buckets
            bucket[inner] = buckets + key[inner] % buckets
            out = list(_by_bucket(bucket, {"h": _low(h), "key": key}))
            yield pa.RecordBatch.from_arrays([
                pa.array([b for b, _ in out], pa.int32()), pa.array([c["h"] for _, c in out], pa.list_(pa.int32())),
                pa.array([c["key"] for _, c in out], pa.list_(pa.int64()))], names=["bucket", "h", "key"])

    def repeated(table: pa.Table) -> pa.Table:
        h, key = (_flat(table, k) for k in ("h", "key"))
        if table.column("bucket")[0].as_py() < buckets:
            order = np.lexsort((key, h))
            h, key = h[order], key[order]
            first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            size = np.diff(np.concatenate([first, [len(h)]]))
            again = np.repeat(key[first] != key[first + size - 1], size)
            h, key = h[again], key[again]
        k, _, (grams,) = _lists(key, np.zeros(len(key), np.int64), [h], pa.int32())
        return pa.table({"key": pa.array(k, pa.int64()), "grams": grams})

    found = rows.select("key", "text").mapInArrow(find, "bucket int, h array<int>, key array<bigint>")
    found = found.groupBy("bucket").applyInArrow(repeated, "key long, grams array<int>")
    return found.groupBy("key").agg(F.flatten(F.collect_list("grams")).alias("grams"))


def repeated_windows(rows: DataFrame, grams: DataFrame, buckets: int, depth: int, gram: int) -> DataFrame:
    """``key``, ``th``, ``pos``, ``mask`` (arrays): anchors and, as bits, the offsets of their repeated windows."""
    side = depth - gram

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 3):
            part = part.filter(pc.and_(pc.invert(part.column(4)), pc.is_valid(part.column(5))))
            data, stops = _texts(part, 3)
            start = np.concatenate([[0], stops])
            places, hashes = anchors(data, stops, depth, gram)
            owner = np.searchsorted(stops, places, "right")
            wanted = np.sort((pc.list_parent_indices(part.column(5)).to_numpy().astype(np.int64) << 32)
                             | part.column(5).flatten().to_numpy().view(np.uint32))
            mine = (owner << 32) | _low(hashes).view(np.uint32)
            if not len(wanted) or not len(mine):
                continue
            hit = wanted[np.minimum(np.searchsorted(wanted, mine), len(wanted) - 1)] == mine
            places, hashes, owner = places[hit], hashes[hit], owner[hit]
            docs, ths = part.column(1).to_numpy(), part.column(2).to_numpy()
            wide = np.concatenate([np.zeros(side, np.uint8), data, np.zeros(depth, np.uint8)])
            around = np.concatenate([np.arange(side), np.arange(depth, side + depth)])
            step = 200_000
            for lo in range(0, len(places), step):
                at, h, o = places[lo:lo + step], hashes[lo:lo + step], owner[lo:lo + step]
                clip = (np.minimum(at - start[o], side) << 8) | np.minimum(stops[o] - at - gram, side)
                out = list(_by_bucket((h >> np.uint64(32)).astype(np.int64) % buckets, {
                    "h": h.view(np.int64), "pos": (at - start[o]).astype(np.int32), "clip": clip.astype(np.int32),
                    "o": o, "context": wide[at[:, None] + around[None]]}))
                # Anchors of one text follow each other: its ids are given once, with their number.
                first = [np.flatnonzero(np.concatenate([[True], c["o"][1:] != c["o"][:-1]])) for _, c in out]
                run = [c["o"][f] for f, (_, c) in zip(first, out)]
                n = [np.diff(np.concatenate([f, [len(c["o"])]])).astype(np.int32) for f, (_, c) in zip(first, out)]
                yield pa.RecordBatch.from_arrays([
                    pa.array([b for b, _ in out], pa.int32()),
                    pa.array([c["h"] for _, c in out], pa.list_(pa.int64())),
                    *(pa.array([c[k] for _, c in out], pa.list_(pa.int32())) for k in ("pos", "clip")),
                    pa.array([docs[r] for r in run], pa.list_(pa.int64())),
                    pa.array([ths[r] for r in run], pa.list_(pa.int64())), pa.array(n, pa.list_(pa.int32())),
                    pa.array([pa.compress(c["context"].tobytes(), "zstd", asbytes=True) for _, c in out], pa.binary())],
                    names=["bucket", "h", "pos", "clip", "doc", "th", "n", "context"])

    def starts(table: pa.Table) -> pa.Table:
        h, pos, clip, doc, th, n = (_flat(table, k) for k in ("h", "pos", "clip", "doc", "th", "n"))
        doc, th = np.repeat(doc, n), np.repeat(th, n)
        sizes = pc.list_value_length(table.column("h")).to_pylist()
        context = np.frombuffer(b"".join(pa.decompress(c, 2 * side * k, "zstd", asbytes=True) for c, k in zip(
            table.column("context").to_pylist(), sizes)), np.uint8).reshape(len(h), 2 * side)
        # Rows of equal context have equal windows, so one of them is sorted for all, with their least and greatest document.
        order, new = _classes(h, clip, context)
        first = np.flatnonzero(new)
        some = order[first]
        low, high = np.minimum.reduceat(doc[order], first), np.maximum.reduceat(doc[order], first)
        offsets = np.arange(side + 1)[None]
        ok = (offsets >= side - (clip[some] >> 8)[:, None]) & (offsets <= (clip[some] & 255)[:, None])
        group = np.cumsum(np.concatenate([[0], h[some][1:] != h[some][:-1]]))
        member = np.empty(len(h), np.int64)
        member[order] = np.cumsum(new) - 1
        mask = np.zeros(len(h), np.int64)
        for offset, rows, least in equal_windows(context[some], group, low, high, ok, depth, gram):
            bound = np.full(len(some), LAST)
            bound[rows] = least
            mask |= (doc > bound[member]).astype(np.int64) << offset
        hit = mask != 0
        key = np.where(doc == LAST, th, doc)
        k, t, (p, m) = _lists(key[hit], th[hit], [pos[hit], mask[hit]], pa.int64())
        return pa.table({"key": pa.array(k, pa.int64()), "th": pa.array(t, pa.int64()), "pos": p.cast(pa.list_(pa.int32())), "mask": m})

    full = rows.join(grams, "key", "left").select("key", "doc", "th", "text", "copy", "grams").mapInArrow(
        cut, "bucket int, h array<bigint>, pos array<int>, clip array<int>, doc array<bigint>, th array<bigint>, "
        "n array<int>, context binary")
    return full.groupBy("bucket").applyInArrow(starts, "key long, th long, pos array<int>, mask array<bigint>")


def without_repeats(docs: DataFrame, depth: int = DEPTH, gram: int = GRAM) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept`` (binary) of every row.

    Takes ``doc_id`` and ``text``. A byte goes if a string of ``depth`` bytes that covers it also starts in a row of
    smaller doc_id. A null text is empty; a null doc_id comes after all others; rows of equal doc_id never remove each
    other's bytes. Grams are compared by 64-bit hash to choose what is sorted; the windows themselves byte by byte.
    The texts are dealt out by key once, for the anchors' contexts and again for the removal.
    """
    buckets = 4 * partitions(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"),
                       F.xxhash64("text").alias("th"), F.coalesce("text", F.lit("")).alias("text"))
    # Of equal texts only those of the smallest document are searched; in the others every window is repeated.
    copies = rows.groupBy(F.unhex(F.md5("text")).alias("m")).agg(
        F.min("doc").alias("first"), F.min("th").alias("th"), F.count("*").alias("c"))
    copies = staged(copies.where("c > 1").select("m", "first", "th"), "copies")
    # A bitmap of fixed size tells most single texts apart without moving them.
    bits = copies.select(F.pmod("th", F.lit(COPY_BITS)).alias("p")).groupBy(F.shiftright("p", 6).alias("at")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(p % 64 AS int))")).alias("bits"))
    rows = rows.withColumn("p", F.pmod("th", F.lit(COPY_BITS)))
    rows = rows.join(F.broadcast(bits), F.shiftright("p", 6) == F.col("at"), "left")
    maybe = F.coalesce(F.expr("bits & shiftleft(1L, cast(p % 64 AS int)) <> 0"), F.lit(False))
    single = rows.where(~maybe).select("doc", "th", "text", F.lit(False).alias("copy"))
    rows = rows.where(maybe).join(copies.select("m", "first"), F.unhex(F.md5("text")) == F.col("m"), "left")
    rows = rows.select("doc", "th", "text", F.coalesce(F.col("doc") > F.col("first"), F.lit(False)).alias("copy"))
    key = F.when(F.col("doc") != LAST, F.col("doc")).otherwise(F.col("th"))  # rows without an id don't share one key
    rows = single.union(rows).select(key.alias("key"), "doc", "th", "text", "copy")
    grams = repeated_grams(rows.where("NOT copy"), buckets, depth, gram)
    gone = repeated_windows(rows, grams, buckets, depth, gram)
    gone = gone.groupBy("key").agg(F.collect_list(F.struct("th", "pos", "mask")).alias("found"))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 3):
            data, stops = _texts(part, 3)
            sizes = np.diff(np.concatenate([[0], stops]))
            start = stops - sizes
            edge = np.zeros(len(data) + 1, np.int64)
            whole = np.flatnonzero(part.column(4).to_numpy(zero_copy_only=False) & (sizes >= depth))
            np.add.at(edge, start[whole], 1)
            np.add.at(edge, stops[whole], -1)
            row = pc.list_parent_indices(part.column(5)).to_numpy()
            th, pos, mask = part.column(5).flatten().flatten()
            row = np.where(th.to_numpy() == part.column(2).to_numpy()[row], row, -1)
            row = row[pc.list_parent_indices(pos).to_numpy()]
            at = start[row] + pos.flatten().to_numpy()
            mask = np.where(row < 0, 0, mask.flatten().to_numpy())
            for offset in range(depth - gram + 1):
                begin = at[(mask >> offset) & 1 != 0] - (depth - gram) + offset
                np.add.at(edge, begin, 1)
                np.add.at(edge, begin + depth, -1)
            cover = np.cumsum(edge[:-1]) > 0
            head = cover & ~np.concatenate([[False], cover])[:-1]
            inside = start[(sizes > 0)]
            head[inside] = cover[inside]
            gone, spans = (np.diff(np.concatenate([[0], np.concatenate([[0], np.cumsum(x)])[stops]])) for x in (cover, head))
            left = pa.py_buffer(data[~cover].tobytes())
            ends = pa.py_buffer(np.concatenate([[0], np.cumsum(sizes - gone)]).astype(np.int32).tobytes())
            kept = pa.Array.from_buffers(pa.binary(), part.num_rows, [None, ends, left])
            yield pa.RecordBatch.from_arrays(
                [part.column(1), *(pa.array(x, pa.int64()) for x in (sizes, gone, spans)), kept], names=names)

    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"]
    out = rows.join(gone, "key", "left").select("key", "doc", "th", "text", "copy", "found").mapInArrow(
        remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
    return out.withColumn("doc_id", F.when(F.col("doc_id") != LAST, F.col("doc_id")))
