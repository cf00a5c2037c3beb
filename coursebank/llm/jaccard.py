"""N-gram Jaccard join by grouped prefixes: groups of equal prefix and size, filtered pairs, verified members."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coursebank.llm.common import components, give_back, slices, staged

WORDS = 4
PERCENT = 85
HEAVY = 400_000  # shingles with a known frequency, at most; they only set the order, never the result
HEAVY_DOCS = 6
SEEN_DOCS = 2
FLUSH = 4_000_000
BITMAP = 1 << 23  # bits; the broadcast bitmap has one row per 64 of them at most

_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: pa.Array, words: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text.

    Words are runs of anything but ASCII white space, A-Z lowered. A text of fewer words has one shingle, the whole
    sequence; a text without words has none.
    """
    lists = pc.split_pattern_regex(pc.ascii_lower(pc.fill_null(texts, "")), r"[ \t\n\r\x0b\x0c]+")
    coded = lists.flatten().dictionary_encode()
    of = np.fromiter((xxhash.xxh64_intdigest(w) for w in coded.dictionary.to_pylist()), np.uint64,
                     len(coded.dictionary))
    empty = pc.index(coded.dictionary, "").as_py()
    codes = coded.indices.to_numpy()
    real = codes != empty
    doc = np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy()))[real]
    h = of[codes[real]]
    at = np.searchsorted(doc, np.arange(len(texts) + 1))
    z = np.full(max(len(h) - words + 1, 0), np.uint64(words))
    for j in range(words):
        z = _mix(z * _STEP + h[j:j + len(z)])
    out = []
    for lo, hi in zip(at[:-1], at[1:]):
        if hi - lo >= words:
            out.append(np.unique(z[lo:hi - words + 1]))
        elif hi > lo:
            one = np.full(1, np.uint64(hi - lo))
            for x in h[lo:hi]:
                one = _mix(one * _STEP + x)
            out.append(one)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _node(shingles: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


def profiles(docs: DataFrame, words: int) -> tuple[DataFrame, DataFrame]:
    """One pass over the texts: the node and size of every row, and shingles seen in several rows of a task.

    A node stands for all rows with the same set, by a 64-bit digest. Written to the shared folder.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def often() -> pa.RecordBatch:
            seen, n = np.unique(np.concatenate(held), return_counts=True)
            seen, n = seen[n >= SEEN_DOCS], n[n >= SEEN_DOCS]
            none = pa.nulls(len(seen), pa.int64())
            return pa.RecordBatch.from_arrays([none, none, none, none, pa.array(seen.view(np.int64)),
                                               pa.array(n.astype(np.int64))], names=names)

        for part in slices(batches, 2):
            sets = shingle_sets(part.column(2), words)
            none = pa.nulls(len(sets), pa.int64())
            yield pa.RecordBatch.from_arrays([
                part.column(0), part.column(1), pa.array([len(s) for s in sets], pa.int64()),
                pa.array([_node(s) if len(s) else None for s in sets], pa.int64()), none, none], names=names)
            held += sets
            if sum(map(len, held)) >= FLUSH:
                yield often()
                held = []
        if held:
            yield often()
        give_back()

    names = ["doc_id", "th", "n", "node", "token", "docs"]
    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("th"), "text")
    both = staged(rows.mapInArrow(run, ", ".join(f"{x} long" for x in names)), "profiles")
    return both.where("n IS NOT NULL").drop("token", "docs"), both.where("n IS NULL").select("token", "docs")


def heavy_order(seen: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles (sorted) and their frequencies, at most HEAVY of them.

    Any total order gives a right prefix filter; putting these last keeps the posting lists short.
    """
    top = seen.groupBy("token").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= HEAVY_DOCS)
    rows = top.orderBy(F.desc("docs"), "token").limit(HEAVY).toPandas()
    token = rows["token"].to_numpy(np.int64).view(np.uint64)
    by = np.argsort(token)
    return token[by], rows["docs"].to_numpy(np.int64)[by]


def prefix(shingles: np.ndarray, heavy: tuple[np.ndarray, np.ndarray], percent: int) -> np.ndarray:
    """The first n - ceil(t * n) + 1 shingles, rare ones first, then by hash."""
    n = len(shingles)
    if len(heavy[0]):
        at = np.minimum(np.searchsorted(heavy[0], shingles), len(heavy[0]) - 1)
        often = np.where(heavy[0][at] == shingles, heavy[1][at], 0)
        shingles = shingles[np.lexsort((shingles, often))]
    return shingles[:n - -(-percent * n // 100) + 1]


def node_prefixes(docs: DataFrame, heavy: tuple[np.ndarray, np.ndarray], words: int, percent: int) -> DataFrame:
    """``node``, ``n``, ``prefix`` and ``gid``, the digest of prefix and size; one row per node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 0):
            sets = [s for s in shingle_sets(part.column(0), words) if len(s)]
            yield pa.RecordBatch.from_arrays([
                pa.array([_node(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
                pa.array([prefix(s, heavy, percent).view(np.int64) for s in sets], pa.list_(pa.int64()))],
                names=["node", "n", "prefix"])
        give_back()

    rows = docs.select("text").mapInArrow(run, "node long, n long, prefix array<bigint>").dropDuplicates(["node"])
    return staged(rows.withColumn("gid", F.xxhash64("n", "prefix")), "prefixes")


def node_sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """``node`` and ``set`` (packed shingles) of the wanted nodes; ``wanted`` names a row of each by doc_id and hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 0):
            sets = [s for s in shingle_sets(part.column(0), words) if len(s)]
            yield pa.RecordBatch.from_arrays([pa.array([_node(s) for s in sets], pa.int64()),
                                              pa.array([s.tobytes() for s in sets], pa.binary())],
                                             names=["node", "set"])
        give_back()

    rows = docs.select(F.col("doc_id").cast("long").alias("d"), F.xxhash64("text").alias("t"), "text")
    # A bitmap of fixed size keeps most other texts out of the shuffle of the exact join below.
    place = F.pmod("t", F.lit(BITMAP))
    bits = wanted.select(F.pmod("th", F.lit(BITMAP)).alias("p"))
    bits = bits.groupBy(F.shiftright("p", 6).alias("at")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(p % 64 AS int))")).alias("bits"))
    rows = rows.withColumn("p", place).join(F.broadcast(bits), F.shiftright("p", 6) == F.col("at"))
    rows = rows.where("bits & shiftleft(1L, cast(p % 64 AS int)) <> 0")
    rows = rows.join(wanted.select("doc_id", "th"), F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("t") == F.col("th")))
    return staged(rows.select("text").mapInArrow(run, "node long, set binary").dropDuplicates(["node"]), "sets")


def prefix_length(n, percent: int):
    """n - ceil(t * n) + 1, for a column of set sizes."""
    return n - F.ceil(n * percent / 100) + 1


def may_link(common, na, nb, percent: int):
    """False only for pairs that can't link: past the shorter reach of two prefixes, at most the rest of one set is common."""
    most = common + F.greatest(na - prefix_length(na, percent), nb - prefix_length(nb, percent))
    return (100 + percent) * most >= percent * (na + nb)


def may_be_first(pos_a, pos_b, na, nb, percent: int):
    """Whether a common shingle at these places can be the first one of a linked pair.

    A linked pair shares so many prefix shingles that behind the first one the others must still have room in both.
    """
    pa_, pb_ = prefix_length(na, percent), prefix_length(nb, percent)
    need = F.ceil(percent * (na + nb) / (100 + percent) - 1e-6) - F.greatest(na - pa_, nb - pb_)
    need = F.greatest(need, F.lit(1))
    return (pos_a + need <= pa_) & (pos_b + need <= pb_) & (100 * F.least(na, nb) >= percent * F.greatest(na, nb))


def verify(near: DataFrame, rows: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (``a``, ``b``) of nodes that are linked, by their whole sets."""
    near = staged(near, "near")
    ids = near.select(F.col("a").alias("node")).union(near.select("b")).distinct()
    wanted = staged(rows.join(ids, "node").select("doc_id", "th"), "wanted")
    sets = node_sets(docs, wanted, words)
    full = near.join(sets.select(F.col("node").alias("a"), F.col("set").alias("sa")), "a")
    full = full.join(sets.select(F.col("node").alias("b"), F.col("set").alias("sb")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.intersect1d(x, y, assume_unique=True).size
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep, pa.bool_())),
                                              batch.column(1).filter(pa.array(keep, pa.bool_()))], names=["a", "b"])
        give_back()

    return staged(full.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long"), "links")


def linked_nodes(docs: DataFrame, rows: DataFrame, heavy: tuple[np.ndarray, np.ndarray], words: int,
                 percent: int) -> DataFrame:
    """Component of every node that has a link: ``node``, ``root``.

    Two rounds. The first checks each group's members against its first node, and each group against the node that has
    a prefix shingle earliest, for every such shingle; this joins large groups of near copies in linear work. The second checks all remaining
    pairs that share a prefix shingle and aren't yet in one component; on one side of a list stand only the nodes
    outside its largest component, since two nodes of that one need no check. So no link between components is lost.
    """
    nodes = node_prefixes(docs, heavy, words, percent)
    groups = nodes.groupBy("gid").agg(F.min("node").alias("first"))
    within = nodes.select("gid", "node").join(groups, "gid").where("node <> first")
    within = within.select(F.col("first").alias("a"), F.col("node").alias("b"))
    # Dealt by shingle once: the counts and the join below reuse that exchange. Only lists of two or more go on.
    posts = nodes.select("node", "n", F.posexplode("prefix").alias("pos", "token")).repartition("token")
    # The node that has the shingle earliest can link most others by it; ties differ from list to list.
    tie = F.xxhash64("node", "token").alias("tie")
    heads = posts.groupBy("token").agg(F.min(F.struct("pos", tie, "node", "n")).alias("h"), F.count("*").alias("c"))
    lists = staged(posts.join(heads.where("c > 1").drop("c"), "token"), "lists")
    across = lists.where(F.col("node") != F.col("h.node")).where(
        may_be_first(F.col("pos"), F.col("h.pos"), F.col("n"), F.col("h.n"), percent))
    across = across.join(groups.select(F.col("first").alias("node")), "node", "left_semi")
    across = across.select(F.col("h.node").alias("a"), F.col("node").alias("b"))
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"),
                                  F.col("prefix").alias(f"p{x}"))

    def checked(pairs: DataFrame) -> DataFrame:
        near = pairs.join(side("a"), "a").join(side("b"), "b")
        near = near.where(may_link(F.size(F.array_intersect("pa", "pb")), F.col("na"), F.col("nb"), percent))
        return verify(near.select("a", "b"), rows, docs, words, percent)

    first = checked(within.union(across).distinct())
    found = staged(components(first), "first-components")

    posts = lists.select("token", "node", "n", "pos").join(found.select(F.col("id").alias("node"), "root"), "node", "left")
    posts = posts.withColumn("root", F.coalesce("root", "node"))
    several = posts.groupBy("token").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y")
    posts = staged(posts.join(several.select("token"), "token", "left_semi"), "posts")
    sizes = posts.groupBy("token", "root").agg(F.count("*").alias("c"))
    largest = sizes.groupBy("token").agg(F.max(F.struct("c", "root")).alias("m")).select("token", F.col("m.root").alias("m"))
    minor = posts.join(largest, "token").where("root <> m").select(
        "token", F.col("node").alias("a"), F.col("n").alias("na"), F.col("pos").alias("qa"), F.col("root").alias("ra"), "m")
    pairs = posts.join(minor, "token").where("root <> ra AND (root = m OR node > a)").where(
        may_be_first(F.col("pos"), F.col("qa"), F.col("n"), F.col("na"), percent))
    pairs = pairs.select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b")).distinct()
    second = checked(pairs)
    edges = second.union(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    return components(edges).select(F.col("id").alias("node"), "root")


def component_rows(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``doc_id``, ``th``, ``n_shingles``, ``root``, ``component_id`` of every row.

    ``doc_id`` and ``th``, the xxhash64 of the text, are the key of a row where ids repeat. ``root`` names the component
    even then, while two components can have one ``component_id``; null for a row with an empty set.

    Takes ``doc_id`` and ``text``. Rows link when their shingle sets' Jaccard similarity is at least ``percent`` / 100;
    ``component_id`` is the smallest doc_id reachable by links. Equal sets are one node from the start, so copies cost
    one row. A null text or one without words has an empty set and links with nothing. A null doc_id never names a
    component; repeated rows stay. Sets are compared by 64-bit hashes of their shingles.
    """
    rows, seen = profiles(docs, words)
    named = rows.where("node IS NOT NULL")
    # One row per node to read its text from, and the smallest id among its rows.
    reps = named.groupBy("node").agg(F.min(F.struct("doc_id", "th")).alias("r"), F.min("doc_id").alias("least"))
    reps = staged(reps.select("node", "r.doc_id", "r.th", "least"), "reps")
    found = staged(linked_nodes(docs, reps, heavy_order(seen), words, percent), "components")
    both = reps.join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = both.groupBy("root").agg(F.min("least").alias("component_id"))
    ids = both.select("node", "root").join(least, "root").select("node", "root", "component_id")
    out = rows.join(ids, "node", "left")
    return out.select("doc_id", "th", F.col("n").alias("n_shingles"), "root",
                      F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def jaccard_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` of every row, by the links of ``component_rows``."""
    return component_rows(docs, words, percent).select("doc_id", "n_shingles", "component_id")
