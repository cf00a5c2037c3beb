"""Trie of the turn prefixes that conversations share, built from digests of fixed-length blocks of turns."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from coursebank.llm.common import n_words, staged

BLOCK_TURNS = 8
WIDTH = 16  # bytes of a digest
ROOT = b""
_NO_END = hashlib.sha256(b"").hexdigest()
_TURNS = "conv long, block long, prev binary, end binary, n int, digests binary, words array<bigint>, last boolean"


def turn_rows(conversations: DataFrame) -> DataFrame:
    """``conv``, ``pos``, ``digest`` and ``words`` of every turn: what the trie needs of a text.

    Null role or text is empty. Turns stand by ``turn``, null first; ties by digest, so repeated rows are turns of
    their own. Rows without ``conv_id`` are left out; further columns are ignored.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv"), "turn", digest.alias("digest"), n_words(F.col("text")).alias("words"))
    order = Window.partitionBy("conv").orderBy(F.asc_nulls_first("turn"), "digest")
    return rows.select("conv", F.row_number().over(order).cast("long").alias("pos"), "digest", "words")


def with_shared_heads(turns: DataFrame, convs: DataFrame, every: int = 20, most: int = 3) -> DataFrame:
    """Conversations rebuilt on the beginning of another: the first h turns of conversation c - c % ``every``, then
    c's own turns after its first h, with h = crc32(decimal c) % (``most`` + 1).

    All turns of the other one if it has fewer, none if it is absent. ``turns`` comes from ``turn_rows``.
    """
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % (most + 1)
    ids = convs.select("conv", (F.col("conv") - F.col("conv") % every).alias("base"), h.alias("h"))
    # At most ``most`` turns a base and 2 * every - 1 conversations.
    heads = turns.where((F.col("conv") % every == 0) & (F.col("pos") <= most)).withColumnRenamed("conv", "base")
    taken = ids.join(heads, "base").where("pos <= h").select("conv", "pos", "digest", "words")
    sizes = heads.groupBy("base").agg(F.count("*").alias("m"))
    shift = ids.join(sizes, "base", "left").select(
        "conv", "h", (F.least("h", F.coalesce("m", F.lit(0))) - F.col("h")).alias("shift"))
    own = turns.join(shift, "conv").where("pos > h").select("conv", (F.col("pos") + F.col("shift")).alias("pos"), "digest", "words")
    return taken.union(own)


def _digest(*parts: bytes) -> bytes:
    return hashlib.md5(b"".join(parts), usedforsecurity=False).digest()


def blocks(turns: DataFrame, length: int) -> DataFrame:
    """One row per conversation and block of ``length`` turns, the last one shorter.

    ``end`` is the digest of the digest before the block (``prev``) and of the block's turns, so it stands for the
    whole prefix. Rows are read as a stream in order; one block of one conversation is held.
    """
    names = [x.split()[0] for x in _TURNS.split(", ")]
    rows = turns.select("conv", "pos", "digest", "words").repartition("conv").sortWithinPartitions("conv", "pos")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, block, prev, digests, words = None, 0, ROOT, [], []

        def row(last: bool) -> tuple:
            joined = b"".join(digests)
            return conv, block, prev, _digest(prev, joined), len(digests), joined, words, last

        for batch in batches:
            out = []
            for c, d, w in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3))):
                if c != conv:
                    if digests:
                        out.append(row(True))
                    conv, block, prev, digests, words = c, 0, ROOT, [], []
                elif len(digests) == length:
                    out.append(row(False))
                    prev, block, digests, words = out[-1][3], block + 1, [], []
                digests.append(d)
                words.append(w)
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip(names, x)) for x in out], kinds)
        if digests:
            yield pa.RecordBatch.from_pylist([dict(zip(names, row(True)))], kinds)

    kinds = pa.schema(list(zip(names, [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.binary(),
                                       pa.list_(pa.int64()), pa.bool_()])))
    return staged(rows.mapInArrow(run, _TURNS), "turn-blocks")


def end_digests(ends: DataFrame) -> DataFrame:
    """``id`` and ``ends_sha256`` of every node at which conversations end.

    The contract's hash runs over all ids in order, so a node's ids pass one task, as a sorted stream of constant
    memory; nodes with a single id, the usual case, are hashed where they are.
    """
    counts = staged(ends.groupBy("id").agg(F.count("*").alias("c"), F.min("conv").alias("conv")), "ends")
    one = counts.where("c = 1").select("id", F.sha2(F.col("conv").cast("string").cast("binary"), 256).alias("ends_sha256"))
    rows = ends.join(counts.where("c > 1").select("id"), "id").select("id", "conv")
    rows = rows.repartition("id").sortWithinPartitions("id", "conv")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            out = []
            for k, c in zip(*(x.to_pylist() for x in batch.columns)):
                if k != key:
                    if state:
                        out.append((key, state.hexdigest()))
                    key, state = k, hashlib.sha256(str(c).encode())
                else:
                    state.update(f",{c}".encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], names=["id", "ends_sha256"])
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([state.hexdigest()])], names=["id", "ends_sha256"])

    return one.union(rows.mapInArrow(run, "id binary, ends_sha256 string"))


def trie_nodes(found: DataFrame, convs: DataFrame, length: int) -> DataFrame:
    """All nodes: ``owner`` (smallest member), ``depth``, ``parent_owner``, ``n_convs``, ``words``, ``id``.

    Conversations are first grouped by block digests. Where all that pass a block's beginning have the same block, its
    turns are nodes without further grouping; only blocks with siblings are compared turn by turn, one row per
    different block. ``id`` is null inside blocks without siblings, where nothing ends or branches.
    """
    one = {c: F.any_value(c).alias(c) for c in ("prev", "block", "n", "digests", "words")}
    classes = staged(found.groupBy("end").agg(F.min("conv").alias("owner"), F.count("*").alias("n_convs"), *one.values()),
                     "block-classes")
    split = classes.groupBy(F.col("prev").alias("p")).agg(F.count("*").alias("c")).where("c > 1").select("p")
    depth = F.col("block") * length + F.col("j")
    each = F.explode(F.sequence(F.lit(1), F.col("n"))).alias("j")
    word = F.element_at("words", F.col("j"))
    alone = classes.join(split, F.col("prev") == F.col("p"), "left_anti").select("*", each).select(
        F.when(F.col("j") == F.col("n"), F.col("end")).alias("id"), F.when(F.col("j") == 1, F.col("prev")).alias("parent"),
        "owner", depth.alias("depth"), "n_convs", word.alias("words"))
    shared = classes.join(split, F.col("prev") == F.col("p"), "left_semi").select("*", each)

    def prefix(j):
        return F.unhex(F.md5(F.concat("prev", F.substring("digests", F.lit(1), j * WIDTH))))

    shared = shared.select(prefix(F.col("j")).alias("id"),
                           F.when(F.col("j") == 1, F.col("prev")).otherwise(prefix(F.col("j") - 1)).alias("parent"),
                           "owner", depth.alias("depth"), "n_convs", word.alias("words"))
    shared = shared.groupBy("id").agg(F.any_value("parent").alias("parent"), F.min("owner").alias("owner"),
                                      F.any_value("depth").alias("depth"), F.sum("n_convs").alias("n_convs"),
                                      F.any_value("words").alias("words"))
    root = convs.agg(F.min("conv").alias("owner"), F.count("*").alias("n_convs")).where("n_convs > 0").select(
        F.lit(ROOT).alias("id"), F.lit(None).cast("binary").alias("parent"), "owner", F.lit(0).cast("long").alias("depth"),
        "n_convs", F.lit(0).cast("long").alias("words"))
    nodes = staged(alone.unionByName(shared).unionByName(root), "nodes")
    above = nodes.where("id IS NOT NULL").select(F.col("id").alias("parent"), F.col("owner").alias("parent_owner"))
    nodes = nodes.join(above, "parent", "left")
    # Inside a block without siblings the parent is the turn before.
    inner = F.col("parent").isNull() & (F.col("depth") > 0)
    return nodes.select("id", "owner", "depth", F.when(inner, F.col("owner")).otherwise(F.col("parent_owner")).alias("parent_owner"),
                        "n_convs", "words")


def _totals(chains: DataFrame) -> DataFrame:
    """``chain``, ``leaves`` and ``saved`` summed over a chain and all below it.

    ``chains`` has ``chain``, ``up`` (the chain that it hangs on, or null) and its own sums. Every round adds the sums
    of those 2^k steps below and doubles the step, so rounds grow with the logarithm of the nesting.
    """
    state = staged(chains, "chains")
    while state.where("up IS NOT NULL").limit(1).count():
        below = state.where("up IS NOT NULL").groupBy("up").agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
        below = below.withColumnRenamed("up", "chain")
        above = state.where("up IS NOT NULL").select(F.col("chain").alias("up"), F.col("up").alias("next"))
        state = staged(state.join(above, "up", "left").join(below, "chain", "left").select(
            "chain", F.col("next").alias("up"), (F.col("leaves") + F.coalesce("l", F.lit(0))).alias("leaves"),
            (F.col("saved") + F.coalesce("s", F.lit(0))).alias("saved")), "chains")
    return state.drop("up")


def prefix_trie(turns: DataFrame, convs: DataFrame, length: int = BLOCK_TURNS) -> DataFrame:
    """One row per node of the trie of turn prefixes, the textless root included.

    ``turns`` comes from ``turn_rows``; ``convs`` has every ``conv`` once, with or without turns. Columns:
    ``conv_id`` (smallest member), ``depth``, ``parent_conv_id`` (null at the root), ``n_convs`` (members),
    ``n_children``, ``n_leaves`` (childless nodes from here down), ``saved_tokens`` (over the same nodes, words of the
    last turn times members beyond the first), ``ends_sha256`` (over the ids that end here). Without conversations
    there is no row. Turns are equal when the 128-bit digests of role and text are.

    The nodes with one smallest member form a chain of falling depth, so (smallest member, depth) names a node, and
    sums over subtrees are sums along chains plus the totals of the chains that hang on them.
    """
    found = blocks(turns, length)
    nodes = staged(trie_nodes(found, convs, length), "trie")
    ends = found.where("last").select(F.col("end").alias("id"), "conv")
    ends = ends.union(convs.join(ends, "conv", "left_anti").select(F.lit(ROOT).alias("id"), "conv"))
    heads = nodes.where("parent_owner <> owner").select(
        F.col("owner").alias("chain"), F.col("parent_owner").alias("up"), (F.col("depth") - 1).alias("at"))
    branches = heads.groupBy(F.col("up").alias("owner"), F.col("at").alias("depth")).agg(F.count("*").alias("branches"))
    last = F.row_number().over(Window.partitionBy("owner").orderBy(F.desc("depth"))) == 1
    rows = nodes.join(branches, ["owner", "depth"], "left").withColumn(
        "n_children", F.coalesce("branches", F.lit(0)) + F.when(last, 0).otherwise(1)).drop("branches")
    rows = staged(rows.withColumns({"leaf": (F.col("n_children") == 0).cast("long"),
                                    "saving": (F.col("n_convs") - 1) * F.col("words")}), "rows")
    own = rows.groupBy(F.col("owner").alias("chain")).agg(F.sum("leaf").alias("leaves"), F.sum("saving").alias("saved"))
    totals = _totals(own.join(heads.select("chain", "up"), "chain", "left"))
    hung = heads.join(totals, "chain").groupBy(F.col("up").alias("owner"), F.col("at").alias("depth")).agg(
        F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
    down = Window.partitionBy("owner").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.join(hung, ["owner", "depth"], "left").withColumns({
        "n_leaves": F.sum(F.col("leaf") + F.coalesce("l", F.lit(0))).over(down),
        "saved_tokens": F.sum(F.col("saving") + F.coalesce("s", F.lit(0))).over(down)})
    rows = rows.join(end_digests(ends), "id", "left")
    return rows.select(F.col("owner").alias("conv_id"), "depth", F.col("parent_owner").alias("parent_conv_id"), "n_convs",
                       F.col("n_children").cast("long").alias("n_children"), "n_leaves", "saved_tokens",
                       F.coalesce("ends_sha256", F.lit(_NO_END)).alias("ends_sha256"))
