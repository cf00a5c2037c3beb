"""Trie of conversation prefixes against brute force: copies, nested prefixes, nulls, ties, blocks of any length."""

import hashlib
import random
import zlib

import pytest

from coursebank.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth int, block string, id binary"


def conversations():
    rng = random.Random(5)
    out = {}
    for c in range(-3, 70):
        if c % 3 == 0:
            turns = [("user", "hello there"), ("assistant", "one two three")]  # a third of all are copies
        else:
            turns = [(rng.choice(["user", None, ""]), rng.choice(["a", "b c", "", None])) for _ in range(rng.randrange(9))]
        out[c] = [(i if i else None, *t) for i, t in enumerate(turns)]
    out[71] = [(i, "user", f"w{i} x") for i in range(60)]  # chains that hang on each other
    for k in range(72, 90):
        out[k] = out[71][:60 - 3 * (k - 71)] + [(100, "user", f"end {k}")]
    out[90] = out[71][:17]
    out[91] = [(5, "user", "tie b"), (5, "user", "tie a"), (5, "user", "tie a"), (1, "x" * 50, "long " * 50_000)]
    return out


def shape(t):
    return (t[1] or "", t[2] or "")


def ordered(turns):
    def digest(t):
        role, text = shape(t)
        return hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()

    return [shape(t) for t in sorted(turns, key=lambda t: (t[0] is not None, t[0] or 0, digest(t)))]


def brute(convs):
    members, ends = {}, {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
        ends.setdefault(tuple(turns), []).append(c)
    children = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        below = children.get(node, [])
        words = len((node[-1][1] if node else "").split())
        leaves[node] = sum(leaves[x] for x in below) if below else 1
        saved[node] = (len(members[node]) - 1) * words + sum(saved[x] for x in below)
    return sorted((min(m), len(node), min(members[node[:-1]]) if node else None, len(m), len(children.get(node, [])),
                   leaves[node], saved[node], hashlib.sha256(",".join(map(str, sorted(ends.get(node, [])))).encode()).hexdigest())
                  for node, m in members.items())


def frame(spark, convs):
    rows = [(c, t, r, x, 1, "clash", b"") for c, turns in convs.items() for t, r, x in turns]
    return spark.createDataFrame(rows + [(None, 1, "user", "no conversation", 1, "", b"")], SCHEMA)


@pytest.fixture(scope="module")
def turns(spark):
    return prefix_trie.turn_rows(frame(spark, conversations())).cache()


@pytest.mark.parametrize("length", [1, 3, 8])
def test_trie(spark, turns, length):
    convs = {c: ordered(t) for c, t in conversations().items()}
    ids = spark.createDataFrame([(c,) for c in convs], "conv long")
    got = prefix_trie.prefix_trie(turns, ids, length).collect()
    assert sorted(map(tuple, got), key=lambda r: r[:2]) == brute(convs)


def test_shared_heads(spark, turns):
    convs = {c: ordered(t) for c, t in conversations().items() if t}
    built = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = convs.get(c - (c % 20 if c >= 0 else -(-c % 20)), [])[:h] + own[h:]
    ids = turns.select("conv").distinct()
    got = prefix_trie.prefix_trie(prefix_trie.with_shared_heads(turns, ids), ids).collect()
    assert sorted(map(tuple, got), key=lambda r: r[:2]) == brute(built)


def test_empty(spark, turns):
    ids = turns.select("conv").distinct()
    assert prefix_trie.prefix_trie(turns.where("false"), ids.where("false")).count() == 0
    only_root = prefix_trie.prefix_trie(turns.where("false"), spark.createDataFrame([(3,), (12,)], "conv long")).collect()
    assert [tuple(r) for r in only_root] == [(3, 0, None, 2, 0, 1, 0, hashlib.sha256(b"3,12").hexdigest())]
