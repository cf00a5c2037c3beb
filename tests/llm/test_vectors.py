"""Searches over vectors against brute force: ties, copies, nulls, vectors of different length, repeated ids."""

import numpy as np
import pytest

from coursebank.llm import hard_negatives, tiles, top_search
from pyspark.sql import functions as F

SCHEMA = "vec_id long, label int, v array<bigint>, score string, shard int, rank string"


def score(a, b):
    return sum(x * y for x, y in zip(a, b))


def table(n=900, seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        v = rng.integers(-3, 4, 6).tolist()  # many ties
        if i % 3 == 0:
            v = [2, 2, -1, 0, 1, 3]  # a third of all rows are copies
        elif i % 11 == 0:
            v = v[: i % 6]  # shorter, or empty
        elif i % 37 == 0:
            v = [x * 10 ** 8 for x in v]
        rows.append([i, i % 4 if i % 13 else None, v])
    rows += [[None, 1, [1, 2, 3, 4, 5, 6]], [5000, 2, None], [5001, 2, [1, None, 3]], [40, 3, [1, 1, 1, 1, 1, 1]],
             [60, 0, [2, 2, -1, 0, 1, 3]], [60, 0, [2, 2, -1, 0, 1, 3]], [-20, 1, [1, 0, 0, 0, 0, -1]]]
    return [(a, b, c, "clash", 7, None) for a, b, c in rows]


@pytest.fixture(scope="module")
def rows(spark):
    data = table()
    return data, spark.createDataFrame(data, SCHEMA)


@pytest.fixture(params=[(256, 64, 64), (7, 3, 5)], ids=["one shard", "many shards"])
def sizes(request, monkeypatch):
    block, shard, queries = request.param
    monkeypatch.setattr(tiles, "BLOCK", block)
    monkeypatch.setattr(tiles, "SHARD_BLOCKS", shard)
    monkeypatch.setattr(tiles, "QUERIES", queries)
    if block < 10:
        monkeypatch.setattr(tiles, "SUMMARIES", 4)
        monkeypatch.setattr(tiles, "GROUP_QUERIES", 9)


def test_top_search(rows, sizes):
    data, df = rows
    got = top_search.top_search(df, df.where("vec_id % 20 = 0"), 6).collect()
    good = [r for r in data if r[0] is not None and r[2] is not None and None not in r[2]]
    want = []
    for q in {(r[0], tuple(r[2])) for r in good if r[0] % 20 == 0}:
        near = sorted((-score(q[1], r[2]), r[0]) for r in good if r[0] != q[0])[:6]
        want += [(q[0], i + 1, ident, -s) for i, (s, ident) in enumerate(near)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_hard_negatives(rows, sizes):
    data, df = rows
    got = hard_negatives.hard_negatives(df, df.where("vec_id % 10 = 0")).collect()
    good = [r for r in data if r[0] is not None and r[1] is not None and r[2] is not None and None not in r[2]]
    want = []
    for a in {(r[0], r[1], tuple(r[2])) for r in good if r[0] % 10 == 0}:
        near = sorted((-score(a[2], r[2]), r[0], r[1]) for r in good if r[0] != a[0])
        for s, p, _ in [x for x in near if x[2] == a[1]][:5]:
            fit = [(t, n) for t, n, label in near if label != a[1] and 50 * -s <= 100 * -t <= 95 * -s][:3]
            want += [(a[0], p, i + 1, n, -s, -t) for i, (t, n) in enumerate(fit)]
    assert sorted(map(tuple, got)) == sorted(want)
    assert len(want) > 100


def test_few_rows_and_none(spark, rows):
    _, df = rows
    few = df.where("vec_id IN (1, 2, 20)")
    assert [r.vec_id for r in top_search.top_search(few, few.where("vec_id = 20"), 20).collect()].__len__() == 2
    for part in (df.where("false"), df.where("v IS NULL")):
        assert top_search.top_search(part, part).count() == 0
        assert hard_negatives.hard_negatives(part, part).count() == 0
    assert top_search.top_search(df, df.where("false")).count() == 0
    assert hard_negatives.hard_negatives(df, df.where("false")).count() == 0


def test_whole_and_finite(spark):
    df = spark.createDataFrame([(1, [0.5, -0.01]), (2, None), (3, [float("nan")]), (4, [None]), (5, [float("inf")]), (6, [])],
                               "i int, e array<float>")
    got = df.select("i", tiles.finite(F.col("e")).alias("f"), tiles.whole(F.col("e"), 64).alias("w")).collect()
    assert {r.i for r in got if r.f} == {1, 6}
    assert got[0].w == [32, -1]


def test_bounds_hold():
    rng = np.random.default_rng(1)
    vals, q = rng.integers(-50, 50, (40, 9)), rng.integers(-50, 50, (30, 7))
    bound = top_search.bounds(q, vals.max(0)[None], vals.min(0)[None])
    assert (tiles.dot(q, vals) <= bound).all()
    big = np.array([[2 ** 31, 2 ** 31, 2 ** 31]])
    assert (top_search.bounds(big, big, -big) >= 3 * 2 ** 61).all()


def test_large_products():
    a = np.array([[2 ** 31, -3], [1, 2 ** 40]])
    b = np.array([[2 ** 31, 5], [7, 2 ** 20]])
    assert tiles.dot(a, b).tolist() == [[2 ** 62 - 15, 7 * 2 ** 31 - 3 * 2 ** 20], [2 ** 31 + 5 * 2 ** 40, 7 + 2 ** 60]]
    s = np.array([[2 ** 60, 2 ** 60, 5, -1]])
    assert hard_negatives._best(s, np.array([[False, True, True, True]]), 2)[1].tolist() == [1, 2]
