"""Hard negatives against all pairs, and the boxes of the trees."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gistline.llm import rtree_negatives as rt

SCHEMA = T.StructType([
    T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType())), T.StructField("label", T.IntegerType()),
    *(T.StructField(c, T.StringType()) for c in ("id", "q", "tile", "low", "score")),
])


def frame(spark, rows):
    return spark.createDataFrame([(i, v, y, *["x"] * 5) for i, v, y in rows], SCHEMA)


def plain(rows, every=50):
    one = {}
    for i, v, y in rows:
        if i is None or v is None or y is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        own = (y, [math.floor(256 * x) for x in v])
        one[i] = min(one.get(i, own), own)

    def score(a, b):
        return max(-rt.LONG, min(rt.LONG, sum(x * y for x, y in zip(a, b, strict=True))))

    out = []
    for a, (label, v) in one.items():
        if a % every:
            continue
        ranked = sorted((-score(v, w), i, y) for i, (y, w) in one.items() if i != a and len(w) == len(v))
        for s, p, _ in [r for r in ranked if r[2] == label][:5]:
            inside = [r for r in ranked if r[2] != label and -50 * s <= -100 * r[0] <= -95 * s]
            out += [(a, p, k + 1, r[1], -s, -r[0]) for k, r in enumerate(inside[:3])]
    return sorted(out)


def run(spark, rows, every=50, **how):
    return sorted(map(tuple, rt.mine(frame(spark, rows), F.col("id") % every == 0, **how).collect()))


def vectors(n, d, seed, labels=4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(labels, d))
    y = rng.integers(0, labels, n)
    return [(int(i), [float(x) for x in v], int(c)) for i, (v, c) in enumerate(zip(centres[y] + rng.normal(size=(n, d)), y, strict=True))]


@pytest.mark.parametrize("tile_rows", [100, 400, 5000])
def test_all_pairs(spark, tile_rows):
    rows = vectors(2000, 6, 1)
    got = run(spark, rows, tile_rows=tile_rows)
    assert got == plain(rows) and len(got) > 100


def test_edge_rows(spark):
    """Ties, copies, repeated ids, other lengths, empty vectors, values no double holds a sum of."""
    rows = vectors(200, 3, 2) + [(1000 + i, [0.5, 0.25, -0.5], i % 2) for i in range(200)]
    rows += [(50, rows[50][1], rows[50][2]), (100, [9.0, 9.0, 9.0], 3), (None, [1.0, 1.0, 1.0], 1), (1500, None, 1), (1550, [1.0, 1.0, 1.0], None)]
    rows += [(1600, [1.0, float("nan"), 1.0], 1), (1650, [float("inf"), 1.0, 1.0], 1), (1700, [None, 1.0, 1.0], 1)]
    rows += [(1750 + i, [1.0 + i, 2.0], i % 2) for i in range(60)] + [(1900 + i, [], i % 2) for i in range(60)]
    rows += [(2000 + i, [3.0**i, 1e13 + i, -7.0, 1.5], i % 2) for i in range(52)]
    assert run(spark, rows, 10, tile_rows=64) == plain(rows, 10)


def test_scores_beyond_a_long(spark):
    rows = [(i, [1e200 * (-1) ** i, 1e12 + 7 * i], i % 2) for i in range(40)]
    assert run(spark, rows, 10, tile_rows=16) == plain(rows, 10)


def test_one_vector_and_no_vector(spark):
    assert run(spark, []) == []
    assert run(spark, [(0, [1.0], 1)]) == []
    assert run(spark, [(0, [1.0], 1), (1, [1.0], 1), (2, [0.75], 2)]) == [(0, 1, 1, 2, 65536, 49152)]


def test_twin(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{sf_dir}/embeddings.parquet'")
    assert sorted(map(tuple, rt.query(spark, sf_dir).collect())) == sorted(con.execute(rt.ORACLE).fetchall())


def test_boxes_prune_and_lose_nothing():
    """On clustered vectors most leaves stay unread; the results are those of all rows."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 4)) * 1000
    v = np.floor(centres[rng.integers(0, 40, 20_000)] + rng.normal(size=(20_000, 4)))
    ids, labels, queries = np.arange(20_000), np.zeros(20_000, np.int64), v[:50]
    tree = rt.Tree(ids, labels, v)
    open_ = np.full((50, 1), -rt.LONG), np.full((50, 1), rt.LONG)
    scores, found = tree.search(queries, ids[:50], labels[:50], *open_, 5, True)
    assert tree.read < 0.2 * 50 * len(tree.leaves)
    product = (queries @ v.T).astype(np.int64)
    for i in range(50):
        want = sorted((-product[i, j], j) for j in range(20_000) if j != i)[:5]
        assert [(-s, j) for s, j in zip(scores[i, 0], found[i, 0], strict=True)] == want
    assert all(((tree.low[i] <= w) & (w <= tree.high[i])).all() for i, (_, _, w) in enumerate(tree.leaves))


def test_windows_outside_every_box_read_nothing():
    v = np.ones((1000, 2))
    tree = rt.Tree(np.arange(1000), np.zeros(1000, np.int64), v)
    far = np.array([[5]]), np.array([[9]])
    scores, _ = tree.search(v[:1], np.array([0]), np.array([1]), *far, 3, False)
    assert tree.read == 0 and (scores == rt.NO_SCORE).all()
