"""Hard negatives against all pairs, with cells, leaves and query blocks small enough to matter."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import negatives

SIZES = {"cell_rows": 40, "query_rows": 16, "leaf_rows": 8}
SCHEMA = "vec_id long, label int, v array<int>"


def brute(rows, anchors, positives=5, negatives=3, low=50, high=95):
    """rows: {id: (label, vector)}."""

    def dot(a, b):
        return sum(x * y for x, y in zip(a, b, strict=False))

    out = []
    for a in anchors:
        label, v = rows[a]
        ranked = sorted((-dot(v, w), i, other) for i, (other, w) in rows.items() if i != a)
        for s, p, _ in [r for r in ranked if r[2] == label][:positives]:
            fits = [r for r in ranked if r[2] != label and low * -s <= 100 * -r[0] <= high * -s]
            out += [(a, p, n, i, -s, -t) for n, (t, i, _) in enumerate(fits[:negatives], 1)]
    return sorted(out)


def mined(spark, rows, anchor, **sizes):
    df = spark.createDataFrame([(i, label, list(v)) for i, (label, v) in rows.items()], SCHEMA).repartition(3)
    return sorted(map(tuple, negatives.mine(df, anchor, **{**SIZES, **sizes}).collect()))


def clustered(n, dims=6, seed=0):
    """Vectors in a few tight clusters of unequal norm, so that the tree leaves most leaves out; a third of them is one vector."""
    r = np.random.default_rng(seed)
    centres = r.normal(0, 200, (7, dims))
    x = np.floor(centres[r.integers(0, 7, n)] + r.normal(0, 12, (n, dims))).astype(int)
    x[: n // 3] = x[0]
    return {i: (int(r.integers(0, 3)), x[i].tolist()) for i in range(n)}


@pytest.mark.parametrize("seed", [0, 1])
def test_equals_all_pairs(spark, seed):
    rows = clustered(300, seed=seed)
    got = mined(spark, rows, F.col("vec_id") % 10 == 0)
    assert got == brute(rows, [i for i in rows if i % 10 == 0]) and len(got) > 100


def test_random_unit_vectors(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(250, 16))
    x = np.floor(256 * x / np.linalg.norm(x, axis=1, keepdims=True)).astype(int)
    rows = {i: (i % 4, x[i].tolist()) for i in range(250)}
    assert mined(spark, rows, F.col("vec_id") % 25 == 0) == brute(rows, range(0, 250, 25))


def test_large_components_are_exact(spark):
    r = np.random.default_rng(4)
    rows = {i: (i % 2, (r.integers(-negatives.BOUND, negatives.BOUND, 4)).tolist()) for i in range(60)}
    assert mined(spark, rows, F.col("vec_id") % 6 == 0) == brute(rows, range(0, 60, 6))


def test_odd_rows(spark):
    rows = {0: (1, [3, 4]), 1: (1, [3]), 2: (1, []), 3: (2, [2, 3]), 4: (2, [0, 0]), 5: (1, [-3, -4]), 10: (2, [3, 4]), 20: (3, [])}
    df = spark.createDataFrame(
        [(i, label, v) for i, (label, v) in rows.items()] + [(None, 1, [9, 9]), (30, None, [9, 9]), (31, 1, None), (0, 1, [3, 4]), (1, 1, [3])], SCHEMA
    )
    df = df.withColumns({c: F.lit("x") for c in ("g", "score", "cell", "shard", "low", "high", "r")})
    got = sorted(map(tuple, negatives.mine(df, F.col("vec_id") % 10 == 0, **SIZES).collect()))
    assert got == brute(rows, [0, 10, 20])
    assert negatives.mine(df.limit(0), F.col("vec_id") % 10 == 0).collect() == []


def test_finite_and_quantized(spark):
    rows = [(1, [0.5, -0.001]), (2, [float("nan"), 0.0]), (3, [float("inf")]), (4, None), (5, [None, 1.0]), (6, []), (7, [1e300, -1e300])]
    df = spark.createDataFrame(rows, "i int, e array<double>")
    got = {r.i: r.q for r in df.where(negatives.finite("e")).select("i", negatives.quantized("e", 256).alias("q")).collect()}
    assert got == {1: [128, -1], 6: [], 7: [negatives.BOUND, -negatives.BOUND]}


def test_leaves_are_left_out():
    """In tight clusters most leaves miss the annulus of a query, and all rows inside lie in the others."""
    rows = clustered(2_000, dims=8, seed=5)
    x = np.array([v for _, v in rows.values()], float)
    most = float((x * x).sum(axis=1).max())
    tree = negatives.Tree(x, most, 32, True)
    least, largest = tree.scores(x[::50])
    s = x[::50] @ x.T
    for leaf, own in enumerate(tree.leaves):
        assert (s[:, own].max(axis=1) <= largest[:, leaf]).all() and (s[:, own].min(axis=1) >= least[:, leaf]).all()
    kth = np.sort(s, axis=1)[:, -5]
    assert (largest >= kth[:, None]).mean() < 0.5
