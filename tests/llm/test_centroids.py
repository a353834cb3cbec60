"""Delta Lloyd against plain Lloyd."""

import hashlib
import math

import numpy as np
from pyspark.sql import functions as F

from graphloom.llm import centroids


def brute(rows, k, rounds, dims, scale):
    """rows: (id, vector); the result as sorted tuples."""
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    c = [v for _, v in sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, m, strict=True)), j) for j, m in enumerate(c))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        c = [[sum(x) // len(x) for x in zip(*m, strict=True)] if (m := [v for (_, v), o in zip(kept, own, strict=True) if o == j]) else c[j] for j in range(len(c))]
    last = [(i, *near(v)[::-1]) for i, v in kept]
    per = [sum(d for _, o, d in last if o == j) for j in range(len(c))]
    return sorted(((i, o, d, per[o], sum(per), hashlib.sha256(",".join(map(str, c[o])).encode()).hexdigest()) for i, o, d in last), key=str)


def run(spark, rows, **sizes):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    df = df.withColumns({c: F.lit("x") for c in ("v", "cluster", "distance", "kind")})
    return sorted(map(tuple, centroids.cluster(df, **sizes).collect()), key=str)


def single(v):
    return [float(np.float32(x)) for x in v]


def test_equals_plain_lloyd(spark):
    r = np.random.default_rng(1)
    rows = [(i, single(r.normal(i % 5, 1, 8))) for i in range(400)]
    for rounds in (0, 1, 3, 8):
        sizes = {"k": 6, "rounds": rounds, "dims": 8, "scale": 64}
        assert run(spark, rows, **sizes) == brute(rows, **sizes)


def test_odd_rows(spark):
    rows = [(1, single([0.1, -0.2])), (1, single([0.1, -0.2])), (2, single([5, 5])), (None, single([4, 4])), (3, None), (4, single([1])), (5, [None, 1.0]), (6, [float("nan"), 0.0]), (7, [float("inf"), 0.0]), (8, [])]
    sizes = {"k": 4, "rounds": 3, "dims": 2, "scale": 64}
    got = run(spark, rows, **sizes)
    assert got == brute(rows, **sizes) and len(got) == 4
    assert {r[1] for r in got if r[0] == 1} == {[r[1] for r in got if r[0] == 1][0]}  # of equal centroids the smaller number
    assert run(spark, rows[4:], **sizes) == []


def test_one_vector_and_large_components(spark):
    rows = [(i, single([3e30, -2.0])) for i in range(5)] + [(9, single([-3e30, 1.0]))]
    got = run(spark, rows, k=2, rounds=3, dims=2, scale=64)
    assert len(got) == 6 and all(r[2] == 0 for r in got if r[1] == got[0][1])
    same = [(i, single([0.5, 0.5])) for i in range(30)]
    sizes = {"k": 3, "rounds": 3, "dims": 2, "scale": 64}
    assert run(spark, same, **sizes) == brute(same, **sizes)


def test_squared_is_exact():
    r = np.random.default_rng(2)
    for top in (1 << 10, centroids.SMALL - 1, 1 << 26):
        x, c = r.integers(-top, top + 1, (20, 64)), r.integers(-top, top + 1, (5, 64))
        want = [[sum((int(a) - int(b)) ** 2 for a, b in zip(v, m, strict=True)) for m in c] for v in x]
        assert centroids.squared(x, c).tolist() == want
