"""Grid join and clustered table against all products."""

import numpy as np

from graphloom.operators import vectors
from graphloom.storage import new_path


def brute(rows, asked, k):
    unit = lambda v: v / (np.linalg.norm(v) or 1)
    out = []
    for q, e in asked:
        best = sorted((-round(float(unit(np.array(e, float)) @ unit(np.array(v, float))), 6) + 0.0, i) for i, v in rows)[:k]
        out += [(q, i, -s + 0.0, n) for n, (s, i) in enumerate(best, 1)]
    return sorted(out)


def made(n=300, dims=6, seed=0):
    r = np.random.default_rng(seed)
    centres = r.normal(0, 1, (8, dims))
    x = centres[r.integers(0, 8, n)] + r.normal(0, 0.08, (n, dims))
    x[:40] = x[0]  # equal scores
    x[41] = 0
    return [(i, x[i].tolist()) for i in range(n)]


def table(spark, rows, name="id", kind="long"):
    return spark.createDataFrame(rows, f"{name} {kind}, embedding array<double>").repartition(3)


def tuples(df):
    return sorted((r.query_id, r.id, r.score, r["rank"]) for r in df.collect())


def close(got, want):
    return [x[:2] + x[3:] for x in got] == [x[:2] + x[3:] for x in want] and all(abs(a[2] - b[2]) < 2e-6 for a, b in zip(got, want, strict=True))


def test_grid_equals_all_products(spark):
    rows = made()
    asked = [rows[i] for i in (0, 5, 41, 50, 299)]
    for k, size in ((1, 7), (5, 64), (400, 64)):
        got = vectors.topk(table(spark, rows), table(spark, asked, "query_id"), k, vector_rows=size, query_rows=2)
        assert close(tuples(got), brute(rows, asked, k)), k


def test_names_may_be_strings(spark):
    rows = [(f"v{i}", v) for i, v in made(60)]
    got = vectors.topk(table(spark, rows, kind="string"), table(spark, rows[:9], "query_id", "string"), 4, 16, 4)
    assert close(tuples(got), brute(rows, rows[:9], 4))


def test_clusters_equal_all_products_and_score_less(spark):
    rows = made(600, seed=1)
    asked = [rows[i] for i in range(0, 600, 50)] + [(900, [0.0] * 6)]
    index = vectors.cluster(table(spark, rows), new_path(spark, "test-vectors"), clusters=12)
    for k in (1, 5):
        best, work = index.search(table(spark, asked, "query_id"), k, first=1, vector_rows=64, query_rows=4)
        assert close(tuples(best), brute(rows, asked, k)), k
        work = {r.query_id: (r.n_scored, r.n_vectors) for r in work.collect()}
        assert all(n == 600 for _, n in work.values()) and work[900][0] == 600 and sum(n for n, _ in work.values()) < 0.6 * 600 * len(asked)


def test_empty_tables(spark):
    rows = made(50)
    some, none = table(spark, rows), table(spark, rows).limit(0)
    ask = lambda df: df.withColumnRenamed("id", "query_id")
    assert vectors.topk(none, ask(some), 3).collect() == [] and vectors.topk(some, ask(none), 3).collect() == []
    index = vectors.cluster(none, new_path(spark, "test-vectors"))
    assert index.search(ask(some), 3)[0].collect() == []
    assert vectors.cluster(some, new_path(spark, "test-vectors")).search(ask(none), 3)[0].collect() == []


def test_no_query_comes_to_the_driver():
    import inspect

    assert "toLocalIterator" not in inspect.getsource(vectors)
