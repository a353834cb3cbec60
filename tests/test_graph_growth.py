"""Graph steps whose work must not gather in one task or shuffle what is large."""

import random

import pytest

from graphloom.operators import graph


@pytest.fixture
def no_small_joins(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_links_are_not_shuffled_by_the_steps(spark, no_small_joins):
    r = random.Random(4)
    names = [f"f{i}" for i in range(20)]
    edges = {(r.choice(names[:15]), r.choice(names)): 0.5 * r.randrange(1, 5) for _ in range(60)}
    out = {a: sum(w for (x, _), w in edges.items() if x == a) for a, _ in edges}
    want = dict.fromkeys(names, 1 / 20)
    for _ in range(3):
        got = dict.fromkeys(names, 0.0)
        for (a, b), w in edges.items():
            got[b] += want[a] * w / out[a]
        lost = 1 - sum(got.values())
        want = {f: 0.15 / 20 + 0.85 * (got[f] + lost / 20) for f in names}
    links = spark.createDataFrame([(a, b, w / out[a]) for (a, b), w in edges.items()], "src string, dst string, p double")
    ranks = graph.pagerank_fixed(links, spark.createDataFrame([(f, 0.05) for f in names], "file string, p double"), 3)
    assert {x.file: pytest.approx(want[x.file]) for x in ranks.collect()} == {x.file: x["rank"] for x in ranks.collect()}
    plan = ranks._jdf.queryExecution().toString().split("Physical Plan")[-1]
    assert "SortMergeJoin [src" not in plan and "BroadcastHashJoin [src" in plan, plan


def test_a_folder_is_dealt_over_tasks(spark, monkeypatch, no_small_joins):
    """Files of one folder, and a few of another: pairs in full, and none of their tasks holds most of them."""
    monkeypatch.setattr(graph, "MODULE_BLOCK", 10, raising=False)
    files = [f"src/m{i}.py" for i in range(60)] + ["lib/a.py", "lib/b.py", "top.py"]
    nodes = spark.createDataFrame([(f, "file", f, f) for f in files], "id string, type string, name string, file string")
    calls = [(files[0], files[1]), (files[0], "lib/a.py"), ("lib/a.py", "lib/b.py"), ("top.py", files[3]), (files[5], files[1])]
    edges = spark.createDataFrame([(a, b, "IMPORTS", None) for a, b in calls], "src string, dst string, type string, confidence string")
    got = graph.weighted_file_graph(nodes, edges, same_module=True)
    folder = lambda f: f.rpartition("/")[0]
    want = {(a, b): 0.2 for a in files for b in files if a != b and folder(a) == folder(b)}
    for a, b in calls:
        want[a, b] = want.get((a, b), 0.0) + 1.0
    rows = got.collect()
    assert len(rows) == len(want)
    assert {(x.src, x.dst): (pytest.approx(x.weight), x.n_import) for x in rows} == {k: (w, int(k in calls)) for k, w in want.items()}
    plan = got._jdf.queryExecution().toString().split("Physical Plan")[-1]
    assert "SortMergeJoin [dir" not in plan
