"""Files told by number give the ranks of files told by path; nodes are made once, and many are not sorted with the edges."""

import random

import pytest
from pyspark.sql import functions as F

from graphloom.operators import graph, push
from graphloom.plans.queries_graph import pagerank_push


def tables(spark):
    r = random.Random(5)
    files = [f"src/n{i % 4}{'/tests' if i % 5 == 0 else ''}/s{i}.py" for i in range(24)] + ["src/none.txt"]
    nodes = [(f, "file", f) for f in files] + [(f"p{i}", "function", r.choice([*files[:9], "gone.py", None])) for i in range(40)] + [("p1", "function", files[3])]
    # Mass is at rest after a few steps.
    edges = {(r.choice(files[9:]), f"p{r.randrange(42)}", r.choice(["CALLS", "IMPORTS", "INHERITS", "OTHER"]), None) for _ in range(200)}
    texts = [(f"q{i}", f"n{i % 5} s{i}" + (" in (SRC/n1/s1.py)" if i % 3 == 0 else "")) for i in range(8)]
    names = "id string, type string, file string", "src string, dst string, type string, confidence string", "query_id string, text string"
    return [spark.createDataFrame(rows, kind) for rows, kind in zip((nodes, sorted(edges, key=str), texts), names, strict=True)]


def test_nodes_are_made_once_for_ranks_of_paths(spark, monkeypatch):
    nodes, edges, texts = tables(spark)
    want = push.rankings(graph.weighted_file_graph(nodes, edges), graph.file_of_nodes(nodes).select("file").distinct(), texts, tolerance=1e-10)[0]
    want = {(r.query_id, r.file): r["rank"] for r in want.select("query_id", "file", F.round("rank", 5).alias("rank")).where("rank > 0").collect()}
    assert len(want) > 50
    for most in (500_000, 0):
        monkeypatch.setattr(graph, "BROADCAST_NODES", most, raising=False)
        seen = spark.sparkContext.accumulator(0)
        made = F.udf(lambda x, seen=seen: seen.add(1) or x, "string").asNondeterministic()
        got = pagerank_push(edges, nodes.coalesce(1).withColumn("file", made("file")), texts).collect()
        assert seen.value == nodes.count()
        assert {(r.query_id, r.file): r["rank"] for r in got} == pytest.approx(want, abs=1.1e-5)


def test_many_nodes_are_not_sorted_with_the_edges(spark, monkeypatch):
    nodes, edges, _ = tables(spark)
    rows = lambda df: sorted(map(tuple, df.collect()))
    want = rows(graph.weighted_file_graph(nodes, edges))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    monkeypatch.setattr(graph, "BROADCAST_NODES", 0, raising=False)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = graph.weighted_file_graph(nodes, edges)
        plan = got._jdf.queryExecution().toString().split("Physical Plan")[-1]
        assert rows(got) == want and {x[3] for x in want} != {0} and {x[5] for x in want} != {0}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "SortMergeJoin" not in plan and plan.count("ShuffledHashJoin") >= 2, plan
