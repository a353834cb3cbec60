"""What is dear to make is made once, and what a window orders is no wider than it must be."""

from pyspark.sql import functions as F

from graphloom.operators import graph


def counted(spark, df, column):
    seen = spark.sparkContext.accumulator(0)
    same = F.udf(lambda x: seen.add(1) or x, "string").asNondeterministic()
    return df.coalesce(1).withColumn(column, same(column)), seen


def test_paths_make_edges_once_for_all_levels(spark):
    edges = spark.createDataFrame([(f"a{i}", f"a{(i * 3 + k) % 20}", "CALLS", "high") for i in range(20) for k in (1, 2)], "src string, dst string, type string, confidence string")
    seeds = spark.createDataFrame([("q", "a1"), ("q", "a2"), ("r", "a1")], "query_id string, node_id string")
    want = sorted(tuple(map(str, r)) for r in graph.bounded_paths(edges, seeds).collect())
    made, seen = counted(spark, edges, "type")
    assert sorted(tuple(map(str, r)) for r in graph.bounded_paths(made, seeds).collect()) == want
    assert {r[3] for r in want} == {"0", "1", "2"} and seen.value <= 2 * edges.count()  # either way of an edge


def test_neighbours_are_ordered_without_what_is_told_of_them(spark):
    nodes = spark.createDataFrame([("f", "file", "f", "f", "d" * 90), ("g", "function", "g1", "f", "one"), ("g", "function", "g2", "f", "two"), ("h", "function", "h", None, None)], "id string, type string, name string, file string, docstring string")
    edges = spark.createDataFrame([("f", "g", "CALLS"), ("h", "f", "CALLS"), ("f", "out", "CALLS"), ("f", "g", "CALLS")], "src string, dst string, type string")
    got = graph.neighbor_tool(nodes, edges, nodes.where("type = 'file'").select(F.col("id").alias("node_id")), "baseline")
    rows = got.collect()
    told = sorted((r.pos, r.id, r.direction, r.file, r.node_type, r.docstring) for r in rows)
    assert [x[:4] for x in told] == [(1, "g", "outgoing", "f"), (2, "g", "outgoing", "f"), (3, "out", "outgoing", "out"), (4, "h", "incoming", "h")]
    assert {(r.name, r.docstring) for r in rows if r.id == "g"} == {("g1", "one"), ("g2", "two")} and [x[5] for x in told[2:]] == [None, ""]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    ordered = [x for x in plan.splitlines() if "coalesce(file" in x and "node_id" in x]
    assert len(ordered) == 1 and "docstring" not in ordered[0], plan
