"""Queries see all rows of their tables."""

from pyspark.sql import functions as F

from graphloom import catalog
from graphloom.plans import queries_graph
from graphloom.plans.base import rows

SF = "/root/testdata/sf0.01"


def ids(df, column):
    return {r[0] for r in df.select(column).distinct().collect()}


def test_bm25_ranks_for_every_benchmark_item(spark):
    items = ids(spark.read.parquet(f"{SF}/benchmark.parquet"), "item_id")
    assert len(items) > 20
    for name in ("bm25plus_topk", "bm25_prefix_scope"):
        assert ids(catalog.QUERIES[name](spark, SF), "query_id") == items


def test_summaries_count_every_document(spark):
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    assert n > 400
    assert catalog.QUERIES["commit_groups"](spark, SF).agg(F.sum("n_issues")).first()[0] == n
    assert catalog.QUERIES["track_groups"](spark, SF).count() == n
    assert ids(catalog.QUERIES["method_summary"](spark, SF), "n_issues") == {n}


def test_graph_has_every_line_and_every_supplier(spark):
    pairs = rows(spark, SF, "SELECT DISTINCT l_suppkey, l_partkey FROM {lineitem}").count()
    assert rows(spark, SF, queries_graph.EDGES).count() == pairs
    suppliers = spark.read.parquet(f"{SF}/supplier.parquet").count()
    paths = catalog.QUERIES["bfs_depth2"](spark, SF)
    assert paths.where("depth = 0").count() == suppliers
    assert ids(paths, "query_id") <= ids(rows(spark, SF, queries_graph.ISSUES), "query_id")
