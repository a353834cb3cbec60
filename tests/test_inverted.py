"""The block index against the ranking that scores every posting."""

import random

from pyspark.sql import functions as F

from graphloom.operators import inverted, lexical
from graphloom.storage import new_path

SF = "/root/testdata/sf0.01"


def ranked(df):
    return sorted((r.query_id, r["rank"], r.doc_id, r.score) for r in df.collect())


def corpus(spark, n=400, seed=1):
    """Zipf-like words: few are everywhere, many are rare."""
    r = random.Random(seed)
    docs = [(i, " ".join(f"w{min(int(r.paretovariate(0.6)), 2_000)}" for _ in range(r.randrange(0, 40)))) for i in range(n)]
    return spark.createDataFrame([*docs, (n, None), (n + 1, "only here")], "doc_id long, text string").repartition(4)


def test_equals_the_full_ranking_and_scores_less(spark):
    docs = corpus(spark)
    asked = [(i, f"w1 w{i * 7 + 3} w{i * 31 + 20} w{i * 31 + 20}") for i in range(40)] + [(90, "only here"), (91, "nowhere"), (92, ""), (93, "W1 w2!w3")]
    queries = spark.createDataFrame(asked, "query_id long, text string")
    for k, size in ((1, 2), (5, 4), (10, 16), (600, 8)):
        index = inverted.build(docs, new_path(spark, "test-bm25"), block_docs=size, shards=3)
        top, work = index.search(queries, k, first=4)
        assert ranked(top) == ranked(lexical.bm25plus(docs, queries, k)), (k, size)
        total = work.agg(F.sum("n_postings").alias("a"), F.sum("n_scored").alias("b")).first()
        assert total.b <= total.a and (k > 5 or total.b < 0.9 * total.a), (k, size, total)


def test_one_index_is_read_by_many_queries(spark):
    docs = corpus(spark, seed=2)
    at = new_path(spark, "test-bm25")
    inverted.build(docs, at, block_docs=16)
    one, two = (spark.createDataFrame([(1, t)], "query_id long, text string") for t in ("w5 w80", "w9 only"))
    for q in (one, two):
        assert ranked(inverted.load(spark, at).search(q, 5)[0]) == ranked(lexical.bm25plus(docs, q, 5))


def test_odd_documents(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "b c"), (None, "a"), (2, None), (3, "a " * 5000)], "doc_id long, text string")
    index = inverted.build(docs, new_path(spark, "test-bm25"))
    assert index.docs.count() == 3 and {r.term: r.df for r in index.terms.collect()} == {"a": 2, "b": 1, "c": 1}
    queries = spark.createDataFrame([(1, "c")], "query_id long, text string")
    assert [(r.doc_id, r["rank"]) for r in index.search(queries, 9)[0].orderBy("rank").collect()] == [(1, 1), (2, 2), (3, 3)]
    empty = inverted.build(docs.limit(0), new_path(spark, "test-bm25"))
    assert empty.search(queries)[0].collect() == []


def test_counts_of_tokens(spark):
    df = spark.createDataFrame([(["b", "a", "b", "c", "b"],), (["x"],)], "t array<string>")
    assert [[tuple(x) for x in r.c] for r in df.select(F.expr(inverted.COUNTED).alias("c")).collect()] == [[("a", 1), ("b", 3), ("c", 1)], [("x", 1)]]


def test_postings_are_not_shuffled_for_a_search(spark):
    docs = corpus(spark, 100)
    index = inverted.build(docs, new_path(spark, "test-bm25"), shards=4)
    asked = spark.createDataFrame([(1, "w1", 1.0)], "query_id long, term string, weight double")
    opened = spark.createDataFrame([(1, 3, 0.5)], "query_id long, block long, base double")
    plan = index._scored(F.broadcast(asked), opened)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan and "partial_sum" in plan
