"""The index is built from texts that are cut into words once, and postings stay where they lie however many ranges are opened."""

from pyspark.sql import functions as F

from graphloom.functions.text import tokens
from graphloom.operators import inverted, lexical
from graphloom.storage import new_path


def test_many_opened_ranges_do_not_shuffle_postings(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"a w{i % 7} w{i % 11}") for i in range(60)], "doc_id long, text string").repartition(3)
    queries = spark.createDataFrame([(1, "a w3"), (2, "w1 a"), (3, "w9 w2 nowhere")], "query_id long, text string")
    want = sorted(tuple(r) for r in lexical.bm25plus(docs, queries, 4).collect())
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        monkeypatch.setattr(inverted, "BROADCAST_ROWS", 6)
        index = inverted.build(docs, new_path(spark, "test-bm25"), block_docs=2, shards=5)
        blocks = [r.block for r in index.segments.select(F.explode("blocks").alias("block")).distinct().orderBy("block").collect()]
        asked = F.broadcast(spark.createDataFrame([(1, "a", 1.0)], "query_id long, term string, weight double"))
        opened = spark.createDataFrame([(1, b, 0.5) for b in blocks[::3]], "query_id long, block long, base double")
        plan = index._scored(asked, opened)._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
        assert sorted(tuple(r) for r in index.search(queries, 4, first=2)[0].collect()) == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_turns_keep_shards_together_up_to_the_bound(monkeypatch):
    monkeypatch.setattr(inverted, "BROADCAST_ROWS", 10)
    assert inverted._turns([(0, 4), (2, 6), (3, 11), (4, 1)]) == [([0, 2], True), ([3], False), ([4], True)]
    assert inverted._turns([]) == [([], True)]


def test_words_are_those_of_tokens(spark, monkeypatch):
    texts = ["", None, "A b,b\x00C9", "İstanbul Kelvin Straße ſ", "né à 9x", "x" * 300, " lead", "trail ", "a", "日本 z9 日本", "tail-", "B"]
    docs = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "doc_id string, text string").coalesce(1)
    monkeypatch.setattr(inverted, "TEXT_BYTES", 16)
    rows = docs.select(F.col("doc_id"), tokens("text").alias("t"))
    index = inverted.build(docs, new_path(spark, "test-bm25"), block_docs=2, shards=2)
    assert {r.doc_id: r.dl for r in index.docs.collect()} == {r.doc_id: len(r.t) for r in rows.collect()}
    got = index.segments.select("term", F.explode(F.arrays_zip("docs", "tfs")).alias("x")).select("term", "x.docs", "x.tfs")
    want = rows.select(F.explode("t").alias("term"), "doc_id").groupBy("term", "doc_id").count().select("term", "doc_id", "count")
    assert sorted(tuple(r) for r in got.collect()) == sorted(tuple(r) for r in want.collect())
    assert {r.term: r.df for r in index.terms.collect()} == {r.term: r["count"] for r in want.groupBy("term").count().collect()}


def test_an_index_asked_twice_is_cut_into_words_once(spark, monkeypatch):
    from graphloom.plans import queries_text

    made = []
    written = inverted.written
    monkeypatch.setattr(inverted, "written", lambda df, name: (made.append(name), written(df, name))[1])
    monkeypatch.setattr(inverted, "TEXT_BYTES", 1_000)
    docs = spark.createDataFrame([(i, f"a w{i % 7}", "s") for i in range(30)], "doc_id long, text string, source string")
    items = spark.createDataFrame([(i, f"a w{i}") for i in range(4)], "query_id long, text string")
    got = queries_text.bm25_index_twice(docs, items)
    want = {i: [tuple(r) for r in lexical.bm25plus(docs, items.where(F.col("query_id") == i), 10 if i % 2 == 0 else 3).collect()] for i in range(4)}
    assert sorted(tuple(r) for r in got.collect()) == sorted(r for rows in want.values() for r in rows)
    assert made.count("inverted-counted") == 1 and "inverted-sizes" not in made
