"""What a task of BM25 holds must not grow with the documents and the queries."""

import random
import re

from graphloom.operators import lexical


def test_tasks_are_as_many_as_documents_and_queries_ask_for(spark, monkeypatch):
    r = random.Random(5)
    docs = [(i, " ".join(f"w{min(int(r.paretovariate(0.6)), 500)}" for _ in range(r.randrange(0, 30)))) for i in range(200)] + [(200, None), (7, "w1 w1 w900")]
    docs = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    queries = spark.createDataFrame([(i, f"w1 w{i} w{i} w{i * 3}") for i in range(10)] + [(99, "nowhere")], "query_id long, text string")
    ranked = lambda: sorted(tuple(x) for x in lexical.bm25plus(docs, queries, 5).collect())
    want = ranked()
    assert len(want) == 50
    tables = {}
    written = lexical.written
    monkeypatch.setattr(lexical, "written", lambda df, name: tables.setdefault(name, df) and written(df, name))
    monkeypatch.setattr(lexical, "TASK_SUMS", 202 * 11 // 20, raising=False)
    assert ranked() == want
    assert tables["postings"].rdd.getNumPartitions() >= 20
    plan = tables["postings"]._jdf.queryExecution().toString().split("Physical Plan")[-1]
    assert "REPARTITION_BY_NUM" in plan and not re.search(r"hashpartitioning\(doc_id#\d+L, term", plan), plan
