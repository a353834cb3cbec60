"""What a search writes is bounded by queries, stretches and k, not by the ranges that a query meets; stretches and batches change no result."""

import random

from pyspark.sql import functions as F

from graphloom.operators import inverted, lexical
from graphloom.storage import new_path


def test_a_search_writes_no_row_a_query_and_range(spark, monkeypatch):
    sizes = {}
    written = inverted.written

    def counted(df, name):
        out = written(df, name)
        sizes[name] = sizes.get(name, 0) + out.count()
        return out

    r = random.Random(5)
    docs = spark.createDataFrame([(f"d{i:03}", "a " * (1 + i % 3) + " ".join(f"w{r.randrange(9)}" for _ in range(4))) for i in range(300)], "doc_id string, text string").repartition(2)
    queries = spark.createDataFrame([(f"q{i}", f"a w{i} w{i + 1}") for i in range(6)], "query_id string, text string")
    index = inverted.build(docs, new_path(spark, "test-bm25"), block_docs=2, shards=2)
    monkeypatch.setattr(inverted, "written", counted)
    got = index.search(queries, 3, first=2)[0].collect()
    # 6 queries, 2 stretches, 3 documents: some more by equal scores, but far from 6 x 150 ranges
    assert max(sizes.values()) <= 150, sizes
    assert sorted(map(tuple, got)) == sorted(map(tuple, lexical.bm25plus(docs, queries, 3).collect()))


def test_small_stretches_and_batches_of_queries_change_no_result(spark, monkeypatch):
    monkeypatch.setattr(inverted, "BATCH_TERMS", 5)
    r = random.Random(6)
    texts = [" ".join(f"w{min(int(r.paretovariate(0.7)), 60)}" for _ in range(r.randrange(12))) for _ in range(80)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, *texts[:30]])], "doc_id long, text string").coalesce(1)
    queries = spark.createDataFrame([(i, f"w1 w{i} w{2 * i} w{2 * i}") for i in range(9)], "query_id long, text string")
    index = inverted.build(docs, new_path(spark, "test-bm25"), block_docs=2)
    assert index.rows.where("term = ''").count() == 1
    want = sorted(map(tuple, lexical.bm25plus(docs, queries, 4).collect()))
    assert sorted(map(tuple, index.search(queries, 4, first=1)[0].collect())) == want
    assert index._found(spark.createDataFrame([(i, "w1", 1.0) for i in range(20)], "query_id long, term string, weight double"), 2, 1).select(F.countDistinct("query_id")).first()[0] == 20


def pieces(batches, size):
    import pyarrow as pa

    before, inverted.TEXT_BYTES = inverted.TEXT_BYTES, size
    try:
        return list(inverted._stretches(pa.RecordBatch.from_arrays([pa.array(range(len(b))), pa.array(b)], ["doc_id", "text"]) for b in batches))
    finally:
        inverted.TEXT_BYTES = before


def test_pieces_are_cut_by_bytes_and_not_by_batches():
    got = pieces([["ab", "c", "defgh"], ["", "ijklmnopq", "r"]], 4)
    assert all(p.num_rows == 1 or sum(map(len, p.column(1).to_pylist())) <= 4 for p in got) and len(got) < 6
    assert [t for p in got for t in p.column(1).to_pylist()] == ["ab", "c", "defgh", "", "ijklmnopq", "r"]
