"""Extraction and embedding hold a bounded number of rows, whatever the batches that Spark sends."""

import pandas as pd
import pyarrow as pa

from graphloom.operators import dense, extract


class Rows:
    """Gives the function that tasks would run."""

    def __init__(self, df):
        self.sparkSession, self.schema = df.sparkSession, df.schema

    def select(self, *_):
        return self

    def mapInArrow(self, run, _):
        return run

    mapInPandas = mapInArrow


def test_extraction_gives_few_files_at_a_time(spark):
    df = spark.createDataFrame([], "path string, content string")
    batch = pa.RecordBatch.from_arrays([pa.array([None, *(f"d/{i}.py" for i in range(300))]), pa.array(["x", None, *(f"some prose {i}" for i in range(299))])], ["path", "content"])
    got = list(extract.chunks(Rows(df))([batch, batch.slice(0, 0)]))
    assert max(b.num_rows for b in got) <= extract.FILES < 300
    rows = pa.Table.from_batches(got).to_pylist()
    assert [(r["file"], r["text"]) for r in rows] == [("d/0.py", ""), *((f"d/{i + 1}.py", f"some prose {i}") for i in range(299))]


def test_embedding_gives_a_call_at_a_time(spark):
    df = spark.createDataFrame([], "id long, text string")
    run = dense.embed(Rows(df), lambda texts: [[float(len(t))] for t in texts], batch=7)
    got = list(run([pd.DataFrame({"id": range(30), "text": ["a" * i if i else None for i in range(30)]}), pd.DataFrame({"id": [], "text": []})]))
    assert max(map(len, got)) <= 7
    assert [x for part in got for x in part.embedding] == [[float(i)] for i in range(30)]
