"""Small document tables that hold the odd cases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark: SparkSession, rows: list[tuple], partitions: int = 3) -> DataFrame:
    """(doc_id, text) rows with the columns of `documents`."""
    full = [(i, t, None, "s" if (i or 0) % 2 else None, None if t is None else len(t)) for i, t in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(partitions)


def clashing(df: DataFrame) -> DataFrame:
    """With more columns whose names operators might use themselves."""
    from pyspark.sql import functions as F

    names = ["_id", "_h", "_k", "_n", "_row", "_bucket", "kept", "score", "size", "shard", "pos", "start", "component_id", "text_sha256", "key", "n", "row", "grade", "tail", "stays", "label", "windows", "_text"]
    return df.withColumns({n: F.lit("x") for n in names})


def documents(spark: SparkSession, sf: str = "sf0.001") -> list[tuple[int, str]]:
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("doc_id", "text").collect()]


LONG = " ".join(f"word{i % 5003} tail{i % 17}." for i in range(60_000))
ODD = [(None, None), (None, "some text"), (1, ""), (2, None), (3, " \n\t "), (4, "one"), (5, "one"), (5, "one"), (6, LONG), (7, LONG), (8, "é" * 500), (9, "a" * 3000)]
