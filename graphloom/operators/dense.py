"""Dense retrieval (F2-F6, F27): exact cosine top-k, files of chunks, embedding of texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.shipping import ship


def normalized(v: Column | str) -> Column:
    """to length 1; a zero vector stays."""
    v = F.col(v) if isinstance(v, str) else v
    d = F.transform(v, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(d, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(d, lambda x: x / F.when(norm == 0, 1.0).otherwise(norm))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def topk(vectors: DataFrame, query: DataFrame, k: int = 10) -> DataFrame:
    """F2: of `vectors(id, embedding)` the `k` nearest to the one row of `query(embedding)`: `id, score, rank`.

    One query needs one pass: the score is a column, the top-k a bounded merge of the tasks' own.
    """
    q = F.broadcast(query.limit(1).select(normalized("embedding").alias("_q")))
    out = vectors.crossJoin(q).select("id", F.round(dot(normalized("embedding"), F.col("_q")), 6).alias("score"))
    best = out.orderBy(F.col("score").desc(), "id").limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.col("score").desc(), "id")))


def first_seen_files(ranked: DataFrame, file: str = "file") -> DataFrame:
    """the files of ranked chunks in the order of their first chunk."""
    w = Window.orderBy("first_rank", file)
    return ranked.groupBy(file).agg(F.min("rank").alias("first_rank")).withColumn("pos", F.row_number().over(w))


def best_per_file(ranked: DataFrame, file: str = "file") -> DataFrame:
    """each file's best chunk score."""
    return ranked.groupBy(file).agg(F.max("score").alias("score"))


def embed(rows: DataFrame, embedder: Callable[[list[str]], list[list[float]]], text: str = "text", batch: int = 100) -> DataFrame:
    """`rows` with an `embedding` of each text, `batch` texts a call and not more held; the embedder does its own retries."""
    from pyspark.sql import types as T

    ship(rows.sparkSession)
    schema = T.StructType([*rows.schema.fields, T.StructField("embedding", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator) -> Iterator:
        for pdf in batches:
            for i in range(0, len(pdf), batch):
                part = pdf.iloc[i : i + batch]
                yield part.assign(embedding=embedder(part[text].fillna("").tolist()))

    return rows.mapInPandas(run, schema)


def hash_embedder(dims: int = 64) -> Callable[[list[str]], list[list[float]]]:
    """A deterministic embedder that needs no network: signed counts of hashed tokens."""

    def run(texts: list[str]) -> list[list[float]]:
        import re
        import zlib

        out = []
        for t in texts:
            v = [0.0] * dims
            for w in re.findall("[a-z0-9]+", t.lower()):
                h = zlib.crc32(w.encode())
                v[h % dims] += 1.0 if h >> 31 else -1.0
            out.append(v)
        return out

    return run
