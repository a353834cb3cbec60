"""Lexical retrieval: BM25Plus, path search, listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.text import path_tokens, token_set, tokens
from graphloom.storage import written

K1, B, DELTA = 1.5, 0.75, 1.0
#: Terms of queries (rows of about 60 bytes) up to which they are broadcast to the postings; they are counted first.
BROADCAST_TERMS = 200_000
#: Sums of a query and a document (of about 100 bytes) that a task holds at most, where each query meets each of its documents.
TASK_SUMS = 2_000_000

#: Of the tokens `t` each distinct one and how often it is there: the ends of the runs of the sorted array.
COUNTED = """
transform(array(sort_array(t)), st -> transform(array(filter(sequence(0, size(st) - 1), i -> i = size(st) - 1 OR get(st, i) <> get(st, i + 1))),
  en -> transform(en, (e, k) -> named_struct('term', get(st, e), 'tf', e - coalesce(get(en, k - 1), -1))))[0])[0]
"""


def bm25plus(docs: DataFrame, queries: DataFrame, top_k: int = 10, tie: str = "doc_id") -> DataFrame:
    """Top `top_k` of `docs(doc_id, text)` for each of `queries(query_id, text)`: `query_id, doc_id, score, rank`.

    A document's score is the sum over the query's tokens, with repeats, of idf * (DELTA + tf part). As DELTA * idf goes
    to every document, a document without any of the tokens scores the query's base, which is above 0 as soon as one
    token is known: the top-k is then filled up with such documents in tie order.

    Texts are read and cut into tokens once; postings of the queries' tokens and a row of each document's length are
    written. Tokens are counted within their row. Postings are dealt by document, so that scores are summed where they lie and only each
    task's best travel, over as many tasks as documents and queries ask for, so that what a task holds does not grow with either.
    """
    wanted = queries.select("query_id", F.explode(tokens("text")).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
    wanted = written(wanted, "asked-terms")
    words = wanted.select("term").distinct().unionByName(queries.sparkSession.createDataFrame([("",)], "term string"))
    small = wanted.count() <= BROADCAST_TERMS
    near = F.broadcast if small else lambda df: df
    # no token is empty: that one stands for the document
    cut = docs.select(F.col(tie).alias("doc_id"), tokens("text").alias("t")).select("doc_id", F.size("t").alias("dl"), F.concat(F.array(F.lit("")), "t").alias("t"))
    cut = cut.select("doc_id", "dl", F.explode(F.expr(COUNTED)).alias("x")).select("doc_id", "dl", "x.*").join(near(words), "term", "left_semi")
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-docs.count() * max(1, queries.count()) // TASK_SUMS))
    every = written(cut.repartition(tasks, "doc_id").groupBy("doc_id", "term").agg(F.sum("tf").alias("tf"), F.first("dl").alias("dl")), "postings")
    sizes, postings = every.where("term = ''"), every.where("term <> ''")
    stats = sizes.agg(F.count("*").alias("n"), F.avg(F.col("dl").cast("double")).alias("avgdl"))
    df = postings.groupBy("term").agg(F.count("*").alias("df"))
    idf = df.crossJoin(F.broadcast(stats)).select("term", F.log((F.col("n") + 1) / F.col("df")).alias("idf"), "avgdl")
    known = written(wanted.join(idf, "term"), "query-terms")
    norm = F.col("tf") * (K1 + 1) / (K1 * (1 - B + B * F.col("dl") / F.col("avgdl")) + F.col("tf"))
    base = known.groupBy("query_id").agg(F.sum(F.col("qtf") * F.col("idf") * DELTA).alias("base"))
    matched = (
        postings.repartition(tasks, "doc_id").join(near(known), "term").groupBy("query_id", "doc_id")
        .agg(F.sum(F.col("qtf") * F.col("idf") * norm).alias("part"))
    )
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "doc_id")
    best = (
        matched.join(near(base), "query_id").select("query_id", "doc_id", F.round(F.col("base") + F.col("part"), 6).alias("score"))
        .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k)
    )
    best = written(best.select("query_id", "doc_id", "score"), "best")
    # Queries with fewer: all that match are among the best, so the first others in tie order are among the first 2k documents.
    count = best.groupBy("query_id").agg(F.count("*").alias("m"))
    short = base.join(count, "query_id", "left").where(F.coalesce("m", F.lit(0)) < top_k).select("query_id", "base")
    first = sizes.select("doc_id").orderBy("doc_id").limit(2 * top_k)
    extra = (
        short.crossJoin(F.broadcast(first)).join(best.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti")
        .select("query_id", "doc_id", F.round("base", 6).alias("score"))
    )
    every = best.unionByName(extra)
    return every.withColumn("rank", F.row_number().over(order)).where((F.col("rank") <= top_k) & (F.col("score") > 0))


def path_search(paths: DataFrame, query: str, top_k: int = 20) -> DataFrame:
    """F7 over `paths(path)`: shared tokens, plus 1 if the path holds the query; `path, score, rank`."""
    q = query.strip().lower()
    overlap = F.size(F.array_intersect(path_tokens("path"), token_set(F.lit(q)))).cast("double")
    hit = F.when(F.lower("path").contains(q) & F.lit(q != ""), 1.0).otherwise(0.0)
    out = paths.select("path", (overlap + hit).alias("score")).where("score > 0").orderBy(F.col("score").desc(), "path").limit(top_k)
    return out.withColumn("rank", F.row_number().over(Window.orderBy(F.col("score").desc(), "path")))


def list_files(paths: DataFrame, prefix: str = "", limit: int = 200) -> DataFrame:
    """F8: the first paths under a prefix, of which leading dots and slashes are dropped."""
    return paths.select("path").where(F.col("path").startswith(prefix.lstrip("./"))).orderBy("path").limit(limit)


def under_prefixes(paths: DataFrame, prefixes: list[str], path: str = "path") -> DataFrame:
    """A2: paths that are one of the prefixes or below it; all if there is none."""
    keep = F.lit(not prefixes)
    for p in (p.rstrip("/") for p in prefixes):
        keep = keep | (F.col(path) == p) | F.col(path).startswith(p + "/")
    return paths.where(keep)


def under_prefix_of(paths: DataFrame, prefix: str, path: str = "path") -> DataFrame:
    """A2 with a prefix in a column: no prefix lets every path pass."""
    p = F.regexp_replace(F.coalesce(F.col(prefix), F.lit("")), "/+$", "")
    return paths.where((p == "") | (F.col(path) == p) | F.col(path).startswith(F.concat(p, F.lit("/"))))


def with_raw_prefixes(paths: DataFrame, prefixes: list[str], path: str = "path") -> DataFrame:
    """Paths that start with one of the prefixes, as strings."""
    keep = F.lit(not prefixes)
    for p in prefixes:
        keep = keep | F.col(path).startswith(p)
    return paths.where(keep)
