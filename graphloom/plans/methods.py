"""Retrieval methods from issues to files (F37), each one plan over all issues; those that need a model are registered by the caller.

`issues(instance_id, problem_statement, ...)` give `instance_id, files`, best file first.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import compact_issue, embedding_text
from graphloom.operators import chunk, dense, extract, fusion, graph, lexical, push, vectors
from graphloom.storage import written

from .registry import Registry

BM25_FILES, CHUNKS, SEEDS, MAP_FILES, MERGED = 10, 20, 8, 10, 12


@dataclass
class Corpus:
    """What a repository's methods search: `files(path, content)`, and a code graph where a method needs one."""

    files: DataFrame
    nodes: DataFrame | None = None
    edges: DataFrame | None = None
    embedder: Callable[[list[str]], list[list[float]]] = dense.hash_embedder()

    def graph(self) -> tuple[DataFrame, DataFrame]:
        if self.nodes is None or self.edges is None:
            raise ValueError("this method needs a code graph")
        return self.nodes, self.edges


def asked(issues: DataFrame) -> DataFrame:
    return issues.select(F.col("instance_id").alias("query_id"), compact_issue("problem_statement").alias("text"))


def listed(ranked: DataFrame, issues: DataFrame, order: str = "rank") -> DataFrame:
    """`ranked(query_id, file, order)` as a list for every issue, empty where nothing was found."""
    got = ranked.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(order, "file"))), lambda x: x["file"]).alias("files"))
    rows = issues.select("instance_id").join(got.withColumnRenamed("query_id", "instance_id"), "instance_id", "left")
    return rows.withColumn("files", F.coalesce("files", F.array().cast("array<string>")))


def nearest(chunks: DataFrame, issues: DataFrame, embedder: Callable, k: int) -> DataFrame:
    """The `k` nearest of `chunks(id, file, embed_text)` for each issue: `query_id, file, id, score, rank`."""
    rows = written(dense.embed(chunks.select("id", "file", "embed_text"), embedder, "embed_text").select("id", "file", "embedding"), "vectors")
    queries = dense.embed(asked(issues), embedder).select("query_id", "embedding")
    return vectors.topk(rows, queries, k).join(rows.select("id", "file"), "id")


def _first_files(found: DataFrame, issues: DataFrame) -> DataFrame:
    return listed(found.groupBy("query_id", "file").agg(F.min("rank").alias("rank")), issues)


def _place(file: str, line: str) -> Column:
    return F.concat(F.col(file), F.lit("#"), F.lpad(F.col(line).cast("string"), 10, "0"))


def bm25(issues: DataFrame, corpus: Corpus) -> DataFrame:
    found = lexical.bm25plus(corpus.files.select("path", F.col("content").alias("text")), asked(issues), BM25_FILES, "path")
    return listed(found.withColumnRenamed("doc_id", "file"), issues)


def fixed_chunks(corpus: Corpus) -> DataFrame:
    rows = chunk.embeddable(chunk.fixed_windows(corpus.files.select(F.col("path").alias("file"), F.col("content").alias("text"))))
    return rows.withColumn("id", _place("file", "start"))


def definition_chunks(corpus: Corpus) -> DataFrame:
    rows = chunk.embeddable(extract.chunks(corpus.files), "text")
    return rows.withColumn("id", F.concat(_place("file", "start_line"), F.lit("#"), "name"))


def described_nodes(nodes: DataFrame) -> DataFrame:
    """functions and classes with what is embedded of them."""
    blank = {c: F.lit(None).cast("string") for c in ("signature", "docstring") if c not in nodes.columns}
    rows = nodes.where("type IN ('function', 'class')").withColumns(blank)
    return rows.select("id", "file", embedding_text("name", "type", "signature", "docstring").alias("embed_text"))


def raw_rag_fixed(issues: DataFrame, corpus: Corpus) -> DataFrame:
    return _first_files(nearest(fixed_chunks(corpus), issues, corpus.embedder, CHUNKS), issues)


def raw_rag_function(issues: DataFrame, corpus: Corpus) -> DataFrame:
    return _first_files(nearest(definition_chunks(corpus), issues, corpus.embedder, CHUNKS), issues)


def rag_metadata(issues: DataFrame, corpus: Corpus) -> DataFrame:
    nodes = described_nodes(corpus.graph()[0]).where("file IS NOT NULL AND file <> ''")
    return _first_files(nearest(nodes, issues, corpus.embedder, CHUNKS), issues)


def gm_deterministic(issues: DataFrame, corpus: Corpus, depth: int = 2, cap: int = 12, how: graph.Scoring | None = None) -> DataFrame:
    nodes, edges = corpus.graph()
    found = nearest(described_nodes(nodes), issues, corpus.embedder, SEEDS)
    seeds = written(graph.seeds_of(found.select("query_id", F.col("id").alias("node_id"), "score"), SEEDS), "seeds")
    return listed(graph.retrieve(nodes, edges, seeds, asked(issues), depth, cap, how), issues)


def repomap_like(issues: DataFrame, corpus: Corpus, k: int = MAP_FILES, same_module: bool = False) -> DataFrame:
    nodes, edges = corpus.graph()
    files = graph.file_of_nodes(nodes).select("file").distinct()
    # ranks that differ by rounding only are equal
    best = push.best_files(graph.weighted_file_graph(nodes, edges, same_module), files, asked(issues), 3 * k)
    best = fusion.candidate_cut(best.drop("rank"), k, ["query_id"])
    return listed(best.where("chosen"), issues)


def agentless_like(issues: DataFrame, corpus: Corpus, k: int = MERGED, samples: int = 4) -> DataFrame:
    """Without a model: lexical and dense candidates, the first symbol of each merged file, and sampled spans of those."""
    nodes, _ = corpus.graph()
    queries = asked(issues)
    chunks = definition_chunks(corpus)
    known = graph.file_of_nodes(nodes).select("file").union(corpus.files.where("path LIKE '%.py'").select("path")).distinct()
    found = nearest(chunks, issues, corpus.embedder, CHUNKS).groupBy("query_id", "file").agg(F.max("score").alias("score"))
    pool = fusion.candidate_pools(known, queries).select("query_id", "file", "rank")
    merged = written(fusion.fused(found, pool, pool.limit(0), ["query_id"], k), "merged")
    symbols = nodes.where("type IN ('function', 'class') AND file IS NOT NULL").select("file", "name", "start_line", "end_line")
    first = symbols.groupBy("file").agg(F.min_by(F.struct("name", "start_line", "end_line"), F.struct("start_line", "name")).alias("s")).select("file", "s.*")
    chosen = merged.join(first, "file").select(F.col("query_id").alias("issue_id"), "file", "name", "start_line", "end_line", "rank")
    spans = fusion.sampled_spans(chosen, samples)
    of = lambda df, key, order, name: df.groupBy(F.col(key).alias("instance_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, "file"))), lambda x: x["file"]).alias(name))
    rows = issues.select("instance_id").join(of(spans, "issue_id", "pos", "a"), "instance_id", "left").join(of(chosen, "issue_id", "rank", "b"), "instance_id", "left")
    rows = rows.join(of(merged, "query_id", "rank", "c"), "instance_id", "left")
    return rows.select("instance_id", fusion.final_files(F.col("a"), F.col("b"), F.col("c"), k).alias("files"))


def registry(corpus: Corpus) -> Registry:
    """All methods that run without a model, over one corpus."""
    out = Registry()
    for method in (bm25, raw_rag_fixed, raw_rag_function, rag_metadata, gm_deterministic, repomap_like, agentless_like):
        out.register(method.__name__, lambda issues, _f=method, **more: _f(issues, corpus, **more))
    return out
