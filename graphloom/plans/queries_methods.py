"""Retrieval methods end to end: documents are files, benchmark items are issues, the order tables are the code graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import query
from .methods import Corpus, registry
from .queries_graph import EDGES, NODES, SCORED
from .queries_sources import cosine_sql, letters, letters_sql
from .queries_text import BM25

FILES = "SELECT concat('d/', doc_id, '.py') AS path, text AS content FROM {documents}"
ISSUES = "SELECT CAST(item_id AS STRING) AS instance_id, text AS problem_statement FROM {benchmark}"
BOTH = {"files": FILES, "issues": ISSUES}
GRAPH = {"nodes": f"SELECT n.*, CAST(length(name) AS INT) AS start_line, CAST(length(name) + 9 AS INT) AS end_line FROM ({NODES}) n", "edges": EDGES, **BOTH}
#: What is asked: the items' texts are short and hold neither headings nor paths.
ASKED = r"asked AS (SELECT instance_id AS query_id, regexp_replace(problem_statement, '^\s+|\s+$', '', 'g') AS text FROM issues)"
LISTED = "SELECT instance_id, coalesce(string_agg(file, ',' ORDER BY rank, file), '') AS files FROM issues LEFT JOIN found ON query_id = instance_id GROUP BY instance_id"


def nearest_sql(chunks: str, k: int) -> str:
    """`closest(query_id, id, file, score, rank)` of `chunks`, a query for id, file, t."""
    return f"""{ASKED}, v AS (SELECT id, file, {letters_sql('t')} AS e FROM ({chunks})), q AS (SELECT query_id, {letters_sql('text')} AS e FROM asked),
    sims AS (SELECT query_id, id, file, {cosine_sql('v.e', 'q.e')} AS score FROM v, q), byscore AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM sims), closest AS (SELECT * FROM byscore WHERE rank <= {k})"""


FIRST = ", found AS (SELECT query_id, file, min(rank) AS rank FROM closest GROUP BY ALL) " + LISTED
WINDOWS = r"""SELECT path || '#' || lpad(s::VARCHAR, 10, '0') AS id, path AS file, substr(substr(content, s::INT + 1, 2048), 1, 500) AS t
FROM (SELECT path, content, unnest(generate_series(0, (greatest(ceil((length(content) - 2048) / 1792.0), 0) * 1792)::BIGINT, 1792)) AS s FROM files) WHERE regexp_replace(substr(content, s::INT + 1, 2048), '\s', '', 'g') <> ''"""
WHOLE = r"SELECT path AS id, path AS file, substr(content, 1, 500) AS t FROM files WHERE regexp_replace(substr(content, 1, 2000), '\s', '', 'g') <> ''"
DESCRIBED = "SELECT id, file, name || CASE WHEN coalesce(docstring, '') <> '' THEN ': ' || substr(docstring, 1, 200) ELSE '' END AS t FROM nodes WHERE type IN ('function', 'class')"


def _run(name: str, issues: DataFrame, files: DataFrame, **graph: DataFrame) -> DataFrame:
    found = registry(Corpus(files, embedder=letters, **graph)).run(name, issues)
    return found.select("instance_id", F.array_join("files", ",").alias("files"))


@query(
    "method_bm25",
    BM25.replace("\nWITH t AS", f"\nWITH {ASKED}, docs AS (SELECT path AS doc_id, content AS text FROM files), items AS (FROM asked), t AS").replace("SELECT query_id, doc_id, score, rank::INT AS rank FROM r WHERE rank <= 10", ", found AS (SELECT query_id, doc_id AS file, rank FROM r WHERE rank <= 10) " + LISTED),
    **BOTH,
)
def method_bm25(files: DataFrame, issues: DataFrame) -> DataFrame:
    return _run("bm25", issues, files)


@query("method_raw_rag_fixed", "WITH " + nearest_sql(WINDOWS, 20) + FIRST, **BOTH)
def method_raw_rag_fixed(files: DataFrame, issues: DataFrame) -> DataFrame:
    return _run("raw_rag_fixed", issues, files)


@query("method_raw_rag_function", "WITH " + nearest_sql(WHOLE, 20) + FIRST, **BOTH)
def method_raw_rag_function(files: DataFrame, issues: DataFrame) -> DataFrame:
    """No document defines anything in Python, so each is one chunk."""
    return _run("raw_rag_function", issues, files)


@query("method_rag_metadata", "WITH " + nearest_sql(DESCRIBED + " AND file IS NOT NULL", 20) + FIRST, **GRAPH)
def method_rag_metadata(files: DataFrame, issues: DataFrame, **graph: DataFrame) -> DataFrame:
    return _run("rag_metadata", issues, files, **graph)


SEEDED = """, top AS (SELECT query_id, id AS node_id, score AS raw FROM closest),
seeds AS (SELECT query_id, node_id, CASE WHEN max(raw) OVER w - min(raw) OVER w <= 1e-12 THEN 1.0 ELSE (raw - min(raw) OVER w) / (max(raw) OVER w - min(raw) OVER w) END AS score FROM top WINDOW w AS (PARTITION BY query_id)), """


@query(
    "method_gm_deterministic",
    "WITH " + nearest_sql(DESCRIBED, 8) + SEEDED + SCORED.replace("files", "node_files").replace("pos <= 6", "pos <= 12").replace("LEFT JOIN issues i USING (query_id)", "LEFT JOIN asked i USING (query_id)").replace("ranked AS (SELECT *,", "ranks AS (SELECT *,")
    + ", found AS (SELECT query_id, file, rank FROM ranks WHERE rank <= 6 AND (rank <= 1 OR score >= greatest(0.0, top * 0.70))) " + LISTED,
    **GRAPH,
)
def method_gm_deterministic(files: DataFrame, issues: DataFrame, **graph: DataFrame) -> DataFrame:
    return _run("gm_deterministic", issues, files, **graph)


@query("method_repomap_like", **GRAPH)
def method_repomap_like(files: DataFrame, issues: DataFrame, **graph: DataFrame) -> DataFrame:
    return _run("repomap_like", issues, files, **graph)


@query("method_agentless_like", **GRAPH)
def method_agentless_like(files: DataFrame, issues: DataFrame, **graph: DataFrame) -> DataFrame:
    return _run("agentless_like", issues, files, **graph)
