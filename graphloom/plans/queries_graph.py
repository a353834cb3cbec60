"""Graph, fusion and agent queries over a graph that the order tables make: suppliers are files, parts are functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators import agent, fusion, graph, push

from graphloom.storage import written

from .base import query

FILE = "concat('src/n', s_nationkey, CASE WHEN s_suppkey % 9 = 0 THEN '/tests' ELSE '' END, '/s', s_suppkey, '.py')"
EDGES = f"""SELECT DISTINCT f AS src, concat('p', l_partkey) AS dst, CASE l_partkey % 3 WHEN 0 THEN 'CALLS' WHEN 1 THEN 'IMPORTS' ELSE 'INHERITS' END AS type,
CASE (l_partkey + l_suppkey) % 4 WHEN 0 THEN 'High' WHEN 1 THEN 'medium' WHEN 2 THEN 'low' END AS confidence
FROM {{lineitem}} JOIN (SELECT s_suppkey, {FILE} AS f FROM {{supplier}}) s ON l_suppkey = s_suppkey"""
NODES = f"""SELECT {FILE} AS id, 'file' AS type, s_name AS name, {FILE} AS file, CAST(NULL AS STRING) AS docstring FROM {{supplier}}
UNION ALL SELECT concat('p', p_partkey), 'function', p_name, f, concat(p_brand, ' ', p_type) FROM {{part}} LEFT JOIN
(SELECT l_partkey, min(f) AS f FROM {{lineitem}} JOIN (SELECT s_suppkey, {FILE} AS f FROM {{supplier}}) s ON l_suppkey = s_suppkey GROUP BY l_partkey) x ON p_partkey = l_partkey"""
# Every supplier is a seed, of the benchmark items in turn.
SEEDS = f"SELECT concat('q', s_suppkey % (SELECT count(*) FROM {{benchmark}})) AS query_id, {FILE} AS node_id, CAST(1.0 - (s_suppkey % 10) * 0.07 AS DOUBLE) AS score FROM {{supplier}}"

NEAR = """
two AS (SELECT src AS id, dst AS other, type, lower(coalesce(confidence, 'medium')) AS confidence FROM edges UNION ALL SELECT dst, src, type, lower(coalesce(confidence, 'medium')) FROM edges),
near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY other, type, CASE confidence WHEN 'high' THEN 1.0 WHEN 'low' THEN 0.2 ELSE 0.6 END, confidence) AS pos FROM two) WHERE pos <= 6)
"""
BFS = NEAR + """,
s0 AS (SELECT DISTINCT query_id, node_id AS seed, node_id AS node FROM seeds),
l1 AS (SELECT query_id, seed, other AS node, min(pos) AS p1, arg_min(type, pos) AS t1, arg_min(confidence, pos) AS c1 FROM s0 JOIN near ON node = id GROUP BY ALL),
v1 AS (SELECT * FROM l1 WHERE node <> seed),
l2 AS (SELECT query_id, seed, other AS node, arg_min(t1, (p1, pos)) AS t1, arg_min(c1, (p1, pos)) AS c1, arg_min(type, (p1, pos)) AS t2, arg_min(confidence, (p1, pos)) AS c2 FROM v1 JOIN near ON node = id GROUP BY ALL),
v2 AS (SELECT l2.* FROM l2 ANTI JOIN v1 USING (query_id, seed, node) WHERE node <> seed),
paths AS (SELECT query_id, seed, node, 0 AS depth, []::VARCHAR[] AS edge_types, []::VARCHAR[] AS confidences FROM s0
UNION ALL SELECT query_id, seed, node, 1, [t1], [c1] FROM v1 UNION ALL SELECT query_id, seed, node, 2, [t1, t2], [c1, c2] FROM v2)
"""
SCORED = BFS + r""",
files AS (SELECT id AS node, CASE WHEN type = 'file' THEN id ELSE file END AS file FROM nodes WHERE CASE WHEN type = 'file' THEN id ELSE file END IN (SELECT id FROM nodes WHERE type = 'file')),
r AS (SELECT p.query_id, f.file, p.depth, edge_types, confidences, s.score AS seed_score,
 list_filter(list_transform(list_zip(edge_types, confidences), lambda z: CASE WHEN z[1] = 'CALLS' THEN z[2] END), lambda x: x IS NOT NULL) AS calls FROM paths p JOIN seeds s ON s.query_id = p.query_id AND s.node_id = p.seed JOIN files f USING (node)),
r2 AS (SELECT *, CASE WHEN len(calls) > 0 THEN list_avg(list_transform(calls, lambda x: (CASE x WHEN 'high' THEN 1.0 WHEN 'low' THEN 0.2 ELSE 0.6 END)::DOUBLE))
 WHEN len(confidences) > 0 THEN list_avg(list_transform(confidences, lambda x: (CASE x WHEN 'high' THEN 1.0 WHEN 'low' THEN 0.2 ELSE 0.6 END)::DOUBLE)) ELSE 1.0 END AS conf
 FROM r),
g AS (SELECT query_id, file, count(*) AS n_paths, len(list_distinct(flatten(list(edge_types)))) AS n_types, max(seed_score / (depth + 1)) AS s_sem, avg(conf) AS s_conf, avg(depth::DOUBLE) AS avg_depth,
 count(*) FILTER (conf < 0.4) AS n_low, count(*) FILTER (conf >= 0.8) AS n_high FROM r2 GROUP BY ALL),
deg AS (SELECT file, count(*) AS degree FROM (SELECT src AS node FROM edges UNION ALL SELECT dst FROM edges) JOIN files USING (node) GROUP BY file),
e AS (SELECT g.*, ln(1 + n_paths) + 0.25 * least(n_types, 3) / 3 AS gg, coalesce(degree, 0) AS d,
 list_distinct(flatten(list_transform(string_split(g.file, '/'), lambda p: regexp_extract_all(lower(regexp_replace(p, '\.[^.]*$', '')), '[a-z0-9]+')))) AS words,
 list_distinct(regexp_extract_all(lower(i.text), '[a-z0-9]+')) AS hint FROM g LEFT JOIN deg USING (file) LEFT JOIN issues i USING (query_id)),
f AS (SELECT *, gg / max(gg) OVER (PARTITION BY query_id) AS s_graph, len(list_intersect(words, hint)) / len(words) AS s_hint,
 least(1.0, CASE WHEN n_low = n_paths THEN 1.0 ELSE greatest(0.0, n_low / n_paths - 0.7) END + 0.35 * CASE WHEN d > 20 THEN least((d - 20) / 20.0, 1.0) ELSE 0.0 END) AS s_pen FROM e),
scored AS (SELECT *, round(0.35 * s_sem + 0.30 * s_graph + 0.20 * s_conf + 0.10 * s_hint - 0.05 * s_pen, 6) AS score FROM f),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, n_high DESC, avg_depth, file) AS rank, max(score) OVER (PARTITION BY query_id) AS top FROM scored)
"""
ISSUES = "SELECT concat('q', item_id) AS query_id, concat('src n', item_id, ' s', item_id, ' breaks') AS text FROM {benchmark}"
GRAPH = {"edges": EDGES, "nodes": NODES}


def _paths(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    return graph.bounded_paths(edges, seeds, depth=2, cap=6)


@query("capped_neighbors", "WITH " + NEAR + "SELECT id, other, type, confidence, pos::INT AS pos FROM near", edges=EDGES)
def capped_neighbors(edges: DataFrame) -> DataFrame:
    return graph.capped_neighbors(edges, 6)


@query(
    "bfs_depth2", "WITH " + BFS + "SELECT query_id, seed, node, depth::INT AS depth, array_to_string(edge_types, '>') AS edge_types, array_to_string(confidences, '>') AS confidences FROM paths",
    edges=EDGES, seeds=SEEDS,
)
def bfs_depth2(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    p = _paths(edges, seeds)
    return p.select("query_id", "seed", "node", "depth", F.array_join("edge_types", ">").alias("edge_types"), F.array_join("confidences", ">").alias("confidences"))


def _scored(edges: DataFrame, nodes: DataFrame, seeds: DataFrame, issues: DataFrame) -> DataFrame:
    edges, nodes = written(edges, "edges"), written(nodes.select("id", "type", "file"), "nodes")  # much to make, and read more than once
    found = graph.evidence(_paths(edges, seeds), seeds, graph.file_of_nodes(nodes))
    hints = issues.select("query_id", graph.token_set("text").alias("tokens"))
    return graph.evidence_score(found, hints, graph.hub_degree(nodes, edges))


@query("evidence_score", "WITH " + SCORED + "SELECT query_id, file, n_paths, n_low, n_high, round(s_pen, 6)::DOUBLE AS s_pen, score::DOUBLE AS score FROM scored", seeds=SEEDS, issues=ISSUES, **GRAPH)
def evidence_score(edges: DataFrame, nodes: DataFrame, seeds: DataFrame, issues: DataFrame) -> DataFrame:
    return _scored(edges, nodes, seeds, issues).select("query_id", "file", "n_paths", "n_low", "n_high", F.round("s_pen", 6).alias("s_pen"), "score")


@query("adaptive_cut", "WITH " + SCORED + "SELECT query_id, file, score::DOUBLE AS score, rank::INT AS rank FROM ranked WHERE rank <= 6 AND (rank <= 1 OR score >= greatest(0.0, top * 0.70))", seeds=SEEDS, issues=ISSUES, **GRAPH)
def adaptive_cut(edges: DataFrame, nodes: DataFrame, seeds: DataFrame, issues: DataFrame) -> DataFrame:
    return graph.adaptive_cut(_scored(edges, nodes, seeds, issues)).select("query_id", "file", "score", "rank")


@query(
    "hub_degree",
    "WITH files AS (SELECT id AS node, CASE WHEN type = 'file' THEN id ELSE file END AS file FROM nodes) SELECT file, count(*) AS degree FROM (SELECT src AS node FROM edges UNION ALL SELECT dst FROM edges) JOIN files USING (node) WHERE file IS NOT NULL GROUP BY file",
    **GRAPH,
)
def hub_degree(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return graph.hub_degree(nodes, edges)


FILE_GRAPH = r"""
files AS (SELECT id AS node, CASE WHEN type = 'file' THEN id ELSE file END AS file FROM nodes WHERE type = 'file' OR file IS NOT NULL),
fe AS (SELECT a.file AS src, b.file AS dst, CASE WHEN type = 'IMPORTS' THEN 'import' WHEN regexp_matches(a.file, '/tests/') AND NOT regexp_matches(b.file, '/tests/') THEN 'test' ELSE 'symbol' END AS kind
 FROM edges JOIN files a ON a.node = edges.src JOIN files b ON b.node = edges.dst WHERE a.file <> b.file),
fg AS (SELECT src, dst, sum(CASE kind WHEN 'test' THEN 0.5 ELSE 1.0 END)::DOUBLE AS weight, count(*) FILTER (kind = 'import') AS n_import, count(*) FILTER (kind = 'symbol') AS n_symbol, count(*) FILTER (kind = 'test') AS n_test FROM fe GROUP BY ALL),
norm AS (SELECT src, dst, weight / sum(weight) OVER (PARTITION BY src) AS p FROM fg),
words AS (SELECT file, list_distinct(regexp_extract_all(lower(file), '[a-z0-9]+')) AS w FROM (SELECT DISTINCT file FROM files)),
raw AS (SELECT file, len(list_intersect(w, ['tests', 'n3', 's9', 'n5', 'in', 'src', 'n1', 's1', 'py'])) + CASE WHEN contains('tests n3 s9 n5 in src/n1/s1.py', file) THEN 3 ELSE 0 END AS raw FROM words),
pers AS (SELECT file, CASE WHEN sum(raw) OVER () > 0 THEN raw / sum(raw) OVER () ELSE 1.0 / count(*) OVER () END AS p FROM raw)
"""
TEXT = "tests n3 s9 n5 in src/n1/s1.py"


def _files(nodes: DataFrame) -> DataFrame:
    return graph.file_of_nodes(nodes).select("file").distinct()


@query("weighted_file_graph", "WITH " + FILE_GRAPH + "SELECT * FROM fg", **GRAPH)
def weighted_file_graph(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return graph.weighted_file_graph(nodes, edges)


@query(
    "same_module_graph",
    "WITH " + FILE_GRAPH.split("norm AS")[0] + """dirs AS (SELECT DISTINCT file, regexp_replace(file, '[^/]*$', '') AS dir FROM files),
    m AS (SELECT a.file AS src, b.file AS dst FROM dirs a JOIN dirs b USING (dir) WHERE a.file <> b.file)
    SELECT src, dst, round(coalesce(weight, 0) + CASE WHEN m.src IS NULL THEN 0 ELSE 0.2 END, 6)::DOUBLE AS weight, coalesce(n_import, 0) AS n_import, coalesce(n_symbol, 0) AS n_symbol, coalesce(n_test, 0) AS n_test FROM fg FULL JOIN m USING (src, dst)""",
    **GRAPH,
)
def same_module_graph(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """files of one folder are linked both ways, which is all pairs of a folder: here a nation's suppliers."""
    return graph.weighted_file_graph(nodes, edges, same_module=True).withColumn("weight", F.round("weight", 6))


@query("row_normalize", "WITH " + FILE_GRAPH + "SELECT src, dst, round(p, 6) AS p FROM norm", **GRAPH)
def row_normalize(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return graph.row_normalized(graph.weighted_file_graph(nodes, edges)).select("src", "dst", F.round("p", 6).alias("p"))


@query("personalization", "WITH " + FILE_GRAPH + "SELECT file, round(p, 6) AS p FROM pers", **GRAPH)
def personalization(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return graph.personalization(_files(nodes), TEXT).select("file", F.round("p", 6).alias("p"))


def _step(k: int) -> str:
    return f"""g{k} AS (SELECT n.dst AS file, sum(r.r * n.p) AS x FROM r{k - 1} r JOIN norm n ON r.file = n.src GROUP BY n.dst),
    d{k} AS (SELECT coalesce(sum(r), 0) AS d FROM r{k - 1} WHERE file NOT IN (SELECT src FROM norm)),
    r{k} AS (SELECT p.file, 0.15 * p.p + 0.85 * (coalesce(x, 0) + d * p.p) AS r FROM pers p LEFT JOIN g{k} USING (file), d{k})"""


@query(
    "pagerank_k_iters", "WITH " + FILE_GRAPH + ", r0 AS (SELECT file, 1.0::DOUBLE / count(*) OVER () AS r FROM pers), " + ", ".join(_step(k) for k in (1, 2, 3)) + " SELECT file, round(r, 9) AS rank FROM r3", **GRAPH
)
def pagerank_k_iters(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    # Written once: every step reads them.
    links = written(graph.packed_links(graph.weighted_file_graph(nodes, edges)), "links")
    person = written(graph.personalization(_files(nodes), TEXT), "person")
    return graph.pagerank_fixed(links, person, 3).select("file", F.round("rank", 9).alias("rank"))


@query("pagerank", **GRAPH)
def pagerank(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return graph.pagerank(graph.weighted_file_graph(nodes, edges), graph.personalization(_files(nodes), TEXT)).select("file", F.round("rank", 6).alias("rank"))


#: One ranking for each item: some texts name a file, some share no word with any.
TEXTS = "SELECT concat('q', item_id) AS query_id, concat('n', item_id % 7, ' s', item_id, CASE WHEN item_id % 5 = 0 THEN ' in (SRC/n1/s1.py)' ELSE '' END) AS text FROM {benchmark}"
PUSHED = FILE_GRAPH.split("words AS")[0] + r"""
all_files AS (SELECT DISTINCT file FROM files),
starts AS (SELECT query_id, file, len(list_intersect(list_distinct(regexp_extract_all(lower(file), '[a-z0-9]+')), list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')))) + CASE WHEN contains(lower(text), lower(file)) THEN 3 ELSE 0 END AS raw FROM all_files, texts),
p AS (SELECT query_id, file, raw / sum(raw) OVER (PARTITION BY query_id) AS p FROM starts QUALIFY sum(raw) OVER (PARTITION BY query_id) > 0),
push AS (SELECT 0 AS k, query_id, file, p::DOUBLE AS r FROM p WHERE p > 0 UNION ALL SELECT k + 1, query_id, n.dst, sum(0.85 * r * n.p) FROM push JOIN norm n ON push.file = n.src WHERE k < 150 GROUP BY k, query_id, n.dst),
mass AS (SELECT query_id, file, sum(r) AS m FROM push GROUP BY ALL)
"""


@query("pagerank_push", "WITH RECURSIVE " + PUSHED + "SELECT * FROM (SELECT query_id, file, round(m / sum(m) OVER (PARTITION BY query_id), 5) AS rank FROM mass) WHERE rank > 0", texts=TEXTS, **GRAPH)
def pagerank_push(edges: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """F22 for all items at once; ranks are told from 0.00001 on, as what is under the tolerance need not reach a file."""
    # Written once: to tell a part's file takes all of lineitem.
    links, names = graph.numbered_file_graph(written(nodes.select("id", "type", "file"), "nodes"), edges)
    got = push.rankings(links, names.select("file"), texts, tolerance=1e-10, names=names)[0]
    return got.select("query_id", "file", F.round("rank", 5).alias("rank")).where("rank > 0")


@query("top_symbols", "SELECT file, array_to_string(list_sort(list_distinct(list(name)))[1:6], ',') AS symbols FROM nodes WHERE type <> 'file' GROUP BY file", nodes=NODES)
def top_symbols(nodes: DataFrame) -> DataFrame:
    return graph.top_symbols(nodes).select("file", F.array_join("symbols", ",").alias("symbols"))


SYMBOLS = "SELECT concat('d/f', p_size, '.py') AS file, p_name AS name, CAST(p_partkey % 50 AS INT) AS start_line FROM {part}"


@query("first_symbol", "SELECT file, arg_min(name, (start_line, name)) AS symbol, min(start_line) AS start_line FROM symbols GROUP BY file", symbols=SYMBOLS)
def first_symbol(symbols: DataFrame) -> DataFrame:
    return fusion.first_symbol(symbols)


@query("symbol_pool", "SELECT file, name, start_line, pos::INT AS pos FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY start_line, name) AS pos FROM symbols) WHERE pos <= 6", symbols=SYMBOLS)
def symbol_pool(symbols: DataFrame) -> DataFrame:
    return fusion.symbol_pool(symbols)


SIGNALS = {
    "dense_": "SELECT label AS q, concat('f', vec_id % 40) AS file, max(CAST(vec_id * 7919 % 1000 AS DOUBLE)) AS score FROM {embeddings} WHERE vec_id % 3 <> 0 GROUP BY label, vec_id % 40",
    "lex": "SELECT q, file, row_number() OVER (PARTITION BY q ORDER BY v DESC, file) AS rank FROM (SELECT label AS q, concat('f', vec_id % 40) AS file, max(vec_id % 97) AS v FROM {embeddings} WHERE vec_id % 2 = 0 GROUP BY label, vec_id % 40)",
    "llm": "SELECT q, file, row_number() OVER (PARTITION BY q ORDER BY v DESC, file) AS rank FROM (SELECT label AS q, concat('f', vec_id % 40) AS file, max(vec_id % 89) AS v FROM {embeddings} WHERE vec_id % 7 = 0 GROUP BY label, vec_id % 40)",
}


@query(
    "rank_fusion",
    """WITH d AS (SELECT q, file, CASE WHEN max(score) OVER w - min(score) OVER w <= 1e-12 THEN 1 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS d FROM dense_ WINDOW w AS (PARTITION BY q)),
    l AS (SELECT q, file, 1 - (rank - 1) / count(*) OVER (PARTITION BY q) AS l FROM lex), m AS (SELECT q, file, 1 - (rank - 1) / count(*) OVER (PARTITION BY q) AS m FROM llm),
    s AS (SELECT q, file, round(0.55 * coalesce(d, 0) + 0.30 * coalesce(l, 0) + 0.15 * coalesce(m, 0), 6) AS score FROM d FULL JOIN l USING (q, file) FULL JOIN m USING (q, file))
    SELECT q, file, score::DOUBLE AS score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, file) AS rank FROM s) WHERE rank <= 12""",
    **SIGNALS,
)
def rank_fusion(dense_: DataFrame, lex: DataFrame, llm: DataFrame) -> DataFrame:
    return fusion.fused(dense_, lex, llm, ["q"])


POOL = "SELECT concat('f', doc_id % 30, '/m', doc_id, '.py') AS file FROM {documents}"


@query(
    "candidate_pool",
    r"""WITH s AS (SELECT file, (len(list_intersect(list_distinct(regexp_extract_all(lower(file), '[a-z0-9]+')), ['f3', 'm4', 'f7', 'm7', 'py'])) + CASE WHEN contains('f3 m4 f7/m7.py', file) THEN 2 ELSE 0 END)::DOUBLE AS score FROM files)
    SELECT file, score, rank::INT AS rank FROM (SELECT *, row_number() OVER (ORDER BY score DESC, file) AS rank FROM s) WHERE rank <= 200""",
    files=POOL,
)
def candidate_pool(files: DataFrame) -> DataFrame:
    return fusion.candidate_pool(files, "f3 m4 f7/m7.py")


@query(
    "span_overlap",
    """WITH o AS (SELECT span_id, 0 AS prio, c.start_line, c.end_line, c.name, c.text FROM spans s JOIN chunks c ON s.file = c.file AND c.start_line <= s.end_ AND c.end_line >= s.start
    UNION ALL SELECT span_id, 1, c.start_line, c.end_line, c.name, c.text FROM spans s JOIN chunks c ON s.file = c.file AND contains(c.name, s.symbol)),
    b AS (SELECT span_id, arg_min(name, (prio, start_line, end_line, name, text)) AS chunk FROM o GROUP BY span_id) SELECT s.span_id, chunk FROM spans s LEFT JOIN b USING (span_id)""",
    spans="SELECT event_id AS span_id, concat('u', user_id) AS file, concat('c', event_id % 13) AS symbol, CAST(event_id % 1500 AS INT) AS start, CAST(event_id % 1500 + 10 AS INT) AS end_ FROM {events} WHERE event_type = 'error'",
    chunks="SELECT concat('u', user_id) AS file, concat('c', event_id % 40) AS name, concat('text ', event_id) AS text, CAST(event_id % 900 AS INT) AS start_line, CAST(event_id % 900 + 30 AS INT) AS end_line FROM {events} WHERE event_type = 'signup'",
)
def span_overlap(spans: DataFrame, chunks: DataFrame) -> DataFrame:
    return fusion.span_excerpts(spans.withColumnRenamed("end_", "end"), chunks).select("span_id", "chunk")


@query(
    "sampled_spans",
    "SELECT issue_id, file, name, pos::INT AS pos FROM (SELECT *, row_number() OVER (PARTITION BY issue_id ORDER BY sha256(issue_id || chr(1) || file || chr(1) || name), file, name) AS pos FROM symbols) WHERE pos <= 4",
    symbols="SELECT concat('i', p_partkey % 17) AS issue_id, concat('d/f', p_size, '.py') AS file, concat(p_name, p_partkey) AS name, CAST(p_partkey % 50 AS INT) AS start_line, CAST(p_partkey % 50 + 5 AS INT) AS end_line FROM {part}",
)
def sampled_spans(symbols: DataFrame) -> DataFrame:
    return fusion.sampled_spans(symbols).select("issue_id", "file", "name", "pos")


#: Docstrings that are longer than what the tools show of them.
TOLD = "SELECT id, type, name, file, repeat(concat(docstring, '. '), 5) AS docstring FROM (" + NODES + ")"
ROW = "row_number() OVER (PARTITION BY node_id ORDER BY direction DESC, coalesce(file, id), id, type)::INT AS pos"


def _neighbors_sql(cap: int, chars: int) -> str:
    return f"""WITH e AS (SELECT src AS node_id, dst AS id, 'outgoing' AS direction, type FROM edges UNION SELECT dst, src, 'incoming', type FROM edges),
    known AS (FROM e WHERE node_id IN (SELECT id FROM nodes WHERE type = 'file'))
    SELECT * FROM (SELECT node_id, id, coalesce(file, id) AS file, name, node_type, substr(coalesce(docstring, ''), 1, {chars}) AS docstring, direction, type, {ROW} FROM known LEFT JOIN (SELECT id, file, name, type AS node_type, docstring FROM nodes) USING (id)) WHERE pos <= {cap}"""


def _neighbors(edges: DataFrame, nodes: DataFrame, mode: str) -> DataFrame:
    asked = nodes.where("type = 'file'").select(F.col("id").alias("node_id"))
    return graph.neighbor_tool(nodes, edges, asked, mode).select("node_id", "id", "file", "name", "node_type", "docstring", "direction", "type", "pos")


@query("neighbor_tool", _neighbors_sql(10, 40), edges=EDGES, nodes=TOLD)
def neighbor_tool(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Asked for every file, in the progressive mode."""
    return _neighbors(edges, nodes, "progressive")


@query("neighbor_tool_baseline", _neighbors_sql(20, 60), edges=EDGES, nodes=TOLD)
def neighbor_tool_baseline(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return _neighbors(edges, nodes, "baseline")


def _summary_sql(total: int, chars: int) -> str:
    return f"""WITH k AS (SELECT DISTINCT src AS file, dst AS id FROM edges WHERE type = 'CALLS')
    SELECT * FROM (SELECT parse_filename(file) AS path, file, id, name, type, substr(coalesce(docstring, ''), 1, {chars}) AS docstring, '' AS signature, row_number() OVER (PARTITION BY file ORDER BY name, id)::INT AS pos FROM k JOIN (SELECT id, name, type, docstring FROM nodes) USING (id)) WHERE pos <= {total}"""


def _summary(edges: DataFrame, nodes: DataFrame, mode: str) -> DataFrame:
    defines = edges.withColumn("type", F.when(F.col("type") == "CALLS", "DEFINES").otherwise(F.col("type")))
    asked = nodes.where("type = 'file'").select(F.element_at(F.split("id", "/"), -1).alias("path"))
    return graph.file_summary(nodes, defines, asked, mode).where("error IS NULL").select("path", "file", "id", "name", "type", "docstring", "signature", "pos")


@query("file_summary_tool", _summary_sql(8, 50), edges=EDGES, nodes=TOLD)
def file_summary_tool(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Asked for every file by the end of its path, in the progressive mode."""
    return _summary(edges, nodes, "progressive")


@query("file_summary_tool_baseline", _summary_sql(12, 80), edges=EDGES, nodes=TOLD)
def file_summary_tool_baseline(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return _summary(edges, nodes, "baseline")


TRACE = """SELECT conv_id AS issue, turn, concat('f', length(text) % 5, '.py') AS file, CASE WHEN turn % 3 = 0 THEN NULL ELSE CAST(length(text) % 100 AS DOUBLE) / 100 END AS score,
CAST(length(text) AS BIGINT) AS tokens, length(text) % 11 = 0 AS confident, role AS tool, turn % 2 = 0 AS cached, text AS response FROM {conversations}"""


@query("trace_observed_scores", "SELECT issue, file, round(sum(coalesce(score, 0.05)), 6)::DOUBLE AS score, count(*) AS n FROM trace GROUP BY ALL", trace=TRACE)
def trace_observed_scores(trace: DataFrame) -> DataFrame:
    return agent.observed_scores(trace).withColumn("score", F.round("score", 6))


@query(
    "trace_grounded",
    """WITH o AS (SELECT issue, file, sum(coalesce(score, 0.05)) AS score FROM trace GROUP BY ALL), c AS (SELECT DISTINCT issue, file FROM trace WHERE confident), cl AS (SELECT DISTINCT issue, file FROM claimed),
    best AS (SELECT issue, file, true AS confirmed FROM c SEMI JOIN cl USING (issue, file)),
    j AS (FROM best UNION ALL SELECT issue, file, true FROM c WHERE issue NOT IN (SELECT issue FROM best)
     UNION ALL SELECT issue, file, false FROM cl SEMI JOIN o USING (issue, file) WHERE issue NOT IN (SELECT issue FROM c)),
    k AS (SELECT j.*, coalesce(o.score, 0) AS score FROM j LEFT JOIN o USING (issue, file))
    SELECT issue, file, confirmed, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY issue ORDER BY confirmed DESC, score DESC, file) AS rank FROM k) WHERE rank <= 6""",
    trace=TRACE, claimed="SELECT conv_id AS issue, concat('f', turn, '.py') AS file FROM {conversations}",
)
def trace_grounded(trace: DataFrame, claimed: DataFrame) -> DataFrame:
    out = agent.grounded(claimed, agent.observed_scores(trace), trace.where("confident").select("issue", "file"))
    return out.select("issue", "file", "confirmed", "rank")


TURNS = """SELECT conv_id AS issue, turn, concat('f', length(text) % 4, '.py') AS file, length(text) % 9 = 0 AS confirmed, length(text) % 7 = 0 AS answer, length(text) % 2 = 0 AS named FROM {conversations}"""


@query(
    "trace_stop_reason",
    """WITH RECURSIVE c AS (SELECT issue, turn, coalesce(answer, false) AS answer, coalesce(named, false) AS named, CASE WHEN NOT coalesce(answer, false) THEN file END AS file, confirmed FROM trace),
    n AS (SELECT *, file IS NOT NULL AND row_number() OVER (PARTITION BY issue, file ORDER BY turn) = 1 AS new FROM c),
    t AS (SELECT issue, turn, bool_or(new) AS fresh, bool_or(answer) AS answer, bool_or(named) AS named, bool_or(confirmed AND file IS NOT NULL) AS confirmed FROM n GROUP BY ALL),
    k AS (SELECT *, row_number() OVER (PARTITION BY issue ORDER BY turn) AS nth, count(*) OVER (PARTITION BY issue) AS total FROM t),
    w AS (SELECT issue, 0::BIGINT AS nth, false AS called, false AS have, 0::BIGINT AS flat, NULL::VARCHAR AS why FROM k WHERE nth = 1 UNION ALL
     SELECT w.issue, k.nth, w.called OR NOT k.answer, w.have OR k.confirmed, CASE WHEN k.fresh THEN 0 ELSE w.flat + 1 END,
     CASE WHEN k.answer AND (k.named AND w.called OR w.have OR k.confirmed) THEN 'sufficient_confidence' WHEN k.answer THEN 'budget'
      WHEN NOT k.fresh AND w.flat + 1 >= 2 AND (w.have OR k.confirmed) THEN 'budget'
      WHEN k.nth >= 5 OR k.nth = k.total THEN CASE WHEN w.have OR k.confirmed THEN 'budget' ELSE 'max_turns' END END
     FROM w JOIN k ON k.issue = w.issue AND k.nth = w.nth + 1 WHERE w.why IS NULL)
    SELECT issue, nth::INT AS turns, why AS stop_reason FROM w WHERE why IS NOT NULL""",
    trace=TURNS,
)
def trace_stop_reason(trace: DataFrame) -> DataFrame:
    return agent.stop_reason(trace, max_turns=5)


@query(
    "trace_telemetry",
    "SELECT issue, count(*) AS n_calls, count(*) FILTER (cached) AS n_hits, sum(length(response))::BIGINT AS response_chars, (SELECT string_agg(tool || '=' || c, ',' ORDER BY tool) FROM (SELECT tool, count(*) AS c FROM trace t2 WHERE t2.issue = trace.issue GROUP BY tool)) AS calls FROM trace GROUP BY issue",
    trace=TRACE,
)
def trace_telemetry(trace: DataFrame) -> DataFrame:
    shown = F.array_join(F.transform(F.map_entries("calls_by_tool"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return agent.telemetry(trace).withColumn("calls", shown).drop("calls_by_tool")


@query(
    "search_calls",
    "SELECT issue, turn, row_number() OVER (PARTITION BY issue, q ORDER BY turn, pos) > 1 AS cached, row_number() OVER (PARTITION BY issue, turn ORDER BY pos) > 4 AS over_limit FROM (SELECT *, lower(trim(query)) AS q FROM calls)",
    calls="SELECT conv_id AS issue, turn, turn AS pos, concat(' ', substr(text, 1, 2)) AS query FROM {conversations}",
)
def search_calls(calls: DataFrame) -> DataFrame:
    return agent.search_calls(calls).select("issue", "turn", "cached", F.col("over").alias("over_limit"))

