"""Text, path, chunk and retrieval queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.functions import text as T
from graphloom.operators import chunk, dense, fusion, graph, inverted, lexical, paths, vectors
from graphloom.sources import datasets
from graphloom.storage import new_path

from .base import query

DOCS = "SELECT doc_id, text, source FROM {documents}"
PAGES = "SELECT page_id, url FROM {pages}"
URL_PATHS = "SELECT page_id, regexp_replace(url, '^[a-z]+://', '') AS path FROM {pages}"
VECTORS = "SELECT vec_id AS id, embedding, label FROM {embeddings}"
ITEMS = "SELECT item_id AS query_id, text FROM {benchmark}"
TOKENS = "regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')"


@query("text_tokenize_counts", f"SELECT doc_id, len({TOKENS})::INT AS n_tokens, len(list_distinct({TOKENS}))::INT AS n_distinct FROM docs", docs=DOCS)
def text_tokenize_counts(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.size(T.tokens("text")).alias("n_tokens"), F.size(T.token_set("text")).alias("n_distinct"))


@query(
    "text_path_tokens",
    r"""SELECT page_id, array_to_string(list_sort(list_distinct(flatten(list_transform(string_split(url, '/'),
        lambda p: regexp_extract_all(lower(regexp_replace(p, '\.[^.]*$', '')), '[a-z0-9]+'))))), ' ') AS tokens FROM pages_""",
    pages_=PAGES,
)
def text_path_tokens(pages_: DataFrame) -> DataFrame:
    return pages_.select("page_id", F.array_join(F.array_sort(T.path_tokens("url")), " ").alias("tokens"))


@query(
    "text_normalize_path",
    r"SELECT page_id, regexp_replace(regexp_replace(replace(trim(p), '\', '/'), '^(\./)+', ''), '^/', '') AS path FROM raw",
    raw=r"SELECT page_id, concat(' ', CASE page_id % 4 WHEN 0 THEN './' WHEN 1 THEN '././' WHEN 2 THEN '/' ELSE '' END, replace(url, '//', '/'), ' ') AS p FROM {pages}",
)
def text_normalize_path(raw: DataFrame) -> DataFrame:
    return raw.select("page_id", T.normalize_path("p").alias("path"))


@query(
    "text_redact", r"SELECT page_id, regexp_replace(t, '\b(?:[\w.-]+/)+[\w.-]+\.py\b', '<PY_PATH>', 'g') AS t FROM raw",
    raw="SELECT page_id, concat('in src/m', page_id % 7, '/a-b.c.py at ', url, ' and x.py or pkg/y.pyc') AS t FROM {pages}",
)
def text_redact(raw: DataFrame) -> DataFrame:
    return raw.select("page_id", T.redact_paths("t").alias("t"))


@query("text_token_estimate", "SELECT doc_id, (length(text) // 4)::BIGINT AS n, (length(trim(text)) // 4)::BIGINT AS n_query FROM docs", docs=DOCS)
def text_token_estimate(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", T.token_estimate("text").alias("n"), T.query_token_estimate("text").alias("n_query"))


@query(
    "issue_compaction",
    r"""WITH a AS (SELECT doc_id, regexp_replace(text, '\r\n?', chr(10), 'g') AS t FROM docs),
    b AS (SELECT doc_id, regexp_replace(regexp_replace(t, '^\s+|\s+$', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g') AS t FROM a),
    c AS (SELECT doc_id, regexp_replace(t, '\b(?:[\w.-]+/)+[\w.-]+\.py\b', '<PY_PATH>', 'g') AS t FROM b)
    SELECT doc_id, CASE WHEN length(t) > 4000 THEN regexp_replace(substr(t, 1, 3997), '\s+$', '') || '...' ELSE t END AS compact FROM c""",
    docs=DOCS,
)
def issue_compaction(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", T.compact_issue("text").alias("compact"))


@query(
    "canonicalize_suffix",
    """WITH v AS (SELECT DISTINCT path AS v FROM urls), w AS (SELECT page_id, want FROM urls),
    e AS (SELECT page_id, v FROM w JOIN v ON v = want), s AS (SELECT page_id, max(v) AS v FROM w JOIN v ON v LIKE '%/' || want GROUP BY page_id HAVING count(*) = 1)
    SELECT w.page_id, w.want, coalesce(e.v, s.v) AS canonical FROM w LEFT JOIN e USING (page_id) LEFT JOIN s USING (page_id)""",
    urls="SELECT page_id, p AS path, CASE WHEN page_id % 3 = 0 THEN p ELSE regexp_replace(p, '^[^/]*/', '') END AS want FROM (SELECT page_id, regexp_replace(url, '^[a-z]+://', '') AS p FROM {pages})",
)
def canonicalize_suffix(urls: DataFrame) -> DataFrame:
    wanted = urls.select("page_id", F.col("want").alias("path"))
    return paths.canonical(wanted, urls.select("path")).select("page_id", F.col("path").alias("want"), "canonical")


@query("json_props_extract", "SELECT event_id, (props->>'k')::BIGINT AS k, props->>'missing' AS missing FROM ev", ev="SELECT event_id, props FROM {events}")
def json_props_extract(ev: DataFrame) -> DataFrame:
    j = T.json_object("props", "k long, missing string")
    return ev.select("event_id", j["k"].alias("k"), j["missing"].alias("missing"))


@query(
    "answer_files",
    r"""SELECT doc_id, array_to_string(CASE WHEN doc_id % 2 = 0 THEN ['src/a' || (doc_id % 5) || '.py', 'b.py'] ELSE list_sort(list_distinct(regexp_extract_all(t, '[\w/.-]+\.py'))) END, ',') AS files FROM raw""",
    raw="""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN concat('I think {{"files": ["src/a', doc_id % 5, '.py", "b.py"]}} fits')
        ELSE concat('look at a/x', doc_id % 3, '.py, then a/x', doc_id % 3, '.py and z.py') END AS t FROM {documents}""",
)
def answer_files(raw: DataFrame) -> DataFrame:
    files = T.files_in_answer("t")
    return raw.select("doc_id", F.array_join(F.when(F.col("doc_id") % 2 == 0, files).otherwise(F.array_sort(files)), ",").alias("files"))


@query(
    "patch_extract",
    """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN d || chr(10) WHEN 1 THEN d || chr(10) WHEN 2 THEN NULL ELSE NULL END AS patch, CASE WHEN doc_id % 4 < 2 THEN 'f' || doc_id || '.py' END AS gold FROM raw""",
    raw="""SELECT doc_id, d, CASE doc_id % 4 WHEN 0 THEN concat('so <patch>', d, '</patch> done') WHEN 1 THEN concat('plain ', chr(10), d) WHEN 2 THEN '<patch>CANNOT_PATCH</patch>' ELSE 'nothing' END AS t
        FROM (SELECT doc_id, concat('--- a/f', doc_id, '.py', chr(10), '+++ b/f', doc_id, '.py', chr(10), '@@ -1,2 +1,2 @@', chr(10), '-x', chr(10), '+y') AS d FROM {documents})""",
)
def patch_extract(raw: DataFrame) -> DataFrame:
    patch = T.extract_patch("t")
    diff = F.concat(F.lit("diff --git a/o.py b/f"), F.col("doc_id"), F.lit(".py\n"), patch)
    return raw.select("doc_id", patch.alias("patch"), F.try_element_at(T.gold_files_from_diff(diff), F.lit(1)).alias("gold"))


@query(
    "stable_ids", "SELECT source, 'issues_' || substr(sha1(source || '|' || string_agg(d, '|' ORDER BY d)), 1, 12) AS issue_set FROM ids GROUP BY source",
    ids="SELECT concat('c', o_custkey) AS source, CAST(o_orderkey AS STRING) AS d FROM {orders}",
)
def stable_ids(ids: DataFrame) -> DataFrame:
    return ids.groupBy("source").agg(F.collect_list("d").alias("ids")).select("source", T.issue_set_id("source", "ids").alias("issue_set"))


@query(
    "infer_domain_case",
    "SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'web_framework' WHEN 1 THEN 'networking' WHEN 2 THEN 'testing_tooling' WHEN 3 THEN 'data_ml' WHEN 4 THEN 'app_cli' ELSE 'library' END AS domain, CASE page_id % 3 WHEN 0 THEN 'SWE-PolyBench' WHEN 1 THEN 'SWE-bench' ELSE 'other' END AS benchmark, trim(regexp_replace(regexp_replace(lower(r), '[/-]', '_', 'g'), '[^a-z0-9_]', '', 'g'), '_') AS slug, trim(regexp_replace(lower(r), '[^a-z0-9]+', '-', 'g'), '-') AS name_slug FROM raw",
    raw="SELECT page_id, concat('Own/ ', CASE page_id % 6 WHEN 0 THEN 'Flask-x' WHEN 1 THEN 'httpx' WHEN 2 THEN 'pytest' WHEN 3 THEN 'Keras' WHEN 4 THEN 'yt-dlp' ELSE 'misc' END) AS r, CASE page_id % 3 WHEN 0 THEN 'org/SWE-PolyBench' WHEN 1 THEN 'SWE-bench_v' ELSE 'x' END AS d FROM {pages}",
)
def infer_domain_case(raw: DataFrame) -> DataFrame:
    return raw.select("page_id", T.domain_of("r").alias("domain"), T.benchmark_of("d").alias("benchmark"), T.slug("r").alias("slug"), T.name_slug("r").alias("name_slug"))


@query(
    "chunk_fixed_windows",
    """SELECT doc_id, s::INT AS start, length(substr(text, s::INT + 1, 2048))::INT AS n_chars, md5(substr(text, s::INT + 1, 2048)) AS digest,
    (length(substr(text, 1, s::INT)) - length(replace(substr(text, 1, s::INT), chr(10), '')) + 1)::INT AS start_line
    FROM (SELECT doc_id, text, unnest(generate_series(0, (greatest(ceil((length(text) - 2048) / 1792.0), 0) * 1792)::BIGINT, 1792)) AS s FROM docs) WHERE trim(regexp_replace(substr(text, s::INT + 1, 2048), '\\s', '', 'g')) <> ''""",
    docs=DOCS,
)
def chunk_fixed_windows(docs: DataFrame) -> DataFrame:
    return chunk.embeddable(chunk.fixed_windows(docs)).select("doc_id", "start", "n_chars", F.md5("chunk").alias("digest"), "start_line")


BM25 = """
WITH t AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS ts FROM docs),
l AS (SELECT doc_id, len(ts) AS dl FROM t), st AS (SELECT count(*) AS n, avg(dl::DOUBLE) AS avgdl FROM l),
p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(ts) AS term FROM t) GROUP BY ALL),
q AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM items) GROUP BY ALL),
i AS (SELECT term, ln((n + 1) / count(*)) AS idf FROM p, st GROUP BY term, n),
b AS (SELECT query_id, sum(qtf * idf * 1e0) AS base FROM q JOIN i USING (term) GROUP BY query_id),
m AS (SELECT query_id, doc_id, sum(qtf * idf * (tf * 2.5e0 / (1.5e0 * (0.25e0 + 0.75e0 * dl / avgdl) + tf))) AS part FROM q JOIN p USING (term) JOIN i USING (term) JOIN l USING (doc_id), st GROUP BY ALL),
s AS (SELECT query_id, doc_id, round(base + coalesce(part, 0), 6) AS score FROM b CROSS JOIN l LEFT JOIN m USING (query_id, doc_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT query_id, doc_id, score, rank::INT AS rank FROM r WHERE rank <= 10
"""


@query("bm25plus_topk", BM25, docs=DOCS, items=ITEMS)
def bm25plus_topk(docs: DataFrame, items: DataFrame) -> DataFrame:
    return lexical.bm25plus(docs, items, 10)


@query("bm25_prefix_scope", BM25.replace("FROM docs)", "FROM docs WHERE source LIKE 'src1%')", 1), docs=DOCS, items=ITEMS)
def bm25_prefix_scope(docs: DataFrame, items: DataFrame) -> DataFrame:
    return lexical.bm25plus(lexical.with_raw_prefixes(docs, ["src1"], "source"), items, 10)


@query("bm25_index_topk", BM25, docs=DOCS, items=ITEMS)
def bm25_index_topk(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The same over a written index that is read back."""
    at = new_path(docs.sparkSession, "bm25")
    inverted.build(docs, at)
    return inverted.load(docs.sparkSession, at).search(items, 10)[0]


@query("bm25_index_twice", BM25.replace("WHERE rank <= 10", "WHERE rank <= CASE WHEN query_id % 2 = 0 THEN 10 ELSE 3 END"), docs=DOCS, items=ITEMS)
def bm25_index_twice(docs: DataFrame, items: DataFrame) -> DataFrame:
    """One index, asked twice: ten documents for items of even number, three for the others."""
    at = new_path(docs.sparkSession, "bm25")
    inverted.build(docs, at)
    ask = lambda odd, k: inverted.load(docs.sparkSession, at).search(items.where(F.col("query_id") % 2 == odd), k)[0]
    return ask(0, 10).unionByName(ask(1, 3))


COSINE = "round(list_sum(list_transform(list_zip(v.embedding, q.embedding), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)) / sqrt(list_sum(list_transform(v.embedding, lambda x: x::DOUBLE * x::DOUBLE))) / sqrt(list_sum(list_transform(q.embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6)"
ONE_QUERY = "WITH q AS (SELECT embedding FROM vecs WHERE id = 0), s AS (SELECT v.id, label, " + COSINE + " AS score FROM vecs v, q), r AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS rank FROM s) "


def _ranked(vecs: DataFrame, k: int) -> DataFrame:
    best = dense.topk(vecs, vecs.where("id = 0").select("embedding"), k)
    return vecs.select("id", "label").join(F.broadcast(best), "id")  # best: k rows


@query("dense_topk", ONE_QUERY + "SELECT id, score, rank::INT AS rank FROM r WHERE rank <= 20", vecs=VECTORS)
def dense_topk(vecs: DataFrame) -> DataFrame:
    return _ranked(vecs, 20).select("id", "score", "rank")


@query("dense_file_max", ONE_QUERY + "SELECT 'f' || label AS file, max(score) AS score FROM r WHERE rank <= 20 GROUP BY label", vecs=VECTORS)
def dense_file_max(vecs: DataFrame) -> DataFrame:
    return dense.best_per_file(_ranked(vecs, 20).select(F.concat(F.lit("f"), "label").alias("file"), "score"))


@query("dense_first_seen", ONE_QUERY + "SELECT 'f' || label AS file, min(rank)::INT AS first_rank, row_number() OVER (ORDER BY min(rank))::INT AS pos FROM r WHERE rank <= 20 GROUP BY label", vecs=VECTORS)
def dense_first_seen(vecs: DataFrame) -> DataFrame:
    return dense.first_seen_files(_ranked(vecs, 20).withColumn("file", F.concat(F.lit("f"), "label")))


BATCH = "WITH s AS (SELECT q.id AS query_id, v.id, " + COSINE + " AS score FROM vecs v, vecs q WHERE q.id % 20 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) SELECT query_id, id, score, rank::INT AS rank FROM r WHERE rank <= 5"


@query("dense_topk_batch", BATCH, vecs=VECTORS)
def dense_topk_batch(vecs: DataFrame) -> DataFrame:
    queries = vecs.where("id % 20 = 0").select(F.col("id").alias("query_id"), "embedding")
    return vectors.topk(vecs, queries, 5).select("query_id", "id", "score", "rank")


@query("dense_clustered_topk", BATCH, vecs=VECTORS)
def dense_clustered_topk(vecs: DataFrame) -> DataFrame:
    """The same over a clustered table that is written and read back."""
    at = new_path(vecs.sparkSession, "clustered")
    vectors.cluster(vecs, at)
    queries = vecs.where("id % 20 = 0").select(F.col("id").alias("query_id"), "embedding")
    return vectors.load(vecs.sparkSession, at, "id long, embedding array<float>").search(queries, 5)[0].select("query_id", "id", "score", "rank")


@query(
    "path_search",
    r"""WITH s AS (SELECT path, (len(list_intersect(list_distinct(flatten(list_transform(string_split(path, '/'), lambda p: regexp_extract_all(lower(regexp_replace(p, '\.[^.]*$', '')), '[a-z0-9]+')))), ['example', 'com', 'a'])) + (contains(lower(path), 'example.com/a'))::INT)::DOUBLE AS score FROM (SELECT DISTINCT path FROM urls))
    SELECT path, score, rank::INT AS rank FROM (SELECT *, row_number() OVER (ORDER BY score DESC, path) AS rank FROM s WHERE score > 0) WHERE rank <= 20""",
    urls=URL_PATHS,
)
def path_search(urls: DataFrame) -> DataFrame:
    return lexical.path_search(urls.select("path").distinct(), "example.com/a")


@query("list_files", "SELECT DISTINCT path FROM urls WHERE starts_with(path, 'w') ORDER BY path LIMIT 200", urls=URL_PATHS)
def list_files(urls: DataFrame) -> DataFrame:
    return lexical.list_files(urls.select("path").distinct(), "./w")


@query(
    "prefix_filter", "SELECT page_id, path FROM urls WHERE path = h OR starts_with(path, h || '/')",
    urls="SELECT page_id, p AS path, (SELECT min(regexp_extract(regexp_replace(url, '^[a-z]+://', ''), '^([^/]+)', 1)) FROM {pages}) AS h FROM (SELECT page_id, regexp_replace(url, '^[a-z]+://', '') AS p FROM {pages})",
)
def prefix_filter(urls: DataFrame) -> DataFrame:
    return lexical.under_prefix_of(urls, "h").select("page_id", "path")


@query(
    "minmax_normalize",
    "SELECT id, label, round(CASE WHEN max(x) OVER w - min(x) OVER w <= 1e-12 THEN 1 ELSE (x - min(x) OVER w) / (max(x) OVER w - min(x) OVER w) END, 6) AS score FROM (SELECT id, label, embedding[1]::DOUBLE AS x FROM vecs) WINDOW w AS (PARTITION BY label)",
    vecs=VECTORS,
)
def minmax_normalize(vecs: DataFrame) -> DataFrame:
    rows = vecs.select("id", "label", F.col("embedding")[0].cast("double").alias("x"))
    return rows.select("id", "label", F.round(T.min_max("x", Window.partitionBy("label")), 6).alias("score"))


@query(
    "token_budget_prefix",
    """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS k FROM docs)
    SELECT doc_id, k::INT AS line_no, spent::BIGINT AS spent FROM (SELECT doc_id, k, sum(length(line) // 4 + 1) OVER (PARTITION BY doc_id ORDER BY k) AS spent FROM l) WHERE spent <= 4096""",
    docs=DOCS,
)
def token_budget_prefix(docs: DataFrame) -> DataFrame:
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("rank", "line"))
    return graph.budget_prefix(lines, 4096, ["doc_id"]).select("doc_id", F.col("rank").alias("line_no"), "spent")


@query(
    "token_budget_greedy",
    """WITH RECURSIVE l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS k FROM docs), o AS (SELECT doc_id, k, length(line) // 4 AS est FROM l),
    w AS (SELECT DISTINCT doc_id, 0::BIGINT AS k, 0::BIGINT AS spent, 0::BIGINT AS kept FROM docs WHERE text IS NOT NULL UNION ALL
    SELECT w.doc_id, o.k::BIGINT, w.spent + CASE WHEN w.spent + est <= 1200 THEN est ELSE 0 END, w.kept + CASE WHEN w.spent + est <= 1200 THEN 1 ELSE 0 END FROM w JOIN o ON o.doc_id = w.doc_id AND o.k = w.k + 1)
    SELECT doc_id, max(kept)::INT AS n_kept, max(spent)::BIGINT AS spent FROM w GROUP BY doc_id""",
    docs=DOCS,
)
def token_budget_greedy(docs: DataFrame) -> DataFrame:
    kept = docs.where("text IS NOT NULL").select("doc_id", fusion.greedy_budget(F.split("text", "\n")).alias("kept"))
    return kept.select("doc_id", F.size("kept").alias("n_kept"), F.aggregate("kept", F.lit(0).cast("long"), lambda s, x: s + T.token_estimate(x)).alias("spent"))


@query(
    "schema_coalesce",
    """SELECT CASE WHEN a <> '' THEN a ELSE b END AS instance_id, CASE WHEN doc_id % 7 = 0 THEN 'fallback' WHEN doc_id % 7 = 1 THEN 'own' ELSE 'r' END AS repo, CASE WHEN a = '' THEN 'x' ELSE 'y' END AS base_commit,
    CASE WHEN doc_id % 4 = 0 THEN 'said' WHEN doc_id % 4 = 1 THEN 'asked' ELSE '' END AS problem_statement, CASE WHEN doc_id % 6 = 0 THEN 'p/q.py,z.py' WHEN doc_id % 6 = 2 THEN 'o.py' WHEN doc_id % 6 = 4 THEN 'n.py' ELSE 'n.py' END AS gold FROM raw""",
    raw="""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '' ELSE CAST(doc_id AS STRING) END AS a, concat('i', doc_id) AS b, CASE WHEN doc_id % 7 > 1 THEN 'r' END AS c, CASE WHEN doc_id % 7 = 1 THEN 'own' END AS d,
        CASE doc_id % 6 WHEN 0 THEN './p/q.py; z.py,p/q.py' WHEN 4 THEN ' ; ' ELSE '' END AS g, CASE doc_id % 6 WHEN 2 THEN '/o.py' WHEN 4 THEN 'unused.py' END AS h, CASE WHEN doc_id % 4 = 0 THEN 'said' ELSE '' END AS e, CASE WHEN doc_id % 4 < 2 THEN 'asked' END AS f FROM {documents}""",
)
def schema_coalesce(raw: DataFrame) -> DataFrame:
    patch = F.lit("diff --git a/m.py b/./n.py\n--- a/m.py")
    rows = raw.select(
        F.col("a").alias("instance_id"), F.col("b").alias("id"), F.col("c").alias("repo"), F.col("d").alias("repository"), F.when(F.col("a") != "", "y").alias("base_sha"),
        F.lit("x").alias("commit"), patch.alias("patch"), F.col("g").alias("gold_files"), F.col("h").alias("file_paths"), F.col("e").alias("statement"), F.col("f").alias("prompt"),
    )
    return datasets.issues(rows, "fallback").select("instance_id", "repo", "base_commit", "problem_statement", F.array_join("gold_files", ",").alias("gold"))


@query(
    "first_seen_union",
    "SELECT doc_id, arg_min(split, split) AS split, count(*) AS n FROM both_ GROUP BY doc_id",
    both_="SELECT doc_id, 0 AS split FROM {documents} WHERE doc_id % 3 <> 0 UNION ALL SELECT doc_id, 1 AS split FROM {documents} WHERE doc_id % 2 = 0",
)
def first_seen_union(both_: DataFrame) -> DataFrame:
    n = both_.groupBy("doc_id").agg(F.count("*").alias("n"))
    return datasets.first_seen(both_, "doc_id", ["split"]).join(n, "doc_id").select("doc_id", "split", "n")


@query(
    "manifest_order_select",
    "SELECT d.doc_id, row_number() OVER (ORDER BY m.pos)::INT AS pos FROM docs d JOIN (SELECT min(i) AS pos, id FROM (SELECT unnest(range(1, 9)) AS i, unnest(['17', '3', '99999999', '42', '3', '5', '0', '8']) AS id) GROUP BY id) m ON m.id = d.doc_id::VARCHAR ORDER BY m.pos LIMIT 5",
    docs="SELECT doc_id FROM {documents}",
)
def manifest_order_select(docs: DataFrame) -> DataFrame:
    return datasets.manifest_selection(docs, ["17", " 3", "99999999", "42", "3 ", "5", "", "0", "8"], 5, "doc_id").select("doc_id", "pos")
