"""Evaluation, statistics, telemetry, tuning and streaming queries; runs and results are made from events and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators import evaluate, patches, stats, telemetry, tuning
from graphloom.sources import runs as run_files
from graphloom.storage import new_path
from graphloom.streaming import checkpoints, status

from .base import query

ISSUES = "SELECT CAST(doc_id AS STRING) AS instance_id, source AS base_commit, doc_id AS ord FROM {documents}"
METHODS = "SELECT DISTINCT concat('m', CAST(event_id % 4 AS STRING)) AS method FROM {events}"
RESULTS = """SELECT CAST(d.doc_id AS STRING) AS instance_id, concat('m', CAST(m AS STRING)) AS method, CASE WHEN (d.doc_id + m) % 11 = 0 THEN 'failed' END AS error,
CAST((d.doc_id * 7 + m * 13) % 101 AS DOUBLE) / 100 AS f1, CAST((d.doc_id * 3 + m) % 101 AS DOUBLE) / 100 AS precision, CAST((d.doc_id * 5 + m) % 101 AS DOUBLE) / 100 AS recall,
CAST(length(text) % 1000 AS BIGINT) AS total_tokens, CAST(length(text) % 600 AS BIGINT) AS prompt_tokens, CASE WHEN d.doc_id % 5 <> 0 THEN CAST(length(text) % 70 AS BIGINT) END AS candidate_tokens, CAST(length(text) % 7 AS BIGINT) AS query_embedding_tokens, CASE d.doc_id % 4 WHEN 0 THEN 'budget' WHEN 1 THEN 'max_turns' WHEN 2 THEN '' END AS stop_reason
FROM {documents} d CROSS JOIN (SELECT DISTINCT event_id % 4 AS m FROM {events}) x WHERE (d.doc_id + m) % 17 <> 0"""
SETUP = "SELECT method, CAST(1000 + 777 * (ascii(substr(method, 2, 1)) - 48) AS BIGINT) AS setup_tokens, CAST(ascii(substr(method, 2, 1)) AS DOUBLE) AS build_time_s FROM (SELECT DISTINCT concat('m', CAST(event_id % 3 AS STRING)) AS method FROM {events}) z"
H = {"issues": ISSUES, "methods": METHODS, "results": RESULTS, "setup": SETUP}
SUMMARY = """
j AS (SELECT i.instance_id, m.method, r.* EXCLUDE (instance_id, method), r.f1 IS NULL OR error IS NOT NULL AS failed FROM issues i CROSS JOIN methods m LEFT JOIN results r ON r.instance_id = i.instance_id AND r.method = m.method),
s AS (SELECT method, count(*) AS n, count(*) FILTER (NOT failed) AS n_success, count(*) FILTER (failed) AS n_errors, avg(CASE WHEN failed THEN 0 ELSE precision END) AS p, avg(CASE WHEN failed THEN 0 ELSE recall END) AS r, avg(CASE WHEN failed THEN 0 ELSE f1 END) AS f,
 sum(coalesce(prompt_tokens, 0))::BIGINT AS pt, sum(coalesce(candidate_tokens, 0))::BIGINT AS ct, sum(coalesce(total_tokens, 0))::BIGINT AS llm, sum(coalesce(query_embedding_tokens, 0))::BIGINT AS qt FROM j GROUP BY method),
t AS (SELECT s.*, coalesce(setup_tokens, 0)::BIGINT AS st, coalesce(build_time_s, 0) AS bt FROM s LEFT JOIN setup USING (method))
"""


def _summary(**kw: DataFrame) -> DataFrame:
    return evaluate.method_summary(**kw)


def _rounded(df: DataFrame, *names: str, places: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, places) for n in names})


@query(
    "prf1",
    """WITH g AS (SELECT source, list_distinct(list(gold) FILTER (gold IS NOT NULL)) AS g, list_distinct(list(pred) FILTER (pred IS NOT NULL)) AS p FROM pairs GROUP BY source),
    h AS (SELECT source, len(coalesce(g, [])) AS ng, len(coalesce(p, [])) AS np, len(list_intersect(coalesce(g, []), coalesce(p, [])))::DOUBLE AS hit FROM g),
    m AS (SELECT source, CASE WHEN np = 0 THEN 0 ELSE hit / np END AS precision, CASE WHEN ng = 0 THEN 0 ELSE hit / ng END AS recall, ng = 0 AS skipped FROM h)
    SELECT source, round(precision, 6)::DOUBLE AS precision, round(recall, 6)::DOUBLE AS recall, round(CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END, 6)::DOUBLE AS f1, skipped FROM m""",
    pairs="SELECT l_orderkey AS source, CASE WHEN l_partkey % 3 > 0 THEN concat('f', l_partkey, '.py') END AS gold, CASE WHEN l_suppkey % 2 = 0 OR l_partkey % 5 = 0 THEN concat('f', l_partkey, '.py') END AS pred FROM {lineitem}",
)
def prf1(pairs: DataFrame) -> DataFrame:
    lists = pairs.groupBy("source").agg(F.collect_list("gold").alias("g"), F.collect_list("pred").alias("p"))
    m = lists.select("source", evaluate.file_metrics("g", "p").alias("m"))
    return _rounded(m.select("source", "m.precision", "m.recall", "m.f1", F.col("m.skipped_empty_gold").alias("skipped")), "precision", "recall", "f1")


@query("commit_groups", "SELECT base_commit, min(ord) AS first_seen, count(*) AS n_issues, row_number() OVER (ORDER BY min(ord))::INT AS pos FROM issues GROUP BY base_commit", issues=ISSUES)
def commit_groups(issues: DataFrame) -> DataFrame:
    return evaluate.commit_groups(issues)


@query("track_groups", "SELECT instance_id, base_commit, (SELECT arg_min(base_commit, ord) FROM issues) AS used_commit FROM issues", issues=ISSUES)
def track_groups(issues: DataFrame) -> DataFrame:
    return evaluate.track_groups(issues, "same_snapshot").select("instance_id", "base_commit", "used_commit")


@query(
    "method_summary",
    "WITH " + SUMMARY + """SELECT method, n AS n_issues, n_success, n_errors, round(p, 6) AS mean_precision, round(r, 6) AS mean_recall, round(f, 6) AS mean_f1, pt AS prompt_tokens, ct AS candidate_tokens, llm AS llm_tokens, qt AS query_tokens, st AS setup_tokens, bt AS setup_time_s, llm + qt AS total_runtime_tokens, round(llm / n, 6) AS avg_llm_tokens, round(qt / n, 6) AS avg_query_tokens,
    round(n_errors / n, 6) AS error_rate, st + llm + qt AS total_cost_tokens, round((llm + qt) / n, 6) AS avg_runtime_tokens, round(st + (llm + qt) / n, 6) AS avg_total_unamortized, round((st + llm + qt) / n, 6) AS avg_total_amortized, round(CASE WHEN f > 0 THEN (llm + qt) / n / f END, 6) AS tokens_per_f1 FROM t""",
    **H,
)
def method_summary(**kw: DataFrame) -> DataFrame:
    return _rounded(_summary(**kw), "mean_precision", "mean_recall", "mean_f1", "error_rate", "avg_llm_tokens", "avg_query_tokens", "avg_runtime_tokens", "avg_total_unamortized", "avg_total_amortized", "tokens_per_f1")


@query(
    "break_even",
    "WITH " + SUMMARY + """, u AS (SELECT method, st, (llm + qt) / n AS rt FROM t), w AS (SELECT a.method AS "left", b.method AS "right", CASE WHEN a.rt - b.rt <> 0 THEN (b.st - a.st) / (a.rt - b.rt) END AS x FROM u a, u b WHERE a.method <> b.method)
    SELECT "left", "right", CASE WHEN x > 0 THEN round(x, 6) END AS n_break_even FROM w""",
    **H,
)
def break_even(**kw: DataFrame) -> DataFrame:
    return evaluate.break_even(_summary(**kw))


@query("delta_to_baseline", "WITH " + SUMMARY + ", u AS (SELECT method, (llm + qt) / n / f AS x FROM t) SELECT method, round(x - (SELECT x FROM u WHERE method = 'm1'), 6) AS delta FROM u", **H)
def delta_to_baseline(**kw: DataFrame) -> DataFrame:
    return _rounded(evaluate.delta_to(_summary(**kw), "m1"), "delta")


@query("stop_reasons", "SELECT method, stop_reason, count(*) AS n FROM results WHERE stop_reason <> '' GROUP BY ALL", results=RESULTS)
def stop_reasons(results: DataFrame) -> DataFrame:
    return evaluate.stop_reasons(results)


@query(
    "amortization", "SELECT count(*) AS n_issues, count(DISTINCT coalesce(nullif(used_commit, ''), nullif(base_commit, ''), '__NO')) AS n_unique_commits, count(*) - count(DISTINCT coalesce(nullif(used_commit, ''), nullif(base_commit, ''), '__NO')) AS cache_hits, round((count(*) - count(DISTINCT coalesce(nullif(used_commit, ''), nullif(base_commit, ''), '__NO'))) / count(*), 6) AS cache_hit_rate FROM r",
    r="SELECT CASE WHEN doc_id % 3 = 0 THEN '' WHEN doc_id % 3 = 1 THEN source END AS used_commit, CASE WHEN doc_id % 5 <> 0 THEN concat('b', CAST(doc_id % 40 AS STRING)) END AS base_commit FROM {documents}",
)
def amortization(r: DataFrame) -> DataFrame:
    return _rounded(evaluate.amortization(r), "cache_hit_rate")


USAGE = "SELECT user_id, event_id, event_type, CAST(event_id % 50 AS BIGINT) AS prompt_tokens, CASE WHEN event_id % 4 = 0 THEN NULL ELSE CAST(event_id % 9 AS BIGINT) END AS candidate_tokens, CASE WHEN event_id % 3 = 0 THEN event_type END AS stop_reason FROM {events}"


@query("usage_merge", "SELECT user_id, sum(prompt_tokens)::BIGINT AS prompt_tokens, sum(coalesce(candidate_tokens, 0))::BIGINT AS candidate_tokens, arg_max(stop_reason, event_id) FILTER (stop_reason IS NOT NULL) AS stop_reason FROM usage_ GROUP BY user_id", usage_=USAGE)
def usage_merge(usage_: DataFrame) -> DataFrame:
    return evaluate.merged_usage(usage_, ["user_id"], "event_id", ["prompt_tokens", "candidate_tokens"], ["stop_reason"])


@query("usage_merge_maps", "SELECT user_id, string_agg(event_type || '=' || v, ',' ORDER BY event_type) AS m FROM (SELECT user_id, event_type, sum(prompt_tokens)::BIGINT AS v FROM usage_ GROUP BY ALL) GROUP BY user_id", usage_=USAGE)
def usage_merge_maps(usage_: DataFrame) -> DataFrame:
    rows = usage_.select("user_id", F.create_map("event_type", "prompt_tokens").alias("m"))
    shown = F.array_join(F.transform(F.map_entries("m"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return evaluate.merged_maps(rows, ["user_id"], "m").select("user_id", shown.alias("m"))


RUNS = "SELECT user_id % 6 AS run, event_type AS method, avg(CAST(event_id % 1000 AS DOUBLE)) AS mean_f1, CASE WHEN user_id % 6 = 3 THEN NULL ELSE avg(CAST(event_id % 77 AS DOUBLE)) END AS cost FROM {events} WHERE NOT (user_id % 6 = 5 AND event_type = 'error') GROUP BY user_id % 6, event_type"


@query(
    "repeat_stats",
    "WITH l AS (SELECT method, 'mean_f1' AS metric, mean_f1 AS v FROM runs UNION ALL SELECT method, 'cost', coalesce(cost, 0) FROM runs) SELECT method, metric, round(avg(v), 6) AS mean, round(coalesce(stddev_samp(v), 0), 6) AS std, round(min(v), 6) AS min, round(max(v), 6) AS max, count(*) AS n_runs FROM l GROUP BY ALL",
    runs=RUNS,
)
def repeat_stats(runs: DataFrame) -> DataFrame:
    return _rounded(evaluate.repeat_stats(runs, ["mean_f1", "cost"]), "mean", "std", "min", "max")


@query("pairwise_deltas", 'SELECT a.method AS "left", b.method AS "right", a.run, round(a.cost - b.cost, 6) AS delta FROM runs a JOIN runs b USING (run) WHERE a.method <> b.method AND a.cost IS NOT NULL AND b.cost IS NOT NULL', runs=RUNS)
def pairwise_deltas(runs: DataFrame) -> DataFrame:
    return _rounded(evaluate.run_deltas(runs, "cost"), "delta")


BOOTSTRAP = """WITH d AS (SELECT a.method AS l, b.method AS r, (a.mean_f1 - b.mean_f1)::DOUBLE AS v FROM runs a JOIN runs b USING (run) WHERE a.method <> b.method AND a.mean_f1 IS NOT NULL AND b.mean_f1 IS NOT NULL),
v AS (SELECT *, row_number() OVER (PARTITION BY l, r ORDER BY v) - 1 AS i, count(*) OVER (PARTITION BY l, r) AS n FROM d),
w AS (SELECT l, r, n, b, ('0x' || substr(md5(concat_ws('|', 17, b, i)), 1, 12))::UBIGINT % n AS i FROM v, range(1, 2001) t(b)),
m AS (SELECT w.l, w.r, b, sum(v) / any_value(w.n) AS m FROM w JOIN v ON w.l = v.l AND w.r = v.r AND w.i = v.i GROUP BY ALL),
p AS (SELECT *, row_number() OVER (PARTITION BY l, r ORDER BY m) AS k FROM m)
SELECT p.l AS "left", p.r AS "right", any_value(n) AS n_runs, round(any_value(x.mean), 6) AS mean, round(max(m) FILTER (k = 50), 6) AS low, round(max(m) FILTER (k = 1950), 6) AS high
FROM p JOIN (SELECT l, r, avg(v) AS mean, any_value(n) AS n FROM v GROUP BY ALL) x ON p.l = x.l AND p.r = x.r GROUP BY p.l, p.r"""


@query("bootstrap_ci", BOOTSTRAP, runs=RUNS)
def bootstrap_ci(runs: DataFrame) -> DataFrame:
    return _rounded(evaluate.bootstrap_ci(evaluate.run_deltas(runs, "mean_f1"), ["left", "right"]), "mean", "low", "high")


INSTANCES = """SELECT concat('run', CAST(user_id % 40 AS STRING)) AS run_id, CAST(event_id AS STRING) AS instance_id, event_id, user_id, CASE event_type WHEN 'purchase' THEN 'patched' WHEN 'error' THEN 'apply_failed' WHEN 'signup' THEN 'timeout_budget_exceeded' ELSE 'no_patch' END AS patch_status,
event_id % 19 = 0 AS timeout_budget_exceeded, CAST(event_id % 500 AS BIGINT) AS retrieval_total_tokens, CAST(event_id % 300 AS BIGINT) AS patch_total_tokens FROM {events}"""
CELL_RUNS = """SELECT concat('run', CAST(k AS STRING)) AS run_id, concat('r', CAST(k % 10 AS STRING)) AS repo, CASE CAST(floor(k / 10) AS BIGINT) WHEN 0 THEN 'graph' WHEN 1 THEN 'dense' WHEN 2 THEN 'oracle' ELSE 'none' END AS method, n AS n_instances,
CASE WHEN k % 7 <> 3 THEN s END AS n_resolved, k % 10 <> 4 AS completed, CAST(1000 + k * 37 AS BIGINT) AS setup_tokens_method_accounted, CAST(NULL AS BIGINT) AS retrieval_setup_tokens, CASE WHEN k % 3 = 0 THEN CAST(k * 100 AS BIGINT) END AS setup_graph, CASE WHEN k % 6 = 0 THEN CAST(k * 90 AS BIGINT) END AS setup_rag, t AS runtime_tokens, CAST(1000 + k * 37 AS BIGINT) AS setup_tokens
FROM (SELECT user_id % 40 AS k, count(*) AS n, CAST(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS BIGINT) AS s, CAST(sum(event_id % 500 + event_id % 300) AS BIGINT) AS t FROM {events} GROUP BY user_id % 40) y"""
C = {"runs": CELL_RUNS, "instances": INSTANCES}
CELLS = "cells AS (SELECT r.*, coalesce(tc, 0)::BIGINT AS timeout_count FROM runs r LEFT JOIN (SELECT run_id, count(*) FILTER (patch_status = 'timeout_budget_exceeded' OR timeout_budget_exceeded) AS tc FROM instances GROUP BY run_id) USING (run_id))"
DUAL = CELLS + """, dual AS (SELECT c.*, runtime_tokens + c.setup_tokens AS method_total, runtime_tokens + CASE WHEN c.method NOT IN ('graph', 'dense') THEN c.setup_tokens WHEN setup_graph IS NOT NULL OR setup_rag IS NOT NULL THEN coalesce(setup_graph, 0) + coalesce(setup_rag, 0) ELSE c.setup_tokens + coalesce(p.setup_tokens, 0) END AS as_run_total
FROM cells c LEFT JOIN (SELECT repo, CASE method WHEN 'graph' THEN 'dense' ELSE 'graph' END AS method, setup_tokens FROM cells WHERE method IN ('graph', 'dense')) p USING (repo, method))"""
POOLED = DUAL + """, lng AS (SELECT method, n_instances, n_resolved, 'method_accounted' AS accounting_view, method_total AS tokens FROM dual WHERE completed UNION ALL SELECT method, n_instances, n_resolved, 'as_run_consumed', as_run_total FROM dual WHERE completed),
pooled AS (SELECT accounting_view, method, count(*) AS n_repos, sum(n_instances)::BIGINT AS n_instances, sum(coalesce(n_resolved, 0))::BIGINT AS n_resolved, sum(tokens)::BIGINT AS tokens FROM lng GROUP BY ALL)"""
TIMEOUTS = CELLS + """, s AS (SELECT method, count(*) AS n_repos, sum(n_instances)::BIGINT AS n_instances, sum(coalesce(n_resolved, 0))::BIGINT AS n_resolved, sum(timeout_count)::BIGINT AS n_timeouts FROM cells WHERE completed GROUP BY method),
tr AS (SELECT *, CASE WHEN n_instances > 0 THEN n_resolved / n_instances END AS a, CASE WHEN n_instances - n_timeouts > 0 THEN n_resolved / (n_instances - n_timeouts) END AS b FROM s),
gap AS (SELECT max(a) FILTER (method = 'graph') - max(a) FILTER (method = 'dense') AS a, max(b) FILTER (method = 'graph') - max(b) FILTER (method = 'dense') AS b FROM tr)"""


def _cells(runs: DataFrame, instances: DataFrame) -> DataFrame:
    return stats.cells(runs.drop("setup_tokens"), instances)


@query(
    "cost_per_resolved",
    "WITH " + DUAL + " SELECT repo, method, method_total, as_run_total, round(CASE WHEN n_resolved > 0 THEN method_total / n_resolved END, 6) AS cpr_method, round(CASE WHEN n_resolved > 0 THEN as_run_total / n_resolved END, 6) AS cpr_as_run, timeout_count, round(n_resolved / n_instances, 6) AS resolved_rate FROM dual",
    **C,
)
def cost_per_resolved(runs: DataFrame, instances: DataFrame) -> DataFrame:
    d = stats.dual_accounting(_cells(runs, instances), "graph", "dense")
    return _rounded(d.select("repo", "method", "method_total", "as_run_total", "cpr_method", "cpr_as_run", "timeout_count", "resolved_rate"), "cpr_method", "cpr_as_run", "resolved_rate")


LEVELS = DUAL + """, lng AS (SELECT repo, method, n_instances, n_resolved, 'method_accounted' AS accounting_view, method_total AS tokens FROM dual WHERE completed UNION ALL SELECT repo, method, n_instances, n_resolved, 'as_run_consumed', as_run_total FROM dual WHERE completed)"""


@query(
    "pooled_levels",
    "WITH " + LEVELS + """, s AS (SELECT accounting_view, repo, method, CASE grouping_id(accounting_view, repo, method) WHEN 0 THEN 'cell' WHEN 1 THEN 'repo' WHEN 2 THEN 'method' ELSE 'view' END AS level, count(*) AS n_cells, sum(n_instances)::BIGINT AS n_instances, sum(coalesce(n_resolved, 0))::BIGINT AS n_resolved, sum(tokens)::BIGINT AS tokens
    FROM lng GROUP BY GROUPING SETS ((accounting_view, repo, method), (accounting_view, repo), (accounting_view, method), (accounting_view)))
    SELECT *, round(CASE WHEN n_resolved > 0 THEN tokens / n_resolved END, 6) AS cost_per_resolved FROM s""",
    **C,
)
def pooled_levels(runs: DataFrame, instances: DataFrame) -> DataFrame:
    return _rounded(stats.pooled_levels(stats.dual_accounting(_cells(runs, instances), "graph", "dense")), "cost_per_resolved")


@query("median_cpr", "WITH " + LEVELS + " SELECT accounting_view, method, count(*) AS n_cells, round(median(tokens / n_resolved), 6) AS median_cpr FROM lng WHERE n_resolved > 0 GROUP BY ALL", **C)
def median_cpr(runs: DataFrame, instances: DataFrame) -> DataFrame:
    return _rounded(stats.median_cpr(stats.dual_accounting(_cells(runs, instances), "graph", "dense")), "median_cpr")


@query(
    "sketched_costs", "SELECT method, count(*) AS n, true AS median_near, true AS distinct_near FROM i GROUP BY method",
    i="SELECT event_type AS method, user_id % 12 AS run, user_id, CAST(event_id % 997 * 1.5 AS DOUBLE) AS cost FROM {events}",
)
def sketched_costs(i: DataFrame) -> DataFrame:
    """Sketches of each method's runs, stored, merged over runs and held against the exact figures."""
    at = new_path(i.sparkSession, "sketches")
    stats.sketched(i, ["method", "run"], "cost", "user_id").write.parquet(at)
    told = stats.from_sketches(i.sparkSession.read.parquet(at), ["method"])
    exact = i.join(told.select("method", F.col("quantiles")[0].alias("m")), "method").groupBy("method").agg(
        (F.count_if(F.col("cost") < F.col("m")) / F.count("*")).alias("under"), (F.count_if(F.col("cost") <= F.col("m")) / F.count("*")).alias("upto"), F.count_distinct("user_id").alias("d")
    )
    near = (F.col("under") <= 0.5 + 0.017) & (F.col("upto") >= 0.5 - 0.017)
    return told.join(exact, "method").select("method", "n", near.alias("median_near"), (F.abs(F.col("n_distinct") - F.col("d")) <= F.greatest(F.lit(1.0), 0.05 * F.col("d"))).alias("distinct_near"))


@query("pooled_cpr", "WITH " + POOLED + " SELECT *, round(CASE WHEN n_resolved > 0 THEN tokens / n_resolved END, 6) AS cost_per_resolved FROM pooled", **C)
def pooled_cpr(runs: DataFrame, instances: DataFrame) -> DataFrame:
    return _rounded(stats.pooled_cpr(stats.dual_accounting(_cells(runs, instances), "graph", "dense")), "cost_per_resolved")


@query(
    "timeout_sensitivity",
    "WITH " + TIMEOUTS + " SELECT method, n_repos, n_instances, n_resolved, n_timeouts, round(a, 6) AS rate_all, round(b, 6) AS rate_no_timeouts, NULL::DOUBLE AS shift_pp FROM tr UNION ALL SELECT 'graph_minus_dense', NULL, NULL, NULL, NULL, round(a, 6), round(b, 6), round(abs((b - a) * 100), 6) FROM gap",
    **C,
)
def timeout_sensitivity(runs: DataFrame, instances: DataFrame) -> DataFrame:
    return _rounded(stats.timeout_sensitivity(_cells(runs, instances), "graph", "dense"), "rate_all", "rate_no_timeouts", "shift_pp")


@query("resolved_rate_pivot", "SELECT repo, round(max(n_resolved / n_instances) FILTER (method = 'graph'), 6) AS graph, round(max(n_resolved / n_instances) FILTER (method = 'dense'), 6) AS dense FROM runs GROUP BY repo", **C)
def resolved_rate_pivot(runs: DataFrame, instances: DataFrame) -> DataFrame:
    return _rounded(stats.resolved_rate_table(_cells(runs, instances), ["graph", "dense"]), "graph", "dense")


@query("cell_selection", "SELECT repo, method, run_id FROM (SELECT *, row_number() OVER (PARTITION BY repo, method ORDER BY frozen DESC, CASE WHEN method = 'none' THEN completed::INT ELSE 0 END DESC, run_id DESC) AS k FROM r) WHERE k = 1",
       r="SELECT concat('r', CAST(user_id % 9 AS STRING)) AS repo, CASE WHEN event_id % 2 = 0 THEN 'none' ELSE event_type END AS method, concat('20260', CAST(event_id AS STRING)) AS run_id, event_id % 300 = 7 AS frozen, event_id % 5 = 0 AS completed FROM {events}")
def cell_selection(r: DataFrame) -> DataFrame:
    return stats.selected_cells(r).select("repo", "method", "run_id")


@query("patch_run_summary", "SELECT run_id, count(*) AS n_instances, count(*) FILTER (patch_status = 'patched') AS n_patched, count(*) FILTER (patch_status = 'apply_failed') AS n_apply_failed, round(count(*) FILTER (patch_status = 'patched') / count(*), 4) AS patch_rate, round(avg(patch_total_tokens), 1) AS avg_patch_tokens FROM instances GROUP BY run_id", instances=INSTANCES)
def patch_run_summary(instances: DataFrame) -> DataFrame:
    return patches.run_summary(instances)


@query(
    "patch_cost_summary",
    "SELECT run_id, setup_tokens, n_resolved, coalesce(a, 0)::BIGINT AS retrieval_tokens, coalesce(b, 0)::BIGINT AS patch_tokens, (setup_tokens + coalesce(a, 0) + coalesce(b, 0))::BIGINT AS total_cost_tokens, round(CASE WHEN n_resolved > 0 THEN (setup_tokens + coalesce(a, 0) + coalesce(b, 0)) / n_resolved END, 6) AS cost_per_resolved FROM runs LEFT JOIN (SELECT run_id, sum(retrieval_total_tokens) AS a, sum(patch_total_tokens) AS b FROM instances GROUP BY run_id) USING (run_id)",
    **C,
)
def patch_cost_summary(runs: DataFrame, instances: DataFrame) -> DataFrame:
    return _rounded(patches.cost_summary(instances, runs.select("run_id", "setup_tokens", "n_resolved")), "cost_per_resolved")


@query("ntile_chunks", "SELECT doc_id, ntile(7) OVER (ORDER BY doc_id)::INT AS worker FROM docs", docs="SELECT doc_id FROM {documents}")
def ntile_chunks(docs: DataFrame) -> DataFrame:
    return patches.contiguous_chunks(docs, 7, "doc_id")


ARMS = {
    "l": "SELECT CAST(doc_id AS STRING) AS instance_id, quality = 1 AS resolved, CASE WHEN doc_id % 6 = 0 THEN 'timeout_budget_exceeded' ELSE 'patched' END AS status FROM {labels} WHERE doc_id % 9 <> 0",
    "r": "SELECT CAST(doc_id AS STRING) AS instance_id, toxic = 0 AND doc_id % 4 <> 0 AS resolved, CASE WHEN doc_id % 5 = 0 THEN 'timeout_budget_exceeded' ELSE 'no_patch' END AS status FROM {labels} WHERE doc_id % 7 <> 0",
}
MCNEMAR = "x AS (SELECT instance_id, coalesce(l.resolved, false) AS lr, coalesce(r.resolved, false) AS rr, l.status AS ls, r.status AS rs FROM l FULL JOIN r USING (instance_id)), mc AS (SELECT count(*) FILTER (lr AND rr) AS a, count(*) FILTER (lr AND NOT rr) AS b, count(*) FILTER (NOT lr AND rr) AS c, count(*) FILTER (NOT lr AND NOT rr) AS d FROM x)"


@query("mcnemar_table", "WITH " + MCNEMAR + " SELECT *, round((abs(b - c) - 1)::DOUBLE ** 2 / (b + c), 6) AS chi2 FROM mc", **ARMS)
def mcnemar_table(l: DataFrame, r: DataFrame) -> DataFrame:  # noqa: E741
    t = stats.mcnemar_table(l, r)
    return t.withColumn("chi2", F.round(stats.chi_square(F.col("b"), F.col("c")), 6))


@query(
    "mcnemar_pairs",
    """WITH i AS (SELECT method, instance_id, bool_or(resolved) AS w FROM arms GROUP BY ALL), m AS (SELECT DISTINCT method FROM i),
    p AS (SELECT x.method AS l, y.method AS r FROM m x JOIN m y ON x.method < y.method),
    j AS (SELECT l, r, instance_id, bool_or(w AND method = l) AS a, bool_or(w AND method = r) AS b FROM p JOIN i ON method IN (l, r) GROUP BY ALL)
    SELECT l AS "left", r AS "right", count(*) FILTER (a AND b) AS a, count(*) FILTER (a AND NOT b) AS b, count(*) FILTER (b AND NOT a) AS c, count(*) FILTER (NOT a AND NOT b) AS d FROM j GROUP BY ALL""",
    arms="SELECT concat('m', CAST(doc_id % 13 % 6 AS STRING)) AS method, CAST(floor(doc_id / 13) AS STRING) AS instance_id, length(text) % 3 > 0 AS resolved FROM {documents}",
)
def mcnemar_pairs(arms: DataFrame) -> DataFrame:
    return stats.mcnemar_pairs(arms)


PAIRS = "SELECT item_id, CAST(item_id % 30 AS BIGINT) AS b, CAST((item_id * 7) % 41 AS BIGINT) AS c FROM {benchmark}"
EXACT = "p AS (SELECT item_id, b, c, CASE WHEN b + c = 0 THEN 1.0 ELSE least(1.0, 2 * (SELECT sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2))) FROM (SELECT b + c AS n) z, (SELECT unnest(range(0, least(b, c) + 1)) AS i) y)) END AS p FROM pairs)"


@query("mcnemar_exact", "WITH " + EXACT + " SELECT item_id, b, c, round(p, 9)::DOUBLE AS p FROM p", pairs=PAIRS)
def mcnemar_exact(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("p", F.round(stats.binomial_p(F.col("b"), F.col("c")), 9))


@query("discordant_rows", "WITH " + MCNEMAR + " SELECT instance_id, CASE WHEN lr THEN 'graph' ELSE 'dense' END AS winner, CASE WHEN lr THEN 'dense' ELSE 'graph' END AS loser, CASE WHEN lr THEN rs ELSE ls END AS loser_status, coalesce(CASE WHEN lr THEN rs ELSE ls END = 'timeout_budget_exceeded', false) AS timeout_confounded FROM x WHERE lr <> rr", **ARMS)
def discordant_rows(l: DataFrame, r: DataFrame) -> DataFrame:  # noqa: E741
    return stats.discordant(l, r, ("graph", "dense"))


@query(
    "wilson_holm_h",
    "WITH " + EXACT + """, h AS (SELECT *, (count(*) OVER () - row_number() OVER (ORDER BY p, item_id) + 1) * p AS s FROM p)
    SELECT item_id, round(least(1.0, max(s) OVER (ORDER BY p, item_id ROWS UNBOUNDED PRECEDING)), 9)::DOUBLE AS p_holm, round(2 * asin(sqrt(b / 50)) - 2 * asin(sqrt(c / 50)), 6) AS h,
    round((b / 50 + 3.841458820694124 / 100) / (1 + 3.841458820694124 / 50) - 1.959963984540054 * sqrt((b / 50) * (1 - b / 50) / 50 + 3.841458820694124 / 10000) / (1 + 3.841458820694124 / 50), 6) AS low FROM h""",
    pairs=PAIRS,
)
def wilson_holm_h(pairs: DataFrame) -> DataFrame:
    t = pairs.withColumn("p", stats.binomial_p(F.col("b"), F.col("c")))
    b, c, n = F.col("b").cast("double"), F.col("c").cast("double"), F.lit(50.0)
    return stats.holm(t).select("item_id", F.round("p_holm", 9).alias("p_holm"), F.round(stats.cohen_h(b / n, c / n), 6).alias("h"), F.round(stats.wilson(b, n)["low"], 6).alias("low"))


@query(
    "rerun_gate",
    "WITH " + POOLED + ", " + TIMEOUTS.replace(CELLS + ", ", "") + ", " + MCNEMAR + """, pc AS (SELECT accounting_view, max(tokens / n_resolved) FILTER (method = 'graph') - max(tokens / n_resolved) FILTER (method = 'dense') AS g FROM pooled GROUP BY accounting_view),
    dd AS (SELECT count(*) AS n, count(*) FILTER (coalesce(CASE WHEN lr THEN rs ELSE ls END = 'timeout_budget_exceeded', false)) AS k FROM x WHERE lr <> rr),
    o AS (SELECT (SELECT product(g) FROM pc) < 0 AS ranking_reversed, (SELECT abs((b - a) * 100) FROM gap) AS sp, n, k FROM dd)
    SELECT ranking_reversed, sp > 5 AS timeout_shift, k * 2 > n AS timeout_majority, round(sp, 6) AS shift_pp, n AS n_discordant, k AS n_confounded, ranking_reversed OR sp > 5 OR k * 2 > n AS rerun FROM o""",
    **C, **ARMS,
)
def rerun_gate(runs: DataFrame, instances: DataFrame, l: DataFrame, r: DataFrame) -> DataFrame:  # noqa: E741
    c = _cells(runs, instances)
    pooled, late = stats.pooled_cpr(stats.dual_accounting(c, "graph", "dense")), stats.timeout_sensitivity(c, "graph", "dense")
    return _rounded(stats.rerun_gate(pooled, late, stats.discordant(l, r, ("graph", "dense")), "graph", "dense"), "shift_pp")


LOG = "SELECT concat('run', CAST(user_id % 12 AS STRING)) AS run_id, CAST(user_id AS STRING) AS instance_id, event_id AS ord, CASE event_type WHEN 'purchase' THEN 'patched' WHEN 'error' THEN 'apply_failed' ELSE event_type END AS patch_status FROM {events}"


@query("latest_wins", "SELECT run_id, instance_id, max(ord) AS ord, arg_max(patch_status, ord) AS patch_status FROM log GROUP BY ALL", log=LOG)
def latest_wins(log: DataFrame) -> DataFrame:
    return telemetry.latest(log, ["run_id", "instance_id"], "ord").select("run_id", "instance_id", "ord", "patch_status")


@query("partial_stats", "SELECT run_id, count(*) AS n_completed, count(*) FILTER (s = 'patched') AS n_patched, count(*) FILTER (s = 'apply_failed') AS n_apply_failed FROM (SELECT run_id, instance_id, arg_max(patch_status, ord) AS s FROM log GROUP BY ALL) GROUP BY run_id", log=LOG)
def partial_stats(log: DataFrame) -> DataFrame:
    return telemetry.partial_stats(log)


@query(
    "checkpoint_last_lines", "SELECT instance_id, arg_max(prediction, (CASE WHEN w = 3 THEN 99 ELSE w END, event_id)) AS prediction FROM (SELECT instance_id, w, event_id, 'p' || event_id AS prediction FROM lines_ WHERE event_id % 13 <> 0 AND event_id % 17 <> 0) GROUP BY instance_id",
    lines_="""SELECT event_id, CAST(event_id % 4 AS INT) AS w, concat('i', user_id) AS instance_id, CASE WHEN event_id % 4 = 3 THEN 'd/predictions_partial.jsonl' ELSE concat('d/worker_', CAST(event_id % 4 AS STRING), '.jsonl') END AS file, event_id AS line_no,
    CASE WHEN event_id % 13 = 0 THEN 'broken {{' WHEN event_id % 17 = 0 THEN '{{"prediction": "x"}}' ELSE concat('{{"instance_id": "i', user_id, '", "prediction": "p', event_id, '"}}') END AS value FROM {events}""",
)
def checkpoint_last_lines(lines_: DataFrame) -> DataFrame:
    return run_files.last_lines(run_files.parsed_checkpoints(lines_)).select("instance_id", "prediction")


CONFIGURED = """SELECT CAST(event_id AS STRING) AS run_id, CASE WHEN event_id % 3 = 0 THEN 'repeat' END AS run_type, concat('u', CAST(user_id % 20 AS STRING)) AS repo_name, event_type AS dataset_name, CASE WHEN event_id % 5 = 0 THEN '' WHEN event_id % 5 = 1 THEN 'i1' END AS issue_set_id,
CASE event_id % 4 WHEN 0 THEN ' strict ' WHEN 1 THEN '' WHEN 2 THEN 'strict' END AS evaluation_track, CASE WHEN event_id % 8 < 5 THEN 'snapshot' END AS amortization_track, CAST(NULL AS STRING) AS snapshot_commit, CASE WHEN event_id % 7 <> 0 THEN CAST(event_id % 2 AS INT) END AS n_issues_evaluated,
CASE WHEN event_id % 11 = 0 THEN 'src' ELSE '' END AS prefix, ts AS created_at FROM {events}"""


@query(
    "superseded",
    """WITH k AS (SELECT *, coalesce(nullif(trim(evaluation_track), ''), nullif(trim(amortization_track), ''), '') AS track FROM r)
    SELECT run_id, repo_name, track FROM (SELECT *, row_number() OVER (PARTITION BY coalesce(run_type, ''), repo_name, dataset_name, coalesce(issue_set_id, ''), track, coalesce(n_issues_evaluated, 0), prefix ORDER BY created_at DESC, run_id DESC) AS n FROM k) WHERE n = 1""",
    r=CONFIGURED,
)
def superseded(r: DataFrame) -> DataFrame:
    prefixes = F.when(F.col("prefix") != "", F.array("prefix"))
    return telemetry.superseded(r.withColumns({"track": telemetry.effective_track(), "source_prefixes": prefixes})).select("run_id", "repo_name", "track")


@query("anti_covered", "SELECT run_id FROM r WHERE run_id NOT IN (SELECT run_id FROM a)", r="SELECT CAST(user_id AS STRING) AS run_id FROM {events} GROUP BY user_id", a="SELECT CAST(user_id AS STRING) AS run_id FROM {events} WHERE event_type = 'signup' AND value > 50 GROUP BY user_id")
def anti_covered(r: DataFrame, a: DataFrame) -> DataFrame:
    return telemetry.without_covered(r, a.agg(F.collect_list("run_id").alias("run_ids")))


STATES = """SELECT CAST(user_id AS STRING) AS run_id, concat('m', CAST(user_id % 60 AS STRING)) AS manifest, user_id % 5 = 0 AS has_summary, CAST(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) % 3 AS BIGINT) AS n_completed,
CAST(count(*) % 40 AS DOUBLE) AS age, CAST(count(*) % 25 AS DOUBLE) AS seen_age, CASE user_id % 3 WHEN 0 THEN true WHEN 1 THEN false END AS pid_alive, CAST(max(event_id) AS DOUBLE) AS last_seen_ts, CAST(user_id % 2 AS BIGINT) AS n_patched FROM {events} GROUP BY user_id"""
STATUS = "st AS (SELECT *, CASE WHEN has_summary THEN 'complete' WHEN n_completed = 0 THEN CASE WHEN pid_alive = false OR seen_age > 15 THEN 'stalled' ELSE 'not_started' END WHEN age > 15 OR pid_alive = false THEN 'stalled' ELSE 'running' END AS status FROM r)"


def _states(r: DataFrame) -> DataFrame:
    return r.withColumn("status", telemetry.run_status(*(F.col(c) for c in ("has_summary", "n_completed", "age", "seen_age", "pid_alive"))))


@query("status_machine", "WITH " + STATUS + " SELECT run_id, status FROM st", r=STATES)
def status_machine(r: DataFrame) -> DataFrame:
    return _states(r).select("run_id", "status")


@query("status_summary", "WITH " + STATUS + " SELECT count(*) AS n_runs, count(*) FILTER (status = 'complete') AS n_complete, count(*) FILTER (status = 'running') AS n_running, count(*) FILTER (status = 'stalled') AS n_stalled, count(*) FILTER (status = 'not_started') AS n_not_started, sum(n_completed)::BIGINT AS n_completed, sum(n_patched)::BIGINT AS n_patched, round(sum(n_patched) / sum(n_completed), 6) AS patch_rate FROM st", r=STATES)
def status_summary(r: DataFrame) -> DataFrame:
    return _rounded(telemetry.status_summary(_states(r)), "patch_rate")


@query("freshest_attempts", "WITH " + STATUS + " SELECT run_id, manifest, status FROM (SELECT *, row_number() OVER (PARTITION BY manifest, status = 'complete' ORDER BY last_seen_ts DESC, run_id DESC) AS k FROM st) WHERE k = 1", r=STATES)
def freshest_attempts(r: DataFrame) -> DataFrame:
    return telemetry.freshest_attempts(_states(r)).select("run_id", "manifest", "status")


@query("visible_runs", "WITH " + STATUS + " SELECT run_id FROM st WHERE status = 'running' OR status = 'not_started' AND seen_age <= 10 OR status = 'complete'", r=STATES)
def visible_runs(r: DataFrame) -> DataFrame:
    return telemetry.visible(_states(r), active_only=True, stalled=False, grace=10).select("run_id")


@query("resumable", "WITH " + STATUS + " SELECT manifest, arg_max(run_id, last_seen_ts) AS run_id FROM st WHERE manifest NOT IN (SELECT manifest FROM st WHERE status = 'complete') GROUP BY manifest", r=STATES)
def resumable(r: DataFrame) -> DataFrame:
    return telemetry.resumable(_states(r)).select("manifest", "run_id")


@query("grid_densify", "SELECT a.repo, b.method, n FROM (SELECT DISTINCT repo FROM g) a CROSS JOIN (SELECT DISTINCT method FROM g) b LEFT JOIN (SELECT repo, method, count(*) AS n FROM g WHERE value > 99 GROUP BY ALL) c ON a.repo = c.repo AND b.method = c.method",
       g="SELECT user_id AS repo, event_type AS method, value FROM {events}")
def grid_densify(g: DataFrame) -> DataFrame:
    counts = g.where("value > 99").groupBy("repo", "method").agg(F.count("*").alias("n"))
    return telemetry.densified(counts, g.select("repo").distinct(), g.select("method").distinct(), ["repo", "method"])


@query("pareto_frontier", "SELECT p_partkey, cost, quality FROM pts a WHERE NOT EXISTS (SELECT 1 FROM pts b WHERE b.cost <= a.cost AND b.quality >= a.quality AND (b.cost < a.cost OR b.quality > a.quality))",
       pts="SELECT p_partkey, p_retailprice AS cost, p_size AS quality FROM {part}")
def pareto_frontier(pts: DataFrame) -> DataFrame:
    return telemetry.pareto(pts).select("p_partkey", "cost", "quality")


@query(
    "regime_shift",
    """SELECT a.repo, a.dataset, coalesce(a.issue_set, '') AS issue_set, a.method, round(coalesce(b.f1, 0) - coalesce(a.f1, 0), 6) AS d_f1, round(b.cost - a.cost, 6) AS d_cost
    FROM g a JOIN g b ON a.repo = b.repo AND a.method = b.method AND a.dataset = b.dataset AND a.issue_set IS NOT DISTINCT FROM b.issue_set WHERE a.track = 'strict' AND b.track = 'snapshot' ORDER BY abs(coalesce(b.f1, 0) - coalesce(a.f1, 0)) DESC, a.repo, a.dataset, coalesce(a.issue_set, ''), a.method LIMIT 20""",
    g="SELECT track, repo, method, dataset, issue_set, CASE WHEN count(*) % 9 <> 0 THEN CAST(sum(k) AS DOUBLE) / 100 END AS f1, CAST(count(*) AS DOUBLE) AS cost FROM (SELECT CASE o_orderkey % 2 WHEN 0 THEN 'strict' ELSE 'snapshot' END AS track, CAST(o_custkey % 10 AS STRING) AS repo, o_orderpriority AS method, concat('d', o_custkey % 2) AS dataset, CASE WHEN o_custkey % 3 > 0 THEN concat('i', o_custkey % 3) END AS issue_set, o_orderkey % 101 AS k FROM {orders}) x GROUP BY track, repo, method, dataset, issue_set",
)
def regime_shift(g: DataFrame) -> DataFrame:
    return _rounded(telemetry.regime_shift(g, "strict", "snapshot"), "d_f1", "d_cost")


@query("best_per_group", "SELECT user_id, arg_max(event_type, (value, -event_id)) AS best, max(value) AS best_value FROM e GROUP BY user_id", e="SELECT user_id, event_type, round(value, 1) AS value, event_id FROM {events}")
def best_per_group(e: DataFrame) -> DataFrame:
    return telemetry.best_per_group(e, ["user_id"], "value", "event_type", "event_id")


@query("top5_costly", "SELECT user_id, event_id, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM e) WHERE rank <= 5", e="SELECT user_id, event_id, value FROM {events}")
def top5_costly(e: DataFrame) -> DataFrame:
    return telemetry.costliest(e, ["user_id"], "value", "event_id").select("user_id", "event_id", "rank")


@query("error_table", "SELECT method, coalesce(n_errors, 0) AS n_errors, round(coalesce(error_rate, n_errors / n_issues, 0), 6) AS error_rate FROM g",
       g="SELECT event_type AS method, CASE WHEN event_type <> 'view' THEN CAST(sum(CASE WHEN value > 60 THEN 1 ELSE 0 END) AS BIGINT) END AS n_errors, count(*) AS n_issues, CASE WHEN event_type = 'click' THEN 0.25 END AS error_rate FROM {events} GROUP BY event_type".replace("0.25", "CAST(0.25 AS DOUBLE)"))
def error_table(g: DataFrame) -> DataFrame:
    return _rounded(telemetry.error_table(g), "error_rate")


@query("tool_rollup", "SELECT method, sum(c)::BIGINT AS n_calls, sum(h)::BIGINT AS n_hits, arg_max(tool, (c, tool)) AS top_tool FROM (SELECT method, tool, sum(n_calls) AS c, sum(n_hits) AS h FROM t GROUP BY ALL) GROUP BY method",
       t="SELECT concat('u', CAST(user_id % 9 AS STRING)) AS method, event_type AS tool, CAST(event_id % 5 AS BIGINT) AS n_calls, CAST(event_id % 2 AS BIGINT) AS n_hits FROM {events}")
def tool_rollup(t: DataFrame) -> DataFrame:
    return telemetry.tool_rollup(t)


@query(
    "leaderboard_guard",
    """WITH gd AS (SELECT config_id, bool_and(coalesce(s.score >= b.score - 0.03, false)) AS passes FROM (SELECT DISTINCT config_id FROM scores) c CROSS JOIN baseline b LEFT JOIN scores s USING (config_id, repo) GROUP BY config_id),
    k AS (SELECT *, row_number() OVER (ORDER BY mean_f1 DESC, f1_std, runtime_tokens, config_id) AS rank FROM results LEFT JOIN gd USING (config_id))
    SELECT config_id, coalesce(passes, false) AS passes, rank::INT AS rank, rank = (SELECT min(rank) FROM k WHERE passes) AS selected FROM k""",
    scores="SELECT p_brand AS config_id, CAST(p_size % 4 AS STRING) AS repo, round(avg(p_retailprice) / 1000, 4) AS score FROM {part} WHERE NOT (p_brand = 'Brand#11' AND p_size % 4 = 2) GROUP BY p_brand, p_size % 4",
    baseline="SELECT CAST(p_size % 4 AS STRING) AS repo, round(avg(p_retailprice) / 1000 - 0.05, 4) AS score FROM {part} GROUP BY p_size % 4",
    results="SELECT p_brand AS config_id, round(avg(p_size), 1) AS mean_f1, round(min(p_retailprice), 0) AS f1_std, CAST(count(*) AS DOUBLE) AS runtime_tokens FROM {part} GROUP BY p_brand",
)
def leaderboard_guard(scores: DataFrame, baseline: DataFrame, results: DataFrame) -> DataFrame:
    return tuning.leaderboard(results, tuning.guarded(scores, baseline)).select("config_id", "passes", "rank", "selected")


@query(
    "split_allocate",
    "SELECT repo, instance_id FROM (SELECT DISTINCT repo, instance_id, CASE repo WHEN 'src0' THEN NULL WHEN 'src1' THEN 5 WHEN 'src2' THEN 900 END AS cap, row_number() OVER (PARTITION BY repo ORDER BY sha1('17|' || instance_id), instance_id) AS k FROM ids WHERE repo IN ('src0', 'src1', 'src2')) WHERE cap IS NULL OR k <= cap",
    ids="SELECT source AS repo, CAST(doc_id AS STRING) AS instance_id FROM {documents}",
)
def split_allocate(ids: DataFrame) -> DataFrame:
    return tuning.allocated_split(ids, ["src0"], {"src1": 5, "src2": 900}, 17)


@query("event_sessions", """WITH o AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM e), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM o)
    SELECT user_id, count(*) AS n, round(sum(value), 4) AS value FROM s GROUP BY user_id, k""", e="SELECT user_id, ts, value FROM {events}")  # fmt: skip
def event_sessions(e: DataFrame) -> DataFrame:
    return checkpoints.sessions(e, "6 hours").select("user_id", "n", F.round("value", 4).alias("value"))


def _fed(e: DataFrame, at: str) -> None:
    """Four files below `at`/feed, one after the other in the order of time."""
    spark = e.sparkSession
    e.repartitionByRange(4, "ts").sortWithinPartitions("ts").write.parquet(f"{at}/in")
    names = spark.read.schema(e.schema).parquet(f"{at}/in").select(F.input_file_name().alias("f")).distinct().orderBy("f")
    for r in names.collect():
        spark.read.schema(e.schema).parquet(r.f).coalesce(1).write.mode("append").parquet(f"{at}/feed")


@query(
    "stream_merge", "SELECT run_id, instance_id, arg_max(patch_status, (ts, patch_status)) AS patch_status, epoch_us(max(ts)) AS ts_us FROM e GROUP BY ALL",
    e="SELECT concat('run', CAST(user_id % 12 AS STRING)) AS run_id, CAST(user_id AS STRING) AS instance_id, event_type AS patch_status, CAST(ts AS TIMESTAMP) AS ts FROM {events}",
)
def stream_merge(e: DataFrame) -> DataFrame:
    """The last status of each instance, merged from four batches into buckets."""
    spark, at = e.sparkSession, new_path(e.sparkSession, "merge")
    _fed(e, at)
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/feed")
    checkpoints.upsert(stream, f"{at}/target", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return checkpoints.merged(spark, f"{at}/target").select("run_id", "instance_id", "patch_status", F.unix_micros("ts").alias("ts_us"))


LIVE = "SELECT concat('run', CAST(user_id % 40 AS STRING)) AS run_id, CAST(ts AS TIMESTAMP) AS ts FROM {events}"


@query(
    "stream_run_status",
    """WITH t AS (SELECT run_id, date_trunc('millisecond', ts) AS ts FROM e), o AS (SELECT *, (SELECT max(ts) FROM t) - INTERVAL 1 HOUR AS horizon FROM t),
    w AS (SELECT *, lag(ts) OVER w AS before, lead(ts) OVER w AS after, row_number() OVER w AS n FROM o WHERE ts <= horizon WINDOW w AS (PARTITION BY run_id ORDER BY ts)), s AS (FROM w)
    SELECT run_id, 'running' AS status, epoch_ms(ts) AS at_ms, n AS n_rows FROM s WHERE before IS NULL OR ts > before + INTERVAL 15 MINUTE
    UNION ALL SELECT run_id, 'stalled', epoch_ms(ts + INTERVAL 15 MINUTE), n FROM s WHERE (after IS NULL OR after > ts + INTERVAL 15 MINUTE) AND ts + INTERVAL 15 MINUTE <= horizon""",
    e=LIVE,
)
def stream_run_status(e: DataFrame) -> DataFrame:
    """All events as a stream of four batches in the order of time; each user group is a run."""
    spark, at = e.sparkSession, new_path(e.sparkSession, "live")
    _fed(e, at)
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/feed")
    status.start(status.live_status(stream), f"{at}/out", f"{at}/checkpoint").awaitTermination()
    got = status.told(spark, f"{at}/out")
    return got.select("run_id", "status", F.unix_millis("at").alias("at_ms"), "n_rows")


@query("stream_checkpoint_status", "SELECT run_id, instance_id, arg_max(patch_status, ts) AS patch_status FROM log GROUP BY ALL",
       log="SELECT concat('run', CAST(user_id % 12 AS STRING)) AS run_id, CAST(user_id AS STRING) AS instance_id, max(ts) AS ts, event_type AS patch_status FROM {events} GROUP BY user_id, event_type")
def stream_checkpoint_status(log: DataFrame) -> DataFrame:
    return checkpoints.latest_per_instance(log).select("run_id", "instance_id", "patch_status")
