"""Queries over results of runs: usage, costs, patches, cells, telemetry, tuning, campaigns."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import evaluate, patches, stats, telemetry, tuning
from graphloom.sources import datasets, runs
from graphloom.storage import new_path

from . import campaign
from .base import fixed, query
from .queries_runs import CELL_RUNS, INSTANCES, RUNS, STATES, STATUS, _rounded, _states
from .registry import Registry, with_retries

EVENTS = "SELECT event_id, user_id, event_type, value, ts FROM {events}"


@query("context_check", "SELECT event_type AS index, count(*) AS n FROM e WHERE event_type IN ('click', 'view') GROUP BY event_type", e=EVENTS)
def context_check(e: DataFrame) -> DataFrame:
    """H4: it fails where a required index is missing or empty."""
    counts = e.groupBy(F.col("event_type").alias("index")).agg(F.count("*").alias("n"))
    return evaluate.required_nonempty(counts, ["click", "view"]).where("failed IS NULL").select("index", "n")


@query(
    "usage_normalized", "SELECT event_id, coalesce(p, 0) AS prompt_tokens, 0::BIGINT AS candidate_tokens, coalesce(t, 0) AS total_tokens, coalesce(q, m, 0) AS query_embedding_tokens FROM u",
    u="SELECT event_id, CASE WHEN event_id % 3 > 0 THEN event_id % 50 END AS p, CASE WHEN event_id % 4 > 0 THEN event_id % 70 END AS t, CASE WHEN event_id % 5 = 0 THEN event_id % 9 END AS q, CASE WHEN event_id % 2 = 0 THEN event_id % 8 END AS m FROM {events}",
)
def usage_normalized(u: DataFrame) -> DataFrame:
    named = u.select("event_id", F.col("p").alias("prompt_tokens"), F.col("t").alias("total_tokens"), F.col("q").alias("query_embedding_tokens"), F.col("m").alias("embedding_tokens"))
    return evaluate.normalized_usage(named).select("event_id", "prompt_tokens", "candidate_tokens", "total_tokens", "query_embedding_tokens")


@query("cost_components", "SELECT event_id, a + b + c AS cost_tokens FROM u", u="SELECT event_id, event_id % 7 AS a, event_id % 11 AS b, event_id % 13 AS c FROM {events}")
def cost_components(u: DataFrame) -> DataFrame:
    named = u.select("event_id", F.col("a").alias("setup_tokens"), F.col("b").alias("llm_tokens"), F.col("c").alias("query_embedding_tokens"))
    return evaluate.cost_components(named).select("event_id", "cost_tokens")


@query("track_check", "SELECT event_id, t AS track_name FROM r", r="SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'strict' WHEN 1 THEN '' END AS t FROM {events}")
def track_check(r: DataFrame) -> DataFrame:
    return evaluate.single_track(r.withColumnRenamed("t", "track_name"), "strict")


@query("setup_totals", "SELECT event_type AS method, round(sum(value), 4) AS build_time_s, sum(event_id)::BIGINT AS setup_tokens FROM e GROUP BY event_type", e=EVENTS)
def setup_totals(e: DataFrame) -> DataFrame:
    contexts = e.select(F.col("event_type").alias("method"), F.col("value").alias("build_time_s"), F.col("event_id").alias("embedding_tokens"))
    return _rounded(evaluate.setup_totals(contexts), "build_time_s", places=4)


@query("repeat_gates", "WITH d AS (SELECT count(*) AS n FROM runs a JOIN runs b USING (run) WHERE a.method <> b.method AND a.cost IS NOT NULL AND b.cost IS NOT NULL), r AS (SELECT count(DISTINCT run) AS n FROM runs) SELECT r.n >= 3 AS enough_runs, d.n > 0 AS pairwise_present, r.n >= 3 AND d.n > 0 AS ready FROM r, d", runs=RUNS)
def repeat_gates(runs: DataFrame) -> DataFrame:
    return evaluate.gates(runs, evaluate.run_deltas(runs, "cost"))


@query(
    "amortization_rollup", "SELECT user_id % 5 AS g, max(n) AS n_issues, round(avg(u))::BIGINT AS n_unique_commits, round(avg(h), 6) AS cache_hit_rate, CASE WHEN count(DISTINCT t) > 1 THEN 'mixed' ELSE max(t) END AS track_name FROM a GROUP BY user_id % 5",
    a="SELECT user_id, count(*) AS n, max(event_id) % 7 AS u, CAST(max(event_id) % 10 AS DOUBLE) / 10 AS h, CASE WHEN user_id % 5 < 2 THEN 'strict' ELSE concat('t', user_id % 2) END AS t FROM {events} GROUP BY user_id",
)
def amortization_rollup(a: DataFrame) -> DataFrame:
    named = a.select((F.col("user_id") % 5).alias("g"), F.col("n").alias("n_issues"), F.col("u").alias("n_unique_commits"), F.col("h").alias("cache_hit_rate"), F.col("t").alias("track_name"))
    return _rounded(evaluate.amortization_rollup(named, ["g"]), "cache_hit_rate")


@query("retrieved_cap", "SELECT doc_id, array_to_string(f[1:greatest(k, 1)], ',') AS files, len(f)::INT AS pre_cap, least(len(f), greatest(k, 1))::INT AS post_cap FROM (SELECT doc_id, k, list_transform(range(n), lambda i: 'f' || i) AS f FROM d)",
       d="SELECT doc_id, CAST(doc_id % 5 AS INT) - 1 AS k, CAST(doc_id % 7 AS INT) AS n FROM {documents}")
def retrieved_cap(d: DataFrame) -> DataFrame:
    files = F.when(F.col("n") > 0, F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.concat(F.lit("f"), i.cast("string"))))
    out = None
    # the cap is a setting of a run, not of a row
    for k in range(-1, 4):
        part = d.where(F.col("k") == k).select("doc_id", patches.capped(files, k).alias("c"))
        out = part if out is None else out.unionByName(part)
    return out.select("doc_id", F.array_join("c.files", ",").alias("files"), "c.pre_cap", "c.post_cap")


@query("robustness", "SELECT user_id, round(count(*) FILTER (event_type = 'view') / greatest(count(*) FILTER (event_type IN ('view', 'error')), 1), 6) AS robustness FROM e GROUP BY user_id", e=EVENTS)
def robustness(e: DataFrame) -> DataFrame:
    of = lambda kind: F.count_if(F.col("event_type") == kind)
    return e.groupBy("user_id").agg(F.round(patches.robustness(of("view"), of("error")), 6).alias("robustness"))


PAYLOADS = """SELECT concat('run', user_id) AS run_id, user_id AS u, n, CASE user_id % 6 WHEN 0 THEN concat('{{"resolved_ids": ["i', user_id, '", "a"], "resolved_instances": 99}}') WHEN 1 THEN concat('{{"i', user_id, '": {{"resolved": true}}, "j": {{"resolved": false}}}}')
WHEN 2 THEN concat('{{"resolved_instances": ', n, ', "total_instances": 5}}') WHEN 3 THEN '{{"x": {{}}}}' WHEN 4 THEN '{{"note": "none"}}' END AS payload FROM (SELECT user_id, count(*) AS n FROM {events} GROUP BY user_id) x"""


@query(
    "harness_payloads",
    """WITH f AS (SELECT run_id, string_agg(instance_id, ',' ORDER BY instance_id) AS ids, count(*) AS k FROM (SELECT DISTINCT run_id, instance_id FROM r WHERE ok) GROUP BY run_id),
    j AS (SELECT p.*, CASE u % 6 WHEN 0 THEN 'a,i' || u WHEN 1 THEN 'i' || u WHEN 2 THEN '' WHEN 3 THEN '' ELSE f.ids END AS ids, CASE u % 6 WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 2 THEN n WHEN 3 THEN 0 ELSE f.k END AS k FROM p LEFT JOIN f USING (run_id))
    SELECT run_id, ids, k AS n_resolved, round(k / (n + 1), 4) AS resolved_rate FROM j""",
    p=PAYLOADS, r="SELECT concat('run', user_id) AS run_id, concat('e', event_id % 9) AS instance_id, event_type = 'purchase' AS ok FROM {events}",
)
def harness_payloads(p: DataFrame, r: DataFrame) -> DataFrame:
    """Three kinds of report, and instances' own reports where there is none."""
    got = patches.harness_results(p.select("run_id", "payload", (F.col("n") + 1).alias("n_total")), r.withColumnRenamed("ok", "resolved"))
    return got.withColumn("ids", F.array_join("ids", ","))


@query("retry_replay", "SELECT user_id::VARCHAR AS instance_id, arg_max(event_type, event_id) AS status, count(*) - 1 AS retries FROM e GROUP BY user_id", e=EVENTS)
def retry_replay(e: DataFrame) -> DataFrame:
    attempts = e.select(F.col("user_id").cast("string").alias("instance_id"), F.col("event_id").alias("attempt"), F.col("event_type").alias("status"))
    return patches.last_attempts(attempts).select("instance_id", "status", "retries")


@query("worker_merge", "SELECT user_id::VARCHAR AS instance_id, arg_max(event_type, (event_id % 4, event_id)) AS prediction, count(*) AS n_rows FROM e GROUP BY user_id", e=EVENTS)
def worker_merge(e: DataFrame) -> DataFrame:
    rows = e.select((F.col("event_id") % 4).alias("worker"), F.col("event_id").alias("line_no"), F.col("user_id").cast("string").alias("instance_id"), F.col("event_type").alias("prediction"))
    return patches.merged_workers(rows)


@query(
    "completion_marker", "SELECT user_id, CASE WHEN NOT s THEN 'missing_summary' WHEN r IS NOT NULL THEN 'harness_results' WHEN e IS NOT NULL THEN 'harness_error' WHEN k IS NOT NULL THEN 'harness_skipped_reason' ELSE 'incomplete' END AS marker FROM u",
    u="SELECT user_id, user_id % 11 <> 0 AS s, CASE WHEN user_id % 2 = 0 THEN user_id END AS r, CASE WHEN user_id % 3 = 0 THEN 'bad' END AS e, CASE WHEN user_id % 5 = 0 THEN 'skip' END AS k FROM {events} GROUP BY user_id",
)
def completion_marker(u: DataFrame) -> DataFrame:
    return u.select("user_id", stats.completion_marker(*map(F.col, "reks")).alias("marker"))


@query(
    "cell_derivation",
    "WITH t AS (SELECT run_id, count(*) FILTER (patch_status = 'timeout_budget_exceeded' OR timeout_budget_exceeded) AS c FROM instances GROUP BY run_id) SELECT run_id, round(n_resolved / n_instances, 6) AS resolved_rate, coalesce(c, 0) AS timeout_count, coalesce(setup_tokens_method_accounted, retrieval_setup_tokens, 0) AS setup_tokens FROM runs LEFT JOIN t USING (run_id)",
    runs=CELL_RUNS.replace("CAST(1000 + k * 37 AS BIGINT) AS setup_tokens_method_accounted, CAST(NULL AS BIGINT) AS retrieval_setup_tokens", "CASE WHEN k % 4 = 0 THEN CAST(1000 + k * 37 AS BIGINT) END AS setup_tokens_method_accounted, CASE WHEN k % 4 = 1 THEN CAST(k AS BIGINT) END AS retrieval_setup_tokens"),
    instances=INSTANCES,
)
def cell_derivation(runs: DataFrame, instances: DataFrame) -> DataFrame:
    return _rounded(stats.cells(runs.drop("setup_tokens"), instances), "resolved_rate").select("run_id", "resolved_rate", "timeout_count", "setup_tokens")


@query("distinct_complete", "WITH " + STATUS + " SELECT count(DISTINCT (manifest, n_patched)) FILTER (status = 'complete') AS n_cells FROM st", r=STATES)
def distinct_complete(r: DataFrame) -> DataFrame:
    return telemetry.distinct_complete(_states(r).select("status", F.col("manifest").alias("repo"), F.col("n_patched").alias("method")))


@query("runs_in_progress", "SELECT run_id FROM a WHERE run_id NOT IN (SELECT run_id FROM b)", a="SELECT CAST(user_id AS STRING) AS run_id FROM {events} GROUP BY user_id", b="SELECT CAST(user_id AS STRING) AS run_id FROM {events} WHERE event_type = 'purchase' AND value > 50 GROUP BY user_id")
def runs_in_progress(a: DataFrame, b: DataFrame) -> DataFrame:
    return telemetry.in_progress(a, b).select("run_id")


@query(
    "recent_progress",
    """WITH o AS (SELECT run_id, ts, count(*) OVER (PARTITION BY run_id ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n_done, count(*) OVER (PARTITION BY run_id ORDER BY ts RANGE BETWEEN INTERVAL 30 MINUTE PRECEDING AND CURRENT ROW) AS n_recent FROM e)
    SELECT run_id, epoch_us(ts) AS ts_us, n_done, n_recent, round(CASE WHEN n_total IS NOT NULL THEN greatest(n_total - n_done, 0) * 1800 / n_recent END, 4) AS eta_s FROM o LEFT JOIN t USING (run_id)""",
    e="SELECT user_id % 5 AS run_id, CAST(ts AS TIMESTAMP) AS ts FROM {events}", t="SELECT user_id % 5 AS run_id, count(*) + user_id % 5 * 100 AS n_total FROM {events} WHERE user_id % 5 > 0 GROUP BY user_id % 5",
)
def recent_progress(e: DataFrame, t: DataFrame) -> DataFrame:
    got = telemetry.recent_progress(e, t)
    return got.select("run_id", F.unix_micros("ts").alias("ts_us"), "n_done", "n_recent", F.round("eta_s", 4).alias("eta_s"))


@query(
    "progress_eta", "SELECT user_id, (100000 - s)::DOUBLE AS elapsed_s, round(CASE WHEN 100000 - s > 120 AND d > 0 THEN (t - d) / (d / (100000 - s)) END, 4) AS eta_s FROM r",
    r="SELECT user_id, CASE WHEN user_id % 4 = 0 THEN 99950 ELSE min(event_id) % 5000 END AS s, count(*) % 5 AS d, count(*) AS t FROM {events} GROUP BY user_id",
)
def progress_eta(r: DataFrame) -> DataFrame:
    named = r.select("user_id", F.col("s").alias("started_ts"), F.col("d").alias("n_done"), F.col("t").alias("n_total"))
    return telemetry.progress(named, F.lit(100000)).select("user_id", "elapsed_s", F.round("eta_s", 4).alias("eta_s"))


@query("plan_totals", "SELECT event_type AS method, coalesce(sum(n), 0)::BIGINT AS n_planned, count(*) AS n_manifests, count(*) FILTER (n IS NULL) AS n_failed FROM m GROUP BY event_type", m="SELECT event_type, CASE WHEN event_id % 6 > 0 THEN event_id % 30 END AS n FROM {events}")
def plan_totals(m: DataFrame) -> DataFrame:
    return telemetry.plan_totals(m.select(F.col("event_type").alias("method"), F.col("n").alias("n_instances")))


@query("flattened_metrics", "SELECT user_id, round(avg(value), 6) AS value_mean, round(coalesce(stddev_samp(value), 0), 6) AS value_std, min(value) AS value_min, max(value) AS value_max FROM e GROUP BY user_id", e=EVENTS)
def flattened_metrics(e: DataFrame) -> DataFrame:
    v = F.col("value")
    m = F.struct(F.round(F.avg(v), 6).alias("mean"), F.round(F.coalesce(F.stddev_samp(v), F.lit(0.0)), 6).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"))
    return telemetry.flattened(e.groupBy("user_id").agg(m.alias("value")), ["value"])


POINTS = """SELECT CAST(user_id AS STRING) AS repo, event_type AS method, CASE WHEN user_id % 3 = 0 THEN CAST(sum(event_id) AS DOUBLE) / 8 END AS avg_total_amortized, CASE WHEN user_id % 4 <> 1 THEN CAST(sum(event_id) AS BIGINT) END AS total_cost_tokens, CAST(count(*) AS DOUBLE) AS avg_runtime_tokens,
CAST(max(event_id) AS BIGINT) AS setup_tokens, CASE WHEN user_id % 5 > 0 THEN user_id % 5 END AS n_issues, user_id % 2 AS n_issues_method, CAST(count(*) % 4 AS DOUBLE) / 4 AS mean_f1 FROM {events} GROUP BY user_id, event_type"""
POINT = """n AS (SELECT *, CASE WHEN coalesce(n_issues, 0) > 0 THEN n_issues ELSE n_issues_method END AS k FROM p),
c AS (SELECT *, coalesce(avg_total_amortized, CASE WHEN k > 0 THEN total_cost_tokens / k END, avg_runtime_tokens + CASE WHEN k > 0 THEN setup_tokens / k ELSE setup_tokens END) AS cost FROM n),
d AS (SELECT repo, method, round(cost, 4) AS cost, round(CASE WHEN mean_f1 > 0 THEN cost / mean_f1 END, 4) AS tokens_per_f1 FROM c)"""


def _points(p: DataFrame) -> DataFrame:
    return _rounded(telemetry.cost_points(p), "cost", "tokens_per_f1", places=4).select("repo", "method", "cost", "tokens_per_f1")


@query("cost_points", "WITH " + POINT + " SELECT * FROM d", p=POINTS)
def cost_points(p: DataFrame) -> DataFrame:
    return _points(p)


@query("cost_outliers", "WITH " + POINT + " SELECT repo, method, tokens_per_f1 FROM d WHERE tokens_per_f1 IS NOT NULL ORDER BY tokens_per_f1 DESC, repo, method LIMIT 20", p=POINTS)
def cost_outliers(p: DataFrame) -> DataFrame:
    return telemetry.cost_outliers(_points(p)).select("repo", "method", "tokens_per_f1")


TRACKS = "SELECT CAST(event_id AS STRING) AS run_id, event_type AS method, event_id AS n, CASE event_id % 4 WHEN 0 THEN ' strict' WHEN 1 THEN ' ' END AS evaluation_track, CASE WHEN event_id % 3 = 0 THEN 'snapshot' WHEN event_id % 3 = 1 THEN '' END AS amortization_track, CASE WHEN event_id % 5 > 0 THEN 'SWE-bench' END AS benchmark, CASE event_id % 7 WHEN 0 THEN '' WHEN 1 THEN 'testing' END AS domain, concat('r', user_id % 3) AS repo FROM {events}"
TRACK = "k AS (SELECT *, coalesce(nullif(trim(evaluation_track), ''), nullif(trim(amortization_track), ''), '') AS track FROM r)"


@query("stale_filter", "WITH " + TRACK + " SELECT run_id, track FROM k WHERE track <> ''", r=TRACKS)
def stale_filter(r: DataFrame) -> DataFrame:
    return telemetry.without_stale(r).select("run_id", "track")


@query("run_filters", "WITH " + TRACK + " SELECT run_id FROM k WHERE coalesce(nullif(benchmark, ''), 'other') = 'other' AND coalesce(nullif(domain, ''), 'library') = 'library' AND coalesce(nullif(track, ''), 'unknown') = 'unknown' AND repo <> ''", r=TRACKS)
def run_filters(r: DataFrame) -> DataFrame:
    return telemetry.filtered(r.withColumn("track", telemetry.effective_track()), "other", "library", "unknown").select("run_id")


@query("comparison_rows", "SELECT run_id, method, n FROM r", r=TRACKS)
def comparison_rows(r: DataFrame) -> DataFrame:
    return telemetry.comparison_rows(r.select("run_id", "method", "n"))


@query("newest_runs", "SELECT run_id FROM r WHERE n % 3 <> 0 ORDER BY run_id DESC LIMIT 25", r=TRACKS)
def newest_runs(r: DataFrame) -> DataFrame:
    return telemetry.newest_runs(r.withColumn("has_summary", F.col("n") % 3 != 0), 25).select("run_id")


@query("remaining_methods", "SELECT repo, method FROM (SELECT DISTINCT repo FROM r), (SELECT DISTINCT method FROM r) EXCEPT SELECT repo, method FROM r WHERE n % 9 = 0", r="SELECT event_id AS n, event_type AS method, concat('r', user_id) AS repo FROM {events}")
def remaining_methods(r: DataFrame) -> DataFrame:
    plan = r.select("repo").distinct().crossJoin(F.broadcast(r.select("method").distinct()))
    return telemetry.remaining(plan, r.withColumn("n_success", F.when(F.col("n") % 9 == 0, 1).otherwise(0)))


@query(
    "tool_stop_reasons", "SELECT method, sum(c)::BIGINT AS n, arg_max(reason, (c, reason)) AS top_stop_reason FROM (SELECT method, reason, sum(k) AS c FROM t GROUP BY ALL) GROUP BY method",
    t="SELECT concat('u', user_id % 9) AS method, event_type AS reason, event_id % 4 AS k FROM {events}",
)
def tool_stop_reasons(t: DataFrame) -> DataFrame:
    return telemetry.top_stop_reason(t.select("method", F.col("reason").alias("stop_reason"), F.col("k").alias("n")))


PROFILE = "SELECT event_type AS method, user_id AS run, CAST(max(event_id) AS DOUBLE) AS setup_tokens, CAST(sum(event_id) AS DOUBLE) AS llm_tokens, CAST(count(*) AS DOUBLE) AS query_tokens, CASE WHEN user_id % 4 > 0 THEN count(*) ELSE 0 END AS n_issues, CAST(avg(event_id) AS DOUBLE) AS avg_total_unamortized, CAST(count(*) % 5 AS DOUBLE) / 5 AS mean_f1, CASE WHEN user_id % 3 > 0 THEN CAST(user_id % 3 AS DOUBLE) END AS setup_time_s FROM {events} GROUP BY event_type, user_id"


@query(
    "token_breakdown",
    """SELECT method, round(avg(setup_tokens), 4) AS setup_tokens, round(avg(llm_tokens / CASE WHEN n_issues > 0 THEN n_issues ELSE 1 END), 4) AS llm_per_issue, round(avg(query_tokens / CASE WHEN n_issues > 0 THEN n_issues ELSE 1 END), 4) AS query_per_issue,
    round(avg(avg_total_unamortized), 4) AS total_per_issue, round(avg(setup_time_s), 4) AS setup_time_s, round(avg(mean_f1), 4) AS mean_f1 FROM p GROUP BY method""",
    p=PROFILE,
)
def token_breakdown(p: DataFrame) -> DataFrame:
    t = telemetry.token_breakdown(p)
    return _rounded(t, *[c for c in t.columns if c != "method"], places=4)


@query("setup_scaling", "SELECT method, run, setup_tokens, n_issues, round(CASE WHEN n_issues > 0 THEN setup_tokens / n_issues END, 4) AS setup_per_issue FROM p", p=PROFILE)
def setup_scaling(p: DataFrame) -> DataFrame:
    return _rounded(telemetry.setup_scaling(p), "setup_per_issue", places=4)


@query("cost_reduction", "SELECT a.repo, a.method, round(CASE WHEN b.cost > 0 THEN a.cost / b.cost END, 6) AS factor FROM g a JOIN g b ON a.repo = b.repo AND a.method = b.method WHERE a.track = 'strict' AND b.track = 'snapshot'",
       g="SELECT CASE o_orderkey % 2 WHEN 0 THEN 'strict' ELSE 'snapshot' END AS track, CAST(o_custkey % 10 AS STRING) AS repo, o_orderpriority AS method, CAST(count(*) AS DOUBLE) AS cost FROM {orders} GROUP BY o_orderkey % 2, o_custkey % 10, o_orderpriority")
def cost_reduction(g: DataFrame) -> DataFrame:
    return _rounded(telemetry.cost_reduction(g, "strict", "snapshot"), "factor")


@query(
    "latest_none_runs", "SELECT repo, run_id, marker FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY run_id DESC) AS k FROM (SELECT *, CASE WHEN r IS NOT NULL THEN 'harness_results' ELSE 'incomplete' END AS marker FROM u WHERE method = 'none')) WHERE k = 1",
    u="SELECT concat('r', user_id % 9) AS repo, CASE WHEN event_id % 2 = 0 THEN 'none' ELSE event_type END AS method, concat('20260', event_id) AS run_id, CASE WHEN event_id % 3 = 0 THEN event_id END AS r FROM {events}",
)
def latest_none_runs(u: DataFrame) -> DataFrame:
    """The newest run without retrieval of each repository, and how far it is."""
    none = F.lit(None).cast("string")
    return telemetry.latest(u.where("method = 'none'"), ["repo"], "run_id").select("repo", "run_id", stats.completion_marker(F.col("r"), none, none, F.lit(True)).alias("marker"))


@query("holdout_deltas", "SELECT s.config_id, repo, round(s.score - b.score, 6) AS delta FROM s JOIN b USING (repo)",
       s="SELECT p_brand AS config_id, CAST(p_size % 4 AS STRING) AS repo, avg(p_retailprice) AS score FROM {part} GROUP BY p_brand, p_size % 4", b="SELECT CAST(p_size % 4 AS STRING) AS repo, avg(p_retailprice) AS score FROM {part} WHERE p_size % 4 > 0 GROUP BY p_size % 4")
def holdout_deltas(s: DataFrame, b: DataFrame) -> DataFrame:
    return _rounded(tuning.holdout_deltas(s, b), "delta")


@query("tuning_repeats", "SELECT config_id, round(avg(f1), 6) AS mean_f1, round(stddev_pop(f1), 6) AS f1_std, round(avg(tokens), 6) AS runtime_tokens FROM s GROUP BY config_id", s="SELECT p_brand AS config_id, p_size AS repeat, CAST(p_partkey % 101 AS DOUBLE) / 100 AS f1, p_retailprice AS tokens FROM {part}")
def tuning_repeats(s: DataFrame) -> DataFrame:
    return _rounded(tuning.repeats_of(s), "mean_f1", "f1_std", "runtime_tokens")


@query(
    "tuning_protocol",
    """WITH m AS (SELECT config_id, avg(f1) AS mean_f1, stddev_pop(f1) AS f1_std, avg(tokens) AS tokens FROM s WHERE stage = 0 GROUP BY config_id), top AS (SELECT config_id FROM m ORDER BY mean_f1 DESC, f1_std, tokens, config_id LIMIT 3),
    f AS (SELECT config_id, avg(f1) AS mean_f1, stddev_pop(f1) AS f1_std, avg(tokens) AS tokens FROM s SEMI JOIN top USING (config_id) WHERE stage = 1 GROUP BY config_id), h AS (SELECT config_id, repo, avg(f1) AS score FROM s SEMI JOIN top USING (config_id) WHERE stage = 2 GROUP BY ALL),
    g AS (SELECT config_id, bool_and(coalesce(h.score >= b.score - 0.03, false)) AS passes FROM top CROSS JOIN b LEFT JOIN h USING (config_id, repo) GROUP BY config_id),
    k AS (SELECT config_id, coalesce(passes, false) AS passes, row_number() OVER (ORDER BY mean_f1 DESC, f1_std, tokens, config_id) AS rank FROM f LEFT JOIN g USING (config_id)) SELECT config_id, passes, rank::INT AS rank, coalesce(rank = (SELECT min(rank) FROM k WHERE passes), false) AS selected FROM k""",
    s="SELECT p_brand AS config_id, CAST(p_partkey % 3 AS INT) AS stage, CAST(p_size % 2 AS STRING) AS repo, CAST(p_partkey % 97 AS DOUBLE) / 96 AS f1, p_retailprice AS tokens FROM {part}",
    b="SELECT CAST(p_size % 2 AS STRING) AS repo, avg(CAST(p_partkey % 97 AS DOUBLE) / 96) AS score FROM {part} WHERE p_partkey % 3 = 2 GROUP BY p_size % 2",
)
def tuning_protocol(s: DataFrame, b: DataFrame) -> DataFrame:
    """M6: coarse scores choose the candidates, repeats rank them, the holdout guards the choice."""
    return tuning.protocol(s.where("stage = 0"), s.where("stage = 1"), s.where("stage = 2").groupBy("config_id", "repo").agg(F.avg("f1").alias("score")), b, 3).select("config_id", "passes", "rank", "selected")


@fixed("tuning_candidates", "config_id, n_problems, total, largest_in_range, n_weights", [(f"cfg-{k:04d}", 0, 1.0, True, 5) for k in range(1, 61)])
def tuning_candidates(spark: SparkSession) -> DataFrame:
    """M1, M2, M7: what holds of every candidate, whatever was drawn."""
    rows = [(c.config_id, len(c.problems()), round(sum(c.weights.values()), 9), max(c.weights.values()) <= tuning.LARGEST_WEIGHT, len(c.weights)) for c in tuning.candidates(60, 17)]
    return spark.createDataFrame(rows, "config_id string, n_problems int, total double, largest_in_range boolean, n_weights int")


@fixed("config_validation", "setting, fault", [
    ("depth=0", "depth must be at least 1"), ("hub_scale=-1", "hub_scale must not be negative"), ("sem=0.8", "weight sem must be in 0..0.7; weights must sum to 1"), ("speed=1", "unknown settings: ['speed']"), ("weights=0.5,0.5", None),
])
def config_validation(spark: SparkSession) -> DataFrame:
    rows = []
    for name, values in {"depth=0": {"depth": 0}, "hub_scale=-1": {"hub_scale": -1}, "sem=0.8": {"weights": {"sem": 0.8}}, "speed=1": {"speed": 1}, "weights=0.5,0.5": {"weights": {"sem": 0.5, "graph": 0.5}}}.items():
        try:
            tuning.checked("c", **values)
            rows.append((name, None))
        except ValueError as e:
            rows.append((name, str(e)))
    return spark.createDataFrame(rows, "setting string, fault string")


@query(
    "base_methods", "SELECT doc_id::VARCHAR AS instance_id, 'none' AS method, '' AS files FROM d UNION ALL SELECT doc_id::VARCHAR, 'oracle', CASE doc_id % 3 WHEN 0 THEN 'p/x.py' WHEN 1 THEN 'g.py,h.py' ELSE '' END FROM d",
    d="SELECT doc_id FROM {documents}",
)
def base_methods(d: DataFrame) -> DataFrame:
    """nothing, and the files that the patch or the gold list names."""
    k = F.col("doc_id") % 3
    issues = d.select(
        F.col("doc_id").cast("string").alias("instance_id"), F.when(k == 0, "diff --git a/o.py b/./p/x.py").otherwise("").alias("patch"),
        F.when(k < 2, F.array(F.lit("./g.py"), F.lit("h.py"), F.lit("g.py"))).alias("gold_files"),
    )
    r = Registry()
    both = [r.run(m, issues).select("instance_id", F.lit(m).alias("method"), F.array_join("files", ",").alias("files")) for m in ("none", "oracle")]
    return both[0].unionByName(both[1])


@fixed("campaign_states", "run, step, state", [("first", "a", "done"), ("first", "b", "failed"), ("first", "c", "pending"), ("again", "a", "done"), ("again", "b", "done"), ("again", "c", "done")])
def campaign_states(spark: SparkSession) -> DataFrame:
    """A failure stops the campaign, a resumed one goes on from there."""
    import tempfile

    tries: list[int] = []

    def flaky() -> None:
        tries.append(1)
        if len(tries) == 1:
            raise RuntimeError

    steps = [("a", lambda: None), ("b", flaky), ("c", lambda: None)]
    with tempfile.TemporaryDirectory() as folder:  # the driver's own state file
        rows = [(run, *x) for run in ("first", "again") for x in campaign.run_campaign(steps, f"{folder}/state.json").items()]
    return spark.createDataFrame(rows, "run string, step string, state string")


@fixed("grouped_jobs", "repo, jobs", [("x", "1,3"), ("y", "2")])
def grouped_jobs(spark: SparkSession) -> DataFrame:
    """One after the other within a repository."""
    done = campaign.by_repository([("x", lambda: 1), ("y", lambda: 2), ("x", lambda: 3)])
    return spark.createDataFrame([(r, ",".join(map(str, v))) for r, v in done.items()], "repo string, jobs string")


@fixed("retry_calls", "kind, tries, outcome", [("transient", 3, "ok"), ("lasting", 5, "OSError"), ("other", 1, "KeyError")])
def retry_calls(spark: SparkSession) -> DataFrame:
    """Only transient failures are tried again, and not for ever."""

    def outcome(kind: str, fails: int, error: type[Exception]) -> tuple[str, int, str]:
        tries: list[int] = []

        def call() -> str:
            tries.append(1)
            if len(tries) <= fails:
                raise error
            return "ok"

        try:
            said = with_retries(call, [OSError], sleep=lambda _: None)
        except Exception as e:  # noqa: BLE001  its name is the result
            said = type(e).__name__
        return kind, len(tries), said

    return spark.createDataFrame([outcome("transient", 2, OSError), outcome("lasting", 99, OSError), outcome("other", 99, KeyError)], "kind string, tries int, outcome string")


@query("provenance", "SELECT count(*) AS n_lines, sha256(string_agg(t, chr(10) ORDER BY t)) AS manifest_sha256 FROM m", m="SELECT DISTINCT CAST(user_id AS STRING) AS t FROM {events}")
def provenance(m: DataFrame) -> DataFrame:
    """N8 of a manifest that lists the users of all events."""
    return campaign.manifest_digest(m, "t")


@query("run_discovery", "SELECT DISTINCT concat('run=', user_id % 8) AS run_id FROM e", e=EVENTS)
def run_discovery(e: DataFrame) -> DataFrame:
    """L1: run folders below any `patch_runs`; clones beside them are not walked."""
    spark, root = e.sparkSession, new_path(e.sparkSession, "discovery")
    rows = e.select((F.col("user_id") % 8).alias("run"), "event_id")
    rows.write.partitionBy("run").parquet(f"{root}/a/patch_runs")
    rows.write.partitionBy("run").parquet(f"{root}/_repos/patch_runs")
    return runs.discovered(spark, root).select("run_id")


@query("split_rows", "SELECT instance_id, repo, split FROM (SELECT *, row_number() OVER (PARTITION BY instance_id ORDER BY s, n) AS k FROM (SELECT 'i' || (doc_id % 700) AS instance_id, 'r' || doc_id % 2 AS repo, CASE WHEN doc_id % 5 = 0 THEN 'test' ELSE 'train' END AS split, CASE WHEN doc_id % 5 = 0 THEN 0 ELSE 1 END AS s, doc_id AS n FROM d) WHERE repo = 'r1') WHERE k = 1",
       d="SELECT doc_id FROM {documents}")
def split_rows(d: DataFrame) -> DataFrame:
    """A3: the splits that are there, one repository, of one id the first row."""
    spark, root = d.sparkSession, new_path(d.sparkSession, "splits")
    rows = d.orderBy("doc_id").select(F.concat(F.lit("i"), F.col("doc_id") % 700).alias("id"), F.concat(F.lit("r"), F.col("doc_id") % 2).alias("repo"), (F.col("doc_id") % 5 == 0).alias("t"))
    for split, part in (("test", rows.where("t")), ("train", rows.where("NOT t"))):
        part.drop("t").write.parquet(f"{root}/{split}.parquet")
    return datasets.load_splits(spark, root, "SWE-x", "r1").select("instance_id", "repo", "split")


