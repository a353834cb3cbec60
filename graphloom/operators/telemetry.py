"""Run telemetry and report tables (L), run selection for orchestration (N)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.ranges import best_before

STALE_MINUTES, GRACE_MINUTES, ETA_AFTER_S = 15.0, 30.0, 120.0
CONFIG_KEY = ("run_type", "repo_name", "dataset_name", "issue_set_id", "track", "snapshot_commit", "n_issues_evaluated", "source_prefixes")


def latest(rows: DataFrame, by: Sequence[str], order: str) -> DataFrame:
    """Each group's row that is last in `order`; rows are compared map-side, so no group is gathered."""
    rest = [c for c in rows.columns if c not in by]
    return rows.groupBy(*by).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*by, "_r.*")


def latest_successful(runs: DataFrame) -> DataFrame:
    return latest(runs.where("n_success > 0"), ["repo", "method"], "run_id")


def partial_stats(checkpoints: DataFrame) -> DataFrame:
    """L2: of `checkpoints(run_id, instance_id, ord, patch_status)` the last of each instance, counted by run."""
    last = checkpoints.groupBy("run_id", "instance_id").agg(F.max_by("patch_status", "ord").alias("s"))
    return last.groupBy("run_id").agg(
        F.count("*").alias("n_completed"), F.count_if(F.col("s") == "patched").alias("n_patched"), F.count_if(F.col("s") == "apply_failed").alias("n_apply_failed")
    )


def run_status(has_summary: Column, n_completed: Column, age: Column, seen_age: Column, pid_alive: Column, stale: float = STALE_MINUTES) -> Column:
    """L3: complete, stalled, not_started or running; ages in minutes, pid_alive null where no process is known."""
    dead = F.coalesce(~pid_alive, F.lit(False))
    old = lambda a: F.coalesce(a > stale, F.lit(False))
    idle = F.when(dead | old(seen_age), "stalled").otherwise("not_started")
    return F.when(has_summary, "complete").when(n_completed == 0, idle).when(old(age) | dead, "stalled").otherwise("running")


def freshest_attempts(runs: DataFrame) -> DataFrame:
    """L4: of each manifest the freshest complete and the freshest unfinished run."""
    done = F.col("status") == "complete"
    w = Window.partitionBy("manifest", done).orderBy(F.col("last_seen_ts").desc(), F.col("run_id").desc())
    return runs.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def visible(runs: DataFrame, active_only: bool = False, complete: bool = True, stalled: bool = True, grace: float = GRACE_MINUTES) -> DataFrame:
    """Complete and stalled runs as asked for. One that has not started shows while it is new; where stalled ones show and
    not only active ones are asked for, whatever its age.
    """
    new = F.coalesce(F.col("seen_age") <= grace, F.lit(False))
    pending = new if active_only or not stalled else F.lit(True)
    status = F.col("status")
    other = F.lit(not active_only) & ~status.isin("running", "complete", "stalled", "not_started")
    return runs.where(
        (status == "running") | (status == "complete") & F.lit(complete) | (status == "stalled") & F.lit(stalled) | (status == "not_started") & pending | other
    )


def status_summary(runs: DataFrame) -> DataFrame:
    """L6."""
    count = lambda s: F.count_if(F.col("status") == s).alias(f"n_{s}")
    return runs.agg(
        F.count("*").alias("n_runs"), *map(count, ("complete", "running", "stalled", "not_started")),
        F.sum("n_completed").alias("n_completed"), F.sum("n_patched").alias("n_patched"),
        F.try_divide(F.sum("n_patched").cast("double"), F.sum("n_completed")).alias("patch_rate"),
    )


def distinct_complete(runs: DataFrame) -> DataFrame:
    """L7."""
    return runs.where("status = 'complete'").agg(F.count_distinct("repo", "method").alias("n_cells"))


def densified(rows: DataFrame, left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """`rows` for every pair of two small key tables, blank where there is none."""
    return left.crossJoin(right).join(rows, list(on), "left")


def in_progress(started: DataFrame, finished: DataFrame) -> DataFrame:
    """Runs with a graph and without a summary."""
    return started.join(finished.select("run_id"), "run_id", "left_anti")


def progress(runs: DataFrame, now: Column) -> DataFrame:
    """Elapsed seconds and those left; no estimate in the first minutes."""
    spent = (now - F.col("started_ts")).cast("double")
    left = (F.col("n_total") - F.col("n_done")) / F.try_divide(F.col("n_done"), spent)
    return runs.withColumns({"elapsed_s": spent, "eta_s": F.when((spent > ETA_AFTER_S) & (F.col("n_done") > 0), left)})


def recent_progress(done: DataFrame, totals: DataFrame, minutes: int = 30) -> DataFrame:
    """L10 over time: `run_id, ts, n_done, n_recent, eta_s` at each row of `done(run_id, ts)`, against `totals(run_id, n_total)`.

    What was completed in the last `minutes` gives the rate, so that a run that slows or rests is told at once. Rows of one time count alike.
    """
    frame = f"(PARTITION BY run_id ORDER BY ts RANGE BETWEEN INTERVAL '{minutes}' MINUTE PRECEDING AND CURRENT ROW)"
    every = "(PARTITION BY run_id ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    rows = done.where("ts IS NOT NULL").select("run_id", F.col("ts").cast("timestamp").alias("ts")).withColumns({"n_done": F.expr(f"count(*) OVER {every}"), "n_recent": F.expr(f"count(*) OVER {frame}")})
    rows = rows.join(totals.select("run_id", "n_total"), "run_id", "left")
    left = F.when(F.col("n_total").isNotNull(), F.greatest(F.col("n_total") - F.col("n_done"), F.lit(0)))
    return rows.select("run_id", "ts", "n_done", "n_recent", (left * F.lit(60.0 * minutes) / F.col("n_recent")).alias("eta_s"))


def plan_totals(manifests: DataFrame) -> DataFrame:
    """Planned instances and unreadable manifests by method."""
    return manifests.groupBy("method").agg(F.sum(F.coalesce("n_instances", F.lit(0))).alias("n_planned"), F.count("*").alias("n_manifests"), F.count_if(F.col("n_instances").isNull()).alias("n_failed"))


def flattened(rows: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Struct columns of mean, std, min, max as columns of their own."""
    rest = [c for c in rows.columns if c not in metrics]
    return rows.select(*rest, *(F.col(f"{m}.{x}").alias(f"{m}_{x}") for m in metrics for x in ("mean", "std", "min", "max")))


def cost_points(rows: DataFrame) -> DataFrame:
    """`rows` with `cost` for an issue and `tokens_per_f1`, null without F1.

    Cost is the amortised average, or else the total over the issues, or else the runtime's average and the setup's share.
    Issues are the run's, or else the method's.
    """
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("double")
    n = F.when(zero("n_issues") > 0, zero("n_issues")).otherwise(zero("n_issues_method"))
    share = F.when(n > 0, zero("setup_tokens") / n).otherwise(zero("setup_tokens"))
    cost = F.coalesce(F.col("avg_total_amortized").cast("double"), F.when(n > 0, F.col("total_cost_tokens") / n), zero("avg_runtime_tokens") + share)
    f1 = zero("mean_f1")
    return rows.withColumn("cost", cost).withColumn("tokens_per_f1", F.when(f1 > 0, F.col("cost") / f1))


def pareto(points: DataFrame, cost: str = "cost", quality: str = "quality", by: Sequence[str] = ()) -> DataFrame:
    """Points that none beats in one respect and equals or beats in the other; equal points all stay.

    A scan in the order of cost with the best quality so far, instead of comparing all pairs; without groups, a scan of each
    range of costs.
    """
    cheapest = points.groupBy(*by, cost).agg(F.max(quality).alias("_q"))
    if by:
        w = Window.partitionBy(*by).orderBy(cost).rowsBetween(Window.unboundedPreceding, -1)
        cheapest = cheapest.withColumn("_best", F.max("_q").over(w))
    else:
        cheapest = best_before(cheapest, cost, "_q", "pareto")
    best = cheapest.where("_best IS NULL OR _q > _best")
    return points.join(best.select(*by, cost, F.col("_q").alias(quality)), [*by, cost, quality], "left_semi")


def without_covered(runs: DataFrame, aggregates: DataFrame) -> DataFrame:
    """Runs that no aggregate lists."""
    return runs.join(aggregates.select(F.explode("run_ids").alias("run_id")).distinct(), "run_id", "left_anti")


def effective_track(own: Column | str = "evaluation_track", amortization: Column | str = "amortization_track") -> Column:
    """The run's own track, or else its amortisation's; empty if it has none."""
    of = lambda c: F.nullif(F.trim(F.col(c) if isinstance(c, str) else c), F.lit(""))
    return F.coalesce(of(own), of(amortization), F.lit(""))


def without_stale(runs: DataFrame) -> DataFrame:
    """Runs with a track, from their own data or the amortisation's."""
    return runs.withColumn("track", effective_track()).where("track <> ''")


def superseded(runs: DataFrame, key: Sequence[str] = CONFIG_KEY, order: Sequence[str] = ("created_at", "run_id")) -> DataFrame:
    """The newest run of each configuration; a missing part of the key counts as empty, and as 0 for a number."""
    kinds = dict(runs.dtypes)
    blank = lambda c: F.array().cast(kinds[c]) if kinds[c].startswith("array") else F.lit("" if kinds[c] == "string" else 0).cast(kinds[c])
    w = Window.partitionBy(*(F.coalesce(F.col(c), blank(c)) for c in key)).orderBy(*(F.col(c).desc_nulls_last() for c in order))
    return runs.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def regime_shift(rows: DataFrame, first: str, second: str, limit: int = 20) -> DataFrame:
    """What changes between two tracks of one repository, dataset, set of issues and method, the largest change of F1 first."""
    cell = ["repo", "dataset", "issue_set", "method"]
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    blank = [F.coalesce(c, F.lit("")).alias(c) for c in cell]
    of = lambda t, x: rows.where(F.col("track") == t).select(*blank, zero("f1").alias(f"{x}_f1"), zero("cost").alias(f"{x}_cost"))
    j = of(first, "a").join(of(second, "b"), cell)
    j = j.select(*cell, (F.col("b_f1") - F.col("a_f1")).alias("d_f1"), (F.col("b_cost") - F.col("a_cost")).alias("d_cost"))
    return j.orderBy(F.abs("d_f1").desc(), *cell).limit(limit)


def cost_outliers(points: DataFrame, limit: int = 20) -> DataFrame:
    """L20."""
    return points.where("tokens_per_f1 IS NOT NULL").orderBy(F.col("tokens_per_f1").desc(), "repo", "method").limit(limit)


def tool_rollup(calls: DataFrame) -> DataFrame:
    """Of `calls(method, tool, n_calls, n_hits)` the sums and the tool used most."""
    t = calls.groupBy("method", "tool").agg(F.sum("n_calls").alias("c"), F.sum("n_hits").alias("h"))
    return t.groupBy("method").agg(F.sum("c").alias("n_calls"), F.sum("h").alias("n_hits"), F.max_by("tool", F.struct("c", "tool")).alias("top_tool"))


def top_stop_reason(stops: DataFrame) -> DataFrame:
    """Of `stops(method, stop_reason, n)` the sum and the commonest reason."""
    t = stops.groupBy("method", "stop_reason").agg(F.sum("n").alias("c"))
    return t.groupBy("method").agg(F.sum("c").alias("n"), F.max_by("stop_reason", F.struct("c", "stop_reason")).alias("top_stop_reason"))


def token_breakdown(summaries: DataFrame) -> DataFrame:
    """By method the runs' means of setup, of model and query tokens for an issue, of totals, seconds of setup and F1."""
    n = F.when(F.col("n_issues") > 0, F.col("n_issues")).otherwise(1)
    return summaries.groupBy("method").agg(
        F.avg("setup_tokens").alias("setup_tokens"), F.avg(F.col("llm_tokens") / n).alias("llm_per_issue"), F.avg(F.col("query_tokens") / n).alias("query_per_issue"),
        F.avg("avg_total_unamortized").alias("total_per_issue"), F.avg(F.when(F.col("setup_time_s") > 0, F.col("setup_time_s"))).alias("setup_time_s"), F.avg("mean_f1").alias("mean_f1"),
    )


def setup_scaling(summaries: DataFrame) -> DataFrame:
    """Each run's setup beside its number of issues."""
    each = F.when(F.col("n_issues") > 0, F.col("setup_tokens") / F.col("n_issues"))
    return summaries.select("method", "run", "setup_tokens", "n_issues", each.alias("setup_per_issue"))


def cost_reduction(rows: DataFrame, first: str, second: str) -> DataFrame:
    """How many times the second track's cost the first one's is."""
    of = lambda t, x: rows.where(F.col("track") == t).select("repo", "method", F.col("cost").alias(x))
    return of(first, "a").join(of(second, "b"), ["repo", "method"]).select("repo", "method", F.when(F.col("b") > 0, F.col("a") / F.col("b")).alias("factor"))


def best_per_group(rows: DataFrame, by: Sequence[str], value: str, name: str, order: str) -> DataFrame:
    """The name with the largest value; of equal ones the first in order."""
    return rows.groupBy(*by).agg(F.max_by(name, F.struct(value, -F.col(order))).alias("best"), F.max(value).alias("best_value"))


def costliest(rows: DataFrame, by: Sequence[str], cost: str, tie: str, k: int = 5) -> DataFrame:
    """L23."""
    w = Window.partitionBy(*by).orderBy(F.col(cost).desc(), tie)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def comparison_rows(summaries: DataFrame) -> DataFrame:
    """L24."""
    return summaries.orderBy("run_id", "method")


def filtered(runs: DataFrame, benchmark: str = "all", domain: str = "all", track: str = "all", repo: str = "all") -> DataFrame:
    """By equality of columns that fall back to "other", "library" and "unknown"."""
    for column, value, default in (("benchmark", benchmark, "other"), ("domain", domain, "library"), ("track", track, "unknown"), ("repo", repo, "unknown")):
        if value != "all":
            runs = runs.where(F.coalesce(F.nullif(column, F.lit("")), F.lit(default)) == value)
    return runs


def error_table(rows: DataFrame) -> DataFrame:
    """L26."""
    rate = F.coalesce(F.col("error_rate"), F.try_divide(F.col("n_errors").cast("double"), F.col("n_issues")), F.lit(0.0))
    return rows.select("method", F.coalesce("n_errors", F.lit(0)).alias("n_errors"), rate.alias("error_rate"))


def newest_runs(runs: DataFrame, n: int) -> DataFrame:
    """L29."""
    return runs.where("has_summary").orderBy(F.col("run_id").desc()).limit(n)


def completed_methods(runs: DataFrame) -> DataFrame:
    """Methods that any run of the repository has finished."""
    return runs.where("n_success > 0").select("repo", "method").distinct()


def remaining(plan: DataFrame, runs: DataFrame) -> DataFrame:
    return plan.join(completed_methods(runs), ["repo", "method"], "left_anti")


def resumable(runs: DataFrame) -> DataFrame:
    """Each manifest's latest unfinished run, where none is complete."""
    done = runs.where("status = 'complete'").select("manifest").distinct()
    return latest(runs.join(done, "manifest", "left_anti"), ["manifest"], "last_seen_ts")
