"""Evaluation and cost aggregation (H), repeats (I)."""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators import ranges

NO_COMMIT = "__NO_BASE_COMMIT__"
METRICS = ("precision", "recall", "f1")


def file_metrics(gold: Column | str, predicted: Column | str) -> Column:
    """H1: struct of precision, recall, f1 over sets, and skipped_empty_gold."""
    none = F.array().cast("array<string>")
    g, p = (F.array_distinct(F.coalesce(F.col(c) if isinstance(c, str) else c, none)) for c in (gold, predicted))
    hit = F.size(F.array_intersect(g, p)).cast("double")
    prec = F.coalesce(F.try_divide(hit, F.size(p)), F.lit(0.0))
    rec = F.coalesce(F.try_divide(hit, F.size(g)), F.lit(0.0))
    return F.struct(
        prec.alias("precision"), rec.alias("recall"), F.coalesce(F.try_divide(2 * prec * rec, prec + rec), F.lit(0.0)).alias("f1"),
        (F.size(g) == 0).alias("skipped_empty_gold"),
    )


def commit_groups(issues: DataFrame, order: str = "ord") -> DataFrame:
    """H2: `base_commit, first_seen, n_issues, pos` in the order of first appearance; null is a group of its own."""
    g = issues.groupBy("base_commit").agg(F.min(order).alias("first_seen"), F.count("*").alias("n_issues"))
    return g.withColumn("pos", F.row_number().over(Window.orderBy("first_seen")))


def track_groups(issues: DataFrame, track: str, pinned: str | None = None, order: str = "ord") -> DataFrame:
    """H3: `issues` with `used_commit`: their own commit, or for "same_snapshot" the pinned or the first one."""
    if track != "same_snapshot":
        return issues.withColumn("used_commit", F.col("base_commit"))
    first = issues.agg(F.min_by("base_commit", order).alias("_first"))
    chosen = F.lit(pinned) if pinned else F.col("_first")
    return issues.crossJoin(F.broadcast(first)).withColumn("used_commit", chosen).drop("_first")


def required_nonempty(counts: DataFrame, required: Sequence[str]) -> DataFrame:
    """H4: `counts(index, n)`; fails when run if a required index is missing or empty."""
    want = counts.sparkSession.createDataFrame([(r,) for r in required], "index string")
    n = F.coalesce("n", F.lit(0))
    said = F.concat(F.lit("empty index: "), F.col("index"))
    return want.join(counts, "index", "left").select("index", n.alias("n"), F.when(n == 0, F.raise_error(said)).alias("failed"))


def normalized_usage(usage: DataFrame) -> DataFrame:
    """H5: missing counts are 0; query embedding tokens fall back to embedding tokens."""
    have = set(usage.columns)
    of = lambda *names: F.coalesce(*(F.col(n) for n in names if n in have), F.lit(0)).cast("long")
    return usage.withColumns({
        "prompt_tokens": of("prompt_tokens"), "candidate_tokens": of("candidate_tokens"), "total_tokens": of("total_tokens"),
        "query_embedding_tokens": of("query_embedding_tokens", "embedding_tokens"),
    })


def cost_components(rows: DataFrame) -> DataFrame:
    """H6: setup + model + query."""
    return rows.withColumn("cost_tokens", F.col("setup_tokens") + F.col("llm_tokens") + F.col("query_embedding_tokens"))


def with_error_results(issues: DataFrame, methods: DataFrame, results: DataFrame) -> DataFrame:
    """H7: a row for each issue and method; a missing or failed result counts zero."""
    grid = issues.select("instance_id").crossJoin(methods.select("method"))
    rows = grid.join(results, ["instance_id", "method"], "left")
    failed = F.col("error").isNotNull() | F.col("f1").isNull()
    zero = {m: F.when(failed, 0.0).otherwise(F.col(m)) for m in METRICS}
    return rows.withColumns(zero | {"failed": failed, "total_tokens": F.coalesce("total_tokens", F.lit(0)), "query_embedding_tokens": F.coalesce("query_embedding_tokens", F.lit(0))})


def merged_usage(usage: DataFrame, by: Sequence[str], order: str, numbers: Sequence[str], last: Sequence[str] = ()) -> DataFrame:
    """H8: numbers summed, other fields' last non-null value."""
    return usage.groupBy(*by).agg(
        *(F.sum(F.coalesce(n, F.lit(0))).alias(n) for n in numbers), *(F.max_by(x, F.when(F.col(x).isNotNull(), F.col(order))).alias(x) for x in last)
    )


def merged_maps(usage: DataFrame, by: Sequence[str], field: str) -> DataFrame:
    """H8 for a map of counts: summed by key."""
    each = usage.select(*by, F.explode(field).alias("k", "v")).groupBy(*by, "k").agg(F.sum("v").alias("v"))
    return each.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias(field))


def method_summary(issues: DataFrame, methods: DataFrame, results: DataFrame, setup: DataFrame) -> DataFrame:
    """One row per method, over all issues: a missing or failed result counts zero.

    `setup(method, setup_tokens)` may have `build_time_s`, results may have `prompt_tokens` and `candidate_tokens`. A method's
    setup is paid once: the unamortised average charges every issue with all of it, the amortised one with its share.
    """
    rows = with_error_results(issues, methods, results)
    n = F.count("*")
    s = rows.groupBy("method").agg(
        n.alias("n_issues"), F.count_if(~F.col("failed")).alias("n_success"), F.count_if("failed").alias("n_errors"),
        *(F.avg(m).alias(f"mean_{m}") for m in METRICS),
        *(F.sum(F.coalesce(c, F.lit(0)) if c in results.columns else F.lit(0)).cast("long").alias(c) for c in ("prompt_tokens", "candidate_tokens")),
        F.sum("total_tokens").alias("llm_tokens"), F.sum("query_embedding_tokens").alias("query_tokens"),
    )
    # one row a method on either side
    s = s.join(setup, "method", "left").withColumn("setup_tokens", F.coalesce("setup_tokens", F.lit(0)))
    s = s.withColumn("setup_time_s", F.coalesce("build_time_s", F.lit(0.0)) if "build_time_s" in setup.columns else F.lit(0.0)).drop("build_time_s")
    spent = F.col("llm_tokens") + F.col("query_tokens")
    runtime = spent / F.col("n_issues")
    return s.withColumns({
        "error_rate": F.col("n_errors") / F.col("n_issues"), "total_runtime_tokens": spent, "total_cost_tokens": F.col("setup_tokens") + spent,
        "avg_llm_tokens": F.col("llm_tokens") / F.col("n_issues"), "avg_query_tokens": F.col("query_tokens") / F.col("n_issues"), "avg_runtime_tokens": runtime,
        "avg_total_unamortized": F.col("setup_tokens") + runtime, "avg_total_amortized": (F.col("setup_tokens") + spent) / F.col("n_issues"),
        "tokens_per_f1": F.when(F.col("mean_f1") > 0, runtime / F.col("mean_f1")),
    })


def stop_reasons(results: DataFrame) -> DataFrame:
    """H10."""
    return results.where("stop_reason IS NOT NULL AND stop_reason <> ''").groupBy("method", "stop_reason").agg(F.count("*").alias("n"))


def delta_to(summary: DataFrame, baseline: str, metric: str = "tokens_per_f1") -> DataFrame:
    """H11."""
    base = summary.where(F.col("method") == baseline).agg(F.max(metric).alias("_b"))
    return summary.crossJoin(F.broadcast(base)).select("method", (F.col(metric) - F.col("_b")).alias("delta"))


def break_even(summary: DataFrame) -> DataFrame:
    """The number of issues after which `left` has caught up with `right`; null where it never does."""
    side = lambda x: summary.select(F.col("method").alias(x), F.col("setup_tokens").alias(f"{x}_s"), F.col("avg_runtime_tokens").alias(f"{x}_r"))
    n = F.try_divide(F.col("right_s") - F.col("left_s"), F.col("left_r") - F.col("right_r"))
    return side("left").crossJoin(side("right")).where(F.col("left") != F.col("right")).select(
        "left", "right", F.when(n > 0, F.round(n, 6)).alias("n_break_even")
    )


def amortization(results: DataFrame) -> DataFrame:
    """H13 over `results(used_commit, base_commit)`, one row per issue."""
    key = F.coalesce(F.nullif("used_commit", F.lit("")), F.nullif("base_commit", F.lit("")), F.lit(NO_COMMIT))
    a = results.agg(F.count("*").alias("n_issues"), F.count_distinct(key).alias("n_unique_commits"))
    rate = F.coalesce(F.try_divide((F.col("n_issues") - F.col("n_unique_commits")).cast("double"), F.col("n_issues")), F.lit(0.0))
    return a.withColumns({"cache_hits": F.col("n_issues") - F.col("n_unique_commits"), "cache_hit_rate": rate})


def single_track(results: DataFrame, track: str) -> DataFrame:
    """`results`; fails when run if another track's name appears."""
    said = F.concat(F.lit("mixed tracks: "), F.col("track_name"))
    bad = F.col("track_name").isNotNull() & (F.col("track_name") != "") & (F.col("track_name") != track)
    return results.withColumn("track_name", F.when(bad, F.raise_error(said)).otherwise(F.col("track_name")))


def setup_totals(contexts: DataFrame) -> DataFrame:
    """Build time and tokens by method over `contexts(commit, method, build_time_s, embedding_tokens)`."""
    return contexts.groupBy("method").agg(F.sum("build_time_s").alias("build_time_s"), F.sum("embedding_tokens").alias("setup_tokens"))


def repeat_stats(runs: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """`method, metric, mean, std, min, max, n_runs` over `runs(run, method, metrics...)`; a missing metric counts 0."""
    pairs = ", ".join(f"'{m}', coalesce(cast({m} AS double), 0e0)" for m in metrics)
    long = runs.selectExpr("run", "method", f"stack({len(metrics)}, {pairs}) AS (metric, v)")
    return long.groupBy("method", "metric").agg(
        F.avg("v").alias("mean"), F.coalesce(F.stddev_samp("v"), F.lit(0.0)).alias("std"), F.min("v").alias("min"), F.max("v").alias("max"), F.count("*").alias("n_runs")
    )


def run_deltas(runs: DataFrame, metric: str) -> DataFrame:
    """Each run's differences between methods; runs that lack either are passed over."""
    side = lambda x: runs.where(F.col(metric).isNotNull()).select("run", F.col("method").alias(x), F.col(metric).alias(f"{x}_v"))
    return side("left").join(side("right"), "run").where(F.col("left") != F.col("right")).select("left", "right", "run", (F.col("left_v") - F.col("right_v")).alias("delta"))


def bootstrap_ci(deltas: DataFrame, by: Sequence[str], value: str = "delta", resamples: int = 2000, seed: int = 17) -> DataFrame:
    """`by, n_runs, mean, low, high` - the 2.5 and 97.5 % places of the sorted resampled means.

    Draws are portable: the value at slot i of resample b is the one of number md5(seed|b|i) mod n, numbered from 0 in order of size. Rows of
    values make the draws of their own slot, meet the values drawn by equality, and are summed by resample before they are
    shuffled, so no group is gathered but its `resamples` means. Null values are passed over.
    """
    # A struct is a key even where its fields are null.
    values = deltas.select(F.struct(*by).alias("_key"), F.col(value).cast("double").alias("_v")).where("_v IS NOT NULL")
    rows = ranges.numbered(values.withColumn("_by", F.struct("_key", "_v")), "_by", "bootstrap")
    size = rows.groupBy("_key").agg(F.min("_row").alias("_first"), F.count("*").alias("_n"), F.avg("_v").alias("mean"))
    rows = rows.join(size, "_key").select("_key", "_v", "_n", (F.col("_row") - F.col("_first")).alias("_i"))
    draw = F.pmod(F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), "_b", "_i")), 1, 12), 16, 10).cast("long"), F.col("_n"))
    drawn = rows.withColumn("_b", F.explode(F.sequence(F.lit(1), F.lit(resamples)))).select("_key", "_b", "_n", draw.alias("_i"))
    means = drawn.join(rows.select("_key", "_i", "_v"), ["_key", "_i"]).groupBy("_key", "_b").agg((F.sum("_v") / F.first("_n")).alias("_m"))
    told = means.groupBy("_key").agg(F.array_sort(F.collect_list("_m")).alias("_m"))  # resamples of them
    place = lambda q: F.element_at("_m", int(q * (resamples - 1)) + 1)
    return told.join(size, "_key").select(*(F.col(f"_key.{c}").alias(c) for c in by), F.col("_n").alias("n_runs"), "mean", place(0.025).alias("low"), place(0.975).alias("high"))


def gates(runs: DataFrame, pairwise: DataFrame, least: int = 3) -> DataFrame:
    """I4: whether there are enough runs and any pairs of them."""
    n = runs.agg((F.count_distinct("run") >= least).alias("enough_runs"))
    have = pairwise.limit(1).agg((F.count("*") > 0).alias("pairwise_present"))
    return n.crossJoin(have).withColumn("ready", F.col("enough_runs") & F.col("pairwise_present"))


def amortization_rollup(runs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """I5 over runs' amortisation rows."""
    return runs.groupBy(*by).agg(
        F.max("n_issues").alias("n_issues"), F.round(F.avg("n_unique_commits")).cast("long").alias("n_unique_commits"),
        F.avg("cache_hit_rate").alias("cache_hit_rate"),
        F.when(F.count_distinct("track_name") > 1, "mixed").otherwise(F.max("track_name")).alias("track_name"),
    )


def ordered_pairs(names: Sequence[str]) -> list[tuple[str, str]]:
    return list(itertools.permutations(names, 2))
