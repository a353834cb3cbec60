"""Statistics of paired and pooled results (K)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators import ranges
from graphloom.storage import written

TIMEOUT = "timeout_budget_exceeded"


def selected_cells(runs: DataFrame) -> DataFrame:
    """K1: of `runs(repo, method, run_id, frozen, completed)` the frozen one, then for "none" completed ones, then the newest."""
    done = F.when(F.col("method") == "none", F.col("completed").cast("int")).otherwise(0)
    w = Window.partitionBy("repo", "method").orderBy(F.col("frozen").desc(), done.desc(), F.col("run_id").desc())
    return runs.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def completion_marker(n_resolved: Column, error: Column, skipped: Column, summary: Column) -> Column:
    """K2."""
    return (
        F.when(~summary, "missing_summary").when(n_resolved.isNotNull(), "harness_results").when(error.isNotNull(), "harness_error")
        .when(skipped.isNotNull(), "harness_skipped_reason").otherwise("incomplete")
    )


def cells(runs: DataFrame, instances: DataFrame) -> DataFrame:
    """Runs with resolved rate, timeouts and setup."""
    late = (F.col("patch_status") == TIMEOUT) | F.coalesce("timeout_budget_exceeded", F.lit(False))
    t = instances.groupBy("run_id").agg(F.count_if(late).alias("timeout_count"))
    rows = runs.join(t, "run_id", "left").na.fill(0, ["timeout_count"])
    return rows.withColumns({
        "resolved_rate": F.try_divide(F.col("n_resolved").cast("double"), F.col("n_instances")),
        "setup_tokens": F.coalesce("setup_tokens_method_accounted", "retrieval_setup_tokens", F.lit(0)),
    })


def resolved_rate_table(cells: DataFrame, methods: list[str]) -> DataFrame:
    """K3."""
    return cells.groupBy("repo").pivot("method", methods).agg(F.first("resolved_rate"))


def dual_accounting(cells: DataFrame, first: str, second: str) -> DataFrame:
    """K4: each cell's tokens with its own setup and with what the run consumed.

    Where a run built both indexes its own figures count; where they are unknown, the paired method's setup is added.
    """
    pair = cells.where(F.col("method").isin(first, second)).select(
        "repo", F.when(F.col("method") == first, second).otherwise(first).alias("method"), F.col("setup_tokens").alias("_paired")
    )
    rows = cells.join(pair, ["repo", "method"], "left")
    built = F.coalesce("setup_graph", "setup_rag").isNotNull()
    as_run = F.when(~F.col("method").isin(first, second), F.col("setup_tokens")).when(
        built, F.coalesce("setup_graph", F.lit(0)) + F.coalesce("setup_rag", F.lit(0))
    ).otherwise(F.col("setup_tokens") + F.coalesce("_paired", F.lit(0)))
    rows = rows.withColumn("as_run_setup", as_run)
    rows = rows.withColumns({"method_total": F.col("runtime_tokens") + F.col("setup_tokens"), "as_run_total": F.col("runtime_tokens") + F.col("as_run_setup")})
    per = lambda c: F.when(F.col("n_resolved") > 0, F.col(c) / F.col("n_resolved"))
    return rows.withColumns({"cpr_method": per("method_total"), "cpr_as_run": per("as_run_total")}).drop("_paired")


def pooled_cpr(dual: DataFrame) -> DataFrame:
    """K5: ratios of sums over completed cells, by accounting view and method."""
    sums = _long(dual).groupBy("accounting_view", "method").agg(
        F.count("*").alias("n_repos"), F.sum("n_instances").alias("n_instances"), F.sum(F.coalesce("n_resolved", F.lit(0))).alias("n_resolved"), F.sum("tokens").alias("tokens")
    )
    return sums.withColumn("cost_per_resolved", F.when(F.col("n_resolved") > 0, F.col("tokens") / F.col("n_resolved")))


def _long(dual: DataFrame) -> DataFrame:
    """Completed cells once for each accounting view."""
    return dual.where("completed").selectExpr(
        "repo", "method", "n_instances", "n_resolved", "stack(2, 'method_accounted', method_total, 'as_run_consumed', as_run_total) AS (accounting_view, tokens)"
    )


def pooled_levels(dual: DataFrame) -> DataFrame:
    """K4, K5 at all levels in one pass: cells, methods, repositories and views, as ratios of sums.

    `accounting_view, repo, method, level, n_cells, n_instances, n_resolved, tokens, cost_per_resolved`; what a level sums over is null, and
    `level` tells by name which it is, as a cell's own name may be null, too.
    """
    view, repo, method = F.col("accounting_view"), F.col("repo"), F.col("method")
    sums = _long(dual).groupingSets([(view, repo, method), (view, repo), (view, method), (view,)], view, repo, method).agg(
        F.grouping_id().alias("_g"), F.count("*").alias("n_cells"), F.sum("n_instances").alias("n_instances"),
        F.sum(F.coalesce("n_resolved", F.lit(0))).alias("n_resolved"), F.sum("tokens").alias("tokens"),
    )
    level = F.when(F.col("_g") == 0, "cell").when(F.col("_g") == 1, "repo").when(F.col("_g") == 2, "method").otherwise("view")
    return sums.withColumns({"level": level, "cost_per_resolved": F.when(F.col("n_resolved") > 0, F.col("tokens") / F.col("n_resolved"))}).drop("_g")


def median_cpr(dual: DataFrame) -> DataFrame:
    """`accounting_view, method, n_cells, median_cpr` - the exact median of the cells' tokens for a resolved instance."""
    per = _long(dual).where("n_resolved > 0").withColumn("cpr", F.col("tokens") / F.col("n_resolved"))
    return per.groupBy("accounting_view", "method").agg(F.count("*").alias("n_cells"), F.percentile("cpr", 0.5).alias("median_cpr"))


def sketched(rows: DataFrame, by: Sequence[str], value: str, key: str, k: int = 200, lg: int = 12) -> DataFrame:
    """Mergeable sketches of each group, to be stored: `by, quantiles` (KLL of `value`) and `distinct` (HLL of `key`)."""
    return rows.groupBy(*by).agg(F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(k)).alias("quantiles"), F.hll_sketch_agg(F.col(key), F.lit(lg)).alias("distinct"))


def from_sketches(sketches: DataFrame, by: Sequence[str], places: Sequence[float] = (0.5,)) -> DataFrame:
    """Of stored sketches, merged over what `by` leaves out: `by, n, quantiles` at `places`, `n_distinct`. Rows are not read again.

    A quantile of 200 items is off by at most about 1.7 % of ranks, a distinct count of 2 ** 12 registers by about 1.6 %.
    """
    both = sketches.groupBy(*by).agg(F.kll_merge_agg_double("quantiles").alias("q"), F.hll_union_agg("distinct").alias("d"))
    at = F.array(*(F.kll_sketch_get_quantile_double("q", F.lit(float(p))) for p in places))
    return both.select(*by, F.kll_sketch_get_n_double("q").alias("n"), at.alias("quantiles"), F.hll_sketch_estimate("d").alias("n_distinct"))


def mcnemar_pairs(arms: DataFrame) -> DataFrame:
    """K7 for all pairs of methods of `arms(method, instance_id, resolved)`: `left, right, a, b, c, d`.

    Instances are numbered once and become bits; a method is a bitmap of those it has and one of those it resolved, a few
    kilobytes for every 32,768 instances. Pairs count common bits, so instances are never joined. An instance that an arm
    lacks, or of unknown result, is unresolved; one that repeats is resolved if any of its rows is.
    """
    arms = arms.select("method", "instance_id", F.coalesce("resolved", F.lit(False)).alias("resolved")).where("method IS NOT NULL AND instance_id IS NOT NULL")
    numbers = ranges.numbered(arms.select("instance_id").distinct(), "instance_id", "mcnemar").select("instance_id", "_row")
    bits = arms.join(numbers, "instance_id").select("method", "resolved", F.bitmap_bucket_number("_row").alias("bucket"), F.bitmap_bit_position("_row").alias("bit"))
    maps = bits.groupBy("method", "bucket").agg(
        F.bitmap_construct_agg("bit").alias("has"), F.bitmap_construct_agg(F.when(F.col("resolved"), F.col("bit"))).alias("won")
    )
    maps = written(maps, "mcnemar-bitmaps")
    one, two = (maps.select(F.col("method").alias(n), "bucket", F.col("has").alias(f"h_{n}"), F.col("won").alias(f"w_{n}")) for n in ("left", "right"))
    names = maps.select("method").distinct()
    pairs = names.select(F.col("method").alias("left")).join(names.select(F.col("method").alias("right")), F.col("left") < F.col("right"))  # a row a pair of methods
    pairs = pairs.crossJoin(maps.select("bucket").distinct())
    met = pairs.join(one, ["left", "bucket"], "left").join(two, ["right", "bucket"], "left")
    sides = met.select("left", "right", "bucket", F.explode(F.array(F.struct(F.col("h_left").alias("h"), F.col("w_left").alias("w")), F.struct(F.col("h_right").alias("h"), F.col("w_right").alias("w")))).alias("x"))
    none = F.unhex(F.repeat(F.lit("00"), F.lit(4096)))
    each = sides.groupBy("left", "right", "bucket").agg(
        F.bitmap_count(F.bitmap_and_agg(F.coalesce("x.w", none))).alias("a"), F.bitmap_count(F.bitmap_or_agg(F.coalesce("x.h", none))).alias("all")
    )
    won = maps.groupBy("method").agg(F.sum(F.bitmap_count("won")).alias("won"))
    sums = each.groupBy("left", "right").agg(F.sum("a").alias("a"), F.sum("all").alias("all"))
    sums = sums.join(won.select(F.col("method").alias("left"), F.col("won").alias("wl")), "left").join(won.select(F.col("method").alias("right"), F.col("won").alias("wr")), "right")
    return sums.select("left", "right", "a", (F.col("wl") - F.col("a")).alias("b"), (F.col("wr") - F.col("a")).alias("c"), (F.col("all") - F.col("wl") - F.col("wr") + F.col("a")).alias("d"))


def timeout_sensitivity(cells: DataFrame, first: str, second: str) -> DataFrame:
    """K6: rates with and without timeouts by method, and a row of the gap between two methods with its shift in points."""
    s = cells.where("completed").groupBy("method").agg(
        F.count("*").alias("n_repos"), F.sum(F.coalesce("n_instances", F.lit(0))).alias("n_instances"),
        F.sum(F.coalesce("n_resolved", F.lit(0))).alias("n_resolved"), F.sum("timeout_count").alias("n_timeouts"),
    )
    rate = lambda d: F.when(d > 0, F.col("n_resolved") / d)
    rows = s.withColumns({"rate_all": rate(F.col("n_instances")), "rate_no_timeouts": rate(F.col("n_instances") - F.col("n_timeouts")), "shift_pp": F.lit(None).cast("double")})
    of = lambda c, m: F.max(F.when(F.col("method") == m, F.col(c)))
    gap = rows.agg(*((of(c, first) - of(c, second)).alias(c) for c in ("rate_all", "rate_no_timeouts")))
    gap = gap.select(F.lit(f"{first}_minus_{second}").alias("method"), "rate_all", "rate_no_timeouts", F.abs((F.col("rate_no_timeouts") - F.col("rate_all")) * 100).alias("shift_pp"))
    return rows.unionByName(gap, allowMissingColumns=True)


def mcnemar_table(left: DataFrame, right: DataFrame) -> DataFrame:
    """K7: a, b, c, d over all instances of either arm(instance_id, resolved); an instance that an arm lacks is unresolved."""
    j = left.select("instance_id", F.col("resolved").alias("l")).join(right.select("instance_id", F.col("resolved").alias("r")), "instance_id", "full_outer")
    left_, right_ = F.coalesce("l", F.lit(False)), F.coalesce("r", F.lit(False))
    return j.agg(
        F.count_if(left_ & right_).alias("a"), F.count_if(left_ & ~right_).alias("b"), F.count_if(~left_ & right_).alias("c"), F.count_if(~left_ & ~right_).alias("d")
    )


def binomial_p(b: Column, c: Column) -> Column:
    """K8: the exact two-sided binomial p of b against c, by a recurrence of logarithms; 1 without discordant pairs."""
    n, k = b + c, F.least(b, c)
    # C(n, i + 1) = C(n, i) * (n - i) / (i + 1), kept as logarithms
    start = F.struct((-n * F.log(F.lit(2.0))).alias("t"), F.lit(0.0).alias("s"))
    step = lambda a, i: F.struct(
        (a["t"] + F.log((n - i).cast("double")) - F.log((i + 1).cast("double"))).alias("t"), (a["s"] + F.exp(a["t"])).alias("s")
    )
    total = F.aggregate(F.sequence(F.lit(0), F.least(k, n - 1).cast("int")), start, step, lambda a: a["s"])
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * total))


def chi_square(b: Column, c: Column) -> Column:
    """K9: with continuity correction."""
    return F.try_divide(F.pow(F.abs(b - c) - 1, F.lit(2)), b + c)


def discordant(left: DataFrame, right: DataFrame, names: tuple[str, str]) -> DataFrame:
    """Instances that one arm alone resolves: `winner, loser, loser_status, timeout_confounded`."""
    side = lambda df, x: df.select("instance_id", F.col("resolved").alias(f"{x}_r"), F.col("status").alias(f"{x}_s"))
    j = side(left, "l").join(side(right, "r"), "instance_id", "full_outer")
    lr, rr = F.coalesce("l_r", F.lit(False)), F.coalesce("r_r", F.lit(False))
    j = j.where(lr != rr)
    lost = F.when(lr, F.col("r_s")).otherwise(F.col("l_s"))
    return j.select(
        "instance_id", F.when(lr, names[0]).otherwise(names[1]).alias("winner"), F.when(lr, names[1]).otherwise(names[0]).alias("loser"),
        lost.alias("loser_status"), F.coalesce(lost == TIMEOUT, F.lit(False)).alias("timeout_confounded"),
    )


def rerun_gate(pooled: DataFrame, timeouts: DataFrame, pairs: DataFrame, first: str, second: str) -> DataFrame:
    """One row of the criteria: a reversed ranking, a shift over 5 points, most discordant pairs due to timeouts."""
    of = lambda v, m: F.max(F.when((F.col("accounting_view") == v) & (F.col("method") == m), F.col("cost_per_resolved")))
    p = pooled.agg(*((of(v, first) - of(v, second)).alias(v) for v in ("method_accounted", "as_run_consumed")))
    t = timeouts.agg(F.max("shift_pp").alias("shift_pp"))
    d = pairs.agg(F.count("*").alias("n_discordant"), F.count_if("timeout_confounded").alias("n_confounded"))
    row = p.crossJoin(t).crossJoin(d).select(
        F.coalesce(F.col("method_accounted") * F.col("as_run_consumed") < 0, F.lit(False)).alias("ranking_reversed"),
        F.coalesce(F.col("shift_pp") > 5, F.lit(False)).alias("timeout_shift"),
        (F.col("n_confounded") * 2 > F.col("n_discordant")).alias("timeout_majority"), "shift_pp", "n_discordant", "n_confounded",
    )
    return row.withColumn("rerun", F.col("ranking_reversed") | F.col("timeout_shift") | F.col("timeout_majority"))


def wilson(k: Column, n: Column, z: float = 1.959963984540054) -> Column:
    """Struct of `low, high`."""
    p, z2 = k / n, z * z
    mid, half = (p + z2 / (2 * n)) / (1 + z2 / n), z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / (1 + z2 / n)
    return F.struct((mid - half).alias("low"), (mid + half).alias("high"))


def holm(tests: DataFrame, p: str = "p") -> DataFrame:
    """`tests` with `p_holm`: the running maximum of (m - i) p in the order of p."""
    w = Window.orderBy(p, *[c for c in tests.columns if c != p][:1])
    step = (F.count("*").over(Window.partitionBy()) - F.row_number().over(w) + 1) * F.col(p)
    return tests.withColumn("_s", step).withColumn("p_holm", F.least(F.lit(1.0), F.max("_s").over(w.rowsBetween(Window.unboundedPreceding, 0)))).drop("_s")


def cohen_h(p1: Column, p2: Column) -> Column:
    """K13."""
    return 2 * F.asin(F.sqrt(p1)) - 2 * F.asin(F.sqrt(p2))
