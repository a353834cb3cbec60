"""Tuning: configurations, guard, leaderboard, splits (M)."""

from __future__ import annotations

import random
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LARGEST_WEIGHT, MAX_DROP = 0.7, 0.03
# Fixed values, in the order in which they are drawn: choices as lists, ranges as pairs with six decimals.
DRAWN = {
    "seed_k": [6, 8, 10], "depth": [1, 2, 3], "cap": [8, 12, 16], "ratio": (0.55, 0.85), "min_cut": (0.0, 0.15),
    "hub_threshold": [12, 16, 20, 24, 30], "hub_scale": (0.1, 0.6),
}
# Fixed order: the drift of rounding goes to the last.
SIGNALS = ("sem", "graph", "conf", "hint", "pen")
COUNTS, AMOUNTS = ("seed_k", "depth", "cap", "min_return", "hub_threshold"), ("ratio", "min_cut", "hub_scale")


@dataclass(frozen=True)
class Config:
    config_id: str
    seed_k: int = 8
    depth: int = 2
    cap: int = 12
    ratio: float = 0.70
    min_cut: float = 0.0
    hub_threshold: int = 20
    hub_scale: float = 0.35
    min_return: int = 1
    weights: dict[str, float] = field(default_factory=dict)

    def problems(self) -> list[str]:
        """M7: what is wrong with it; no weights are no fault."""
        out = [f"{n} must be at least 1" for n in COUNTS if getattr(self, n) < 1]
        out += [f"{n} must not be negative" for n in AMOUNTS if getattr(self, n) < 0]
        out += [f"no weight is called {k}" for k in self.weights if k not in SIGNALS]
        out += [f"weight {k} must be in 0..{LARGEST_WEIGHT}" for k, w in self.weights.items() if not 0 <= w <= LARGEST_WEIGHT]
        if self.weights and abs(sum(self.weights.values()) - 1) > 1e-6:
            out.append("weights must sum to 1")
        return out


def checked(config_id: str, **values: object) -> Config:
    """M7: a configuration of `values`; names that are not known and values out of range raise."""
    kinds = dict.fromkeys(COUNTS, int) | dict.fromkeys(AMOUNTS, float)
    if unknown := [n for n in values if n not in kinds and n != "weights"]:
        raise ValueError(f"unknown settings: {unknown}")
    made = Config(config_id, **{n: kinds[n](v) if n in kinds else {k: float(w) for k, w in dict(v).items()} for n, v in values.items()})
    if wrong := made.problems():
        raise ValueError("; ".join(wrong))
    return made


def sampled_weights(rng: random.Random, tries: int = 10_000) -> dict[str, float]:
    """M1: uniform draws brought to sum 1, taken anew while one is too large."""
    for _ in range(tries):
        drawn = [rng.random() + 1e-6 for _ in SIGNALS]
        parts = [d / sum(drawn) for d in drawn]
        if max(parts) <= LARGEST_WEIGHT:
            parts = [round(p, 6) for p in parts]
            return dict(zip(SIGNALS, [*parts[:-1], round(parts[-1] + (1.0 - sum(parts)), 6)], strict=True))
    raise RuntimeError("no weights in range were drawn")


def candidates(n: int, seed: int) -> list[Config]:
    """M2: `n` configurations of one seeded stream."""
    rng = random.Random(seed)
    draw = lambda of: rng.choice(of) if isinstance(of, list) else round(rng.uniform(*of), 6)
    return [Config(f"cfg-{k:04d}", **{name: draw(of) for name, of in DRAWN.items()}, weights=sampled_weights(rng)) for k in range(1, max(n, 0) + 1)]


def guarded(scores: DataFrame, baseline: DataFrame, max_drop: float = MAX_DROP) -> DataFrame:
    """M3: `config_id, passes` - every repository of `baseline(repo, score)` is there and did not drop too far."""
    configs = scores.select("config_id").distinct()
    j = configs.crossJoin(baseline.select("repo", F.col("score").alias("b"))).join(scores, ["config_id", "repo"], "left")
    return j.groupBy("config_id").agg(F.bool_and(F.coalesce(F.col("score") >= F.col("b") - max_drop, F.lit(False))).alias("passes"))


def holdout_deltas(scores: DataFrame, baseline: DataFrame) -> DataFrame:
    """M4."""
    return scores.join(baseline.select("repo", F.col("score").alias("b")), "repo").select("config_id", "repo", (F.col("score") - F.col("b")).alias("delta"))


def leaderboard(results: DataFrame, guard: DataFrame) -> DataFrame:
    """M5: `results(config_id, mean_f1, f1_std, runtime_tokens)` ranked; `selected` marks the first that passes."""
    order = (F.col("mean_f1").desc(), F.col("f1_std"), F.col("runtime_tokens"), F.col("config_id"))
    rows = results.join(guard, "config_id", "left").withColumn("passes", F.coalesce("passes", F.lit(False)))
    rows = rows.withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    first = F.min(F.when(F.col("passes"), F.col("rank"))).over(Window.partitionBy())
    return rows.withColumn("selected", F.coalesce(F.col("rank") == first, F.lit(False)))


def selected(board: DataFrame) -> str:
    row = board.where("selected").select("config_id").first()
    if row is None:
        raise ValueError("no configuration passes the guard")
    return row[0]


def repeats_of(scores: DataFrame) -> DataFrame:
    """M6: mean and population deviation over `scores(config_id, repeat, f1, tokens)`."""
    return scores.groupBy("config_id").agg(F.avg("f1").alias("mean_f1"), F.stddev_pop("f1").alias("f1_std"), F.avg("tokens").alias("runtime_tokens"))


def protocol(coarse: DataFrame, repeated: DataFrame, holdout: DataFrame, baseline: DataFrame, k: int = 10) -> DataFrame:
    """M6: the leaderboard of the `k` best by `coarse(config_id, f1, tokens)`, ranked by their `repeated` scores and guarded by `holdout(config_id, repo, score)`."""
    first = repeats_of(coarse).orderBy(F.col("mean_f1").desc(), "f1_std", "runtime_tokens", "config_id").limit(k).select("config_id")
    best = lambda df: df.join(F.broadcast(first), "config_id", "left_semi")
    return leaderboard(repeats_of(best(repeated)), guarded(best(holdout), baseline))


def allocated_split(ids: DataFrame, anchors: Sequence[str], caps: dict[str, int], seed: int, target: int | None = None) -> DataFrame:
    """M8: all of the anchors' `ids(repo, instance_id)`, and up to a cap of others in the order of a seeded hash.

    Fails when run if the total is not the target.
    """
    spark = ids.sparkSession
    want = spark.createDataFrame([(r, None) for r in anchors] + [(r, c) for r, c in caps.items() if c > 0], "repo string, cap int")
    order = F.sha1(F.concat(F.lit(f"{seed}|"), F.col("instance_id").cast("string")))
    w = Window.partitionBy("repo").orderBy(order, "instance_id")
    rows = ids.select("repo", "instance_id").distinct().join(F.broadcast(want), "repo").withColumn("_r", F.row_number().over(w))
    rows = rows.where("cap IS NULL OR _r <= cap").select("repo", "instance_id")
    if target is None:
        return rows
    n = rows.agg(F.count("*").alias("_n"))
    checked = n.select(F.when(F.col("_n") != target, F.raise_error(F.concat(F.lit(f"the split should have {target} rows and has "), F.col("_n").cast("string")))).alias("_failed"))
    return rows.crossJoin(checked).where("_failed IS NULL").drop("_failed")
