"""Bootstrap, levels, sketches, bitmaps, rates and report shapes against plain Python."""

import datetime as dt
import hashlib
import json
import random
import statistics

import pytest
from pyspark.sql import functions as F

from graphloom.operators import evaluate, patches, stats, telemetry


def drawn(values, resamples, seed):
    values, n = sorted(values), len(values)
    means = sorted(sum(values[int(hashlib.md5(f"{seed}|{b}|{i}".encode()).hexdigest()[:12], 16) % n] for i in range(n)) / n for b in range(1, resamples + 1))
    return means[int(0.025 * (resamples - 1))], means[int(0.975 * (resamples - 1))]


def test_bootstrap_by_portable_draws(spark):
    groups = {("a", "b"): [0.1, 0.5, 0.3, 0.3, -0.2], ("a", None): [1.5], (None, None): [2.0, 4.0]}
    rows = [(*k, v) for k, vs in groups.items() for v in [*vs, None]]
    df = spark.createDataFrame(rows, "left string, right string, delta double").repartition(3)
    got = {(r.left, r.right): r for r in evaluate.bootstrap_ci(df, ["left", "right"], resamples=400).collect()}
    assert set(got) == set(groups)
    for k, vs in groups.items():
        low, high = drawn(vs, 400, 17)
        assert got[k].n_runs == len(vs) and got[k].mean == pytest.approx(statistics.fmean(vs)) and (got[k].low, got[k].high) == (pytest.approx(low), pytest.approx(high))
    assert evaluate.bootstrap_ci(df.limit(0), ["left", "right"]).collect() == []


def test_bitmaps_equal_the_table_of_one_pair(spark):
    r = random.Random(4)
    rows = [(f"m{r.randrange(4)}", f"i{r.randrange(60_000)}", r.choice([True, False, None])) for _ in range(4_000)] + [("m9", None, True), (None, "i1", True), ("alone", "only here", True)]
    arms = spark.createDataFrame(rows, "method string, instance_id string, resolved boolean").repartition(3)
    got = {(x.left, x.right): (x.a, x.b, x.c, x.d) for x in stats.mcnemar_pairs(arms).collect()}
    assert len(got) == 10
    one = arms.where("instance_id IS NOT NULL").groupBy("method", "instance_id").agg(F.bool_or(F.coalesce("resolved", F.lit(False))).alias("resolved"))
    for left, right in (("m0", "m1"), ("alone", "m3"), ("m2", "m3")):
        side = lambda m: one.where(F.col("method") == m).select("instance_id", "resolved")
        assert got[left, right] == tuple(stats.mcnemar_table(side(left), side(right)).first())


def test_levels_sum_their_cells(spark):
    cells = [("r1", "graph", 10, 4, True, 100, 120), ("r1", "dense", 10, 0, True, 50, 60), ("r2", "graph", 5, 1, True, 30, 30), ("r2", "dense", 5, 5, False, 1, 1), (None, "graph", 2, None, True, 7, 8)]
    dual = spark.createDataFrame(cells, "repo string, method string, n_instances long, n_resolved long, completed boolean, method_total long, as_run_total long")
    got = {(r.accounting_view, r.level, r.repo, r.method): (r.n_cells, r.n_resolved, r.tokens, r.cost_per_resolved) for r in stats.pooled_levels(dual).collect()}
    assert got["method_accounted", "view", None, None] == (4, 5, 187, 37.4)
    assert got["as_run_consumed", "method", None, "graph"] == (3, 5, 158, 31.6) and got["method_accounted", "repo", "r1", None] == (2, 4, 150, 37.5)
    assert got["method_accounted", "repo", None, None] == (1, 0, 7, None) and got["method_accounted", "cell", "r1", "dense"] == (1, 0, 50, None)
    assert {(r.accounting_view, r.method): (r.n_cells, r.median_cpr) for r in stats.median_cpr(dual).collect()} == {("method_accounted", "graph"): (2, 27.5), ("as_run_consumed", "graph"): (2, 30.0)}


def test_sketches_merge_within_their_bounds(spark):
    rows = spark.range(40_000).select((F.col("id") % 3).alias("m"), (F.col("id") % 40).alias("run"), ((F.col("id") * 7919) % 10_007).cast("double").alias("v"), (F.col("id") % 5_000).alias("k"))
    stored = stats.sketched(rows, ["m", "run"], "v", "k")
    for r in stats.from_sketches(stored, ["m"], [0.1, 0.5, 0.9]).collect():
        values = sorted(x.v for x in rows.where(F.col("m") == r.m).select("v").collect())
        assert r.n == len(values) and abs(r.n_distinct - 5_000) < 0.05 * 5_000
        for q, got in zip((0.1, 0.5, 0.9), r.quantiles, strict=True):
            assert abs(sum(v <= got for v in values) / len(values) - q) < 0.017


def test_recent_progress(spark):
    t0 = dt.datetime(2026, 1, 1)
    at = [0, 10, 10, 40, 100]
    done = spark.createDataFrame([("a", t0 + dt.timedelta(minutes=m)) for m in at] + [("a", None), ("b", t0)], "run_id string, ts timestamp")
    totals = spark.createDataFrame([("a", 9)], "run_id string, n_total long")
    got = sorted(((r.run_id, r.ts, r.n_done, r.n_recent, r.eta_s) for r in telemetry.recent_progress(done, totals).collect()), key=str)
    # at minute 40 the frame still holds minute 10
    assert [x[2:4] for x in got if x[0] == "a"] == [(1, 1), (3, 3), (3, 3), (4, 3), (5, 1)]
    assert [x[4] for x in got if x[0] == "a"] == [8 * 1800.0, 6 * 600.0, 6 * 600.0, 5 * 600.0, 4 * 1800.0] and got[-1][4] is None


def test_reports_of_any_shape(spark):
    def said(payload):
        """What the rules say of a payload, by Python's own notion of truth."""
        try:
            p = json.loads(payload)
        except (TypeError, ValueError):
            return None
        if not isinstance(p, dict):
            return None
        if isinstance(p.get("resolved_ids"), list):
            return sorted(map(str, p["resolved_ids"])), len(p["resolved_ids"])
        yes = sorted(k for k, v in p.items() if isinstance(v, dict) and v.get("resolved"))
        if yes or p and all(isinstance(v, dict) for v in p.values()):
            return yes, len(yes)
        n = p.get("resolved_instances")
        return ([], int(n)) if isinstance(n, (int, float)) and not isinstance(n, bool) else None

    shapes = [
        {"resolved_ids": ["b", "a", 5]}, {"resolved_ids": "no list", "x": {"resolved": True}}, {"resolved_ids": None, "resolved_instances": 3}, {"a\"b\\c": {"resolved": True}, "{": {"resolved": 0.0}},
        {"x": {"resolved": {"deep": []}}, "y": {"resolved": {}}, "z": {"resolved": []}, "w": {"resolved": [0]}, "v": {"resolved": ""}, "u": {"resolved": "no"}}, {"x": "{\"resolved\": true}"},
        {"resolved_instances": "7"}, {"resolved_instances": True}, {"resolved_instances": 2.9}, {"resolved_instances": {"resolved": 1}}, {}, {"x": {"resolved": None}, "y": 1},
    ]
    payloads = [json.dumps(s) for s in shapes] + ["[1]", "null", "3", "", "{broken", "{\"a\": }", None, '{"x": {"resolved": 1e400}}'[:-12] + "1}}"]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(payloads)], "i int, p string")
    got = {r.i: r.x and (r.x.ids, r.x.n_resolved) for r in df.select("i", patches.harness_payload("p", 4).alias("x")).collect()}
    assert got == {i: said(p) for i, p in enumerate(payloads)}
