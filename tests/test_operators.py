"""Behaviour of operators on small literal tables."""

import json
import math

import pytest
from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.operators import agent, chunk, dense, evaluate, fusion, graph, lexical, patches, paths, stats, telemetry, tuning
from graphloom.plans.campaign import by_repository, provenance, run_campaign
from graphloom.plans.registry import Registry, generate, with_retries
from graphloom.sources import datasets, runs
from graphloom.streaming import checkpoints

NODES = "id string, type string, name string, file string"
EDGES = "src string, dst string, type string, confidence string"
SEEDS = "query_id string, node_id string, score double"


def values(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def one(spark, column, **given):
    row = spark.createDataFrame([tuple(given.values())], ", ".join(f"{k} string" for k in given))
    return row.select(column.alias("x")).first().x


def test_issue_compaction(spark):
    text = "Intro\r\n```\nlog\n```\n## Steps\n- [ ] box\ndo it in src/a/b.py\n\n\n\nnow\n### System info\nold\n## Empty\n"
    assert one(spark, T.compact_issue("t"), t=text) == "Intro\n\n### Steps\ndo it in <PY_PATH>\n\nnow"
    assert one(spark, T.compact_issue("t"), t="## Logs\nonly noise") == "## Logs\nonly noise"
    assert one(spark, T.compact_issue("t", 20), t="x" * 30) == "x" * 17 + "..."
    assert one(spark, T.compact_issue("t"), t=None) == ""


def test_text_functions(spark):
    assert one(spark, T.normalize_path("p"), p=" ././a\\b.py ") == "a/b.py"
    assert one(spark, T.is_test_file("p"), p="src/tests/x.py") and one(spark, T.is_test_file("p"), p="a/test_b.py") and one(spark, T.is_test_file("p"), p="a/b_test.py")
    assert not one(spark, T.is_test_file("p"), p="a/latest.py")
    assert one(spark, T.gold_files_from_text("p"), p="./a.py; b.py,a.py") == ["a.py", "b.py"]
    assert one(spark, T.files_in_answer("t"), t='ok {"files": ["a.py", "b/c.py"]}') == ["a.py", "b/c.py"]
    assert one(spark, T.extract_patch("t"), t="<patch>x</patch>") == "x\n" and one(spark, T.extract_patch("t"), t="<patch> cannot_patch</patch>") is None
    assert one(spark, T.extract_patch("t"), t="```diff\n--- a/x\n+++ b/x\n@@ -1 +1 @@\n-a\n+b\n```\nend") == "--- a/x\n+++ b/x\n@@ -1 +1 @@\n-a\n+b\n"
    assert one(spark, T.confidence_label(F.lit(0.5)), t="") == "medium" and one(spark, T.confidence_weight("t"), t="odd") == 0.6
    assert one(spark, T.embedding_text("n", F.lit("function"), "s", "d"), n="f", s="(x)", d="Doc") == "f(x): Doc"
    assert one(spark, T.method_of_model("t", "own-"), t="own-bm25") == "bm25" and one(spark, T.excerpt("t", 5), t="a \n b  c d") == "a b c"


def test_bm25_ranks_and_fills_up(spark):
    docs = spark.createDataFrame([("src/auth.py", "login user password token"), ("src/database.py", "query table rows"), ("src/render.py", "html page view")], "path string, text string")
    ask = spark.createDataFrame([("a", "user login"), ("d", "database query"), ("n", "zzz"), ("e", "")], "query_id string, text string")
    out = lexical.bm25plus(docs, ask, 3, tie="path").orderBy("query_id", "rank").collect()
    got = {q: [r.doc_id for r in out if r.query_id == q] for q in "adne"}
    assert got == {"a": ["src/auth.py", "src/database.py", "src/render.py"], "d": ["src/database.py", "src/auth.py", "src/render.py"], "n": [], "e": []}


def test_prefixes(spark):
    p = spark.createDataFrame([("src/a.py",), ("src2/b.py",), ("src",)], "path string")
    assert {r.path for r in lexical.under_prefixes(p, ["src/"]).collect()} == {"src/a.py", "src"}
    assert lexical.with_raw_prefixes(p, ["src"]).count() == 3 and lexical.under_prefixes(p, []).count() == 3


def test_canonical_paths(spark):
    valid = spark.createDataFrame([("src/a/x.py",), ("src/b/x.py",), ("src/y.py",)], "path string")
    rows = spark.createDataFrame([("q", ["src/y.py", "y.py", "x.py", "none.py", "a/x.py"])], "k string, paths array<string>")
    assert values(paths.canonical_list(rows, valid, "k"), "files") == [(["src/y.py", "src/a/x.py"],)]


def test_chunks_and_dense(spark):
    files = spark.createDataFrame([("a", "x" * 5000), ("b", "short\n"), ("c", " \n ")], "file string, text string")
    out = chunk.fixed_windows(files)
    assert [r.start for r in out.where("file = 'a'").orderBy("start").collect()] == [0, 1792, 3584]
    assert {r.file for r in chunk.embeddable(out).collect()} == {"a", "b"}
    embedded = dense.embed(files.select("file", "text"), dense.hash_embedder(8)).select(F.monotonically_increasing_id().alias("id"), "embedding")
    assert dense.topk(embedded, embedded.where("id >= 0"), 2).count() == 2
    zero = spark.createDataFrame([([0.0, 0.0],), ([3.0, 4.0],)], "v array<double>").select(dense.normalized("v").alias("v"))
    assert sorted(r.v for r in zero.collect()) == [[0.0, 0.0], [0.6, 0.8]]


def retrieved(spark, nodes, edges, seeds, text="", how=None, **more):
    n, e = spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES)
    s, i = spark.createDataFrame(seeds, SEEDS), spark.createDataFrame([("q", text)], "query_id string, text string")
    return {r.file: r for r in graph.retrieve(n, e, s, i, how=how, **more).collect()}


def files(*names):
    return [(n, "file", n, n) for n in names]


OPEN = graph.Scoring(ratio=0.0, min_return=6)


def test_graph_budget_confidence_and_grounding(spark):
    nodes = [*files("a.py", "b.py", "c.py", "d.py"), ("g", "function", "g", "not_there.py")]
    edges = [("a.py", "b.py", "CALLS", "high"), ("a.py", "c.py", "CALLS", "low"), ("b.py", "d.py", "CALLS", "high"), ("a.py", "g", "CALLS", "high")]
    got = retrieved(spark, nodes, edges, [("q", "a.py", 0.99)], how=OPEN)
    assert set(got) == {"a.py", "b.py", "c.py", "d.py"} and got["b.py"].score > got["c.py"].score
    assert got["b.py"].s_conf == 1.0 and got["c.py"].s_conf == 0.2 and got["c.py"].s_pen == 1.0 and got["b.py"].s_pen == 0.0
    assert set(retrieved(spark, nodes, edges, [("q", "a.py", 0.99)], how=OPEN, depth=1)) == {"a.py", "b.py", "c.py"}
    assert set(retrieved(spark, nodes, edges, [("q", "a.py", 0.99)], how=OPEN, depth=1, cap=1)) == {"a.py", "b.py"}
    assert "c.py" not in retrieved(spark, nodes, edges, [("q", "a.py", 0.99)])
    assert got == retrieved(spark, nodes, edges, [("q", "a.py", 0.99)], how=OPEN)


def test_hub_penalty(spark):
    names = ["seed.py", "hub.py", "own.py", *(f"x{i}.py" for i in range(6))]
    edges = [("seed.py", "hub.py", "CALLS", "high"), ("seed.py", "own.py", "CALLS", "high"), *(("hub.py", f"x{i}.py", "CALLS", "high") for i in range(6))]
    w = dict(graph.WEIGHTS) | {"pen": 0.40}
    how = graph.Scoring(hub_threshold=2, weights=tuple(w.items()), ratio=0.0, min_return=6)
    got = retrieved(spark, files(*names), edges, [("q", "seed.py", 1.0)], how=how, depth=1)
    assert got["hub.py"].score < got["own.py"].score and got["hub.py"].s_pen > got["own.py"].s_pen


def test_pagerank(spark):
    n = spark.createDataFrame([*files("a.py", "b.py", "c.py", "tests/test_a.py"), ("b.py::f", "function", "f", "b.py")], NODES)
    e = spark.createDataFrame([("b.py", "a.py", "IMPORTS", None), ("b.py::f", "a.py", "CALLS", "high"), ("tests/test_a.py", "a.py", "CALLS", "high")], EDGES)
    g = graph.weighted_file_graph(n, e)
    assert {(r.src, r.dst): (r.weight, r.n_import, r.n_symbol, r.n_test) for r in g.collect()} == {("b.py", "a.py"): (2.0, 1, 1, 0), ("tests/test_a.py", "a.py"): (0.5, 0, 0, 1)}
    ranks = {r.file: r["rank"] for r in graph.pagerank(g, graph.personalization(graph.file_of_nodes(n).select("file").distinct(), "nothing")).collect()}
    assert math.isclose(sum(ranks.values()), 1) and max(ranks, key=ranks.get) == "a.py"
    assert graph.weighted_file_graph(n, e, same_module=True).where("weight = 0.2").count() == 5
    assert graph.neighbor_tool(n, e, "nope").first().error == "unknown node: nope"


def test_budgets(spark):
    lines = ["x" * 40, "y" * 400, "z" * 40]
    row = spark.createDataFrame([(lines,)], "l array<string>")
    assert row.select(fusion.greedy_budget(F.col("l"), 25).alias("k")).first().k == [lines[0], lines[2]]
    ranked = spark.createDataFrame(list(enumerate(lines)), "rank int, line string")
    assert graph.budget_prefix(ranked, 25).count() == 1


def test_validated_spans_and_final_files(spark):
    pool = spark.createDataFrame([("i", "s1"), ("i", "s2"), ("j", "s1")], "issue_id string, symbol_id string")
    spans = [{"symbol_id": "s1", "start": 1, "end": 2, "confidence": 0.5}, {"symbol_id": "zz", "confidence": 0.5}, {"symbol_id": "s2", "confidence": 2}, 7]
    answers = spark.createDataFrame([("i", json.dumps(spans)), ("j", "nonsense")], "issue_id string, answer string")
    got = {r.issue_id: ([s.symbol_id for s in r.spans], r.violations) for r in fusion.validated_spans(answers, pool).collect()}
    assert got == {"i": (["s1"], 3), "j": ([], 1)}
    row = spark.createDataFrame([(["b"], ["a", "b"], ["c"])], "x array<string>, y array<string>, z array<string>")
    assert row.select(fusion.final_files(F.col("x"), F.col("y"), F.col("z")).alias("f")).first().f == ["b"]


def test_evaluation(spark):
    issues = spark.createDataFrame([("1",), ("2",)], "instance_id string")
    methods, setup = spark.createDataFrame([("m",)], "method string"), spark.createDataFrame([("m", 100)], "method string, setup_tokens long")
    schema = "instance_id string, method string, precision double, recall double, f1 double, total_tokens long, query_embedding_tokens long, error string"
    results = spark.createDataFrame([("1", "m", 1.0, 0.5, 2 / 3, 10, 2, None), ("2", "m", None, None, None, None, None, "boom")], schema)
    s = evaluate.method_summary(issues, methods, results, setup).first()
    assert (s.n_success, s.error_rate, s.mean_precision, s.mean_recall, s.llm_tokens, s.query_tokens, s.total_cost_tokens) == (1, 0.5, 0.5, 0.25, 10, 2, 112)
    assert math.isclose(s.mean_f1, 1 / 3)
    commits = spark.createDataFrame([("c", "c"), ("c", None)], "used_commit string, base_commit string")
    assert evaluate.amortization(commits).first().cache_hit_rate == 0.5
    sets = spark.createDataFrame([([], ["a"]), (["a"], []), (["a", "b"], ["a", "a"])], "g array<string>, p array<string>")
    got = [r.m for r in sets.select(evaluate.file_metrics("g", "p").alias("m")).collect()]
    assert [(m.f1, m.skipped_empty_gold) for m in got] == [(0.0, True), (0.0, False), (2 / 3, False)]
    with pytest.raises(Exception, match="empty index"):
        evaluate.required_nonempty(spark.createDataFrame([("a", 3)], "index string, n long"), ["a", "b"]).collect()
    mixed = spark.createDataFrame([("strict",), ("other",)], "track_name string")
    with pytest.raises(Exception, match="mixed tracks"):
        evaluate.single_track(mixed, "strict").collect()


def test_bootstrap_edges(spark):
    d = spark.createDataFrame([("one", 0.5), *(("many", x / 10) for x in range(10))], "k string, delta double")
    got = {r.k: r for r in evaluate.bootstrap_ci(d, ["k"]).collect()}
    assert (got["one"].low, got["one"].high) == (0.5, 0.5) and got["many"].low < 0.45 < got["many"].high


def test_binomial_goldens(spark):
    pairs = [("repomap", 212, 11), ("agentless", 141, 19), ("gm", 101, 30), ("meta", 94, 34), ("cold", 87, 37), ("bm25", 81, 45), ("fn", 71, 40), ("prog", 69, 43), ("fixed", 67, 43)]
    t = spark.createDataFrame(pairs, "m string, b long, c long").withColumn("p", stats.binomial_p(F.col("b"), F.col("c")))
    got = {r.m: (r.p, r.p_holm) for r in stats.holm(t.select("m", "p")).collect()}
    want = {"repomap": (2.1e-49, 1.9e-48), "agentless": (3.2e-24, 2.6e-23), "gm": (3.5e-10, 2.5e-9), "meta": (1.1e-7, 6.5e-7), "cold": (8.3e-6, 4.1e-5), "bm25": (1.7e-3, 6.8e-3), "fn": (4.2e-3, 1.3e-2), "prog": (1.8e-2, 3.6e-2), "fixed": (2.8e-2, 3.6e-2)}
    for m, (p, h) in want.items():
        assert math.isclose(got[m][0], p, rel_tol=0.05) and math.isclose(got[m][1], h, rel_tol=0.05), m
    w = spark.range(1).select(stats.wilson(F.lit(269.0), F.lit(500.0)).alias("w"), stats.cohen_h(F.lit(0.468), F.lit(0.066)).alias("h")).first()
    assert (round(w.w.low, 3), round(w.w.high, 3), round(w.h, 2)) == (0.494, 0.581, 0.99)


def test_run_status(spark):
    rows = [(True, 0, 99.0, 99.0, False), (False, 0, None, 1.0, None), (False, 0, None, 20.0, None), (False, 0, None, 1.0, False), (False, 3, 1.0, 1.0, True), (False, 3, 20.0, 20.0, None), (False, 3, 1.0, 1.0, False)]
    df = spark.createDataFrame(rows, "s boolean, n int, age double, seen double, alive boolean")
    got = [r.x for r in df.select(telemetry.run_status(F.col("s"), F.col("n"), F.col("age"), F.col("seen"), F.col("alive")).alias("x")).collect()]
    assert got == ["complete", "not_started", "stalled", "stalled", "running", "stalled", "stalled"]


def test_pareto_keeps_ties(spark):
    pts = spark.createDataFrame([("a", 1.0, 1.0), ("b", 1.0, 1.0), ("c", 2.0, 1.0), ("d", 2.0, 3.0), ("e", 1.0, 0.5)], "n string, cost double, quality double")
    assert {r.n for r in telemetry.pareto(pts).collect()} == {"a", "b", "d"}


def test_checkpoints_and_patches(spark, tmp_path):
    (tmp_path / "worker_1.jsonl").write_text('{"instance_id": "a", "prediction": "w1"}\nbroken\n{"prediction": "x"}\n')
    (tmp_path / "worker_10.jsonl").write_text('{"instance_id": "a", "prediction": "w10"}\n{"instance_id": "b", "prediction": "first"}\n{"instance_id": "b", "prediction": "last"}\n')
    (tmp_path / "predictions_partial.jsonl").write_text('{"instance_id": "a", "prediction": "merged"}\n')
    got = dict(values(runs.last_lines(runs.read_checkpoints(spark, str(tmp_path))), "instance_id", "prediction"))
    assert got == {"a": "merged", "b": "last"}
    chunks = patches.contiguous_chunks(spark.range(10), 3, "id")
    assert [r["count"] for r in chunks.groupBy("worker").count().orderBy("worker").collect()] == [4, 3, 3]
    payloads = [
        '{"resolved_ids": ["b", "a"], "resolved_instances": 9}', '{"x": {"resolved": true}, "y": {"resolved": false}, "z": {"resolved": 1}}', '{"x": {}, "y": {"resolved": null}}',
        '{"resolved_instances": 4, "total_instances": 8}', '{"note": "nothing"}', "broken", '{"resolved_ids": []}', '{"x": {"resolved": true}, "resolved_instances": 7}',
    ]
    got = [r.p and tuple(r.p) for r in spark.createDataFrame([(p,) for p in payloads], "p string").coalesce(1).select(patches.harness_payload("p", 8).alias("p")).collect()]
    assert got == [(["a", "b"], 2, 0.25), (["x", "z"], 2, 0.25), ([], 0, 0.0), ([], 4, 0.5), None, None, ([], 0, 0.0), (["x"], 1, 0.125)]


def test_tuning():
    for c in tuning.candidates(200, 7):
        assert c.problems() == [] and abs(sum(c.weights.values()) - 1) < 1e-9 and [*c.weights] == ["sem", "graph", "conf", "hint", "pen"]
        assert c.seed_k in (6, 8, 10) and c.depth in (1, 2, 3) and c.cap in (8, 12, 16) and 0.55 <= c.ratio <= 0.85 and 0 <= c.min_cut <= 0.15
        assert c.hub_threshold in (12, 16, 20, 24, 30) and 0.1 <= c.hub_scale <= 0.6 and c.min_return == 1 and max(c.weights.values()) <= 0.7
    assert tuning.candidates(3, 7) == tuning.candidates(3, 7) and [c.config_id for c in tuning.candidates(2, 7)] == ["cfg-0001", "cfg-0002"] and tuning.candidates(-1, 7) == []
    bad = tuning.Config("x", seed_k=0, min_return=0, ratio=-1, hub_scale=-0.1, weights={"sem": 0.8, "odd": 0.1})
    assert len(bad.problems()) == 7
    assert tuning.checked("y", depth="3", ratio="0.5").depth == 3
    for wrong in ({"depth": 0}, {"speed": 1}, {"weights": {"sem": 0.5}}):
        with pytest.raises(ValueError):
            tuning.checked("z", **wrong)


def test_split_target(spark):
    ids = spark.createDataFrame([("a", str(i)) for i in range(4)] + [("b", str(i)) for i in range(9)], "repo string, instance_id string")
    assert tuning.allocated_split(ids, ["a"], {"b": 3}, 1, 7).count() == 7
    with pytest.raises(Exception, match="should have 8"):
        tuning.allocated_split(ids, ["a"], {"b": 3}, 1, 8).collect()


def test_grounding_and_files(spark):
    claimed = spark.createDataFrame([("i", "a"), ("i", "b"), ("i", "zz")], "issue string, file string")
    seen = spark.createDataFrame([("i", "a", 0.5, 1), ("i", "b", 0.9, 1)], "issue string, file string, score double, n long")
    none = spark.createDataFrame([], "issue string, file string")
    assert [r.file for r in agent.grounded(claimed, seen, none).orderBy("rank").collect()] == ["b", "a"]
    ok = lambda *files: spark.createDataFrame([("i", f) for f in files], "issue string, file string")
    of = lambda *a, **k: [r.file for r in agent.grounded(*a, **k).orderBy("rank").collect()]
    assert of(claimed, seen, ok("a")) == ["a"]
    # no claimed file is confirmed: all confirmed ones, seen or not
    assert of(claimed, seen, ok("y", "x")) == ["x", "y"] and of(claimed, seen, ok("x", "b", "y")) == ["b"]
    assert of(claimed, seen, ok("a"), confirmed_only=False) == ["a", "b"]
    store = spark.createDataFrame([("a.py", "x" * 50)], "path string, content string")
    got = agent.read_files(spark.createDataFrame([("./a.py",), ("../a.py",), ("b.py",)], "path string"), store, 10).collect()
    assert {r.path: r.error for r in got} == {"./a.py": None, "../a.py": "outside", "b.py": "not found"}


def test_stop_reasons(spark):
    """(file, confirmed, answer, named) by turn, for the mode that needs confirmed files."""
    call, again, sure, tell, vague = ("a", False, False, False), ("a", False, False, False), ("b", True, False, False), (None, False, True, True), (None, False, True, False)
    cases = {
        "named": ([call, tell], (2, "sufficient_confidence")), "at once": ([tell], (1, "budget")), "fallback": ([sure, vague], (2, "sufficient_confidence")),
        "vague": ([call, vague], (2, "budget")), "stuck": ([sure, sure, sure, tell], (3, "budget")), "stuck without files": ([call, again, again, again], (4, "max_turns")),
        "used up": ([sure, call, ("c", False, False, False), ("d", False, False, False), tell], (4, "budget")),
    }
    rows = [(name, k, *turn) for name, (turns, _) in cases.items() for k, turn in enumerate(turns)]
    trace = spark.createDataFrame(rows, "issue string, turn int, file string, confirmed boolean, answer boolean, named boolean")
    got = {r.issue: (r.turns, r.stop_reason) for r in agent.stop_reason(trace, max_turns=4).collect()}
    assert got == {name: want for name, (_, want) in cases.items()}
    observed = {r.issue: r.stop_reason for r in agent.stop_reason(trace, max_turns=4, need_confirmed=False, use_observed=True).collect()}
    assert observed["stuck without files"] == "budget" and observed["vague"] == "sufficient_confidence"


def test_evidence_labels_paths_by_their_mean(spark):
    """A path of a high and a low edge is medium: (1.0 + 0.2) / 2; calls alone count where there are any."""
    paths = spark.createDataFrame([
        ("q", "s", "n1", 2, ["IMPORTS", "IMPORTS"], ["high", "low"]), ("q", "s", "n2", 2, ["CALLS", "IMPORTS"], ["low", "high"]), ("q", "s", "n3", 1, ["CALLS"], ["high"]),
    ], "query_id string, seed string, node string, depth int, edge_types array<string>, confidences array<string>")
    files = spark.createDataFrame([("n1", "f.py"), ("n2", "f.py"), ("n3", "f.py")], "node string, file string")
    found = graph.evidence(paths, spark.createDataFrame([("q", "s", 1.0)], "query_id string, node_id string, score double"), files).first()
    assert (found.n_paths, found.n_low, found.n_high, found.n_types) == (3, 1, 1, 2)


def test_neighbours_by_weight_and_both_ways(spark):
    """low < medium < high; an edge back to the same node is another neighbour; labels in any case."""
    e = spark.createDataFrame([("a", "b", "CALLS", "High"), ("a", "b", "CALLS", "low"), ("a", "b", "CALLS", None), ("b", "a", "CALLS", "LOW")], "src string, dst string, type string, confidence string")
    got = [(r.other, r.confidence) for r in graph.capped_neighbors(e, 12).where("id = 'a'").orderBy("pos").collect()]
    assert got == [("b", "low"), ("b", "low"), ("b", "medium"), ("b", "high")]


def test_visible_runs(spark):
    rows = [("r", "running", 99.0), ("c", "complete", 1.0), ("s", "stalled", 1.0), ("new", "not_started", 5.0), ("old", "not_started", 90.0), ("none", "not_started", None)]
    runs_ = spark.createDataFrame(rows, "run_id string, status string, seen_age double")
    shown = lambda **k: {r.run_id for r in telemetry.visible(runs_, **k).collect()}
    assert shown(active_only=True, complete=False, stalled=False) == {"r", "new"}
    assert shown(active_only=True, complete=True, stalled=True) == {"r", "new", "c", "s"}
    assert shown() == {"r", "c", "s", "new", "old", "none"}
    assert shown(stalled=False) == {"r", "c", "new"}


def test_configurations_that_supersede(spark):
    rows = [
        ("1", "2026-02-11 10:00:00", None, "strict", None, 8, None), ("2", "2026-02-11 12:00:00", "", " strict ", "x", 8, []), ("3", "2026-02-11 11:00:00", "", "", "strict", 8, []),
        ("4", "2026-02-11 09:00:00", "repeat", "strict", None, 8, []), ("5", "2026-02-11 09:00:00", "", "strict", None, 8, ["src"]),
    ]
    runs_ = spark.createDataFrame(rows, "run_id string, created_at string, run_type string, evaluation_track string, amortization_track string, n_issues_evaluated int, source_prefixes array<string>")
    runs_ = runs_.withColumns({"track": telemetry.effective_track(), "repo_name": F.lit("r"), "dataset_name": F.lit("d"), "issue_set_id": F.lit("i"), "snapshot_commit": F.lit(None).cast("string")})
    assert {r.run_id for r in telemetry.superseded(runs_).collect()} == {"2", "4", "5"}


def test_cost_of_points(spark):
    kind = "avg_total_amortized double, total_cost_tokens long, avg_runtime_tokens double, setup_tokens long, n_issues int, n_issues_method int, mean_f1 double"
    rows = [(1000.0, 5, 1.0, 1, 2, 2, 0.5), (None, 900, 1.0, 1, 3, 9, 0.0), (None, 900, 1.0, 1, 0, 9, 0.5), (None, None, 10.0, 60, 0, 6, 0.5), (None, None, 10.0, 60, 0, None, None)]
    got = [(r.cost, r.tokens_per_f1) for r in telemetry.cost_points(spark.createDataFrame(rows, kind).coalesce(1)).collect()]
    assert got == [(1000.0, 2000.0), (300.0, None), (100.0, 200.0), (20.0, 40.0), (70.0, None)]


def test_test_files_and_names(spark):
    paths = {"pkg/Tests/a.py": True, "pkg\\testing\\a.py": True, "Test_x.py": True, "a/x_TEST.py": True, "a/contest.py": False, "latest/a.py": False, "a/test_dir/b.py": False, "tests": True}
    got = {r.p: r.t for r in spark.createDataFrame([(p,) for p in paths], "p string").select("p", T.is_test_file("p").alias("t")).collect()}
    assert got == paths
    names = spark.createDataFrame([(" My/Repo-X v2.0 ",), ("--",), (None,)], "n string").coalesce(1).select(T.slug("n").alias("a"), T.name_slug("n").alias("b")).collect()
    assert [tuple(r) for r in names] == [("my_repo_xv20", "my-repo-x-v2-0"), ("exp", "unknown"), ("exp", "unknown")]
    a = T.suite_id({"repo_name": "r", "evaluation_track": None, "source_prefixes": ("src",), "n": 3})
    assert a == T.suite_id({"n": 3, "repo_name": "r", "evaluation_track": "", "snapshot_commit": "", "source_prefixes": ["src"], "seed": None}) and a.startswith("suite_") and len(a) == 18
    made = spark.range(1).select(T.harness_id("h", F.lit("1"), F.lit("BM 25"), F.lit("/x")).alias("a"), T.harness_id("h", F.lit("1"), F.lit("m"), F.lit("/x"), F.lit("own")).alias("b")).first()
    assert made.a.startswith("h_1_bm-25_") and len(made.a) == 18 and made.b == "own"


def test_datasets_aliases(spark, tmp_path):
    """The cases of two dataset families: other names for the fields, lists as text, empty values that fall through."""
    poly = spark.createDataFrame([("pb-1", "org/repo", "Find files", "c0ffee", "src/a.py\nsrc/b.py"), ("pb-2", "org/other", "ignored", "deadbeef", "x.py")], "id string, repository string, prompt string, base_sha string, gold_files string")
    poly.write.parquet(f"{tmp_path}/poly/test.parquet")
    got = datasets.load_splits(spark, f"{tmp_path}/poly", "SWE-PolyBench", "org/repo").collect()
    assert [(r.instance_id, r.repo, r.problem_statement, r.base_commit, r.gold_files, r.split) for r in got] == [("pb-1", "org/repo", "Find files", "c0ffee", ["src/a.py", "src/b.py"], "test")]
    rows = spark.createDataFrame([("i", "", "diff --git a/./x.py b/./y.py", ["/o.py", "o.py", " "]), ("j", "", "diff --git a/x.py b//y.py", [" "]), ("k", "said", "", [])], "instance_id string, statement string, gold_patch string, oracle_files array<string>")
    out = {r.instance_id: (r.repo, r.problem_statement, r.gold_files) for r in datasets.issues(rows, "fb").collect()}
    assert out == {"i": ("fb", "", ["o.py"]), "j": ("fb", "", ["y.py"]), "k": ("fb", "said", [])}
    many = spark.createDataFrame([("same", str(9 - k)) for k in range(9)], "instance_id string, base_commit string").coalesce(1)
    many.write.parquet(f"{tmp_path}/o/test.parquet")
    assert datasets.load_splits(spark, f"{tmp_path}/o", "x").first().base_commit == "9"


def test_final_files_and_cut(spark):
    kind = "a array<string>, b array<string>, c array<string>"
    rows = spark.createDataFrame([(["x", "y", "x"], ["z"], ["w"]), ([], ["z", "z"], ["w"]), (None, [], ["w"]), (None, None, None)], kind).coalesce(1)
    assert [r.f for r in rows.select(fusion.final_files(F.col("a"), F.col("b"), F.col("c")).alias("f")).collect()] == [["x", "y"], ["z"], ["w"], []]
    cut = fusion.candidate_cut(spark.createDataFrame([(f"f{i}", float(i)) for i in range(9)], "file string, score double"), 2).collect()
    assert [(r.file, r.chosen) for r in sorted(cut, key=lambda r: r.rank)] == [("f8", True), ("f7", True), ("f6", False), ("f5", False), ("f4", False), ("f3", False)]


def test_datasets(spark, tmp_path):
    raw = spark.createDataFrame([("", "7", "r", "diff --git a/x.py b/y.py")], "instance_id string, id string, repo string, patch string")
    assert values(datasets.issues(raw), "instance_id", "gold_files") == [("7", ["y.py"])]
    for split, rows in (("test", [("1", "r")]), ("train", [("1", "r"), ("2", "r"), ("3", "s")])):
        spark.createDataFrame(rows, "instance_id string, repo string").write.parquet(f"{tmp_path}/{split}.parquet")
    got = datasets.load_splits(spark, str(tmp_path), "SWE-x", repo="r")
    assert dict(values(got, "instance_id", "split")) == {"1": "test", "2": "train"}
    assert datasets.family("SWE-PolyBench") == "poly" and datasets.merged_config({"a": {"x": 1, "y": 2}}, {"a": {"y": 3}}) == {"a": {"x": 1, "y": 3}}
    assert datasets.generated_manifests(raw.select("repo", F.col("id").alias("instance_id")), ["m", "n"]).count() == 2


def test_latex_and_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("r", "a", 0.5), ("r", "b", 0.25), ("s", "a", 0.1)], "repo string, method string, f1 double")
    lines = dict(values(runs.latex_pivot(rows, ["a", "b"]), "repo", "line"))
    assert lines == {"r": "r & \\textbf{0.500} & 0.250 \\\\", "s": "s & \\textbf{0.100} & --- \\\\"}
    runs.save_csv(rows, str(tmp_path / "c"), ["method", "repo", "f1"])
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).columns == ["method", "repo", "f1"]
    runs.save_graph(rows.withColumn("_x", F.lit(1)), rows, str(tmp_path / "g"))
    assert "_x" not in runs.load_graph(spark, str(tmp_path / "g"))[0].columns


def test_registry_and_campaign(spark, tmp_path):
    issues = spark.createDataFrame([("1", ["a.py"])], "instance_id string, gold_files array<string>")
    r = Registry()
    assert values(r.run("oracle", issues), "files") == [(["a.py"],)] and values(r.run("none", issues), "files") == [([],)]
    with pytest.raises(ValueError):
        r.run("bm25", issues)
    answered = generate(spark.createDataFrame([("hi",)], "prompt string"), lambda ps: [p.upper() for p in ps])
    assert answered.first().answer == "HI"
    tries = []

    def flaky():
        tries.append(1)
        if len(tries) < 3:
            raise OSError
        return "ok"

    assert with_retries(flaky, [OSError], sleep=lambda _: None) == "ok"
    done, state = [], str(tmp_path / "s.json")

    def fail():
        raise RuntimeError

    assert run_campaign([("a", lambda: done.append("a")), ("b", fail), ("c", lambda: done.append("c"))], state) == {"a": "done", "b": "failed", "c": "pending"}
    assert run_campaign([("a", lambda: done.append("a")), ("b", lambda: done.append("b"))], state) == {"a": "done", "b": "done"} and done == ["a", "b"]
    assert by_repository([("x", lambda: 1), ("y", lambda: 2), ("x", lambda: 3)]) == {"x": [1, 3], "y": [2]}
    assert len(provenance("m")["manifest_sha256"]) == 64


def test_streams_equal_batches(spark, tmp_path):
    folder, rows = tmp_path / "log", []
    folder.mkdir()
    for k in range(3):
        lines = []
        for i in range(20):
            row = {"run_id": f"r{i % 2}", "instance_id": f"i{i % 7}", "patch_status": f"s{(i * 7 + k) % 5}", "ts": f"2024-01-0{k + 1}T00:00:{i:02d}"}
            lines.append(json.dumps(row))
            rows.append(row)
        (folder / f"w{k}.jsonl").write_text("\n".join([*lines, "broken", '{"run_id": "r0"}']))
    stream = checkpoints.checkpoint_stream(spark, str(folder))
    q = checkpoints.latest_per_instance(stream).writeStream.outputMode("complete").format("memory").queryName("latest").start()
    q.processAllAvailable()
    q.stop()
    want = {}
    for r in sorted(rows, key=lambda r: r["ts"]):
        want[r["run_id"], r["instance_id"]] = r["patch_status"]
    assert {(r.run_id, r.instance_id): r.patch_status for r in spark.table("latest").collect()} == want
    q = checkpoints.upsert(checkpoints.checkpoint_stream(spark, str(folder)).where("ts IS NOT NULL"), str(tmp_path / "t"), str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.run_id, r.instance_id): r.patch_status for r in checkpoints.merged(spark, str(tmp_path / "t")).collect()} == want
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    feed = tmp_path / "e"
    events.write.parquet(str(feed))
    live = checkpoints.sessions(spark.readStream.schema(events.schema).parquet(str(feed)), "6 hours", "400 days")
    q = live.writeStream.outputMode("append").format("memory").queryName("live").trigger(availableNow=True).start()
    q.awaitTermination()
    closed = {tuple(r)[:3] for r in spark.table("live").collect()}
    assert closed <= {tuple(r)[:3] for r in checkpoints.sessions(events, "6 hours").collect()}
