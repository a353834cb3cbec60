"""Scores and cuts worked out by hand, and inputs past what few rows show."""

import hashlib

import pytest
from pyspark.sql import functions as F

from graphloom.functions.text import path_tokens
from graphloom.operators import graph, tuning
from graphloom.plans import campaign
from graphloom.sources import datasets

NODES = "id string, type string, name string, file string, docstring string, signature string"
EDGES = "src string, dst string, type string, confidence string"


def scores(spark, edges, text, **more):
    names = sorted({x for e in edges for x in e[:2]})
    n = spark.createDataFrame([(x, "file", x, x, "", "") for x in names], NODES)
    s = spark.createDataFrame([("q", "a.py", 1.0)], "query_id string, node_id string, score double")
    i = spark.createDataFrame([("q", text)], "query_id string, text string")
    how = graph.Scoring(ratio=0.0, min_return=6, **more)
    return {r.file: r.score for r in graph.retrieve(n, spark.createDataFrame(edges, EDGES), s, i, depth=1, how=how).collect()}


def test_evidence_score_by_hand(spark):
    got = scores(spark, [("a.py", "b.py", "CALLS", "high"), ("a.py", "c.py", "CALLS", "low")], "fix b")
    # a: sem 1, graph ln 2 / (ln 2 + 1 / 12), conf 1; b: sem 1 / 2, graph 1, conf 1, hint 1; c: sem 1 / 2, graph 1, conf 0.2, penalty 1
    assert got == {"a.py": pytest.approx(0.817803, abs=1e-6), "b.py": pytest.approx(0.775), "c.py": pytest.approx(0.465)}


def test_hub_penalty_by_hand(spark):
    many = [("a.py", "b.py", "CALLS", "high"), *(("b.py", f"x{i}.py", "CALLS", "high") for i in range(29))]
    plain = scores(spark, many[:20], "")
    assert plain["b.py"] == pytest.approx(0.675)  # 20 ends: not yet a hub
    assert scores(spark, many, "")["b.py"] == pytest.approx(0.675 - 0.05 * 0.35 * 0.5)  # 30 ends: half way to twice the threshold
    assert graph.Scoring().hub_threshold == tuning.Config("x").hub_threshold == 20


def test_path_tokens_take_backslashes_for_slashes(spark):
    rows = spark.createDataFrame([("src\\pkg\\Core_two.test.py",), ("a/b.c/d",), ("",)], "p string").select(path_tokens("p").alias("t")).collect()
    assert [r.t for r in rows] == [["src", "pkg", "core", "two", "test"], ["a", "b", "d"], []]


def test_tools_show_what_their_mode_allows(spark):
    doc = "d" * 200
    n = [("f.py", "file", "f", "f.py", doc, ""), ("lib/g.py", "file", "g", "lib/g.py", doc, ""), ("f.py::C", "class", "C", "f.py", doc, "")]
    n += [(f"f.py::{i:02d}", "function", f"n{i:02d}", "f.py", doc, f"(x{i})") for i in range(30)] + [(f"f.py::C.m{i}", "function", f"m{i}", "f.py", doc, "()") for i in range(9)]
    e = [("f.py", "f.py::C", "DEFINES", None), ("lib/g.py", "f.py", "IMPORTS", None)] + [("f.py", f"f.py::{i:02d}", "DEFINES", None) for i in range(30)]
    e += [("f.py::C", f"f.py::C.m{i}", "CONTAINS", None) for i in range(9)]
    n, e = spark.createDataFrame(n, NODES), spark.createDataFrame(e, EDGES)
    for mode, cap, chars, total, own, said in (("progressive", 10, 40, 8, 4, 50), ("baseline", 20, 60, 12, 6, 80)):
        asked = spark.createDataFrame([("f.py",), ("lib/g.py",), ("f.py",), ("none",), (None,)], "node_id string")
        got = graph.neighbor_tool(n, e, asked, mode).collect()
        mine = [r for r in got if r.node_id == "f.py"]
        assert len(mine) == cap and {len(r.docstring) for r in mine} == {chars} and {r.pos for r in mine} == set(range(1, cap + 1))
        assert [(r.id, r.direction) for r in got if r.node_id == "lib/g.py"] == [("f.py", "outgoing")]
        assert [r.error for r in got if r.node_id == "none"] == ["unknown node: none"]
        summary = graph.file_summary(n, e, spark.createDataFrame([("f.py",), ("g.py",), ("no.py",)], "path string"), mode).collect()
        mine = sorted((r for r in summary if r.path == "f.py"), key=lambda r: r.pos)
        assert [r.name for r in mine] == ["C", *(f"n{i:02d}" for i in range(total - 1))] and {len(r.docstring) for r in mine} == {said}
        assert len(mine[0].methods) == own and mine[0].signature is None and mine[1].signature == "(x0)"
        assert [r.error for r in summary if r.path == "no.py"] == ["unknown file: no.py"] and not [r for r in summary if r.path == "g.py"]


def test_file_summary_prefers_the_whole_path(spark):
    n = spark.createDataFrame([(p, "file", p, p, "", "") for p in ("x/f.py", "f.py", "y/g.py", "b/y/g.py")] + [("k", "function", "k", "f.py", "", "")], NODES)
    e = spark.createDataFrame([(p, "k", "DEFINES", None) for p in ("x/f.py", "f.py", "y/g.py", "b/y/g.py")], EDGES)
    got = {p: graph.file_summary(n, e, p).first().file for p in ("f.py", "g.py", "y/g.py", "x/f.py")}
    assert got == {"f.py": "f.py", "g.py": "b/y/g.py", "y/g.py": "y/g.py", "x/f.py": "x/f.py"}


def test_families_of_any_number_of_names(spark):
    rows = spark.range(5_000).select("id", F.concat(F.lit("org/"), "id", F.when(F.col("id") % 3 == 0, "-PolyBench").otherwise("")).alias("n"), F.lit(None).cast("string").alias("d"))
    got = rows.unionByName(spark.createDataFrame([(-1, None, None), (-2, None, "polybench")], "id long, n string, d string")).select("id", datasets.family_of("n", "d").alias("f"))
    assert got.count() == 5_002 and got.where("f = 'poly'").count() == 1_667 + 1
    assert {r.id: r.f for r in got.where("id < 0").collect()} == {-1: "default", -2: "poly"}


def test_manifest_digest(spark):
    lines = spark.range(5_000).select(F.concat(F.lit("r"), F.col("id") % 4_000).alias("x")).unionByName(spark.createDataFrame([(None,)], "x string"))
    want = hashlib.sha256("\n".join(sorted({f"r{i}" for i in range(4_000)})).encode()).hexdigest()
    assert tuple(campaign.manifest_digest(lines, "x").first()) == (4_000, want)
    assert campaign.manifest_digest(lines.limit(0), "x").first().n_lines == 0
    with pytest.raises(Exception, match="more than 3999 lines"):
        campaign.manifest_digest(lines, "x", 3_999).collect()
