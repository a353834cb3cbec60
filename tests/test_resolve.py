import pytest

from graphloom.operators import extract, resolve


@pytest.fixture(autouse=True)
def small(spark):
    """A hundred tiny joins: planning costs more than running."""
    quick = {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "1", "spark.sql.codegen.wholeStage": "false"}
    was = {k: spark.conf.get(k) for k in quick}
    for k, v in quick.items():
        spark.conf.set(k, v)
    yield
    for k, v in was.items():
        spark.conf.set(k, v)


def built(spark, files, low=True):
    df = spark.createDataFrame(list(files.items()), "path string, content string")
    nodes, edges = resolve.code_graph(df, low)
    return {r.id: r for r in nodes.collect()}, {(r.src, r.dst): (r.type, r.confidence) for r in edges.collect()}


FILES = {
    "a.py": "import b\nfrom c import tool as t\nfrom pkg1 import mod\n\nclass A:\n    def run(self):\n        self.step()\n        helper()\n        b.work()\n        t()\n        mod.far()\n    def step(self):\n        pass\n\ndef helper():\n    '''Doc.'''\n    return 1\n",
    "b.py": "def work():\n    pass\nclass B:\n    def step(self):\n        pass\n",
    "c.py": "def tool():\n    pass\n",
    "pkg1/mod.py": "def far():\n    pass\ndef near():\n    pass\n",
    "pkg1/sub/caller.py": "def go():\n    near()\n",
    "pkg2/mod.py": "def near():\n    pass\n",
}


def test_call_cascade(spark):
    nodes, edges = built(spark, FILES)
    run = "a.py::A.run"
    assert edges[run, "a.py::A.step"] == ("CALLS", "high") and (run, "b.py::B.step") not in edges
    assert edges[run, "a.py::helper"] == ("CALLS", "high")
    assert edges[run, "b.py::work"] == edges[run, "c.py::tool"] == edges[run, "pkg1/mod.py::far"] == ("CALLS", "high")
    assert edges["pkg1/sub/caller.py::go", "pkg1/mod.py::near"] == ("CALLS", "low")
    assert edges["a.py", "b.py"][0] == "IMPORTS" and edges["a.py", "a.py::A"][0] == "DEFINES" and edges["a.py::A", run][0] == "CONTAINS"
    assert nodes["a.py::helper"].docstring == "Doc." and nodes[run].parent_class == "A"


def test_low_confidence_can_be_dropped(spark):
    _, edges = built(spark, FILES, low=False)
    assert all(c != "low" for _, c in edges.values())


def test_inheritance(spark):
    _, edges = built(spark, {
        "base.py": "class Base:\n    pass\nclass Other:\n    pass\n",
        "child.py": "from base import Base\nimport base\nclass C(Base):\n    pass\nclass D(base.Other[int]):\n    pass\n",
        "local.py": "class P:\n    pass\nclass Q(P, metaclass=M):\n    pass\n",
    })
    inherits = {k for k, (t, _) in edges.items() if t == "INHERITS"}
    assert inherits == {("child.py::C", "base.py::Base"), ("child.py::D", "base.py::Other"), ("local.py::Q", "local.py::P")}


def test_confidence_labels(spark):
    _, edges = built(spark, {
        "external.py": "def outside():\n    pass\n",
        "local.py": "class K:\n    def inner(self):\n        pass\ndef top():\n    pass\ndef caller():\n    top()\n    inner()\n    outside()\n",
    })
    got = {d: c for (s, d), (t, c) in edges.items() if s == "local.py::caller"}
    assert got == {"local.py::top": "high", "local.py::K.inner": "medium", "external.py::outside": "low"}


def test_typed_receivers_and_wildcards(spark):
    _, edges = built(spark, {
        "m/__init__.py": "from .impl import *\n",
        "m/impl.py": "class Engine:\n    def start(self):\n        pass\ndef make():\n    pass\n",
        "use.py": "from m.impl import Engine\nfrom m import *\ndef f():\n    e = Engine()\n    e.start()\ndef g(x):\n    y: Engine = x\n    y.start()\ndef h():\n    make()\n",
    })
    assert edges["use.py::f", "m/impl.py::Engine.start"] == edges["use.py::g", "m/impl.py::Engine.start"] == ("CALLS", "high")
    assert edges["use.py", "m/impl.py"][0] == "IMPORTS" and edges["m/__init__.py", "m/impl.py"][0] == "IMPORTS"


def test_broken_and_empty_files(spark):
    nodes, edges = built(spark, {"bad.py": "def (:\n", "empty.py": "", "ok.py": "def f():\n    pass\n"})
    assert set(nodes) == {"bad.py", "empty.py", "ok.py", "ok.py::f"} and set(edges) == {("ok.py", "ok.py::f")}


def test_chunks():
    out = extract.chunks_of("a.py", FILES["a.py"])
    assert [c["name"] for c in out] == ["A", "A.run", "A.step", "helper"]
    assert extract.chunks_of("x.py", "X = 1\n") == [{"file": "x.py", "name": "x.py", "text": "X = 1\n", "start_line": 1, "end_line": 2}]


def test_scan(spark, tmp_path):
    for p in ("a.py", "pkg/__init__.py", "pkg/b.py", ".hidden/c.py", "pkg/.d.py", "pkg/e.txt"):
        (tmp_path / p).parent.mkdir(exist_ok=True)
        (tmp_path / p).write_text("x = 1\n")
    assert sorted(r.path for r in extract.scan(spark, str(tmp_path)).collect()) == ["a.py", "pkg/__init__.py", "pkg/b.py"]
    assert extract.scan(spark, str(tmp_path), skip_hidden=False).count() == 5


@pytest.mark.parametrize("text", ["class A(B, C[int]):\n    pass\n", "import a.b as c, d\nfrom . import e\nfrom ..f import (g, h as i)\nfrom j import *\n"])
def test_rows_of_one_file(text):
    rows, imports = extract.definitions_of("p/q.py", text)
    if imports:
        assert [(x["alias"], x["module"], x["symbol"], x["dots"]) for x in imports] == [
            ("c", "a.b", None, 0), ("d", "d", None, 0), ("e", "", "e", 1), ("g", "f", "g", 2), ("i", "f", "h", 2), ("*", "j", "*", 0)
        ]
    else:
        assert rows[1]["bases"] == ["B", "C"]


def test_import_resolve_query(spark):
    import __spark_entry__ as entry

    rows = {(r.file, r.alias, r.target_file, r.target_node) for r in entry.queries()["import_resolve"](spark, "").collect()}
    assert {x[:3] for x in rows} == {("a.py", "b", "b.py"), ("a.py", "t", "c.py"), ("d.py", "*", "pkg1/mod.py"), ("d.py", "m", "pkg1/mod.py"), ("d.py", "a", "a.py")}
    assert {x[3] is not None for x in rows if x[1] == "t"} == {True}
