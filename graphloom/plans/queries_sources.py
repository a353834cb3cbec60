"""Scans, sinks, extraction, resolution, text and model-function queries. Code is read from fixed sources, as the tables hold none."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.operators import agent, chunk, dense, extract, fusion, lexical, paths, resolve
from graphloom.sources import datasets, runs
from graphloom.storage import new_path

from .base import fixed, query
from .queries_graph import NODES
from .registry import generate, register_functions

SOURCES = {
    "a.py": "import b\nfrom c import tool as t\nclass A(b.Base):\n    def run(self):\n        self.step()\n        helper()\n        b.work()\n        t()\n    def step(self):\n        pass\ndef helper():\n    return 1\n",
    "b.py": "def work():\n    pass\nclass Base:\n    pass\n",
    "c.py": "def tool():\n    near()\n",
    "d.py": '"""Module doc."""\nfrom pkg1.mod import *\nfrom pkg1 import mod as m\nimport a\nclass B(a.A, Generic[T]):\n    """ A class. """\n    def go(self, other: a.A) -> int:\n        item = a.A()\n        item.step()\n        def inner():\n            near()\n        m.near()\n        return self.missing()\ndef all_of(k=1):\n    b = B()\n    return b.go(k)\n',
    "pkg1/mod.py": "def near():\n    pass\n",
    "pkg2/mod.py": "def near():\n    pass\n",
    ".hidden/e.py": "x = 1\n",
    "notes.txt": "no source",
}
PARSED = [p for p in SOURCES if p.endswith(".py") and not p.startswith(".")]


def _sources(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(p, SOURCES[p]) for p in PARSED], "path string, content string")


def _folder(spark: SparkSession) -> str:
    """The sources as files of the shared folder."""
    root = new_path(spark, "sources")
    fs = spark._jvm.org.apache.hadoop.fs
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    for path, content in SOURCES.items():
        at = fs.Path(f"{root}/{path}")
        out = at.getFileSystem(conf).create(at)
        out.write(bytearray(content.encode()))
        out.close()
    return root


@fixed("source_scan", "path, n_chars", [("a.py", 195), ("b.py", 42), ("c.py", 23), ("d.py", 336), ("pkg1/mod.py", 21), ("pkg2/mod.py", 21)])
def source_scan(spark: SparkSession) -> DataFrame:
    return extract.scan(spark, _folder(spark)).select("path", F.length("content").alias("n_chars"))


@fixed("source_scan_all", "path, under_pkg", [(".hidden/e.py", False), ("a.py", False), ("b.py", False), ("c.py", False), ("d.py", False), ("pkg1/mod.py", True), ("pkg2/mod.py", True)])
def source_scan_all(spark: SparkSession) -> DataFrame:
    """Hidden folders too; a raw prefix takes every path that begins so."""
    found = extract.scan(spark, _folder(spark), skip_hidden=False)
    below = lexical.with_raw_prefixes(found, ["pkg"]).select("path", F.lit(True).alias("u"))
    return found.join(below, "path", "left").select("path", F.coalesce("u", F.lit(False)).alias("under_pkg"))


@fixed("code_graph_extract", "id, type, name, signature, docstring, file, parent_class, start_line, end_line", [
    ("a.py", "file", "a.py", None, "", "a.py", None, 1, 13), ("a.py::A", "class", "A", None, "", "a.py", None, 3, 10), ("a.py::A.run", "function", "run", "(self)", "", "a.py", "A", 4, 8),
    ("a.py::A.step", "function", "step", "(self)", "", "a.py", "A", 9, 10), ("a.py::helper", "function", "helper", "()", "", "a.py", None, 11, 12),
    ("b.py", "file", "b.py", None, "", "b.py", None, 1, 5), ("b.py::work", "function", "work", "()", "", "b.py", None, 1, 2), ("b.py::Base", "class", "Base", None, "", "b.py", None, 3, 4),
    ("c.py", "file", "c.py", None, "", "c.py", None, 1, 3), ("c.py::tool", "function", "tool", "()", "", "c.py", None, 1, 2),
    ("d.py", "file", "d.py", None, "Module doc.", "d.py", None, 1, 17), ("d.py::B", "class", "B", None, "A class.", "d.py", None, 5, 13),
    ("d.py::B.go", "function", "go", "(self, other: a.A) -> int", "", "d.py", "B", 7, 13), ("d.py::all_of", "function", "all_of", "(k=1)", "", "d.py", None, 14, 16),
    ("pkg1/mod.py", "file", "pkg1/mod.py", None, "", "pkg1/mod.py", None, 1, 3), ("pkg1/mod.py::near", "function", "near", "()", "", "pkg1/mod.py", None, 1, 2),
    ("pkg2/mod.py", "file", "pkg2/mod.py", None, "", "pkg2/mod.py", None, 1, 3), ("pkg2/mod.py::near", "function", "near", "()", "", "pkg2/mod.py", None, 1, 2),
])
def code_graph_extract(spark: SparkSession) -> DataFrame:
    return extract.nodes(extract.definitions(_sources(spark))).select("id", "type", "name", "signature", "docstring", "file", "parent_class", "start_line", "end_line")


@fixed("definition_details", "id, bases, calls, hints", [
    ("a.py::A", "b.Base", "", ""), ("a.py::A.run", "", "self.step .helper b.work .t", ""), ("a.py::A.step", "", "", ""), ("a.py::helper", "", "", ""), ("b.py::work", "", "", ""), ("b.py::Base", "", "", ""),
    ("c.py::tool", "", ".near", ""), ("d.py::B", "a.A Generic", "", ""), ("d.py::B.go", "", "a.A item.step .near m.near self.missing", "item=a.A"), ("d.py::all_of", "", ".B b.go", "b=B"),
    ("pkg1/mod.py::near", "", "", ""), ("pkg2/mod.py::near", "", "", ""),
])
def definition_details(spark: SparkSession) -> DataFrame:
    """Base classes without their parameters, calls in order with those of nested functions, local types."""
    calls = F.array_join(F.transform("calls", lambda c: F.concat_ws(".", c["qualifier"], c["name"])), " ")
    hints = F.array_join(F.transform(F.map_entries("hints"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), " ")
    return extract.definitions(_sources(spark)).where("type <> 'file'").select("id", F.array_join("bases", " ").alias("bases"), calls.alias("calls"), hints.alias("hints"))


EDGES = [
    ("a.py", "a.py::A", "DEFINES", None), ("a.py", "a.py::helper", "DEFINES", None), ("a.py", "b.py", "IMPORTS", None), ("a.py", "c.py", "IMPORTS", None), ("a.py::A", "a.py::A.run", "CONTAINS", None),
    ("a.py::A", "a.py::A.step", "CONTAINS", None), ("a.py::A", "b.py::Base", "INHERITS", None), ("a.py::A.run", "a.py::A.step", "CALLS", "high"), ("a.py::A.run", "a.py::helper", "CALLS", "high"),
    ("a.py::A.run", "b.py::work", "CALLS", "high"), ("a.py::A.run", "c.py::tool", "CALLS", "high"), ("b.py", "b.py::Base", "DEFINES", None), ("b.py", "b.py::work", "DEFINES", None), ("c.py", "c.py::tool", "DEFINES", None),
    ("c.py::tool", "pkg1/mod.py::near", "CALLS", "low"), ("d.py", "a.py", "IMPORTS", None), ("d.py", "pkg1/mod.py", "IMPORTS", None), ("d.py", "d.py::B", "DEFINES", None), ("d.py", "d.py::all_of", "DEFINES", None),
    ("d.py::B", "d.py::B.go", "CONTAINS", None), ("d.py::B", "a.py::A", "INHERITS", None), ("d.py::B.go", "a.py::A", "CALLS", "high"), ("d.py::B.go", "a.py::A.step", "CALLS", "high"),
    ("d.py::B.go", "pkg1/mod.py::near", "CALLS", "high"), ("d.py::all_of", "d.py::B", "CALLS", "high"), ("d.py::all_of", "d.py::B.go", "CALLS", "high"),
    ("pkg1/mod.py", "pkg1/mod.py::near", "DEFINES", None), ("pkg2/mod.py", "pkg2/mod.py::near", "DEFINES", None),
]


@fixed("call_cascade", "src, dst, type, confidence", EDGES)
def call_cascade(spark: SparkSession) -> DataFrame:
    return resolve.code_graph(_sources(spark))[1]


@fixed("call_cascade_sure", "src, dst, confidence", [(s, d, c) for s, d, t, c in EDGES if t == "CALLS" and c != "low"])
def call_cascade_sure(spark: SparkSession) -> DataFrame:
    """Without the calls that only a name links."""
    return resolve.code_graph(_sources(spark), low=False)[1].where("type = 'CALLS'").select("src", "dst", "confidence")


@fixed("import_resolve", "file, alias, kind, symbol, target_file, target_node", [
    ("a.py", "b", "module", None, "b.py", None), ("a.py", "t", "symbol", "tool", "c.py", "c.py::tool"), ("d.py", "*", "symbol", "*", "pkg1/mod.py", None), ("d.py", "m", "module", "mod", "pkg1/mod.py", None),
    ("d.py", "a", "module", None, "a.py", None),
])
def import_resolve(spark: SparkSession) -> DataFrame:
    files = _sources(spark)
    bound = resolve.bindings(extract.imports(files), files, extract.definitions(files))
    return bound.select("file", "alias", "kind", "symbol", "target_file", "target_node")


@fixed("module_files", "file, module, dots, target_file", [
    ("p/q/x.py", "y", 1, "p/q/y.py"), ("p/q/x.py", "", 1, "p/q/__init__.py"), ("p/q/x.py", "r", 2, "p/r/__init__.py"), ("p/q/x.py", "z", 2, None), ("p/q/x.py", "p.q.y", 0, "p/q/y.py"), ("p/q/x.py", "both", 0, "both.py"),
])
def module_files(spark: SparkSession) -> DataFrame:
    """Dots walk up, a module's file comes before its package's."""
    files = spark.createDataFrame([(p,) for p in ("p/q/x.py", "p/q/y.py", "p/q/__init__.py", "p/r/__init__.py", "both.py", "both/__init__.py")], "path string")
    asked = [("p/q/x.py", "y", 1), ("p/q/x.py", "", 1), ("p/q/x.py", "r", 2), ("p/q/x.py", "z", 2), ("p/q/x.py", "p.q.y", 0), ("p/q/x.py", "both", 0)]
    return resolve.module_files(spark.createDataFrame(asked, "file string, module string, dots int"), files)


NAMED = "id string, type string, name string, file string"


@fixed("import_targets", "req, target", [("wild", "s.py::f"), ("again", "r.py::g"), ("member", "r.py::C.m"), ("of module", "r.py::g"), ("symbol", "r.py::C")])
def import_targets(spark: SparkSession) -> DataFrame:
    """C4: members of classes and of modules, wildcards, and what a wildcard's module itself imports."""
    nodes = spark.createDataFrame([("s.py", "file", "s.py", "s.py"), ("s.py::f", "function", "f", "s.py"), ("r.py::g", "function", "g", "r.py"), ("r.py::C", "class", "C", "r.py"), ("r.py::C.m", "function", "m", "r.py")], NAMED)
    files = spark.createDataFrame([(p,) for p in ("x.py", "s.py", "r.py")], "path string")
    found = [("x.py", 0, "*", "s", "*", 0), ("x.py", 1, "r", "r", None, 0), ("x.py", 2, "C", "r", "C", 0), ("s.py", 0, "g", "r", "g", 0)]
    bound = resolve.bindings(spark.createDataFrame(found, extract.IMPORTS), files, nodes)
    asked = [("wild", "x.py", "f", None), ("again", "x.py", "g", None), ("member", "x.py", "C", "m"), ("of module", "x.py", "r", "g"), ("symbol", "x.py", "C", None), ("nothing", "x.py", "h", None)]
    return resolve.import_targets(spark.createDataFrame(asked, "req string, file string, name string, member string"), bound, nodes).select("req", "target")


def _classes(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """Two classes of one name, in a near and in a far folder, and one that a file imports."""
    ids = [("p/a/k.py::K", "K", "p/a/k.py"), ("q/k.py::K", "K", "q/k.py"), ("p/x.py::L", "L", "p/x.py"), ("z.py::List", "List", "z.py")]
    nodes = spark.createDataFrame([(i, "class", n, f) for i, n, f in ids], NAMED)
    files = spark.createDataFrame([(p,) for p in ("p/x.py", "p/a/k.py", "q/k.py", "z.py", "q/y.py")], "path string")
    imports = spark.createDataFrame([("q/y.py", 0, "k", "p.a.k", None, 0), ("q/y.py", 1, "Own", "p.x", "L", 0)], extract.IMPORTS)
    return nodes, resolve.bindings(imports, files, nodes)


@fixed("base_class_cascade", "req, target", [("near", "p/a/k.py::K"), ("same folder", "q/k.py::K"), ("member", "p/a/k.py::K"), ("imported", "p/x.py::L"), ("own file", "p/x.py::L")])
def base_class_cascade(spark: SparkSession) -> DataFrame:
    """Imported member, imported name, own file, then the nearest anywhere."""
    nodes, bound = _classes(spark)
    asked = [("near", "p/x.py", "K"), ("same folder", "q/y.py", "K"), ("member", "q/y.py", "k.K"), ("imported", "q/y.py", "Own"), ("own file", "p/x.py", " L "), ("none", "p/x.py", "Missing"), ("blank", "p/x.py", " ")]
    return resolve.base_classes(spark.createDataFrame(asked, "req string, file string, expr string"), bound, nodes).select("req", "target")


@fixed("type_expression", "req, target", [("optional", "p/a/k.py::K"), ("first", "p/x.py::L"), ("own class", "z.py::List")])
def type_expression(spark: SparkSession) -> DataFrame:
    """The first name that is a class; typing's own words are none, but a user's class may be called List."""
    nodes, bound = _classes(spark)
    asked = [("optional", "p/x.py", "Optional[K]"), ("first", "p/x.py", "dict[str, Union[L, K]]"), ("own class", "p/x.py", "List[int]"), ("noise", "p/x.py", "Optional[Any]"), ("none", "p/x.py", None)]
    return resolve.type_classes(spark.createDataFrame(asked, "req string, file string, expr string"), bound, nodes).select("req", "target")


@fixed("edge_overwrite", "src, dst, type, confidence", [("a", "b", "CALLS", "low"), ("a", "c", "INHERITS", None)])
def edge_overwrite(spark: SparkSession) -> DataFrame:
    """C11: of one pair the last edge written stays, calls after bases after imports."""
    rows = [("a", "b", "IMPORTS", None, 0, 0), ("a", "b", "CALLS", "high", 2, 0), ("a", "b", "CALLS", "low", 2, 3), ("a", "c", "INHERITS", None, 1, 0), ("a", "c", "DEFINES", None, 0, 9)]
    return resolve.one_edge_per_pair(spark.createDataFrame(rows, "src string, dst string, type string, confidence string, stage int, seq int"))


@fixed("definition_chunks", "file, name, n_chars, start_line, end_line", [
    ("a.py", "A", 135, 3, 10), ("a.py", "A.run", 85, 4, 8), ("a.py", "A.step", 33, 9, 10), ("a.py", "helper", 27, 11, 12), ("b.py", "work", 21, 1, 2), ("b.py", "Base", 21, 3, 4),
    ("c.py", "tool", 23, 1, 2), ("d.py", "B", 212, 5, 13), ("d.py", "B.go", 165, 7, 13), ("d.py", "all_of", 48, 14, 16), ("pkg1/mod.py", "near", 21, 1, 2), ("pkg2/mod.py", "near", 21, 1, 2), ("plain.py", "plain.py", 6, 1, 2),
])
def definition_chunks(spark: SparkSession) -> DataFrame:
    """Methods stand beside their class; a file without definitions is one chunk."""
    files = _sources(spark).unionByName(spark.createDataFrame([("plain.py", "x = 1\n")], "path string, content string"))
    return extract.chunks(files).select("file", "name", F.length("text").alias("n_chars"), "start_line", "end_line")


@query(
    "chunk_hygiene", "SELECT doc_id, substr(chunk, 1, 500) AS embed_text FROM c WHERE trim(regexp_replace(chunk, '\\s', '', 'g')) <> ''",
    c="SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN concat(' ', chr(10)) ELSE text END AS chunk FROM {documents}",
)
def chunk_hygiene(c: DataFrame) -> DataFrame:
    return chunk.embeddable(c).select("doc_id", "embed_text")


@query(
    "canonical_lists",
    """WITH v AS (SELECT DISTINCT p AS v FROM urls), w AS (SELECT g, pos, want FROM urls),
    e AS (SELECT w.*, coalesce((SELECT max(v) FROM v WHERE v = want), (SELECT max(v) FROM v WHERE v LIKE '%/' || want HAVING count(*) = 1)) AS c FROM w),
    f AS (SELECT g, c, min(pos) AS pos FROM e WHERE c IS NOT NULL GROUP BY ALL) SELECT g, coalesce(string_agg(c, ',' ORDER BY pos), '') AS files FROM (SELECT DISTINCT g FROM w) LEFT JOIN f USING (g) GROUP BY g""",
    urls="SELECT page_id % 40 AS g, page_id AS pos, p, CASE page_id % 4 WHEN 0 THEN p WHEN 1 THEN 'not/there' ELSE regexp_replace(p, '^[^/]*/', '') END AS want FROM (SELECT page_id, regexp_replace(url, '^[a-z]+://', '') AS p FROM {pages})",
)
def canonical_lists(urls: DataFrame) -> DataFrame:
    lists = urls.groupBy("g").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "want"))), lambda x: x["want"]).alias("paths"))
    return paths.canonical_list(lists, urls.select(F.col("p").alias("path")), "g").select("g", F.array_join("files", ",").alias("files"))


@query(
    "embedding_texts", "SELECT p_partkey, p_name || CASE WHEN kind = 'function' AND coalesce(sig, '') <> '' THEN sig ELSE '' END || CASE WHEN coalesce(doc, '') <> '' THEN ': ' || substr(doc, 1, 200) ELSE '' END AS t FROM p",
    p="SELECT p_partkey, p_name, CASE WHEN p_partkey % 2 = 0 THEN 'function' ELSE 'class' END AS kind, CASE WHEN p_partkey % 3 > 0 THEN concat('(', p_type, ')') END AS sig, CASE p_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE repeat(p_brand, 40) END AS doc FROM {part}",
)
def embedding_texts(p: DataFrame) -> DataFrame:
    return p.select("p_partkey", T.embedding_text("p_name", "kind", "sig", "doc").alias("t"))


@query("method_names", "SELECT event_id, CASE WHEN starts_with(name, 'loom-') THEN substr(name, 6) ELSE name END AS method FROM n", n="SELECT event_id, concat(CASE event_id % 3 WHEN 0 THEN 'loom-' WHEN 1 THEN 'x-loom-' ELSE '' END, event_type) AS name FROM {events}")
def method_names(n: DataFrame) -> DataFrame:
    return n.select("event_id", T.method_of_model("name", "loom-").alias("method"))


@query(
    "confidence_labels", "SELECT event_id, CASE WHEN w >= 0.8 THEN 'high' WHEN w >= 0.4 THEN 'medium' ELSE 'low' END AS label, CASE lower(l) WHEN 'high' THEN 1.0 WHEN 'low' THEN 0.2 ELSE 0.6 END::DOUBLE AS weight FROM e",
    e="SELECT event_id, CAST(event_id % 11 AS DOUBLE) / 10 AS w, CASE event_id % 5 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'low' WHEN 2 THEN 'odd' WHEN 3 THEN 'medium' END AS l FROM {events}",
)
def confidence_labels(e: DataFrame) -> DataFrame:
    return e.select("event_id", T.confidence_label("w").alias("label"), T.confidence_weight("l").alias("weight"))


@query(
    "test_files", r"SELECT page_id, list_contains(string_split(q, '/'), 'tests') OR list_contains(string_split(q, '/'), 'testing') OR starts_with(string_split(q, '/')[-1], 'test_') OR ends_with(string_split(q, '/')[-1], '_test.py') AS is_test FROM (SELECT page_id, lower(replace(p, '\', '/')) AS q FROM f)",
    f=r"SELECT page_id, concat(CASE page_id % 5 WHEN 0 THEN 'src/Tests/' WHEN 1 THEN 'lib\\testing\\' WHEN 2 THEN 'latests/' ELSE '' END, CASE page_id % 7 WHEN 0 THEN 'Test_x.py' WHEN 1 THEN 'y_test.py' WHEN 2 THEN 'contest.py' ELSE 'z.py' END) AS p FROM {pages}",
)
def test_files(f: DataFrame) -> DataFrame:
    return f.select("page_id", T.is_test_file("p").alias("is_test"))


test_files.__test__ = False


@query(
    "patch_prompts", "SELECT item_id, 'Issue:' || chr(10) || text || chr(10) || chr(10) || 'Files:' || chr(10) || '--- a.py' || chr(10) || text || chr(10) || '--- b.py' || chr(10) || 'x' || CASE WHEN fix IS NOT NULL THEN chr(10) || chr(10) || 'Correction:' || chr(10) || fix ELSE '' END AS prompt FROM i",
    i="SELECT item_id, text, CASE WHEN item_id % 2 = 0 THEN concat('again ', item_id) END AS fix FROM {benchmark}",
)
def patch_prompts(i: DataFrame) -> DataFrame:
    shown = lambda path, content: F.struct(F.lit(path).alias("path"), content.alias("content"))
    return i.select("item_id", T.patch_prompt(F.col("text"), F.array(shown("a.py", F.col("text")), shown("b.py", F.lit("x"))), F.col("fix")).alias("prompt"))


@query(
    "file_reads",
    """WITH k AS (SELECT doc_id, asked, regexp_replace(asked, '^(\\./)+', '') AS p FROM r), j AS (SELECT k.*, f.content, starts_with(p, '/') OR list_contains(string_split(p, '/'), '..') AS outside FROM k LEFT JOIN (SELECT path, content FROM r) f ON f.path = k.p)
    SELECT asked, CASE WHEN outside OR content IS NULL THEN NULL WHEN length(content) > 60 THEN substr(content, 1, 60) || chr(10) || '... [truncated]' ELSE content END AS content, CASE WHEN outside THEN 'outside' WHEN content IS NULL THEN 'not found' END AS error FROM j""",
    r="SELECT doc_id, concat('d/', doc_id, '.py') AS path, text AS content, concat(CASE doc_id % 5 WHEN 0 THEN './' WHEN 1 THEN '../' WHEN 2 THEN '/' WHEN 3 THEN 'no/' ELSE '././' END, 'd/', doc_id, '.py') AS asked FROM {documents}",
)
def file_reads(r: DataFrame) -> DataFrame:
    got = agent.read_files(r.select(F.col("asked").alias("path")), r.select("path", "content"), 60)
    return got.withColumnRenamed("path", "asked")


def letters(texts: list[str]) -> list[list[float]]:
    """An embedder that SQL can write too: how often some letters occur."""
    return [[float(t.lower().count(x)) for x in "aeionrst"] for t in texts]


def letters_sql(text: str) -> str:
    return "[" + ", ".join(f"(length({text}) - length(replace(lower({text}), '{x}', '')))::DOUBLE" for x in "aeionrst") + "]"


def cosine_sql(a: str, b: str) -> str:
    norm = lambda v: f"CASE WHEN list_sum(list_transform({v}, lambda x: x * x)) = 0 THEN 1 ELSE sqrt(list_sum(list_transform({v}, lambda x: x * x))) END"
    return f"round(list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1] * z[2])) / ({norm(a)}) / ({norm(b)}), 6)"


@query("embed_batches", f"SELECT item_id, array_to_string(list_transform({letters_sql('text')}, lambda x: x::INT), ' ') AS v FROM i", i="SELECT item_id, text FROM {benchmark}")
def embed_batches(i: DataFrame) -> DataFrame:
    got = dense.embed(i, letters, batch=7)
    return got.select("item_id", F.array_join(F.transform("embedding", lambda x: x.cast("int").cast("string")), " ").alias("v"))


def _upper(prompts: list[str]) -> list[str]:
    return [p.upper() for p in prompts]


@query("model_answers", "SELECT item_id, upper(coalesce(prompt, '')) AS answer FROM i", i="SELECT item_id, CASE WHEN item_id % 9 > 0 THEN concat('item ', item_id, ' of ', length(text)) END AS prompt FROM {benchmark}")
def model_answers(i: DataFrame) -> DataFrame:
    return generate(i, _upper).select("item_id", "answer")


@query("registered_functions", "SELECT event_id, event_id * 2 + 1 AS doubled FROM e", e="SELECT event_id FROM {events}")
def registered_functions(e: DataFrame) -> DataFrame:
    """O3: a caller's function under a name of its own, used in SQL."""

    @F.pandas_udf("long")
    def loom_double(x):  # noqa: ANN001, ANN202
        return x * 2 + 1

    register_functions(e.sparkSession, {"loom_double": loom_double})
    return e.selectExpr("event_id", "loom_double(event_id) AS doubled")


@query("graph_round_trip", "SELECT id, type, name, file FROM nodes", nodes=NODES)
def graph_round_trip(nodes: DataFrame) -> DataFrame:
    """What begins with an underscore is not kept."""
    spark, at = nodes.sparkSession, new_path(nodes.sparkSession, "graph")
    runs.save_graph(nodes.withColumn("_seen", F.lit(1)), nodes.select(F.col("id").alias("src"), F.col("file").alias("dst")), at)
    back = runs.load_graph(spark, at)[0]
    return back.select("id", "type", "name", "file", *(c for c in back.columns if c.startswith("_")))


@query("vectors_round_trip", "SELECT id, round(list_sum(embedding)::DOUBLE, 4) AS total, label FROM v", v="SELECT vec_id AS id, embedding, label FROM {embeddings}")
def vectors_round_trip(v: DataFrame) -> DataFrame:
    at = new_path(v.sparkSession, "vectors")
    runs.save_vectors(v, at)
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x)
    return runs.load_vectors(v.sparkSession, at).select("id", F.round(total, 4).alias("total"), "label")


@query("result_sinks", "SELECT 'run' AS place, user_id, count(*) AS n FROM e GROUP BY user_id UNION ALL SELECT 'latest', user_id, count(*) FROM e GROUP BY user_id", e="SELECT user_id, event_id FROM {events}")
def result_sinks(e: DataFrame) -> DataFrame:
    """The same results under the run's folder and under "latest"."""
    root = new_path(e.sparkSession, "results")
    runs.save_results(e, e.groupBy("user_id").agg(F.count("*").alias("n")), f"{root}/run1")
    read = lambda place, name: e.sparkSession.read.schema("user_id long, n long").json(f"{root}/{place}/summary").select(F.lit(name).alias("place"), "user_id", "n")
    return read("run1", "run").unionByName(read("latest", "latest"))


@query("checkpoint_append", "SELECT instance_id, prediction FROM c UNION ALL SELECT instance_id, prediction FROM c WHERE n % 2 = 0", c="SELECT event_id AS n, CAST(event_id AS STRING) AS instance_id, event_type AS prediction FROM {events}")
def checkpoint_append(c: DataFrame) -> DataFrame:
    """A10: later lines stand beside earlier ones."""
    at = new_path(c.sparkSession, "checkpoint")
    for rows in (c, c.where("n % 2 = 0")):
        runs.append_checkpoints(rows.drop("n"), at)
    return c.sparkSession.read.schema("instance_id string, prediction string").json(at)


@query(
    "latex_table",
    """WITH w AS (SELECT repo, max(f1) FILTER (method = 'click') AS a, max(f1) FILTER (method = 'view') AS b, max(f1) FILTER (method = 'nothing') AS c FROM g GROUP BY repo), m AS (SELECT *, greatest(a, b, c) AS best FROM w)
    SELECT repo, concat_ws(' & ', repo, CASE WHEN a IS NULL THEN '---' WHEN abs(a - best) < 1e-4 THEN printf('\\textbf{%.3f}', a) ELSE printf('%.3f', a) END, CASE WHEN b IS NULL THEN '---' WHEN abs(b - best) < 1e-4 THEN printf('\\textbf{%.3f}', b) ELSE printf('%.3f', b) END, '---') || ' \\\\' AS line FROM m""".replace("\\\\textbf", "\\textbf"),
    g="SELECT concat('u', CAST(user_id AS STRING)) AS repo, event_type AS method, CAST(count(*) AS DOUBLE) / 7 AS f1 FROM {events} WHERE event_type IN ('click', 'view') GROUP BY user_id, event_type",
)
def latex_table(g: DataFrame) -> DataFrame:
    return runs.latex_pivot(g, ["click", "view", "nothing"])


@query("summary_tree", "SELECT concat('run=', repo) AS run_id, n FROM s WHERE n % 7 <> 0", s="SELECT user_id AS repo, count(*) AS n FROM {events} GROUP BY user_id")
def summary_tree(s: DataFrame) -> DataFrame:
    """One document a folder; what can't be parsed is passed over."""
    spark, root = s.sparkSession, new_path(s.sparkSession, "tree")
    text = F.when(F.col("n") % 7 == 0, F.lit("{broken")).otherwise(F.to_json(F.struct("n")))
    run = F.concat(F.lit("run="), F.coalesce(F.col("repo").cast("string"), F.lit("")))
    runs.save_summaries(s.select(run.alias("run_id"), text.alias("value")), root)
    return runs.read_summaries(spark, root, "n long").where("n IS NOT NULL")


@query("adapter_dispatch", "SELECT page_id, CASE WHEN contains(lower(n || ' ' || d), 'polybench') THEN 'poly' ELSE 'default' END AS family FROM a", a="SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'org/SWE-PolyBench_Verified' ELSE 'org/SWE-bench' END AS n, CASE page_id % 3 WHEN 0 THEN 'PolyBench' ELSE '' END AS d FROM {pages}")
def adapter_dispatch(a: DataFrame) -> DataFrame:
    return a.select("page_id", datasets.family_of("n", "d").alias("family"))


@fixed("config_sources", "name, value", [("depth", "3"), ("method", "bm25"), ("repos", "a,b")])
def config_sources(spark: SparkSession) -> DataFrame:
    """A campaign file over defaults; nested settings are merged."""
    read = datasets.config_rows('{"run": {"depth": 3}, "repos": ["a", "b"]}')
    merged = datasets.merged_config({"run": {"depth": 2, "method": "bm25"}, "repos": []}, read)
    flat = {**merged["run"], "repos": ",".join(merged["repos"])}
    return spark.createDataFrame([(k, v if isinstance(v, str) else json.dumps(v)) for k, v in sorted(flat.items())], "name string, value string")


@query("manifest_generation", "SELECT source AS repo, m AS method, count(DISTINCT doc_id)::INT AS n_instances, min(doc_id::VARCHAR) AS first FROM d, (VALUES ('bm25'), ('oracle')) v(m) GROUP BY ALL", d="SELECT source, doc_id FROM {documents}")
def manifest_generation(d: DataFrame) -> DataFrame:
    ids = d.select(F.col("source").alias("repo"), F.col("doc_id").cast("string").alias("instance_id"))
    return datasets.generated_manifests(ids, ["bm25", "oracle"]).select("repo", "method", "n_instances", F.get("instance_ids", F.lit(0)).alias("first"))


@query(
    "span_validation",
    """SELECT i AS issue_id, CASE k WHEN 0 THEN 's0' WHEN 3 THEN 's0,s1' ELSE '' END AS spans, CASE k WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 2 THEN 1 WHEN 3 THEN 0 ELSE 1 END AS violations FROM d""",
    d="""SELECT doc_id AS i, doc_id % 5 AS k, CASE doc_id % 5 WHEN 0 THEN '[{{"symbol_id": "s0", "start": 1, "end": 2, "confidence": 0.5}}, {{"symbol_id": "s9", "confidence": 0.5}}, {{"symbol_id": "s1", "confidence": 1.5}}]'
        WHEN 1 THEN 'no list' WHEN 2 THEN '["s0"]' WHEN 3 THEN '[{{"symbol_id": "s0", "confidence": 0}}, {{"symbol_id": "s1", "confidence": 1}}]' ELSE '[{{"symbol_id": "s0"}}]' END AS answer FROM {documents}""",
)
def span_validation(d: DataFrame) -> DataFrame:
    pool = d.select(F.col("i").alias("issue_id"), F.explode(F.array(F.lit("s0"), F.lit("s1"))).alias("symbol_id"))
    got = fusion.validated_spans(d.select(F.col("i").alias("issue_id"), "answer"), pool)
    return got.select("issue_id", F.array_join(F.col("spans.symbol_id"), ",").alias("spans"), "violations")


@query(
    "final_files", "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'a.py,' || doc_id || '.py' WHEN 1 THEN 'b.py' WHEN 2 THEN 'c.py,d.py' ELSE '' END AS files FROM d",
    d="SELECT doc_id FROM {documents}",
)
def final_files(d: DataFrame) -> DataFrame:
    k = F.col("doc_id") % 4
    own = F.concat(F.col("doc_id").cast("string"), F.lit(".py"))
    none = F.array().cast("array<string>")
    spans = F.when(k == 0, F.array(F.lit("a.py"), own, F.lit("a.py"))).otherwise(none)
    symbols = F.when(k <= 1, F.array(F.lit("b.py"), F.lit("b.py"))).otherwise(none)
    stage1 = F.when(k <= 2, F.array(F.lit("c.py"), F.lit("d.py")))
    return d.select("doc_id", F.array_join(fusion.final_files(spans, symbols, stage1), ",").alias("files"))


@query("candidate_cut", "SELECT p_brand, file, score, rank <= 4 AS chosen FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY score DESC, file) AS rank FROM r) WHERE rank <= 12", r="SELECT p_brand, concat('f', p_partkey) AS file, CAST(p_size AS DOUBLE) AS score FROM {part}")
def candidate_cut(r: DataFrame) -> DataFrame:
    return fusion.candidate_cut(r, 4, ["p_brand"]).select("p_brand", "file", "score", "chosen")


@query("compact_search_hits", "SELECT lower(query) AS query, id, round(max(score), 4) AS score, min(rank)::INT AS rank FROM h WHERE rank <= 5 GROUP BY ALL",
       h="SELECT CASE WHEN event_id % 2 = 0 THEN event_type ELSE upper(event_type) END AS query, user_id AS id, value / 7 AS score, CAST(event_id % 9 + 1 AS INT) AS rank FROM {events}")
def compact_search_hits(h: DataFrame) -> DataFrame:
    return agent.compact_hits(h)
