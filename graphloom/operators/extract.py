"""Code extraction (A1, B, E1): Python sources to definitions, imports and chunks, parsed with the standard library.

`files(path, content)`; a file that does not parse gives its file row and nothing else.
"""

from __future__ import annotations

import ast
import warnings
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.shipping import ship

CHUNK_CHARS = 2000
#: Files whose rows are held at a time.
FILES = 64

DEFS = (
    "id string, type string, name string, signature string, docstring string, file string, parent_class string, start_line int, end_line int, "
    "bases array<string>, calls array<struct<name:string,qualifier:string>>, hints map<string,string>"
)
IMPORTS = "file string, seq int, alias string, module string, symbol string, dots int"
CHUNKS = "file string, name string, text string, start_line int, end_line int"


def scan(spark: SparkSession, root: str, skip_hidden: bool = True) -> DataFrame:
    """`path, content` of the Python files below `root`; hidden ones only where asked for.

    Spark's own file sources pass over names that begin with an underscore, so packages' __init__.py would be missing. The
    driver lists names, tasks read the files; `root` is a path or URI that all machines can open. Bytes that are no UTF-8
    are replaced, files that can't be read are passed over.
    """
    from pyarrow import fs

    system, base = fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root)
    base = base.rstrip("/")
    found = system.get_file_info(fs.FileSelector(base, recursive=True))
    paths = sorted(f.path[len(base) + 1 :] for f in found if f.is_file and f.path.endswith(".py"))
    if skip_hidden:
        paths = [p for p in paths if not any(part.startswith(".") for part in p.split("/"))]
    ship(spark)

    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa

        system = fs.FileSystem.from_uri(root)[0] if "://" in root else fs.LocalFileSystem()
        for batch in batches:
            out = []
            for p in batch.column(0).to_pylist():
                try:
                    with system.open_input_stream(f"{base}/{p}") as f:
                        out.append({"path": p, "content": f.read().decode("utf-8", "replace")})
                except OSError:
                    continue
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("path", pa.string()), ("content", pa.string())]))

    listed = spark.createDataFrame([(p,) for p in paths], "path string")
    return listed.repartition(max(1, min(len(paths) // 100, 1000))).mapInArrow(read, "path string, content string")


def _dotted(node: ast.AST) -> str:
    try:
        return ast.unparse(node)
    except Exception:  # noqa: BLE001
        return ""


def _calls(body: ast.AST) -> list[dict]:
    out = []
    for x in ast.walk(body):
        if isinstance(x, ast.Call):
            f = x.func
            if isinstance(f, ast.Name):
                out.append((f.lineno, f.col_offset, f.id, ""))
            elif isinstance(f, ast.Attribute):
                first = f.value
                while isinstance(first, (ast.Attribute, ast.Call, ast.Subscript)):
                    first = first.func if isinstance(first, ast.Call) else first.value
                out.append((f.lineno, f.col_offset, f.attr, first.id if isinstance(first, ast.Name) else ""))
    return [{"name": n, "qualifier": q} for _, _, n, q in sorted(out)]


def _hints(body: ast.AST) -> dict[str, str]:
    out = {}
    found = [x for x in ast.walk(body) if isinstance(x, (ast.AnnAssign, ast.Assign))]
    for x in sorted(found, key=lambda x: (x.lineno, x.col_offset)):
        if isinstance(x, ast.AnnAssign) and isinstance(x.target, ast.Name):
            out[x.target.id] = _dotted(x.annotation)
        elif isinstance(x, ast.Assign) and isinstance(x.value, ast.Call) and isinstance(x.value.func, (ast.Name, ast.Attribute)):
            for t in x.targets:
                if isinstance(t, ast.Name):
                    out[t.id] = _dotted(x.value.func)
    return out


def _start(node: ast.AST) -> int:
    return min([node.lineno, *(d.lineno for d in node.decorator_list)])


def _function(node: ast.AST, file: str, parent: str | None) -> dict:
    owner = f"{parent}." if parent else ""
    returns = f" -> {_dotted(node.returns)}" if node.returns else ""
    return {
        "id": f"{file}::{owner}{node.name}", "type": "function", "name": node.name, "signature": f"({_dotted(node.args)}){returns}",
        "docstring": (ast.get_docstring(node) or "").strip(), "file": file, "parent_class": parent, "start_line": node.lineno, "end_line": node.end_lineno,
        "bases": [], "calls": _calls(node), "hints": _hints(node),
    }


def _base(node: ast.expr) -> str:
    return _dotted(node.value if isinstance(node, ast.Subscript) else node)


FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)


def definitions_of(path: str, content: str) -> tuple[list[dict], list[dict]]:
    """Definition rows and import rows of one file. Nested functions and classes are no nodes."""
    rows = [{"id": path, "type": "file", "name": path, "signature": None, "docstring": None, "file": path, "parent_class": None, "start_line": 1, "end_line": content.count("\n") + 1, "bases": [], "calls": [], "hints": {}}]
    imports: list[dict] = []
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(content)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return rows, imports
    rows[0]["docstring"] = (ast.get_docstring(tree) or "").strip()
    defs: dict[str, dict] = {}
    for node in tree.body:
        if isinstance(node, FUNCTIONS):
            row = _function(node, path, None)
            defs[row["id"]] = row
        elif isinstance(node, ast.ClassDef):
            defs[f"{path}::{node.name}"] = {
                "id": f"{path}::{node.name}", "type": "class", "name": node.name, "signature": None, "docstring": (ast.get_docstring(node) or "").strip(),
                "file": path, "parent_class": None, "start_line": node.lineno, "end_line": node.end_lineno, "bases": [_base(b) for b in node.bases], "calls": [], "hints": {},
            }
            for x in node.body:
                if isinstance(x, FUNCTIONS):
                    row = _function(x, path, node.name)
                    defs[row["id"]] = row
        elif isinstance(node, ast.Import):
            for a in node.names:
                imports.append({"alias": a.asname or a.name.split(".")[0], "module": a.name, "symbol": None, "dots": 0})
        elif isinstance(node, ast.ImportFrom):
            for a in node.names:
                imports.append({"alias": a.asname or a.name, "module": node.module or "", "symbol": a.name, "dots": node.level})
    return rows + list(defs.values()), [{"file": path, "seq": i, **x} for i, x in enumerate(imports)]


def chunks_of(path: str, content: str) -> list[dict]:
    """A chunk for each top-level definition and each method; the whole file where there is none."""
    lines = content.splitlines(keepends=True)
    out: list[dict] = []

    def add(node: ast.AST, name: str) -> None:
        first = _start(node)
        out.append({"file": path, "name": name, "text": "".join(lines[first - 1 : node.end_lineno])[:CHUNK_CHARS], "start_line": first, "end_line": node.end_lineno})

    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            body = ast.parse(content).body
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        body = []
    for node in body:
        if isinstance(node, (*FUNCTIONS, ast.ClassDef)):
            add(node, node.name)
            if isinstance(node, ast.ClassDef):
                for x in node.body:
                    if isinstance(x, FUNCTIONS):
                        add(x, f"{node.name}.{x.name}")
    if not out:
        out.append({"file": path, "name": path, "text": content[:CHUNK_CHARS], "start_line": 1, "end_line": content.count("\n") + 1})
    return out


def _mapped(files: DataFrame, rows, schema: str) -> DataFrame:
    from pyspark.sql.types import _parse_datatype_string

    ship(files.sparkSession)
    arrow = _parse_datatype_string(schema)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        kind = to_arrow_schema(arrow)
        for batch in batches:
            for at in range(0, batch.num_rows, FILES):
                part = batch.slice(at, FILES)
                out = [r for p, c in zip(part.column(0), part.column(1), strict=True) if p.as_py() is not None for r in rows(p.as_py(), c.as_py() or "")]
                yield pa.RecordBatch.from_pylist(out, schema=kind)

    return files.select("path", "content").mapInArrow(run, arrow)


def definitions(files: DataFrame) -> DataFrame:
    """File, class and function rows with what resolution needs; of one id the last definition."""
    return _mapped(files, lambda p, c: definitions_of(p, c)[0], DEFS)


def imports(files: DataFrame) -> DataFrame:
    """Top-level imports in order; a plain import has no symbol."""
    return _mapped(files, lambda p, c: definitions_of(p, c)[1], IMPORTS)


def chunks(files: DataFrame) -> DataFrame:
    return _mapped(files, chunks_of, CHUNKS)


def nodes(defs: DataFrame) -> DataFrame:
    """Definition rows without what only resolution needs."""
    return defs.drop("bases", "calls", "hints")


def structure_edges(defs: DataFrame) -> DataFrame:
    """DEFINES from files and CONTAINS from classes: `src, dst, type, confidence`."""
    top = defs.where("type <> 'file' AND parent_class IS NULL").select(F.col("file").alias("src"), F.col("id").alias("dst"), F.lit("DEFINES").alias("type"))
    inner = defs.where("parent_class IS NOT NULL").select(F.concat("file", F.lit("::"), "parent_class").alias("src"), F.col("id").alias("dst"), F.lit("CONTAINS").alias("type"))
    return top.unionByName(inner).withColumn("confidence", F.lit(None).cast("string"))


def last_definitions(defs: DataFrame) -> DataFrame:
    """B3 over rows gathered elsewhere: of one id the one that starts last."""
    w = Window.partitionBy("id").orderBy(F.col("start_line").desc())
    return defs.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
