"""Methods without a DuckDB equivalent, against plain Python."""

import re

from graphloom.plans.methods import Corpus, registry
from graphloom.plans.queries_sources import letters

FILES = {"pkg/core.py": "def start():\n    run()\ndef run():\n    pass\n", "pkg/util.py": "def help_me():\n    pass\n", "pkg/empty.py": "", "tests/test_core.py": "def test_start():\n    start()\n", "lib/one.py": "class One:\n    pass\n"}
NODES = [(p, "file", p, p, 1, 9) for p in FILES] + [
    ("pkg/core.py::start", "function", "start", "pkg/core.py", 1, 2), ("pkg/core.py::run", "function", "run", "pkg/core.py", 3, 4), ("pkg/util.py::help_me", "function", "help_me", "pkg/util.py", 1, 2),
    ("tests/test_core.py::test_start", "function", "test_start", "tests/test_core.py", 1, 2), ("lib/one.py::One", "class", "One", "lib/one.py", 1, 2),
]
EDGES = [
    ("pkg/core.py", "pkg/util.py", "IMPORTS"), ("tests/test_core.py::test_start", "pkg/core.py::start", "CALLS"), ("pkg/core.py::start", "pkg/core.py::run", "CALLS"), ("pkg/util.py::help_me", "lib/one.py::One", "CALLS"),
    ("pkg/util.py", "pkg/core.py", "IMPORTS"),
]
ISSUES = [("i1", "core fails in pkg/util.py when it starts"), ("i2", "nothing known"), ("i3", "one two py"), ("i4", "def run in class One")]


def words(text):
    return set(re.findall("[a-z0-9]+", text.lower()))


def corpus(spark):
    return Corpus(
        spark.createDataFrame(list(FILES.items()), "path string, content string"),
        spark.createDataFrame(NODES, "id string, type string, name string, file string, start_line int, end_line int"),
        spark.createDataFrame([(*e, None) for e in EDGES], "src string, dst string, type string, confidence string"), letters,
    )


def answers(spark, name, **more):
    issues = spark.createDataFrame(ISSUES, "instance_id string, problem_statement string")
    return {r.instance_id: r.files for r in registry(corpus(spark)).run(name, issues, **more).collect()}


def asked(text):
    """What retrieval sees of an issue: paths to Python files are not told."""
    return re.sub(r"\b(?:[\w.-]+/)+[\w.-]+\.py\b", "<PY_PATH>", text)


def ranked_files(text):
    file = {i: f for i, _, _, f, *_ in NODES}
    weight = {}
    for a, b, kind in EDGES:
        a, b = file[a], file[b]
        if a != b:
            test = kind != "IMPORTS" and "test" in a and "test" not in b
            weight[a, b] = weight.get((a, b), 0) + (0.5 if test else 1.0)
    raw = {f: len(words(f) & words(text)) + 3 * (f in text.lower()) for f in FILES}
    total = sum(raw.values())
    p = {f: raw[f] / total if total else 1 / len(FILES) for f in FILES}
    r = {f: 1 / len(FILES) for f in FILES}
    out = {f: sum(w for (a, _), w in weight.items() if a == f) for f in FILES}
    for _ in range(300):
        lost = sum(r[f] for f in FILES if not out[f])
        r = {f: 0.15 * p[f] + 0.85 * (lost * p[f] + sum(r[a] * w / out[a] for (a, b), w in weight.items() if b == f)) for f in FILES}
    return sorted(FILES, key=lambda f: (-round(r[f], 4), f)), r


def test_repomap_like(spark):
    got = answers(spark, "repomap_like")
    for i, text in ISSUES:
        order, r = ranked_files(asked(text))
        assert set(got[i]) == set(order)
        # the iteration stops at a tolerance: files nearer than that may change places
        assert all(r[a] >= r[b] - 1e-5 for a, b in zip(got[i], got[i][1:], strict=False)), i


def test_agentless_like_picks_files_with_symbols(spark):
    got = answers(spark, "agentless_like_localization")
    assert all(len(f) == 4 and set(f) == set(FILES) - {"pkg/empty.py"} for f in got.values())  # four samples, one a file
    assert got == answers(spark, "agentless_like")
    few = answers(spark, "agentless_like", k=1)
    # the first of the merged files alone, or what was merged if it has no symbol
    for i, text in ISSUES:
        cos = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / ((sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5 or 1)
        q = letters([asked(text)])[0]
        dense = {f: max(cos(letters([c])[0], q) for c in [t, *re.split("(?=def )", t)] if c.strip()) for f, t in FILES.items() if t}
        low, high = min(dense.values()), max(dense.values())
        pool = sorted(FILES, key=lambda f: (-len(words(f) & words(asked(text))), f))
        score = {f: 0.55 * ((dense[f] - low) / (high - low) if f in dense else 0) + 0.30 * (1 - pool.index(f) / len(pool)) for f in FILES}
        best = sorted(score.values())[-1]
        assert score[few[i][0]] > best - 0.06, (i, score, few[i])  # chunks of the brute force are cut less finely


def test_methods_by_name(spark):
    valid = spark.createDataFrame([("pkg/core.py",), ("pkg/util.py",)], "path string")
    assert set(answers(spark, "bm25", valid=valid)["i4"]) == {"pkg/core.py", "pkg/util.py"}
    assert all(f in FILES for files in answers(spark, "gm_deterministic").values() for f in files)
