"""Run folders are listed by tasks, and only those right below the root count."""

import inspect

from graphloom.sources import runs


def test_summaries_of_all_folders(spark, tmp_path):
    put = lambda at, text: ((tmp_path / at).parent.mkdir(parents=True, exist_ok=True), (tmp_path / at).write_text(text))
    for i in range(40):
        put(f"run {i}/summary.json", f'{{"n": {i}}}')
    for at in ("_hidden", ".dot", "_k=1", "k=2"):
        put(f"{at}/summary.json", '{"n": 100}')
    put("broken/summary.json", "{oops"), put("a/b/summary.json", '{"n": 7}'), put("summary.json", '{"n": 8}'), put("c/other.json", '{"n": 9}')
    got = {(r.run_id, r.n) for r in runs.read_summaries(spark, f"{tmp_path}/", "n long").where("n IS NOT NULL").collect()}
    want = {(f"run%20{i}", i) for i in range(40)} | {(x, 100) for x in ("_hidden", ".dot", "_k=1", "k=2")}
    assert got == want
    assert '/*/' not in inspect.getsource(runs.read_summaries)
    (tmp_path / "none").mkdir()
    assert runs.read_summaries(spark, f"{tmp_path}/none", "n long").collect() == []
