"""Candidates by shared words against all pairs, and the greedy budget against a plain loop."""

import random

from pyspark.sql import functions as F

from graphloom.functions.text import token_estimate
from graphloom.operators import fusion


def words(text):
    import re

    return set(re.findall("[a-z0-9]+", (text or "").lower()))


def test_candidate_pools_equal_all_pairs(spark):
    files = [f"d{i % 5}/m{i}.py" for i in range(40)]
    texts = {"a": "m3 d1 and D2/m7.py fail", "b": "", "c": "py", "d": "unknown words", "e": None, "f": "see d4/m14.pyx"}
    rows = spark.createDataFrame([(f,) for f in [*files, files[0]]], "file string")
    queries = spark.createDataFrame(list(texts.items()), "query_id string, text string")
    for limit in (3, 10, 100):
        got = fusion.candidate_pools(rows, queries, limit).collect()
        for q, t in texts.items():
            score = {f: len(words(f) & words(t)) + 2 * (f.lower() in (t or "").lower()) for f in files}
            want = sorted(files, key=lambda f: (-score[f], f))[:limit]
            assert [(r.file, r.score) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] == [(f, score[f]) for f in want], (q, limit)


def test_greedy_budget_equals_a_loop(spark):
    r = random.Random(3)
    arrays = [["x" * r.choice([0, 1, 3, 4, 9, 40, 400]) for _ in range(n)] for n in (0, 1, 5, 60, 3_000)] + [["a"] * 20_000]
    got = spark.createDataFrame([(i, a) for i, a in enumerate(arrays)], "i int, l array<string>").select("i", fusion.greedy_budget(F.col("l"), 50).alias("k")).collect()
    for row in got:
        spent, want = 0, []
        for x in arrays[row.i]:
            if spent + len(x) // 4 <= 50:
                spent += len(x) // 4
                want.append(x)
        assert row.k == want
    assert spark.createDataFrame([(None,)], "l array<string>").select(fusion.greedy_budget(F.col("l")).alias("k"), token_estimate(F.lit("abcd")).alias("e")).first().e == 1
