import hashlib

from graphloom.llm.exact import exact_dedup

from .helpers import ODD, clashing, documents, table


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(hashlib.sha256((t or "").encode()).hexdigest(), []).append(i)
    out = []
    for h, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        left = 1
        for i in ids:
            stays = left == 1 and i == keep
            left -= stays
            out.append((i, keep, len(ids), stays, h))
    return sorted(out, key=str)


def got(df):
    return sorted(map(tuple, df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=str)


def test_equals_brute_force(spark):
    rows = documents(spark)
    assert got(exact_dedup(table(spark, rows))) == brute(rows)


def test_odd_rows_and_clashing_columns(spark):
    assert got(exact_dedup(clashing(table(spark, ODD)))) == brute(ODD)


def test_hot_groups_take_the_broadcast_way(spark):
    rows = [(i, "hot") for i in range(400)] + [(1000 + i, f"t{i}") for i in range(50)] + [(2000, "hot"), (2000, "hot")]
    assert got(exact_dedup(table(spark, rows), max_hot=2, tracked=16)) == brute(rows)


def test_empty(spark):
    assert exact_dedup(table(spark, [])).count() == 0


def test_no_python_in_the_plan(spark):
    plan = exact_dedup(table(spark, ODD))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
