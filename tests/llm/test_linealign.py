import random

from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.llm.linealign import blocks, line_dedup, patience

from .helpers import ODD, clashing, table


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 6), max_size=25), st.lists(st.integers(0, 6), max_size=25))
def test_alignment_is_increasing_and_equal(a, b):
    out = patience(a, b)
    assert all(a[i] == b[j] for i, j in out)
    assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(out, out[1:], strict=False))


def test_patience_prefers_unique_lines():
    a, b = [1, 9, 2, 3, 9, 4], [9, 1, 2, 3, 5, 4]
    assert patience(a, b) == [(0, 1), (2, 2), (3, 3), (5, 5)]


def brute(rows, least=40):
    """Every pair of documents aligned."""
    rows = sorted(rows)
    out = {}
    for k, (i, t) in enumerate(rows):
        lines = [x.strip() for x in t.split("\n")]
        gone = set()
        for _, u in rows[:k]:
            aligned = patience([hash(x) if x else 0 for x in lines], [hash(x.strip()) if x.strip() else 0 for x in u.split("\n")])
            gone.update(blocks(aligned, [*map(len, lines)], least))
        out[i] = ("\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone), sorted(gone))
    return out


def line(k):
    return f"this is line number {k} of the common text"


def rows_with_overlaps():
    rows = []
    for i in range(30):
        own = [f"document {i} has its own line {j} here" for j in range(6)]
        if i % 3 == 0:
            own[2:2] = [line(k) for k in range(i // 6, i // 6 + 4)]
        rows.append((i, "\n".join(own)))
    return rows + [(40, rows[3][1]), (41, rows[3][1] + "\n" + rows[0][1]), (42, "short\nshort"), (43, "short\nshort")]


def test_equals_brute_force(spark):
    rows = rows_with_overlaps()
    out = {r.doc_id: (r.text, r.deleted) for r in line_dedup(table(spark, rows), rare=40).collect()}
    assert out == brute(rows)


def test_frequent_lines(spark):
    rows = [(i, "\n".join([f"own {i} line with some words in it", *(line(k) for k in range(3)), f"end {i} of this one document"])) for i in range(300)]
    out = {r.doc_id: r.deleted for r in line_dedup(table(spark, rows)).collect()}
    assert out.pop(0) == [] and all(d == [1, 2, 3] for d in out.values())


def rows_with_frequent_blocks():
    """Blocks of frequent lines that the first holder and the one before it lack, hold twice or hold in crossing order."""
    rng = random.Random(5)
    block = ["Released under the MIT License.", "", "See the file for the terms."]
    rows = []
    for i in range(160):
        parts = [[line(k)] for k in rng.sample(range(4), rng.randrange(3))] + [[x] for x in rng.sample(["{", "}", "short", ""], 2)]
        parts += [block] * rng.choice([0, 1, 1, 2]) + [block[:1]] * rng.randrange(2) + [[f"own {i // 3} words that three documents hold"]] * rng.randrange(2)
        parts += [[f"document {i} has its own line {j} here"] for j in range(rng.randrange(3))]
        rng.shuffle(parts)
        rows.append((i, "\n".join(x for p in parts for x in p)))
    return rows


def test_frequent_blocks_equal_brute_force(spark):
    rows = rows_with_frequent_blocks()
    out = {r.doc_id: (r.text, r.deleted) for r in line_dedup(table(spark, rows)).collect()}
    assert out == brute(rows)


def test_odd_rows(spark):
    out = line_dedup(clashing(table(spark, ODD))).collect()
    assert len(out) == len(ODD)
    by = {r.doc_id: r.text for r in out}
    assert by[6] and by[7] == "" and by[2] == "" and by[4] == by[5] == "one" and by[3] == " \n\t "


def test_empty(spark):
    assert line_dedup(table(spark, [])).count() == 0
