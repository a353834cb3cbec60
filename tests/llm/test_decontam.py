import random
import re
from collections import Counter

from graphloom.llm.decontam import clean, decontaminate

from .helpers import ODD, clashing, documents, table


def bag(words):
    return Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else Counter()


def words_of(text):
    return [w for w in re.split("[\x20\x09-\x0d]+", (text or "").lower()) if w]


def brute(rows, items):
    """Of each document, the items that any window of their length matches."""
    out = []
    for i, t in rows:
        w = words_of(t)
        hit = set()
        for k, x in items:
            y = words_of(x)
            if not y:
                continue
            for at in range(max(1, len(w) - len(y) + 1)):
                a, b = bag(w[at : at + len(y)]), bag(y)
                both = sum((a & b).values())
                if both and 100 * both >= 75 * (sum(a.values()) + sum(b.values()) - both):
                    hit.add(k)
        out.append((i, tuple(sorted(hit))))
    return sorted(out, key=str)


def got(df):
    return sorted([(r.doc_id, tuple(r.item_ids)) for r in df.collect()], key=str)


def bench(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


def test_equals_brute_force(spark):
    items = [(r.item_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    rows = documents(spark)
    rng = random.Random(5)
    for k, (i, t) in enumerate(rows[:40]):  # passages with a few words changed, dropped or added
        x = rng.choice(items)[1].split()
        for _ in range(k % 4):
            at = rng.randrange(len(x))
            x[at : at + rng.randrange(2)] = ["other"] * rng.randrange(2)
        w = t.split()[:300]
        at = rng.randrange(len(w) + 1)
        rows.append((10_000 + i, " ".join(w[:at] + x + w[at:])))
    assert got(decontaminate(table(spark, rows), bench(spark, items))) == brute(rows, items)


def edited(rng, x):
    """One of the ways in which passages come back: words changed, runs put in or left out, halves swapped, ends cut, repeats."""
    x, kind = [*x], rng.randrange(6)
    if kind == 0:
        at = len(x) // 2 + rng.randrange(-5, 6)
        x = x[at:] + x[:at]
    if kind in (1, 2):
        at, n = rng.randrange(len(x)), rng.randrange(1, 13)
        x[at : at + n * (kind == 2)] = [f"new{rng.randrange(99)}" for _ in range(n * (kind == 1))]
    if kind in (1, 3):
        for _ in range(rng.randrange(7)):
            x[rng.choice((0, -1)) + rng.randrange(-2, 3)] = "changed"
    if kind == 4:
        x = x[rng.randrange(len(x) // 6) : len(x) - rng.randrange(len(x) // 6)]
    if kind == 5:
        for _ in range(rng.randrange(1, 4)):
            x[rng.randrange(len(x))] = "other"
    return x


def test_edited_passages_equal_brute_force(spark):
    rng = random.Random(11)
    vocabulary = [f"w{k}" for k in range(400)]
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.choice((12, 40, 40, 59, 80, 116, 120))))) for k in range(30)]
    items += [(30, "a b " * 30), (31, "tick " * 25 + "tock " * 15), (32, items[0][1] + " " + items[1][1])]
    rows = []
    for i in range(500):
        w = rng.choices(vocabulary, k=rng.randrange(80))
        at = rng.randrange(len(w) + 1)
        rows.append((i, " ".join(w[:at] + edited(rng, rng.choice(items)[1].split()) + w[at:])))
    rows.append((900, " ".join(x[1] for x in items)))
    want = brute(rows, items)
    assert sum(len(hit) > 0 for _, hit in want) > 150
    assert got(decontaminate(table(spark, rows), bench(spark, items))) == want


def test_windows_cross_the_stretches_of_a_document(spark, monkeypatch):
    from graphloom.llm import decontam

    monkeypatch.setattr(decontam, "STRETCH", 1)  # four item lengths
    rng = random.Random(3)
    items = [(k, " ".join(f"x{rng.randrange(60)}" for _ in range(30))) for k in range(4)]
    rows = [(i, " ".join(y for k in range(14) for y in ([f"f{rng.randrange(9)}"] * rng.randrange(25) + edited(rng, items[(i + k) % 4][1].split())))) for i in range(20)]
    assert got(decontaminate(table(spark, rows), bench(spark, items))) == brute(rows, items)


def test_odd_rows(spark):
    items = [(1, "one"), (2, ""), (3, None), (None, "some text"), (4, " ".join(f"word{i % 5003} tail{i % 17}." for i in range(1000, 1030))), (5, "a a a a a a a a a a")]
    rows = [*ODD, (20, "a a a a a a a a a a a a"), (21, "ONE"), (22, "a a a a a a a a a a b")]
    df = clashing(table(spark, rows))
    assert got(decontaminate(df, bench(spark, items))) == brute(rows, [x for x in items if x[0] is not None])
    left = clean(df, bench(spark, items))
    assert left.columns == df.columns
    assert sorted((r.doc_id for r in left.collect()), key=str) == sorted((i for i, hit in brute(rows, [x for x in items if x[0]]) if not hit), key=str)


def test_empty(spark):
    assert decontaminate(table(spark, []), bench(spark, [(1, "a b c d e f")])).count() == 0
    assert not any(r.contaminated for r in decontaminate(table(spark, ODD), bench(spark, [])).collect())


def test_no_python_in_the_plan(spark):
    plan = decontaminate(table(spark, ODD), bench(spark, [(1, "a b c d e f")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def best(rows, items):
    """Of each document and item the largest similarity of any window, where it matches."""
    out = {}
    for i, t in rows:
        w = words_of(t)
        for k, x in items:
            y = words_of(x)
            b, a = bag(y), None
            for at in range(max(1, len(w) - len(y) + 1)):
                a = bag(w[at : at + len(y)])
                both = sum((a & b).values())
                if both and 100 * both >= 75 * (sum(a.values()) + sum(b.values()) - both):
                    out[i] = max(out.get(i, 0), both / (sum(a.values()) + sum(b.values()) - both))
    return out


def test_long_items_equal_brute_force(spark):
    """Items that take windows in steps: whole, edited near the least similarity, cut by the document's ends, repetitive."""
    rng = random.Random(8)
    vocabulary = [f"w{k}" for k in range(3_000)]
    items = [(1, " ".join(rng.choices(vocabulary, k=700))), (2, " ".join(rng.choices(vocabulary, k=1_100))), (3, "tick tock tack " * 200 + "end")]
    rows = []
    for i in range(14):
        x = rng.choice(items[:2])[1].split()
        for _ in range(rng.choice((0, 3, 12, 17, 19, 21, 24)) * len(x) // 700):
            x[rng.randrange(len(x))] = "other"
        around = [rng.choices(vocabulary, k=rng.randrange(300)) for _ in range(2)]
        rows.append((i, " ".join(around[0] + x[rng.randrange(60) :] + around[1])))
    rows += [(50, items[2][1]), (51, "tick tock tack " * 330), (52, " ".join(items[0][1].split()[:600])), (53, "none of them")]
    want = brute(rows, items)
    assert 4 < sum(len(hit) > 0 for _, hit in want) < len(rows)
    told = decontaminate(table(spark, rows), bench(spark, items))
    assert got(told) == want
    high = best(rows, items)
    assert all(abs(r.best_similarity - high.get(r.doc_id, 0.0)) < 1e-9 for r in told.collect())


def test_no_match_is_left_to_chance(spark):
    """A passage at 48 of 56 shingles, the others being those of another item of its length: its fingerprint shares no block with the item's."""
    rng = random.Random(3571)
    words = lambda n: [f"{rng.randrange(10**6)}" for _ in range(n)]
    item, tail = words(60), words(8)
    items = [(1, " ".join(item)), (2, " ".join(words(48) + item[48:52] + tail))]
    rows = [(1, " ".join(item[:52] + tail))]
    assert brute(rows, items) == [(1, (1,))]
    assert got(decontaminate(table(spark, rows), bench(spark, items))) == brute(rows, items)
