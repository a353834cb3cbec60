import random
from collections import Counter

import numpy as np

from graphloom.llm.suffix import LENGTH, STRETCH, _anchors, multikey_quicksort, remove_repeats

from .helpers import ODD, clashing, documents, table


def brute(rows):
    texts = [(i, (t or "").encode()) for i, t in rows]
    count = Counter(t[p : p + LENGTH] for _, t in texts for p in range(len(t) - LENGTH + 1))
    out = []
    for i, t in texts:
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - LENGTH + 1):
            if count[t[p : p + LENGTH]] > 1:
                gone[p : p + LENGTH] = True
        kept = bytes(np.frombuffer(t, np.uint8)[~gone])
        runs = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out.append((i, len(t), runs, kept))
    return sorted(out, key=str)


def got(df):
    return sorted([(r.doc_id, r.n_bytes, len(r.spans), bytes(r.kept)) for r in df.collect()], key=str)


def planted():
    rng = random.Random(11)
    text = lambda n: "".join(rng.choice("abcdefghij klmno\x00é") for _ in range(n))
    long, rows = text(900), []
    for i in range(60):
        a = rng.randrange(600)
        rows.append((i, text(rng.randrange(300)) + long[a : a + rng.randrange(150, 300)] + text(rng.randrange(300))))
    # pieces of 199, 200 and 201 bytes; periods; strings that overlap themselves
    exact = "".join(rng.choice("abcdef") for _ in range(500))
    rows += [(100, "x" + exact[:199] + "y"), (101, "z" + exact[:199] + "w"), (102, "u" + exact[250:450] + "v"), (103, "s" + exact[250:450]), (104, exact[240:460])]
    rows += [(110, "ab" * 400), (111, text(50) + "ab" * 101 + text(50)), (112, "word " * 300 + text(20) + "word " * 39), (113, "q" * 199), (114, "r" * 201), (115, "q" * 200)]
    return rows


def test_equals_brute_force(spark):
    rows = documents(spark)[:120] + [(10_000 + i, t) for i, t in planted()]
    assert got(remove_repeats(table(spark, rows))) == brute(rows)


def test_small_buckets_and_hot_cores(spark):
    rows = planted()
    want = brute(rows)
    assert got(remove_repeats(table(spark, rows), bucket=50)) == want
    assert got(remove_repeats(table(spark, rows), bucket=30, hot=3)) == want


def test_hot_cores_at_production_parameters(spark, monkeypatch):
    """One line in every text, more often than HOT; between equal, nearly equal and quite different neighbours."""
    from graphloom.llm import suffix

    rng = random.Random(6)
    text = lambda n: "".join(rng.choice("abcdefghij klmno") for _ in range(n))
    line, passage = text(60), text(330)
    before, after = [text(200) for _ in range(5)], [text(200) for _ in range(5)]
    rows = [(i, text(rng.randrange(120, 260)) + line + text(rng.randrange(120, 260))) for i in range(120)]
    rows += [(200 + i, text(rng.randrange(20)) + rng.choice(before)[rng.randrange(200) :] + line + rng.choice(after)[: rng.randrange(200)] + text(rng.randrange(20))) for i in range(120)]
    rows += [(400 + i, text(rng.randrange(200)) + passage[rng.randrange(40) : 330 - rng.randrange(40)] + text(rng.randrange(200))) for i in range(120)]
    rows += [(600 + i, passage[:210]) for i in range(60)] + [(700 + i, line) for i in range(60)]
    want = brute(rows)
    assert sum(r[2] > 0 for r in want) > 200
    for hot, bucket in ((20, 50), (2, 5000), (100, 10)):
        assert got(remove_repeats(table(spark, rows), hot=hot, bucket=bucket)) == want, hot
    small = [(i, t[:400]) for i, t in rows[:60]]
    copies = small + [(1000 + i, line + "common tail of more than two hundred bytes " * 6) for i in range(suffix.HOT + 10)]
    out = {r[0]: r[1:] for r in got(remove_repeats(table(spark, copies, 8)))}
    assert all(out[1000 + i] == (len(copies[-1][1]), 1, b"") for i in (0, 7, suffix.HOT + 9))
    whole = {r[0]: r[1:] for r in brute(small + copies[len(small) : len(small) + 2])}
    assert all(out[i] == whole[i] for i, _ in small)


def test_periods_are_compared_by_bytes():
    """Thue-Morse strings, on which polynomial hashes modulo a power of two collide."""
    from graphloom.llm.suffix import anchors, string_classes

    t = np.array([bin(i).count("1") & 1 for i in range(6000)], np.uint8)
    data = np.concatenate((t[:4096] + 97, 1 - t[:4096] + 97, np.tile(np.array([97, 98], np.uint8), 600)))
    classes, by = string_classes(data), {}
    for i, c in enumerate(classes.tolist()):
        assert by.setdefault(data[i : i + LENGTH].tobytes(), c) == c
    assert len(by) == len(set(classes.tolist()))
    for piece in (1 << 20, 700):
        _, _, spans = anchors(np.tile(np.array([97, 98, 99], np.uint8), 700), piece)
        assert spans and spans[0][0] == 0


def test_very_long_texts(spark):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghijklmno") for _ in range(rng.randrange(2, 9))) for _ in range(4000)]
    long = " ".join(rng.choice(words) for _ in range(60_000))
    rows = [(1, long), (2, long[100_000:100_300] + " own words"), (3, "ab" * 60_000), (4, "cd " * 100 + long[:150])]
    assert got(remove_repeats(table(spark, rows))) == brute(rows)


def test_texts_of_several_stretches(spark):
    rng = random.Random(4)
    text = lambda n: "".join(rng.choice("abcdefghij klmno") for _ in range(n))
    again = text(700)
    rows = [(1, text(5000)), (2, text(900) + again + text(1500) + again), (3, text(2000) + "word " * 500 + text(300)), (4, again[:400] + text(2600))]
    want = brute(rows)
    assert want[0][2] == 0
    assert got(remove_repeats(table(spark, rows), stretch=1000)) == want
    assert got(remove_repeats(table(spark, rows), stretch=1000, hot=1)) == want


def test_anchors_of_stretches_are_distinct():
    import pyarrow as pa

    rng = random.Random(4)
    text = bytes(rng.randrange(97, 123) for _ in range(5000))
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([1]), pa.array([text], pa.binary())], ["_id", "_h", "text"])
    cut, whole = ([p for out in _anchors([batch], n) for p in out.column(3).to_pylist()] for n in (1000, STRETCH))
    assert cut == whole


def test_odd_rows(spark):
    assert got(remove_repeats(clashing(table(spark, ODD)))) == brute(ODD)


def test_empty(spark):
    assert remove_repeats(table(spark, [])).count() == 0


def test_multikey_quicksort():
    rng = np.random.default_rng(1)
    rows = rng.integers(0, 3, (500, 16)).astype(np.uint8)
    rows[::7] = rows[0]
    order = multikey_quicksort(rows)
    keys = [bytes(rows[i]) for i in order]
    assert keys == sorted(keys) and sorted(order) == list(range(500))
