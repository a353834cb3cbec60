import random
import re

from graphloom.llm.minhash import near_dedup

from .helpers import ODD, clashing, documents, table

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sets_of(text):
    words = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def brute(rows):
    sets = [(i, sets_of(t)) for i, t in rows]
    parent = {i: i for i, _ in rows if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and i is not None and j is not None:
                both = len(a & b)
                if 100 * both >= 75 * (len(a) + len(b) - both):
                    x, y = sorted((root(i), root(j)))
                    parent[y] = x
    return sorted([(i, len(s), None if i is None else root(i), i is None or root(i) == i) for i, s in sets], key=str)


def got(df):
    return sorted(map(tuple, df.select("doc_id", "n_shingles", "component_id", "kept").collect()), key=str)


def test_equals_brute_force(spark):
    rows = documents(spark)
    assert got(near_dedup(table(spark, rows))) == brute(rows)


def test_chains_and_hot_groups(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    base = [word() for _ in range(120)]
    rows = []
    for i in range(150):  # a walk: neighbours are alike, the ends are not
        rows.append((i, " ".join(base)))
        base[rng.randrange(120)] = word()
    hot = [word() for _ in range(60)]
    for i in range(1000, 1120):  # near copies of one text
        copy = list(hot)
        copy[rng.randrange(60)] = word()
        rows.append((i, " ".join(copy)))
    rows += [(2000 + i, " ".join(hot)) for i in range(50)]
    rows += [(3000 + i, " ".join(word() for _ in range(40))) for i in range(60)]
    assert got(near_dedup(table(spark, rows))) == brute(rows)


def test_odd_rows(spark):
    assert got(near_dedup(clashing(table(spark, ODD)))) == brute(ODD)


def test_empty(spark):
    assert near_dedup(table(spark, [])).count() == 0
