import zlib
from collections import Counter

from graphloom.llm.sharding import BUCKETS, PRIME, round_constants, shard_rows

from .helpers import ODD, clashing, documents, table


def permuted(x, n):
    a = int(-(-(n**0.5) // 1))
    b = (n + a - 1) // a

    def mix(v, mul, add):
        y = (v % PRIME * mul + add) % PRIME
        return y * y % PRIME * y % PRIME

    while True:
        left, right = x // b, x % b
        for i, (mul, add) in enumerate(round_constants()):
            if i % 2:
                right = (right + mix(left, mul, add)) % b
            else:
                left = (left + mix(right, mul, add)) % a
        x = left * b + right
        if x < n:
            return x


def test_equals_brute_force(spark):
    rows = documents(spark)
    n = len(rows)
    number = sorted(rows, key=lambda r: (r[0] % PRIME * 48271 % PRIME % BUCKETS, r[0]))
    want = {}
    for k, (i, t) in enumerate(number):
        to = permuted(k, n)
        want[i] = (len(t.encode()) + 8, zlib.crc32(t.encode()), k, to % 24, to // 24)
    got = {r[0]: tuple(r[1:]) for r in shard_rows(table(spark, rows)).collect()}
    assert got == want


def test_is_a_permutation_for_any_count(spark):
    for n in (1, 2, 3, 5, 24, 25, 97, 700):
        out = shard_rows(table(spark, [(i * 7, f"t{i}") for i in range(n)]), shards=5).collect()
        slots = {}
        for r in out:
            slots.setdefault(r.shard, []).append(r.slot)
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
        counts = Counter(r.shard for r in out)
        assert max(counts.values()) - min(counts[s] for s in range(5)) <= 1


def test_odd_rows(spark):
    out = shard_rows(clashing(table(spark, ODD))).collect()
    assert len(out) == len(ODD) and {r.row_number for r in out} == set(range(len(ODD)))
    assert {(r.size, r.text_crc32) for r in out if r.doc_id == 2} == {(8, 0)}
    assert sum(r.doc_id is None for r in out) == 2


def test_partitioning_does_not_matter(spark):
    rows = documents(spark)
    assert sorted(shard_rows(table(spark, rows, 1)).collect()) == sorted(shard_rows(table(spark, rows, 7)).collect())


def test_empty(spark):
    assert shard_rows(table(spark, [])).count() == 0


def test_equals_duckdb(spark):
    import duckdb

    from graphloom.llm.queries import ORACLE_SQL, QUERIES

    sf = "/root/testdata/sf0.001"
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    for name in ("op4_exact_dedup", "op7_sharding"):
        df = QUERIES[name](spark, sf)
        want = c.sql(f"SELECT {', '.join(df.columns)} FROM ({ORACLE_SQL[name]})").fetchall()
        assert sorted(map(tuple, df.collect())) == sorted(want)
