"""Sharding by a Feistel permutation with cycle walking over global row numbers, in DataFrame operations only.

Row numbers: ids are spread over `buckets` numbering buckets by a fixed arithmetic hash, each bucket is numbered by
itself, and the buckets' counts - a table of at most `buckets` rows, so safe to broadcast - give the offsets. No task
sees all rows. The permutation works on Z_a x Z_b, the smallest such grid over the row count with a = ceil(sqrt(n)), so
fewer than a of its points lie outside and walks are rare and short. Shard and slot are the remainder and quotient of
the permuted number: anyone who knows n and the key can compute them, and any n gives counts at most one apart.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import text_of

BUCKETS = 2048
PRIME = 2147483647
ROUNDS = 6
#: A walk of this many steps reaches the inside for any n: a walk meets fewer than a outside points, and where
#: a > WALK the chance of so long a walk is below (1/a) ** WALK.
WALK = 32
KEY = 20240501


def round_constants(key: int = KEY, rounds: int = ROUNDS) -> list[tuple[int, int]]:
    """Multiplier and addend of each round, from the Park-Miller generator."""
    x, out = key % PRIME or 1, []
    for _ in range(rounds):
        x = x * 48271 % PRIME
        y = x * 48271 % PRIME
        out.append((x, y))
        x = y
    return out


def bucket_of(id_sql: str, buckets: int = BUCKETS) -> str:
    """Numbering bucket of an id, as SQL text: ids that step evenly still spread."""
    return f"(((({id_sql}) % {PRIME} + {PRIME}) % {PRIME}) * 48271 % {PRIME} % {buckets})"


def permuted(x: Column, a: Column, b: Column, n: Column, key: int = KEY) -> Column:
    """The number that `x` in 0..n-1 becomes."""

    def half(i: int, mul: int, add: int) -> Callable[[Column], Column]:
        if i % 2 == 0:
            return lambda s: F.struct(F.pmod(s["l"] + _mix(s["r"], mul, add), a).alias("l"), s["r"].alias("r"))
        return lambda s: F.struct(s["l"].alias("l"), F.pmod(s["r"] + _mix(s["l"], mul, add), b).alias("r"))

    def once(state: Column) -> Column:
        for i, (mul, add) in enumerate(round_constants(key)):
            # transform() over one element binds the state, so that it is computed once a round
            state = F.transform(F.array(state), half(i, mul, add))[0]
        return state

    start = F.struct(F.call_function("div", x, b).alias("l"), F.pmod(x, b).alias("r"))
    walked = F.aggregate(
        F.sequence(F.lit(1), F.lit(WALK)), once(start),
        lambda s, _: F.when(s["l"] * b + s["r"] < n, s).otherwise(once(s)),
    )
    return F.transform(F.array(walked), lambda s: s["l"] * b + s["r"])[0]


def _mix(x: Column, mul: int, add: int) -> Column:
    """A cubic over the prime field, in 64-bit integers."""
    p = F.lit(PRIME).cast("long")
    y = F.pmod(F.pmod(x, p) * F.lit(mul).cast("long") + F.lit(add).cast("long"), p)
    return F.pmod(F.pmod(y * y, p) * y, p)


def shard_rows(
    docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", key: int = KEY, buckets: int = BUCKETS
) -> DataFrame:
    """One row per input row: `doc_id, size, text_crc32, row_number, shard, slot`.

    size is the text's UTF-8 bytes plus 8 (null text: 8, CRC of the empty text). Shard counts differ by at most one and
    each shard's slots run from 0 without gaps. Row numbers follow (numbering bucket, id, text); null ids come first in
    bucket 0; rows that repeat in full get different numbers, in any order. The same rows and key give the same
    result whatever the partitioning. An empty table gives an empty result; other columns are ignored.
    """
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text_of(text_col)) + 8).cast("long").alias("size"),
        F.crc32(text_of(text_col)).alias("text_crc32"),
        F.xxhash64(text_of(text_col)).alias("_h"),
    ).withColumn("_bucket", F.coalesce(F.expr(bucket_of("doc_id", buckets)), F.lit(0)).cast("int"))
    counts = rows.groupBy("_bucket").agg(F.count("*").alias("_c"))
    table = counts.select(
        "_bucket",
        (F.sum("_c").over(Window.orderBy("_bucket")) - F.col("_c")).alias("_offset"),
        F.sum("_c").over(Window.partitionBy()).alias("_n"),
    ).withColumn("_a", F.ceil(F.sqrt("_n")).cast("long")).withColumn("_b", F.expr("(_n + _a - 1) div _a"))
    own = Window.partitionBy("_bucket").orderBy(F.col("doc_id").asc_nulls_first(), "_h", "text_crc32", "size")
    numbered = (
        rows.withColumn("_rn", F.row_number().over(own)).join(F.broadcast(table), "_bucket")
        .withColumn("_row", F.col("_offset") + F.col("_rn") - 1)
    )
    to = permuted(F.col("_row"), F.col("_a"), F.col("_b"), F.col("_n"), key)
    return numbered.withColumn("_to", to).select(
        "doc_id", "size", "text_crc32", F.col("_row").alias("row_number"),
        F.pmod("_to", F.lit(shards)).cast("int").alias("shard"), F.expr(f"_to div {shards}").alias("slot"),
    )


def duckdb_sql(shards: int = 24, key: int = KEY, buckets: int = BUCKETS) -> str:
    """The `rows` law in DuckDB: a table-driven CRC, and a recursion over rounds that goes on while a point is outside."""

    def mix(x: str, k: int) -> str:
        mul, add = round_constants(key)[k]
        y = f"((({x} % {PRIME}) * {mul} + {add}) % {PRIME})"
        return f"(({y} * {y} % {PRIME}) * {y} % {PRIME})"

    left = " ".join(f"WHEN {k} THEN (l + {mix('r', k)}) % a" for k in range(ROUNDS) if k % 2 == 0)
    right = " ".join(f"WHEN {k} THEN (r + {mix('l', k)}) % b" for k in range(ROUNDS) if k % 2)
    return f"""
WITH RECURSIVE crc_table AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS c FROM range(256) x(i))),
sized AS (SELECT doc_id, (octet_length(encode(coalesce(text, ''))) + 8)::BIGINT AS size,
 xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT)), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8))) AS text_crc32,
 {bucket_of("doc_id", buckets)} AS bucket FROM documents, crc_table),
n AS (SELECT count(*) AS n, ceil(sqrt(count(*)))::BIGINT AS a FROM documents), grid AS (SELECT n, a, (n + a - 1) // a AS b FROM n),
rows_ AS (SELECT *, row_number() OVER (ORDER BY bucket, doc_id) - 1 AS x FROM sized),
walk AS (SELECT doc_id, n, a, b, x // b AS l, x % b AS r, 0 AS k FROM rows_, grid
 UNION ALL SELECT doc_id, n, a, b, CASE k % {ROUNDS} {left} ELSE l END, CASE k % {ROUNDS} {right} ELSE r END, k + 1 FROM walk WHERE k = 0 OR k % {ROUNDS} <> 0 OR l * b + r >= n),
done AS (SELECT doc_id, l * b + r AS p FROM walk WHERE k > 0 AND k % {ROUNDS} = 0 AND l * b + r < n)
SELECT doc_id, size, text_crc32, 'rows' AS law, (p % {shards})::INT AS shard, p // {shards} AS slot, NULL::INT AS grown_shard FROM sized JOIN done USING (doc_id)
"""
