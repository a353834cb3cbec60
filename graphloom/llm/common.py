"""Helpers shared by the training-data operators: shared-folder tables, row keys, word rules, components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.shipping import ship
from graphloom.storage import discard, written

#: Stands for a null id inside join keys; results carry null again.
NULL_ID = -(1 << 63)


class Released:
    """A function of Arrow batches after which the worker gives its memory back: Spark keeps workers for later stages."""

    def __init__(self, function: Callable):
        self.function = function

    def __call__(self, batches: Iterator) -> Iterator:
        try:
            yield from self.function(batches)
        finally:
            release_memory()


def release_memory() -> None:
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def map_arrow(df: DataFrame, function: Callable, schema) -> DataFrame:
    """`df.mapInArrow`, with this package sent to the executors."""
    ship(df.sparkSession)
    return df.mapInArrow(Released(function), schema)


def pieces(batches: Iterator, rows: int = 512) -> Iterator:
    """Arrow batches in slices, so that what a function makes of one at a time stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def input_bytes(df: DataFrame) -> int | None:
    """Catalyst's size estimate of a plan, None where it can't tell."""
    try:
        return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    except Exception:  # noqa: BLE001  a private interface: only a hint for partition counts
        return None


def partitions(spark: SparkSession, least: int = 1) -> int:
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def text_of(column: str = "text") -> Column:
    """Null counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def row_key(id_col: str = "doc_id", text_col: str = "text") -> list[Column]:
    """Key columns `_id`, `_h` that are never null and name a row's id and text; rows that repeat both share a key."""
    return [
        F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID).cast("long")).alias("_id"),
        F.xxhash64(text_of(text_col)).alias("_h"),
    ]


def id_back(column: str = "_id") -> Column:
    return F.when(F.col(column) != F.lit(NULL_ID).cast("long"), F.col(column))


#: Rows of a key from which it counts as hot, and how many such keys are broadcast at most.
HOT_ROWS, HOT_KEYS = 10_000, 512


def with_counts(rows: DataFrame, counts: DataFrame, key: str, count: str, name: str) -> DataFrame:
    """`rows` joined with `counts(key, ...)`, one row a key. The hottest keys, few by a fixed bound, meet their rows by broadcast;
    the rows of the others are shuffled by key.
    """
    counts = written(counts, f"{name}-counts")
    hot = written(counts.where(F.col(count) >= HOT_ROWS).orderBy(F.col(count).desc(), key).limit(HOT_KEYS), f"{name}-hot")
    if not hot.limit(1).count():
        return rows.join(counts, key)
    keys = hot.select(key)
    rest = rows.join(F.broadcast(keys), key, "left_anti").join(counts.join(F.broadcast(keys), key, "left_anti"), key)
    return rows.join(F.broadcast(hot), key).unionByName(rest)


def components(edges: DataFrame, name: str, rounds_between: int = 2) -> DataFrame:
    """Connected components of `edges(a, b)` (longs) as `(node, component)`, component being the least node reachable.

    Alternates large-star and small-star steps; each step links nodes to the least neighbour, so a group of m nodes
    settles in O(log m) rounds and no step holds more than O(edges) rows. Tables in the shared folder cut lineage.
    Nodes without edges are not listed.
    """
    both = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now0 = now = written(both, f"{name}-cc")
    while not _stars(now):
        for _ in range(rounds_between):
            # large star: larger neighbours of u link to the least of u and its neighbours
            sym = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
            low = sym.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
            now = (
                sym.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                .where("u <> v").distinct()
            )
            # small star: u and its smaller neighbours link to the least of them
            low = now.groupBy("u").agg(F.min("v").alias("m"))
            now = (
                now.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                .union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
            )
        before, now = now0, written(now, f"{name}-cc")
        discard(before)
        now0 = now
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _stars(links: DataFrame) -> bool:
    """Whether every node links to one other at most, and none that is linked to links on."""
    ends = links.select(F.col("u").alias("n"), F.lit(1).alias("a"), F.lit(0).alias("b")).union(links.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("n").agg(F.sum("a").alias("a"), F.max("b").alias("b")).where("a > 1 OR (a > 0 AND b > 0)").limit(1).count() == 0
