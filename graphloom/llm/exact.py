"""Exact dedup by a heavy-hitter split, in DataFrame operations only.

A Misra-Gries frequent-items summary of the text digests, merged from per-partition summaries, proposes the digests
that could be frequent. Their exact counts and surviving rows are then computed with map-side partial sums; the
verified winners - at most `max_hot` rows of a digest and two numbers - are broadcast, so rows of hot digests get their
answer in the map task and are never shuffled. Only the other digests go through an ordinary shuffle, of which a group
holds one row in `max_hot` at most, but for the summary's error; their sums stream past, no window holds a group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, row_key, text_of, written

MAX_HOT = 512
TRACKED = 8192
#: Keys of dropped rows up to which they are broadcast; beyond, both sides shuffle.
BROADCAST_IDS = 500_000


def _groups(rows: DataFrame, max_hot: int, tracked: int) -> DataFrame:
    """`doc_id, sha, _h, _n, _keep, _size`: `rows(doc_id, sha, _h)`, repeated ones as one of `_n`, with their group's answer."""
    found = rows.agg(F.expr(f"approx_top_k(sha, {max_hot}, {tracked})").alias("f"))
    proposed = found.select(F.explode("f.item").alias("sha"))
    answer = (F.max("doc_id").alias("_keep"), F.count("*").alias("_size"))
    hot = rows.join(F.broadcast(proposed), "sha").groupBy("sha").agg(*answer).where("_size > 1")
    told = rows.join(F.broadcast(hot), "sha", "left")
    names = ["doc_id", "sha", "_h", "_n", "_keep", "_size"]
    # Of a hot group only the rows that carry the surviving id are still open: one, unless rows repeat.
    settled = told.where("_size IS NOT NULL AND NOT (doc_id <=> _keep)").withColumn("_n", F.lit(1).cast("long")).select(names)
    top = told.where("_size IS NOT NULL AND doc_id <=> _keep").groupBy("sha", "_keep", "_size", "doc_id", "_h").agg(F.count("*").alias("_n")).select(names)
    # One shuffle serves the sums and the join.
    cold = told.where("_size IS NULL").select("doc_id", "sha", "_h").repartition("sha")
    once = cold.groupBy("sha", "doc_id", "_h").agg(F.count("*").alias("_n"))
    return settled.union(top).union(once.join(cold.groupBy("sha").agg(*answer), "sha").select(names))


def _digests(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Written once, so that texts are read and hashed once."""
    text = text_of(text_col)
    return written(docs.select(F.col(id_col).alias("doc_id"), F.sha2(text, 256).alias("sha"), F.xxhash64(text).alias("_h")), "exact-digests")


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_hot: int = MAX_HOT, tracked: int = TRACKED
) -> DataFrame:
    """One row per input row: `doc_id, keep_id, group_size, kept, text_sha256`.

    Texts are equal when their SHA-256 digests are; of equal texts the row with the largest id stays. A null text is the
    empty text. Null ids sort below all others: keep_id is null only where a whole group has null ids. Rows that repeat an
    id and its text are copies too, and exactly one of them is kept. An empty table gives an empty result. Other columns
    are ignored, whatever their names.
    """
    told = _groups(_digests(docs, id_col, text_col), max_hot, tracked)
    copy = F.explode(F.sequence(F.lit(1).cast("long"), "_n")).alias("_copy")
    return told.select("doc_id", "_keep", "_size", "sha", copy).select(
        "doc_id", F.col("_keep").alias("keep_id"), F.col("_size").alias("group_size"),
        (F.col("doc_id").eqNullSafe(F.col("_keep")) & (F.col("_copy") == 1)).alias("kept"), F.col("sha").alias("text_sha256"),
    )


def select(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs`, with all their columns, that `exact_dedup` keeps; of rows that repeat id and text, one."""
    told = _groups(_digests(docs, id_col, text_col), MAX_HOT, TRACKED)
    stays = F.col("doc_id").eqNullSafe(F.col("_keep"))
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID).cast("long")).alias("_id")
    lost = written(told.where(~stays | (F.col("_n") > 1)).select(key, "_h", stays.alias("_stays")), "exact-lost")
    if lost.count() <= BROADCAST_IDS:
        lost = F.broadcast(lost)
    rows = docs.select(F.struct("*").alias("row"), *row_key(id_col, text_col)).join(lost, ["_id", "_h"], "left")
    once = rows.where("_stays").dropDuplicates(["_id", "_h"])
    return rows.where("_stays IS NULL").unionByName(once).select("row.*")


#: Rows that repeat an id and its text do not occur in the tables this runs on.
SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents)
WINDOW w AS (PARTITION BY text_sha256)
"""
