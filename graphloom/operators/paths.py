"""Canonical paths by unique suffix."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def canonical(rows: DataFrame, valid: DataFrame, path: str = "path") -> DataFrame:
    """`rows` with `canonical`: the valid path that equals theirs, or else the only one that ends in "/" and theirs.

    All suffixes of valid paths are made once and joined by equality, so no pair of paths is compared.
    """
    parts = F.split("v", "/")
    v = valid.select(F.col(path).alias("v")).distinct()
    ends = v.select("v", F.explode(F.sequence(F.lit(1), F.size(parts))).alias("k"))
    ends = ends.select("v", F.array_join(F.slice(parts, F.col("k"), F.size(parts)), "/").alias("s"), (F.col("k") > 1).alias("partial"))
    one = ends.groupBy("s").agg(
        F.max(F.when(~F.col("partial"), F.col("v"))).alias("exact"), F.count_if("partial").alias("n"), F.max(F.when(F.col("partial"), F.col("v"))).alias("only")
    )
    found = one.select("s", F.coalesce("exact", F.when(F.col("n") == 1, F.col("only"))).alias("canonical"))
    return rows.join(found, rows[path] == found.s, "left").drop("s")


def canonical_list(rows: DataFrame, valid: DataFrame, by: str, paths: str = "paths") -> DataFrame:
    """`by, files` - canonical paths of each list, first occurrences, in order."""
    each = canonical(rows.select(by, F.posexplode(paths).alias("pos", "path")), valid).where("canonical IS NOT NULL")
    first = each.groupBy(by, "canonical").agg(F.min("pos").alias("pos"))
    got = first.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "canonical"))), lambda x: x["canonical"]).alias("files"))
    return rows.select(by).distinct().join(got, by, "left").withColumn("files", F.coalesce("files", F.array().cast("array<string>")))
