"""Running figures over a whole table without gathering it in one task.

Rows are dealt into ranges of their order; a range is numbered or scanned by itself, and takes over from those before it
a figure of which there is one a range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.storage import written


def in_ranges(rows: DataFrame, order: str, name: str) -> DataFrame:
    """`rows` with `_range`, written, so that a range keeps its rows however often it is read."""
    return written(rows.repartitionByRange(order).withColumn("_range", F.spark_partition_id()), name)


def carried(dealt: DataFrame, figure: Column, running: str) -> DataFrame:
    """`_range, _before`: `figure` of each range, put together by `running` (sum or max) over the ranges before it."""
    w = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    return dealt.groupBy("_range").agg(figure.alias("_f")).select("_range", F.expr(f"{running}(_f)").over(w).alias("_before"))


def numbered(rows: DataFrame, order: str, name: str = "numbered") -> DataFrame:
    """`rows` with `_row`, from 1 in order."""
    dealt = in_ranges(rows, order, name)
    before = carried(dealt, F.count("*"), "sum")
    place = F.row_number().over(Window.partitionBy("_range").orderBy(order))
    return dealt.withColumn("_place", place).join(F.broadcast(before), "_range").withColumn("_row", F.coalesce("_before", F.lit(0)) + F.col("_place")).drop("_range", "_place", "_before")


def best_before(rows: DataFrame, order: str, value: str, name: str = "ranges") -> DataFrame:
    """`rows`, each `order` once, with `_best`: the largest value of the rows before, null for the first."""
    dealt = in_ranges(rows, order, name)
    before = carried(dealt, F.max(value), "max")
    w = Window.partitionBy("_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return dealt.withColumn("_own", F.max(value).over(w)).join(F.broadcast(before), "_range").withColumn("_best", F.greatest("_own", "_before")).drop("_range", "_own", "_before")
