"""Chunking (E2, E3); chunks by definition are in `extract`."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIZE, STRIDE, EMBEDDED = 2048, 1792, 500


def fixed_windows(files: DataFrame, size: int = SIZE, stride: int = STRIDE, text: str = "text") -> DataFrame:
    """Overlapping windows of `files`: its other columns, `start, chunk, n_chars, start_line, end_line`.

    The last window is the first that reaches the end, so a short file is one chunk.
    """
    n = F.length(text)
    starts = F.sequence(F.lit(0), F.greatest(F.ceil((n - size) / F.lit(stride)), F.lit(0)).cast("int") * stride, F.lit(stride))
    rows = files.withColumn("start", F.explode(starts)).withColumn("chunk", F.expr(f"substring({text}, start + 1, {size})"))
    lines = lambda c: F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))
    before = F.expr(f"substring({text}, 1, start)")
    rows = rows.withColumn("n_chars", F.length("chunk")).withColumn("start_line", lines(before) + 1)
    return rows.withColumn("end_line", F.col("start_line") + lines(F.col("chunk"))).drop(text)


def embeddable(chunks: DataFrame, chunk: str = "chunk", chars: int = EMBEDDED) -> DataFrame:
    """Without blank chunks; `embed_text` is what gets embedded."""
    return chunks.where(F.trim(F.regexp_replace(chunk, r"\s", "")) != "").withColumn("embed_text", F.substring(chunk, 1, chars))
