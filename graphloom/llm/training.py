"""What the two trained operators share: bounded labelled samples, hashed words, an optimiser."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Hashed feature space; a model is that many floats whatever the corpus.
BITS = 18
MASK = (1 << BITS) - 1
#: The most labelled rows that a model is fitted on where the operator does not say otherwise, those with the least hash of their id.
MAX_TRAIN = 4_000
#: Features seen in fewer training documents than this keep weight 0.
MIN_DF = 3


def slot(feature: str) -> int:
    return zlib.crc32(feature.encode("utf-8", "replace")) & MASK


def held_out(id_col: str = "doc_id"):
    """Whether crc32 of the id as text is divisible by 5; a null id counts as empty text, so as held out."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(5)) == 0


def sample(docs: DataFrame, labels: DataFrame, label: str, max_rows: int = MAX_TRAIN) -> DataFrame:
    """`(doc_id, text, label)` of at most `max_rows` labelled ids that are not held out.

    The ids are chosen by hash, so alike for any partitioning; an id labelled twice takes its largest label, and an id of
    several documents the text that sorts last. The chosen ids are few by that bound and are broadcast to the documents.
    """
    chosen = (
        labels.select(F.col("doc_id").alias("_l"), F.col(label).alias("label")).where("_l IS NOT NULL AND label IS NOT NULL")
        .where(~held_out("_l")).groupBy("_l").agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("_l"), "_l").limit(max_rows)
    )
    text = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = text.join(F.broadcast(chosen), F.col("doc_id") == F.col("_l"))
    return rows.groupBy("doc_id").agg(F.max("text").alias("text"), F.max("label").alias("label"))


class Weights(dict):
    """Weight of a token, worked out when first asked for; bounded."""

    def __init__(self, of: Callable[[str], float], most: int = 200_000):
        super().__init__()
        self.of, self.most = of, most

    def __missing__(self, token: str) -> float:
        if len(self) >= self.most:
            self.clear()
        w = self.of(token)
        if len(token) <= 64:
            self[token] = w
        return w


def adam(x: np.ndarray, gradient: Callable[[np.ndarray], np.ndarray], steps: int, rate: float) -> np.ndarray:
    m, v = np.zeros_like(x), np.zeros_like(x)
    for t in range(1, steps + 1):
        g = gradient(x)
        m = 0.9 * m + 0.1 * g
        v = 0.999 * v + 0.001 * g * g
        x = x - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return x


def compact(features: np.ndarray, doc: np.ndarray, min_df: int = MIN_DF) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keeps features of at least `min_df` documents: which entries stay, their columns, the columns' features.

    `doc` is sorted; documents are counted a few at a time, so that little memory is needed.
    """
    df = np.zeros(MASK + 1, np.int32)
    cuts = np.searchsorted(doc, np.arange(0, (int(doc[-1]) if len(doc) else 0) + 65, 64))
    for a, b in zip(cuts, cuts[1:], strict=False):
        pairs = np.unique(doc[a:b].astype(np.int64) << BITS | features[a:b])
        df += np.bincount(pairs & MASK, minlength=MASK + 1).astype(np.int32)
    found = np.flatnonzero(df >= min_df)
    column = np.full(MASK + 1, -1, np.int32)
    column[found] = np.arange(len(found))
    at = column[features]
    stay = at >= 0
    return stay, at[stay], found


def summed(index: np.ndarray, values: Callable[[slice], np.ndarray], size: int, step: int = 1 << 20) -> np.ndarray:
    """`bincount` with weights, a stretch at a time."""
    out = np.zeros(size)
    for a in range(0, len(index), step):
        part = slice(a, a + step)
        out += np.bincount(index[part], values(part), size)
    return out


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))
