"""Quality by ordinal cumulative-link regression on graded ratings.

P(grade <= k) = sigmoid(theta_k - s) with one score s for all grades - shared weights of hashed text features - and
ordered thresholds theta_0 < theta_1 < ..., kept in order by fitting the first and the logarithms of the gaps. The
expected grade is the sum of the tail probabilities P(grade > k); a tail probability selects documents. Any set of
integer grades will do; with two it is logistic regression.

Features of a token: its lower-cased letters and its shape (case, digits, marks). s is their weights' mean over the
tokens, plus weights of how often a token repeats the one before, how many tokens are distinct, and the length.

A model is fitted on a bounded sample (see `training.sample`); every document is scored, whole, and only from its text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from operator import eq

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.shipping import ship

from .common import map_arrow, pieces, release_memory, text_of
from .training import MASK, MAX_TRAIN, Weights, adam, compact, sample, sigmoid, slot, summed

STEPS, RATE, L2 = 200, 0.3, 1e-6
#: A document stays if P(grade >= the second grade) is at least this.
LEAST_TAIL = 0.5

UPPER, LOWER, DIGIT = re.compile(r"[^\W\d_a-zà-öø-ÿß]+"), re.compile(r"[a-zà-öø-ÿß]+"), re.compile(r"\d+")


def shape(token: str) -> str:
    """The token with runs of capitals, small letters and digits each written as one letter."""
    return DIGIT.sub("0", LOWER.sub("a", UPPER.sub("A", token)))


def token_slots(token: str) -> tuple[int, int]:
    return slot("w" + token.lower().strip(".,;:!?")), slot("s" + shape(token)[:24])


def text_features(tokens: list[str]) -> list[int]:
    """Slots of what the whole text shows."""
    n = len(tokens)
    if not n:
        return [slot("empty")]
    again = sum(map(eq, tokens, tokens[1:])) / n
    return [slot(f"again{round(again * 10)}"), slot(f"distinct{round(len(set(tokens)) / n * 10)}"), slot(f"length{min(n.bit_length(), 12)}")]


@dataclass
class Model:
    weights: np.ndarray
    grades: list[int]
    thresholds: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def tails(self, s: float | np.ndarray) -> np.ndarray:
        """P(grade > k) for each threshold k."""
        return sigmoid(np.asarray(s)[..., None] - self.thresholds)


def fit(cols: np.ndarray, values: np.ndarray, doc: np.ndarray, ratings: np.ndarray, steps: int = STEPS) -> Model:
    """Sparse features (slot, value, document) and each document's rating. Without ratings: no grade, all weights 0."""
    grades, y = np.unique(ratings, return_inverse=True)
    weights = np.zeros(MASK + 1, np.float32)
    if len(grades) < 2:
        return Model(weights, [int(g) for g in grades])
    n, k = len(y), len(grades) - 1
    stay, col, found = compact(cols, doc)
    values, doc = values[stay], doc[stay]
    share = np.cumsum(np.bincount(y, minlength=k + 1))[:-1] / n
    start = np.log(share / (1 - share))
    gaps = np.log(np.maximum(np.diff(start), 1e-3))

    def unpack(x: np.ndarray) -> np.ndarray:
        return np.cumsum(np.append(x[0], np.exp(x[1:k])))

    def gradient(x: np.ndarray) -> np.ndarray:
        theta, w = unpack(x), x[k:]
        s = summed(doc, lambda p: values[p] * w[col[p]], n)
        high = np.where(y < k, sigmoid(theta[np.minimum(y, k - 1)] - s), 1.0)
        low = np.where(y > 0, sigmoid(theta[np.maximum(y - 1, 0)] - s), 0.0)
        p = np.maximum(high - low, 1e-9)
        up, down = high * (1 - high) / p, low * (1 - low) / p
        out = np.empty_like(x)
        slope = up - down
        out[k:] = summed(col, lambda p: values[p] * slope[doc[p]], len(found)) / n + L2 * w
        by = np.zeros(k)
        np.add.at(by, np.minimum(y, k - 1), np.where(y < k, -up, 0) / n)
        np.add.at(by, np.maximum(y - 1, 0), np.where(y > 0, down, 0) / n)
        tail = np.cumsum(by[::-1])[::-1]
        out[0], out[1:k] = tail[0], tail[1:] * np.exp(x[1:k])
        return out

    x = adam(np.concatenate([start[:1], gaps, np.zeros(len(found))]), gradient, steps, RATE)
    weights[found] = x[k:]
    return Model(weights, [int(g) for g in grades], unpack(x))


def _train_rows(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in pieces(batches):
        slots, values = [], []
        for t in batch.column(1):
            tokens = t.as_py().split()
            per: dict[int, float] = {}
            for token in tokens:
                for x in token_slots(token):
                    per[x] = per.get(x, 0) + 1 / len(tokens)
            for x in text_features(tokens):
                per[x] = per.get(x, 0) + 1
            slots.append([*per])
            values.append([*per.values()])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), pa.array(slots, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float32()))],
            ["doc_id", "label", "slots", "vals"],
        )


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = MAX_TRAIN) -> Model:
    texts = sample(docs, labels, label, max_rows).select("doc_id", "text", F.col("label").cast("int"))
    rows = map_arrow(texts, _train_rows, "doc_id long, label int, slots array<int>, vals array<float>").toArrow().sort_by("doc_id")
    slots = rows["slots"].combine_chunks()
    doc = np.repeat(np.arange(len(slots), dtype=np.int32), np.diff(slots.offsets.to_numpy()))
    model = fit(slots.values.to_numpy(), rows["vals"].combine_chunks().values.to_numpy(), doc, rows["label"].to_numpy())
    del rows, slots
    release_memory()
    return model


def scorer(model: Model):
    """A function of one text: its score s."""

    def weigh(token: str) -> float:
        a, b = token_slots(token)
        return float(model.weights[a]) + float(model.weights[b])

    weight = Weights(weigh)
    get = weight.__getitem__

    def of(text: str) -> float:
        tokens = text.split()
        return (sum(map(get, tokens)) / len(tokens) if tokens else 0.0) + float(sum(model.weights[x] for x in text_features(tokens)))

    return of


def _verdicts(docs: DataFrame, model: Model, text_col: str = "text") -> Column:
    """`grade, tail` of a text. Only texts go to Python and only verdicts come back; the other columns stay in the JVM."""
    import pyarrow as pa

    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2 ** BITS floats

    def verdicts(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m: Model = shared.value
        of = scorer(m)
        low, steps = m.grades[0] if m.grades else 0, np.diff(m.grades)
        try:
            for texts in arrays:
                tails = m.tails(np.fromiter((of(t.as_py()) for t in texts), float, len(texts)))
                grade = low + tails @ steps if tails.shape[1] else np.full(len(texts), float(low))
                tail = tails[:, 0] if tails.shape[1] else np.ones(len(texts))
                yield pa.StructArray.from_arrays([pa.array(grade), pa.array(tail)], ["grade", "tail"])
        finally:
            release_memory()

    verdicts.__annotations__ = {"arrays": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(verdicts, "grade double, tail double")(text_of(text_col))


def score(docs: DataFrame, model: Model, least_tail: float = LEAST_TAIL) -> DataFrame:
    """One row per input row: `doc_id, expected_grade, tail_probability, kept`.

    tail_probability is that of a grade above the least; kept: at least `least_tail`. Null texts count as empty, empty
    texts are scored by their emptiness alone. Where the labels held one grade or none, everything is kept. Null and
    repeated ids pass through; an empty table gives an empty result; other columns are ignored.
    """
    told = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _verdicts(docs, model).alias("v"))
    return told.select(
        "doc_id", F.col("v.grade").alias("expected_grade"), F.col("v.tail").alias("tail_probability"), (F.col("v.tail") >= least_tail).alias("kept")
    )


def select(docs: DataFrame, model: Model, least_tail: float = LEAST_TAIL) -> DataFrame:
    """The rows of `docs`, with all their columns, that `score` keeps: null texts as empty ones, rows that repeat alike, none of none."""
    # a struct keeps the documents' own columns apart from the verdict
    return docs.select(F.struct("*").alias("row"), _verdicts(docs, model).alias("v")).where(F.col("v.tail") >= least_tail).select("row.*")
