"""Toxicity by multiple-instance learning.

Only documents have labels. A sentence s of hashed words and word beginnings has probability p_s = sigmoid(w.x_s + b); a document is
toxic if any of its sentences is: P = 1 - prod(1 - p_s), the noisy-or. With S = sum softplus(z_s), -log(1 - P) = S, so
the likelihood's gradient reaches each sentence as p_s times a factor of its document, and the sentences that explain
a label take it. Afterwards the sentence probabilities locate the offending sentences.

A model is fitted on a bounded sample (see `training.sample`); every document is scored, whole, and only from its text.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, pieces, release_memory
from .training import MASK, Weights, adam, compact, held_out, sample, sigmoid, slot, summed

SENTENCE = re.compile(r"[^.!?\n]+")
WORD = re.compile(r"\w+")
STEPS, RATE, L2 = 200, 0.05, 1e-4
#: The most labelled rows that the model is fitted on: toxic ones are few, and their words must be met.
#: Chosen on a fifth of the training rows: of 437 toxic ones 374, 410 and 422 are caught with 4,000, 8,000 and 16,000 rows (check_s).
MAX_TRAIN = 8_000


def word_slots(word: str) -> tuple[int, ...]:
    """A word's features: itself and its beginnings, which inflected forms share."""
    return (slot(word), *(slot("^" + word[:k]) for k in (3, 4, 5) if len(word) >= k))


@dataclass
class Model:
    weights: np.ndarray
    bias: float


def fit(flat: np.ndarray, sizes: np.ndarray, doc: np.ndarray, labels: np.ndarray, steps: int = STEPS) -> Model:
    """`flat`: feature slots, sentence after sentence; `sizes`: how many each sentence has; `doc`: each sentence's document;
    `labels`: 0 or 1 of each document.

    Without rows, or with labels of one kind, the weights are 0 and the bias follows the (smoothed) rate.
    """
    n, many = len(labels), len(sizes)
    rate = (labels.sum() + 0.5) / (n + 1) if n else 0.5
    base = math.log(max(-math.log1p(-rate) * max(n, 1) / max(many, 1), 1e-9))
    weights = np.zeros(MASK + 1, np.float32)
    if not n or labels.min() == labels.max():
        return Model(weights, base)
    sent = np.repeat(np.arange(many, dtype=np.int32), sizes)
    stay, col, found = compact(flat, doc[sent])
    sent = sent[stay]
    del stay
    pos = labels[doc] == 1

    def gradient(x: np.ndarray) -> np.ndarray:
        w = x[:-1]
        z = x[-1] + summed(sent, lambda p: w[col[p]], many)
        total = np.bincount(doc, np.logaddexp(0, z), n)
        factor = np.where(pos, -1 / np.expm1(np.clip(total, 1e-9, 500))[doc], 1.0)
        g = sigmoid(z) * factor
        out = np.empty_like(x)
        out[:-1] = summed(col, lambda p: g[sent[p]], len(found)) / n + L2 * w
        out[-1] = g.sum() / n
        return out

    x = adam(np.append(np.zeros(len(found)), base), gradient, steps, RATE)
    weights[found] = x[:-1]
    return Model(weights, float(x[-1]))


def _train_rows(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in pieces(batches):
        slots = []
        for t in batch.column(1):
            slots.append([[*chain.from_iterable(map(word_slots, {*ws}))] for x in SENTENCE.findall(t.as_py().lower()) if (ws := WORD.findall(x))])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), pa.array(slots, pa.list_(pa.list_(pa.int32())))], ["doc_id", "label", "slots"]
        )


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_rows: int = MAX_TRAIN) -> Model:
    texts = sample(docs, labels, label, max_rows).select("doc_id", "text", F.col("label").cast("int"))
    rows = map_arrow(texts, _train_rows, "doc_id long, label int, slots array<array<int>>").toArrow().sort_by("doc_id")
    slots = rows["slots"].combine_chunks()
    inner = slots.values
    doc = np.repeat(np.arange(len(slots), dtype=np.int32), np.diff(slots.offsets.to_numpy()))
    sizes = np.diff(inner.offsets.to_numpy())
    model = fit(inner.values.to_numpy(), sizes, doc, (rows["label"].to_numpy() > 0).astype(np.int64))
    del rows, slots, inner
    release_memory()
    return model


def _score(batches: Iterator, model, least: float) -> Iterator:
    import pyarrow as pa

    m: Model = model.value
    weight = Weights(lambda w: float(sum(m.weights[x] for x in word_slots(w))))
    get, bias, exp, log1p = weight.__getitem__, m.bias, math.exp, math.log1p
    low = math.log(least / (1 - least))
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
    for batch in pieces(batches):
        scores, found = [], []
        for t in batch.column(1):
            text = t.as_py()
            total, best = 0.0, -1e9
            for x in SENTENCE.findall(text.lower()):
                if ws := WORD.findall(x):
                    z = bias + sum(map(get, set(ws)))
                    best = max(best, z)
                    total += log1p(exp(z)) if z < 30 else z
            scores.append(-math.expm1(-total))
            spans = []
            if best >= low:
                for x in SENTENCE.finditer(text):
                    if ws := WORD.findall(x[0].lower()):
                        z = bias + sum(map(get, set(ws)))
                        if z >= low:
                            spans.append({"start": x.start(), "end": x.end(), "score": 1 / (1 + exp(-min(z, 40)))})
            found.append(spans)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(found, kind)], ["doc_id", "score", "sentences"])


def score(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """One row per input row: `doc_id, held_out, score, predicted, sentences`.

    score is the noisy-or of the sentence probabilities; an empty or null text has no sentence and scores 0. sentences
    holds start, end (code points) and score of those of at least `least`. Null ids are kept and count as held out; rows
    that repeat get the same score; an empty table gives an empty result; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2 ** BITS floats
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    out = map_arrow(
        rows, partial(_score, model=shared, least=least),
        "doc_id long, score double, sentences array<struct<start:int,end:int,score:double>>",
    )
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "sentences")
