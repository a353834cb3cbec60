import math
import re
import zlib

import numpy as np

from graphloom.llm import quality, toxicity
from graphloom.llm.training import held_out, sample

from .helpers import ODD, clashing, table


def auc(y, p):
    order = np.argsort(p, kind="stable")
    _, first, back, n = np.unique(np.asarray(p)[order], return_index=True, return_inverse=True, return_counts=True)
    rank = np.empty(len(p))
    rank[order] = (first + (n + 1) / 2)[back]
    y = np.asarray(y)
    return (rank[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (len(y) - y.sum()))


def tables(spark, sf="sf0.01"):
    return (spark.read.parquet(f"/root/testdata/{sf}/{t}.parquet") for t in ("documents", "labels"))


def slot(feature):
    return zlib.crc32(feature.encode()) % (1 << 18)


def plain_quality(text, model):
    """The score worked out word by word, with the weights alone."""
    tokens = text.split()
    w = [float(x) for x in model.weights]

    def shape(t):
        out = []
        for c in t:
            kind = "0" if c.isdigit() else "a" if "a" <= c <= "z" or "à" <= c <= "ö" or "ø" <= c <= "ÿ" or c == "ß" else "A" if c.isalnum() else c
            if kind not in "0aA" or kind == c in "_" or not out or out[-1] != kind:
                out.append(kind)
        return "".join(out)[:24]

    total = 0.0
    for t in tokens:
        total += w[slot("w" + t.lower().strip(".,;:!?"))] + w[slot("s" + shape(t))]
    s = total / len(tokens) if tokens else w[slot("empty")]
    if tokens:
        again = sum(a == b for a, b in zip(tokens, tokens[1:], strict=False)) / len(tokens)
        s += w[slot(f"again{round(again * 10)}")] + w[slot(f"distinct{round(len(set(tokens)) / len(tokens) * 10)}")] + w[slot(f"length{min(len(bin(len(tokens))) - 2, 12)}")]
    return [1 / (1 + math.exp(-(s - t))) for t in model.thresholds]


def plain_toxicity(text, model):
    """One less the product of what the sentences leave."""
    left = 1.0
    sentences = [""]
    for c in text.lower():
        if c in ".!?\n":
            sentences.append("")
        else:
            sentences[-1] += c
    for sentence in sentences:
        words = {x for x in re.split(r"\W+", sentence) if x}
        if words:
            z = model.bias + sum(float(model.weights[slot(x)]) + sum(float(model.weights[slot("^" + x[:k])]) for k in (3, 4, 5) if len(x) >= k) for x in words)
            left *= 1 / (1 + math.exp(min(z, 700)))
    return 1 - left


def test_scores_equal_plain_ones(spark):
    docs, labels = tables(spark)
    texts = {r.doc_id: r.text for r in docs.collect()}
    model = quality.train(docs, labels)
    for r in quality.score(docs, model).collect():
        tails = plain_quality(texts[r.doc_id], model)
        assert math.isclose(r.tail_probability, tails[0], abs_tol=1e-6), r.doc_id
        assert math.isclose(r.expected_grade, model.grades[0] + sum(t * (b - a) for t, a, b in zip(tails, model.grades, model.grades[1:], strict=False)), abs_tol=1e-6)
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = toxicity.train(docs, labels)
    for r in toxicity.score(docs, model).collect():
        assert math.isclose(r.score, plain_toxicity(texts[r.doc_id], model), abs_tol=1e-6), r.doc_id


def test_samples_are_bounded_with_repeated_ids(spark):
    docs = table(spark, [(i % 7, f"text {i}") for i in range(400)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(7)] * 3, "doc_id long, toxic int")
    rows = sample(docs, labels, "toxic", 3).collect()
    assert len(rows) == len({r.doc_id for r in rows}) == 3
    # of several texts the greatest stands for the id
    assert all(r.text == max(f"text {i}" for i in range(400) if i % 7 == r.doc_id) and r.label == r.doc_id % 2 for r in rows)


def test_toxicity_on_held_out_rows(spark):
    docs, labels = tables(spark, "sf0.1")
    rows = toxicity.score(docs, toxicity.train(docs, labels)).join(labels, "doc_id").where("held_out").collect()
    assert auc([r.toxic for r in rows], [r.score for r in rows]) > 0.93
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)


def test_offending_sentences_are_found(spark):
    rows = [(i, f"Good words number {i} here. " + ("You are awful now. " if i % 3 == 0 else "") + "The end comes.") for i in range(300)]
    docs = table(spark, rows)
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)], "doc_id long, toxic int")
    for r in toxicity.score(docs, toxicity.train(docs, labels)).collect():
        text = rows[r.doc_id][1]
        assert r.predicted == (r.doc_id % 3 == 0)
        assert [text[s.start : s.end].strip() for s in r.sentences] == ["You are awful now"] * r.predicted


def test_toxicity_odd_rows(spark):
    docs, labels = tables(spark)
    model = toxicity.train(docs, labels)
    out = toxicity.score(clashing(table(spark, ODD)), model).collect()
    assert len(out) == len(ODD) and {r.score for r in out if r.doc_id in (1, 2, 3)} == {0.0}
    assert all(r.held_out for r in out if r.doc_id is None)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.score(table(spark, []), toxicity.train(table(spark, []), none)).count() == 0
    assert toxicity.score(table(spark, ODD), toxicity.train(table(spark, ODD), none)).count() == len(ODD)


def test_quality_on_held_out_rows(spark):
    docs, labels = tables(spark)
    rows = quality.score(docs, quality.train(docs, labels)).join(labels, "doc_id").where(held_out()).collect()
    assert auc([r.quality for r in rows], [r.tail_probability for r in rows]) > 0.97
    assert np.mean([r.kept == (r.quality == 1) for r in rows]) > 0.93


def test_ordinal_grades(spark):
    """Four grades told by how many words of a kind a text has."""
    rng = np.random.default_rng(2)
    rows, ratings = [], []
    for i in range(900):
        good = int(rng.integers(0, 31))
        words = ["good"] * good + ["plain"] * (30 - good)
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
        ratings.append((i, min(good // 8, 3) + 1))
    docs = table(spark, rows)
    model = quality.train(docs, spark.createDataFrame(ratings, "doc_id long, quality int"))
    assert model.grades == [1, 2, 3, 4] and (np.diff(model.thresholds) > 0).all()
    out = {r.doc_id: r for r in quality.score(docs, model).collect()}
    error = np.mean([abs(out[i].expected_grade - g) for i, g in ratings])
    assert error < 0.5
    assert all(1 <= r.expected_grade <= 4 for r in out.values())


def test_quality_odd_rows(spark):
    docs, labels = tables(spark)
    model = quality.train(docs, labels)
    df = clashing(table(spark, ODD))
    out = quality.score(df, model).collect()
    assert len(out) == len(ODD)
    left = quality.select(df, model)
    assert left.columns == df.columns and left.count() == sum(r.kept for r in out)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert all(r.kept for r in quality.score(table(spark, ODD), quality.train(table(spark, ODD), none)).collect())
    assert quality.score(table(spark, []), model).count() == 0
