"""From documents to token ids: quality, exact copies, near copies, benchmark passages, encoding.

Each stage reads all that the one before kept. The stages before the last return whole rows of `documents`, with all their columns.

Null texts count as empty. An empty or null text is graded, is the copy of other empty ones, near to nothing, holds no passage and has no tokens. Rows
without id are graded and encoded like others; of equal texts any row with an id comes before them, and they are near to nothing. Rows
that repeat an id and text are copies, of which one stays. A stage of an empty table is empty, as is the result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import bpe, decontam, exact, minhash, quality
from graphloom.llm.common import documents, written
from graphloom.llm.queries import tokenizer_path


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of a grade above the least is one half or more, by a model of the labelled ones.

    A bounded number of labelled rows is read for the model; every row is graded.
    """
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.select(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id; null and empty texts are equal."""
    return exact.select(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies the row with the least id. Texts without words are linked with nothing."""
    return minhash.select(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark; texts without words hold none, nor does any where the benchmark is empty."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of whole texts, with digests of them and of the decoded text: a row for every row, none for empty texts' tokens."""
    return bpe.encode(docs, tokenizer_path())


STAGES = [
    ("quality", keep_quality),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("bpe", encode),
]

#: A trained model, MinHash and BPE have no SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
