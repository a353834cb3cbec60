"""Methods by name (F37), model and embedding functions (O), retries."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.text import gold_files_from_diff, normalize_paths
from graphloom.operators.paths import canonical_list
from graphloom.shipping import ship

# Fixed names of the methods and of what they used to be called.
METHODS = (
    "none", "oracle", "bm25", "raw_rag_fixed", "raw_rag_function", "rag_metadata", "rag_progressive", "gm_deterministic", "gm_progressive", "repomap_like",
    "agentless_like", "agentic_cold_start", "rag_baseline",
)
ALIASES = {"agentless_like_localization": "agentless_like"}

Method = Callable[..., DataFrame]


class Registry:
    """Retrieval methods: each takes issues(instance_id, problem_statement, gold_files) and gives instance_id, files."""

    def __init__(self) -> None:
        self.methods: dict[str, Method] = {"none": no_files, "oracle": oracle_files}

    def register(self, name: str, method: Method) -> None:
        if name not in METHODS:
            raise ValueError(f"unknown method: {name}")
        self.methods[name] = method

    def run(self, name: str, issues: DataFrame, valid: DataFrame | None = None, **more: Any) -> DataFrame:
        """The method's files; with `valid(path)` as canonical paths of those, others left out."""
        name = ALIASES.get(name, name)
        if name not in self.methods:
            raise ValueError(f"unknown method: {name}")
        found = self.methods[name](issues, **more)
        if valid is None:
            return found
        return canonical_list(found.select("instance_id", normalize_paths("files").alias("paths")), valid, "instance_id")


def no_files(issues: DataFrame, **_: Any) -> DataFrame:
    """F36."""
    return issues.select("instance_id", F.array().cast("array<string>").alias("files"))


def oracle_files(issues: DataFrame, **_: Any) -> DataFrame:
    """the files of the patch, or else the gold files."""
    gold = F.coalesce("gold_files", F.array().cast("array<string>"))
    if "patch" in issues.columns:
        patched = gold_files_from_diff("patch")
        gold = F.when(F.size(patched) > 0, patched).otherwise(gold)
    return issues.select("instance_id", normalize_paths(gold).alias("files"))


def generate(rows: DataFrame, model: Callable[[list[str]], list[str]], prompt: str = "prompt", answer: str = "answer") -> DataFrame:
    """O1: `rows` with a model's answers, by batches; the model is any function of a list of prompts."""
    ship(rows.sparkSession)

    @F.pandas_udf("string")
    def run(prompts: pd.Series) -> pd.Series:
        return pd.Series(model(prompts.fillna("").tolist()))

    return rows.withColumn(answer, run(prompt))


def register_functions(spark: SparkSession, functions: dict[str, Callable]) -> None:
    """O3: names for SQL; a value that has an `eval` is a table function."""
    for name, f in functions.items():
        if hasattr(f, "func") and hasattr(getattr(f, "func", None), "eval"):
            spark.udtf.register(name, f)
        else:
            spark.udf.register(name, f)


def with_retries(call: Callable[[], Any], transient: Sequence[type[Exception]], tries: int = 5, delay: float = 5.0, most: float = 60.0, deadline: float | None = None, sleep: Callable[[float], None] = time.sleep, seed: int = 0) -> Any:
    """Repeats transient failures with doubling, capped and jittered pauses, within a deadline."""
    rng, began = random.Random(seed), time.monotonic()
    for k in range(tries):
        try:
            return call()
        except tuple(transient):
            pause = min(delay * 2**k, most) * (0.5 + rng.random() / 2)
            if k == tries - 1 or deadline is not None and time.monotonic() - began + pause > deadline:
                raise
            sleep(pause)
    raise ValueError("tries must be at least 1")
