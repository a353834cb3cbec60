"""Issue datasets and manifests."""

from __future__ import annotations

import itertools
import json
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions.text import gold_files_from_diff, gold_files_from_text, normalize_paths

# Fixed names: where a dataset may keep each field, in order of preference.
FIELDS = {
    "instance_id": ("instance_id", "id", "issue_id", "problem_id"),
    "repo": ("repo", "repository"),
    "base_commit": ("base_commit", "base_sha", "commit", "snapshot_commit"),
    "problem_statement": ("problem_statement", "statement", "issue", "prompt"),
    "patch": ("patch", "gold_patch"),
}
GOLD = ("gold_files", "oracle_files", "target_files", "file_paths")
SPLITS = {"default": ("test", "train", "dev"), "poly": ("test", "validation", "dev", "train")}


def family(name: str, declared: str = "") -> str:
    """A5."""
    return "poly" if "polybench" in f"{name} {declared}".lower() else "default"


def family_of(name: str, declared: str) -> Column:
    """A5 for columns, either of which may be null."""
    both = F.lower(F.concat_ws(" ", name, declared))
    return F.when(F.contains(both, F.lit("polybench")), "poly").otherwise("default")


def _given(df: DataFrame, names: Iterable[str]) -> Column:
    """The first of the columns that is there and is neither null nor empty."""
    have = [F.nullif(F.col(n).cast("string"), F.lit("")) for n in names if n in df.columns]
    return F.coalesce(*have, F.lit(None).cast("string"))


def issues(raw: DataFrame, repo: str = "", *more: str) -> DataFrame:
    """A4: any dataset's rows in one shape; the first gold list that is given counts, and if it names no file, the patch.

    Rows without a repository belong to `repo`. Missing texts are empty, a missing commit is null. `more` names columns that
    stay.
    """
    out = {k: _given(raw, v) for k, v in FIELDS.items()}
    gold = F.lit(None).cast("array<string>")
    for name in reversed([n for n in GOLD if n in raw.columns]):
        c = F.col(name)
        if raw.schema[name].dataType.typeName() == "array":
            gold = F.when(F.size(c) > 0, normalize_paths(c)).otherwise(gold)
        else:
            gold = F.when(c != "", gold_files_from_text(c)).otherwise(gold)
    gold = F.when(F.size(gold) > 0, gold).otherwise(normalize_paths(gold_files_from_diff(out["patch"])))
    defaults = {"instance_id": "", "repo": repo, "problem_statement": "", "patch": ""}
    fields = [F.coalesce(c, F.lit(defaults[k])).alias(k) if k in defaults else c.alias(k) for k, c in out.items()]
    split = [F.col("split")] if "split" in raw.columns else []
    return raw.select(*fields, gold.alias("gold_files"), *split, *more)


def load_splits(spark: SparkSession, root: str, name: str, repo: str | None = None, fmt: str = "parquet") -> DataFrame:
    """A3: the union of the splits that can be read, of one repository if asked; of one id the first seen."""
    parts = []
    names = FIELDS["repo"] if family(name) == "poly" else FIELDS["repo"][:1]
    row = "_metadata.row_index" if fmt == "parquet" else "monotonically_increasing_id()"
    for k, split in enumerate(SPLITS[family(name)]):
        try:
            df = spark.read.format(fmt).load(f"{root}/{split}.{fmt}")
        except Exception:  # noqa: BLE001  a split that is not there is passed over
            continue
        place = F.struct(F.lit(k), F.expr("_metadata.file_path"), F.expr(row))
        df = df.select("*", F.lit(split).alias("split"), place.alias("_place"))
        if repo:
            df = df.where(_given(df, names) == repo)
        parts.append(issues(df, repo or "", "_place"))
    if not parts:
        raise ValueError(f"no split of {name} can be read")
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return first_seen(rows, "instance_id", ["_place"]).drop("_place")


def first_seen(rows: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def manifest_selection(rows: DataFrame, ids: Sequence[str], n: int, key: str = "instance_id", order: str | None = None) -> DataFrame:
    """The first `n` rows where no ids are given; else those listed, in the list's order, with `pos`.

    Ids are trimmed, repeats and unknown ones passed over.
    """
    if not ids:
        w = Window.orderBy(order or key)
        return rows.orderBy(order or key).limit(n).withColumn("pos", F.row_number().over(w))
    clean = list(dict.fromkeys(i.strip() for i in ids if i.strip()))
    listed = rows.sparkSession.createDataFrame(list(zip(clean, range(len(clean)), strict=True)), f"{key} string, _pos int")
    found = rows.withColumn("_k", F.col(key).cast("string")).join(F.broadcast(listed.withColumnRenamed(key, "_k")), "_k").drop("_k")
    return found.orderBy("_pos").limit(n).withColumn("pos", F.row_number().over(Window.orderBy("_pos"))).drop("_pos")


def config_rows(text: str) -> dict:
    """A manifest, suite or campaign written as JSON, or as YAML where a parser is installed."""
    try:
        return json.loads(text)
    except ValueError:
        import yaml

        return yaml.safe_load(text)


def merged_config(defaults: dict, *layers: dict) -> dict:
    """Later layers win, one level of nesting is merged."""
    out = dict(defaults)
    for layer in layers:
        for k, v in layer.items():
            out[k] = {**out[k], **v} if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def generated_manifests(ids: DataFrame, methods: Sequence[str]) -> DataFrame:
    """A manifest row for each repository of `ids(repo, instance_id)` and each method."""
    m = ids.sparkSession.createDataFrame([(x,) for x in methods], "method string")
    return ids.groupBy("repo").agg(F.array_sort(F.collect_set("instance_id")).alias("instance_ids")).crossJoin(F.broadcast(m)).withColumn("n_instances", F.size("instance_ids"))


def method_pairs(methods: Sequence[str]) -> list[tuple[str, str]]:
    return list(itertools.permutations(methods, 2))
