"""Patch-run results (J)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators.ranges import numbered


def capped(files: Column | str, k: int) -> Column:
    """The first max(k, 1), with counts before and after."""
    f = F.coalesce(F.col(files) if isinstance(files, str) else files, F.array().cast("array<string>"))
    kept = F.slice(f, 1, max(k, 1))
    return F.struct(kept.alias("files"), F.size(f).alias("pre_cap"), F.size(kept).alias("post_cap"))


def robustness(ok: Column, failed: Column) -> Column:
    """J2."""
    return ok / F.greatest(ok + failed, F.lit(1))


def cost_summary(instances: DataFrame, runs: DataFrame) -> DataFrame:
    """`run_id, runtime tokens, total_cost_tokens, cost_per_resolved`; null where nothing is resolved."""
    t = instances.groupBy("run_id").agg(F.sum("retrieval_total_tokens").alias("retrieval_tokens"), F.sum("patch_total_tokens").alias("patch_tokens"))
    rows = runs.join(t, "run_id", "left").na.fill(0, ["retrieval_tokens", "patch_tokens"])
    total = F.col("setup_tokens") + F.col("retrieval_tokens") + F.col("patch_tokens")
    return rows.withColumn("total_cost_tokens", total).withColumn("cost_per_resolved", F.when(F.col("n_resolved") > 0, F.col("total_cost_tokens") / F.col("n_resolved")))


def _kind(v: Column) -> Column:
    """OBJECT, ARRAY, STRING and so on, of a variant."""
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)


def _counts_as_yes(v: Column) -> Column:
    """Whether a variant is neither null, false, zero nor empty."""
    kind, got = _kind(v), lambda t: F.try_variant_get(v, "$", t)
    yes = F.when(kind == "BOOLEAN", got("boolean")).when(kind == "STRING", got("string") != "").when(kind == "ARRAY", F.size(got("array<variant>")) > 0)
    yes = yes.when(kind == "OBJECT", F.size(got("map<string, variant>")) > 0).when(kind.isin("BIGINT", "DECIMAL", "DOUBLE", "FLOAT"), got("double") != 0)
    return F.coalesce(yes, F.lit(False))


def harness_payload(payload: Column | str, n_total: Column | int = 0) -> Column:
    """Struct of `ids, n_resolved, resolved_rate` of a report: a list of resolved ids, instances by id, or only their number.

    Null where the report is none of these; the rate is 0 where nothing was run. A report is parsed once, as a variant, and
    what it is is told by the types of its values. Malformed text is none of these.
    """
    p = F.col(payload) if isinstance(payload, str) else payload
    n = F.lit(n_total) if isinstance(n_total, int) else n_total
    # one element binds the variant, so that it is made once
    return F.transform(F.array(F.try_parse_json(p)), lambda v: _report(v, n))[0]


def _report(v: Column, n: Column) -> Column:
    ids_of = F.try_variant_get(v, "$.resolved_ids", "array<string>")
    listed = F.when(_kind(F.try_variant_get(v, "$.resolved_ids", "variant")) == "ARRAY", F.array_sort(ids_of))
    top = F.when(_kind(v) == "OBJECT", F.try_variant_get(v, "$", "map<string, variant>"))
    inner = F.map_filter(top, lambda _, x: F.coalesce(_kind(x) == "OBJECT", F.lit(False)))
    by = F.array_sort(F.map_keys(F.map_filter(inner, lambda _, x: _counts_as_yes(F.try_variant_get(x, "$.resolved", "variant")))))
    instances = (F.size(by) > 0) | ((F.size(top) > 0) & (F.size(inner) == F.size(top)))
    ids = F.coalesce(listed, F.when(instances, by))
    said = F.try_variant_get(v, "$.resolved_instances", "variant")
    counted = F.when(_kind(said).isin("BIGINT", "DECIMAL", "DOUBLE", "FLOAT"), F.try_variant_get(said, "$", "double").cast("long"))
    found = F.when(ids.isNotNull(), F.size(ids).cast("long")).otherwise(counted)
    rate = F.when(n > 0, F.round(found / n, 4)).otherwise(0.0)
    return F.when(found.isNotNull(), F.struct(F.coalesce(ids, F.array().cast("array<string>")).alias("ids"), found.alias("n_resolved"), rate.alias("resolved_rate")))


def resolved_from_reports(reports: DataFrame) -> DataFrame:
    """`run_id, ids` of single instances' reports(run_id, instance_id, resolved)."""
    return reports.where("resolved").groupBy("run_id").agg(F.array_sort(F.collect_set("instance_id")).alias("ids"))


def harness_results(payloads: DataFrame, reports: DataFrame) -> DataFrame:
    """`run_id, ids, n_resolved, resolved_rate` of `payloads(run_id, payload, n_total)`; of runs whose report says nothing, by their instances' reports."""
    rows = payloads.withColumn("p", harness_payload("payload", F.col("n_total"))).join(resolved_from_reports(reports).withColumnRenamed("ids", "_ids"), "run_id", "left")
    ids = F.when(F.col("p").isNotNull(), F.col("p.ids")).otherwise(F.col("_ids"))
    n = F.when(F.col("p").isNotNull(), F.col("p.n_resolved")).when(F.col("_ids").isNotNull(), F.size("_ids").cast("long"))
    return rows.select("run_id", ids.alias("ids"), n.alias("n_resolved"), F.when(F.col("n_total") > 0, F.round(n / F.col("n_total"), 4)).otherwise(0.0).alias("resolved_rate"))


def last_attempts(attempts: DataFrame) -> DataFrame:
    """The final row of each instance's attempts, with how many repairs it took."""
    return attempts.groupBy("instance_id").agg(F.max_by(F.struct(*attempts.columns), "attempt").alias("r"), (F.count("*") - 1).alias("retries")).select("r.*", "retries")


def contiguous_chunks(rows: DataFrame, workers: int, order: str) -> DataFrame:
    """`rows` with `worker`: contiguous, the first ones one longer where it does not divide."""
    n = rows.agg(F.count("*").alias("_n"))
    size, more = F.expr(f"_n DIV {workers}"), F.col("_n") % workers
    long = more * (size + 1)  # rows of the longer ones
    of = F.when(F.col("_row") <= long, F.ceil(F.col("_row") / (size + 1))).otherwise(more + F.ceil((F.col("_row") - long) / size))
    return numbered(rows, order).crossJoin(F.broadcast(n)).withColumn("worker", of.cast("int")).drop("_row", "_n")


def merged_workers(rows: DataFrame) -> DataFrame:
    """Of `rows(worker, line_no, instance_id, prediction)` the last prediction of each instance, and how many there were."""
    return rows.groupBy("instance_id").agg(F.max_by("prediction", F.struct("worker", "line_no")).alias("prediction"), F.count("*").alias("n_rows"))


def run_summary(instances: DataFrame) -> DataFrame:
    """J9."""
    patched = F.count_if(F.col("patch_status") == "patched")
    return instances.groupBy("run_id").agg(
        F.count("*").alias("n_instances"), patched.alias("n_patched"), F.count_if(F.col("patch_status") == "apply_failed").alias("n_apply_failed"),
        F.round(patched / F.count("*"), 4).alias("patch_rate"), F.round(F.avg("patch_total_tokens"), 1).alias("avg_patch_tokens"),
    )
