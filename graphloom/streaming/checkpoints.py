"""Structured Streaming over append-only checkpoint logs and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.sources.runs import CHECKPOINT


def checkpoint_stream(spark: SparkSession, folder: str) -> DataFrame:
    """New lines of JSONL files in `folder`, malformed ones and those without id dropped."""
    lines = spark.readStream.option("maxFilesPerTrigger", 1000).text(folder)
    got = lines.select(F.from_json("value", CHECKPOINT + ", ts timestamp, run_id string, patch_status string").alias("j")).select("j.*")
    return got.where("instance_id IS NOT NULL AND instance_id <> ''")


def latest_per_instance(stream: DataFrame) -> DataFrame:
    """The last row of each instance by time; one row of state an instance."""
    return stream.groupBy("run_id", "instance_id").agg(F.max_by("patch_status", "ts").alias("patch_status"), F.max("ts").alias("ts"))


def _timed(events: DataFrame, late: str) -> DataFrame:
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return rows.withWatermark("ts", late) if events.isStreaming else rows


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of each user's events; state older than the watermark is dropped."""
    w = _timed(events, late)
    return w.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(
        "user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "value"
    )


def status_counts(events: DataFrame, every: str = "10 minutes", late: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Events by type in windows of time, which overlap where they begin each `slide`."""
    w = _timed(events, late)
    return w.groupBy(F.window("ts", every, slide).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


#: Folders that instances are hashed into; a batch writes those anew that it touches.
BUCKETS = 64
STATE = "run_id string, instance_id string, patch_status string, ts timestamp"


def _numbers(spark: SparkSession, folder: str) -> list[int]:
    """Finished batches below `folder`, by number."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not store.exists(at):
        return []
    found = [x.getPath() for x in store.listStatus(at)]
    done = [p for p in found if store.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(int(p.getName()) for p in done if p.getName().isdigit())


def _manifest(spark: SparkSession, target: str, before: int | None = None) -> dict[int, int]:
    """The batch that wrote each bucket last, by the newest manifest (before batch `before`): BUCKETS entries at most."""
    numbers = [n for n in _numbers(spark, f"{target}/manifest") if before is None or n < before]
    if not numbers:
        return {}
    return {r.bucket: r.batch for r in spark.read.schema("bucket int, batch long").json(f"{target}/manifest/{numbers[-1]}").collect()}


def _of(target: str, manifest: dict[int, int], buckets) -> list[str]:
    return [f"{target}/data/{manifest[b]}/bucket={b}" for b in sorted(buckets) if b in manifest]


def merged(spark: SparkSession, target: str) -> DataFrame:
    """The state that `upsert` keeps below `target`: one row an instance."""
    manifest = _manifest(spark, target)
    paths = _of(target, manifest, manifest)
    return spark.read.schema(STATE).parquet(*paths) if paths else spark.createDataFrame([], STATE)


def upsert(stream: DataFrame, target: str, checkpoint: str, buckets: int = BUCKETS):
    """Keeps each instance's last row below `target`, of equal times the largest status.

    A batch writes only the buckets that it touches, below its own number, and then a manifest of where each bucket is now. It starts
    from the newest manifest before it, so a batch that is run again writes the same once more. Buckets that neither the
    last manifest nor the one before it names are deleted.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.selectExpr("run_id", "instance_id", "patch_status", "CAST(ts AS TIMESTAMP) AS ts").persist()
        bucket = F.pmod(F.xxhash64("run_id", "instance_id"), F.lit(buckets)).cast("int").alias("bucket")
        touched = [r.bucket for r in rows.select(bucket).distinct().collect()]
        before = _manifest(spark, target, number)
        if touched:
            old = _of(target, before, touched)
            every = rows.unionByName(spark.read.schema(STATE).parquet(*old)) if old else rows
            last = every.groupBy("run_id", "instance_id").agg(F.max(F.struct("ts", "patch_status")).alias("x")).select("run_id", "instance_id", "x.patch_status", "x.ts")
            last.select("*", bucket).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{target}/data/{number}")
        now = before | dict.fromkeys(touched, number)
        spark.createDataFrame(sorted(now.items()), "bucket int, batch long").coalesce(1).write.mode("overwrite").json(f"{target}/manifest/{number}")
        rows.unpersist()
        _clear(spark, target, number, before, now)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)


def _clear(spark: SparkSession, target: str, number: int, before: dict[int, int], now: dict[int, int]) -> None:
    """Deletes buckets and manifests that are older than the one before the last."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    store = path(target).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    older = [n for n in _numbers(spark, f"{target}/manifest") if n < number]
    for n in older[:-1]:
        gone = {r.bucket: r.batch for r in spark.read.schema("bucket int, batch long").json(f"{target}/manifest/{n}").collect()}
        for bucket, batch in gone.items():
            if batch not in (before.get(bucket), now.get(bucket)):
                store.delete(path(f"{target}/data/{batch}/bucket={bucket}"), True)
        store.delete(path(f"{target}/manifest/{n}"), True)
