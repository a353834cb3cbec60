"""Run folders: summaries, checkpoints, graphs, tables."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from graphloom.shipping import ship
from graphloom.storage import store

CHECKPOINT = "instance_id string, prediction string, per_instance string"
MERGED_FILE = "predictions_partial.jsonl"
#: Tasks at most that list folders; Spark's own bound is a task for each of 10,000.
LISTING = 64


def checkpoint_order(path: Column) -> Column:
    """Workers by their number, the merged file last."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.when(name == MERGED_FILE, F.lit(1 << 60)).otherwise(F.coalesce(F.regexp_extract(name, r"(\d+)", 1).try_cast("bigint"), F.lit(-1)))


def parsed_checkpoints(lines: DataFrame) -> DataFrame:
    """`lines(file, line_no, value)` to rows; lines that are no JSON object or have no id are dropped."""
    rows = lines.select("file", "line_no", F.from_json("value", CHECKPOINT).alias("j"))
    rows = rows.select("file", "line_no", "j.*").where("instance_id IS NOT NULL AND instance_id <> ''")
    return rows.withColumn("file_ord", checkpoint_order(F.col("file")))


def last_lines(rows: DataFrame) -> DataFrame:
    """Each instance's last line, the merged file counting as last of all."""
    return rows.groupBy("instance_id").agg(F.max_by(F.struct("prediction", "per_instance", "file", "line_no"), F.struct("file_ord", "file", "line_no")).alias("r")).select("instance_id", "r.*")


def read_checkpoints(spark: SparkSession, pattern: str) -> DataFrame:
    """Lines of checkpoint files with their numbers; a file is read by one task, as it is written by one worker."""
    files = spark.read.option("wholetext", True).text(pattern).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\n")).alias("line_no", "value"))
    return parsed_checkpoints(files.where("value <> ''"))


def append_checkpoints(rows: DataFrame, path: str) -> None:
    """A10."""
    rows.write.mode("append").json(path)


def save_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Without columns that begin with an underscore."""
    nodes.drop(*(c for c in nodes.columns if c.startswith("_"))).write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").parquet(f"{path}/edges")


def load_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")


def save_vectors(vectors: DataFrame, path: str) -> None:
    """A8."""
    vectors.write.mode("overwrite").parquet(path)


def load_vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def discovered(spark: SparkSession, root: str, below: str = "patch_runs", skip: str = "_repos") -> DataFrame:
    """L1: `run_dir, run_id, seen_ts` of the folders below any folder called `below`, the newest first; `skip` is not entered.

    A run's time is that of its newest summary, prediction or checkpoint file, null without any.
    """
    fs = spark._jvm.org.apache.hadoop.fs
    at = fs.Path(root)
    system = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    marks = lambda name: name in ("patch_summary.json", "predictions.json", MERGED_FILE) or (name.startswith("worker_") and name.endswith(".jsonl"))
    rows, todo = [], [at] if system.exists(at) else []
    while todo:
        folder = todo.pop()
        inside = [s for s in system.listStatus(folder) if s.isDirectory()]
        if folder.getName() == below:
            for run in inside:
                times = [s.getModificationTime() for s in system.listStatus(run.getPath()) if s.isFile() and marks(s.getPath().getName())]
                rows.append((run.getPath().toString(), run.getPath().getName(), max(times) / 1000 if times else None))
        elif folder.getName() != skip:
            todo += [s.getPath() for s in inside]
    found = spark.createDataFrame(rows, "run_dir string, run_id string, seen_ts double")
    return found.orderBy(F.coalesce("seen_ts", F.lit(0.0)).desc(), F.col("run_id").desc())


def save_results(detailed: DataFrame, summary: DataFrame, path: str) -> None:
    """Under the run's folder and again under "latest"."""
    base, _, _ = path.rstrip("/").rpartition("/")
    for at in (path, f"{base}/latest"):
        detailed.write.mode("overwrite").json(f"{at}/detailed_results")
        summary.write.mode("overwrite").json(f"{at}/summary")


def save_summaries(rows: DataFrame, root: str, name: str = "summary.json") -> None:
    """The folder of each of `rows(run_id, value)` with its document. Tasks write them, however few bytes they are; a document has its name
    once it is whole. `root` is a path or URI that all machines can open.
    """
    spark = rows.sparkSession
    ship(spark)

    def put(runs: Iterator[Row]) -> None:
        system, base = store(root)
        for run_id, value in runs:
            at = f"{base}/{run_id}"
            system.create_dir(at, recursive=True)
            part = f"{at}/.{name}.{uuid.uuid4().hex}"
            with system.open_output_stream(part, compression=None) as out:
                out.write(value.encode())
            system.move(part, f"{at}/{name}")

    # With a number of its own the exchange is not made one task, as a writer of small rows would be.
    rows.select("run_id", "value").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "run_id").foreachPartition(put)


def read_summaries(spark: SparkSession, root: str, schema: str, name: str = "summary.json") -> DataFrame:
    """One JSON document for each run folder; broken ones are dropped. Some of Spark's tasks list the folders, not the driver one by one."""
    fs = spark._jvm.org.apache.hadoop.fs
    system = fs.Path(root).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    depth = len(system.makeQualified(fs.Path(root)).toUri().getPath().rstrip("/").split("/"))
    # What has this ending is not compressed, and is read without a look for its codec, which takes longer than the file.
    if name.endswith(".json"):
        reader, value = (lambda: spark.read.format("binaryFile")), F.col("content").cast("string").alias("value")
    else:
        reader, value = (lambda: spark.read.format("text").option("wholetext", True)), F.col("value")
    tasks = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    kept = spark.conf.get(tasks)
    spark.conf.set(tasks, str(min(int(kept), LISTING)))  # folders are listed as the reader is made
    try:
        text = reader().option("recursiveFileLookup", True).option("pathGlobFilter", name).load(root)
    finally:
        spark.conf.set(tasks, kept)
    text = text.select(value, F.input_file_name().alias("at"))
    # Folders that such a listing hides, which are few.
    hidden = [s.getPath() for s in system.globStatus(fs.Path(f"{root}/[_.]*/{name}")) or []]
    hidden = [p.toString() for p in hidden if not (p.getParent().getName().startswith("_") and "=" in p.getParent().getName())]
    if hidden:
        text = text.unionByName(reader().load(hidden).select(value, F.input_file_name().alias("at")))
    parts = F.split(F.regexp_replace("at", "^[A-Za-z0-9+.-]+:(//[^/]*)?", ""), "/")
    text = text.where(F.size(parts) == depth + 2).select(F.element_at(parts, -2).alias("run_id"), F.from_json("value", schema).alias("j"))
    return text.where("j IS NOT NULL").select("run_id", "j.*")


def latex_pivot(rows: DataFrame, methods: Sequence[str], by: str = "repo", value: str = "f1") -> DataFrame:
    """A line for each row of the table, its best value in bold, a dash where there is none: `by, line`."""
    wide = rows.groupBy(by).pivot("method", list(methods)).agg(F.first(value))
    best = F.greatest(*(F.col(f"`{m}`") for m in methods)) if len(methods) > 1 else F.col(f"`{methods[0]}`")
    cell = lambda m: F.when(F.col(f"`{m}`").isNull(), "---").when(F.abs(F.col(f"`{m}`") - best) < 1e-4, F.format_string("\\textbf{%.3f}", F.col(f"`{m}`"))).otherwise(F.format_string("%.3f", F.col(f"`{m}`")))
    return wide.select(by, F.concat(F.concat_ws(" & ", F.col(by), *(cell(m) for m in methods)), F.lit(" \\\\")).alias("line"))


def save_csv(rows: DataFrame, path: str, columns: Sequence[str]) -> None:
    """One file with the columns in this order."""
    rows.select(*columns).coalesce(1).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)
