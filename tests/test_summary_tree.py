"""A tree of many small documents is written by as many tasks as there are, and listed by few."""

import pytest
from pyspark.sql import functions as F

from graphloom.plans.queries_sources import summary_tree
from graphloom.sources import runs


def test_folders_are_dealt_over_tasks(spark):
    rows = spark.range(300).select(F.when(F.col("id") > 0, F.col("id")).alias("repo"), (F.col("id") + 1).alias("n"))
    parallelism = spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism")
    sc, group = spark.sparkContext, "summary-tree"
    sc.setJobGroup(group, "")
    try:
        got = summary_tree(rows)
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    told = sc.statusTracker()
    stages = [told.getStageInfo(s) for j in told.getJobIdsForGroup(group) for s in told.getJobInfo(j).stageIds]
    assert max(s.numTasks for s in stages) <= 64, stages
    wrote = [s for s in stages if s.name.startswith("foreachPartition")]
    assert wrote and all(s.numTasks > 1 for s in wrote), stages
    assert spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism") == parallelism
    assert sorted(map(tuple, got.collect())) == sorted((f"run={i or ''}", i + 1) for i in range(300) if (i + 1) % 7)


@pytest.mark.parametrize("name", ["summary.json", "part-*"])
def test_documents_are_whole(spark, tmp_path, name):
    """Several lines, other letters, none, again; by either reader."""
    texts = {"a": '{"n":\n 1}', "b c": '{"n": 2, "s": "Ünder"}', "_d": '{"n": 3}', "e": "", "f": "{oops"}
    docs = spark.createDataFrame(list(texts.items()), "run_id string, value string")
    for _ in range(2):
        runs.save_summaries(docs, str(tmp_path), name.replace("*", "0"))
    got = runs.read_summaries(spark, f"file:{tmp_path}", "n long, s string", name).where("n IS NOT NULL").collect()
    assert {tuple(r) for r in got} == {("a", 1, None), ("b%20c", 2, "Ünder"), ("_d", 3, None)}
    assert sorted(p.name for p in tmp_path.rglob("*") if p.is_file()) == [name.replace("*", "0")] * len(texts)
