"""The bucketed state table: what a batch writes, and batches that run again."""

import datetime as dt
import shutil

from graphloom.streaming import checkpoints

T0 = dt.datetime(2026, 1, 5)
SCHEMA = "run_id string, instance_id string, patch_status string, ts timestamp"


def add(spark, folder, rows):
    spark.createDataFrame([(r, i, s, T0 + dt.timedelta(seconds=t)) for r, i, s, t in rows], SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))


def merge(spark, tmp):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp / "in"))
    checkpoints.upsert(stream, str(tmp / "t"), str(tmp / "c"), buckets=16).trigger(availableNow=True).start().awaitTermination()
    return {(r.run_id, r.instance_id): (r.patch_status, r.ts) for r in checkpoints.merged(spark, str(tmp / "t")).collect()}


def latest(rows):
    out = {}
    for r, i, s, t in rows:
        out[r, i] = max(out.get((r, i), (T0, "")), (T0 + dt.timedelta(seconds=t), s))
    return {k: (s, t) for k, (t, s) in out.items()}


def size(folder):
    return sum(p.stat().st_size for p in folder.rglob("*.parquet"))


def test_batches_write_only_what_they_touch(spark, tmp_path):
    first = [(f"r{i % 3}", f"i{i}", f"s{i % 5}", i) for i in range(4_000)]
    add(spark, tmp_path / "in", first)
    assert merge(spark, tmp_path) == latest(first)
    second = [("r0", "i0", "new", 5_000), ("r0", "i3", "older", 1), ("r0", "i0", "newest", 5_000)]
    add(spark, tmp_path / "in", second)
    assert merge(spark, tmp_path) == latest([*first, *second])
    data = sorted((tmp_path / "t/data").iterdir(), key=lambda p: int(p.name))
    assert len(list(data[1].glob("bucket=*"))) <= 2 and size(data[1]) < 0.3 * size(data[0])
    for k in range(3):
        add(spark, tmp_path / "in", [("r9", "only", f"v{k}", 9_000 + k)])
        got = merge(spark, tmp_path)
    assert got["r9", "only"][0] == "v2" and len(got) == 4_001
    # the last two versions of a bucket stay, and no more manifests than theirs
    assert len(list((tmp_path / "t/manifest").iterdir())) == 2
    assert sum(1 for d in (tmp_path / "t/data").iterdir() for _ in d.glob("bucket=*")) <= 16 + 2


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path):
    add(spark, tmp_path / "in", [("r", f"i{i}", "a", i) for i in range(50)])
    merge(spark, tmp_path)
    add(spark, tmp_path / "in", [("r", "i1", "b", 100)])
    want = merge(spark, tmp_path)
    # as if the driver had been lost after the batch and before its commit
    shutil.rmtree(tmp_path / "c/commits")
    (tmp_path / "c/commits").mkdir()
    assert merge(spark, tmp_path) == want
    assert checkpoints.merged(spark, str(tmp_path / "none")).collect() == []
