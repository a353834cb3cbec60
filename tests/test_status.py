"""Live status against the table of all rows, whatever the batches."""

import datetime as dt
import random

from graphloom.streaming import status

T0 = dt.datetime(2026, 1, 5, 8, 0, 0)
SCHEMA = "run_id string, ts timestamp"


def feed(spark, path, batches):
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{path}/{n:03d}")


def run(spark, tmp, rows_dir, late="1 hour"):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(rows_dir))
    q = status.start(status.live_status(stream, late), f"{tmp}/out", f"{tmp}/checkpoint")
    q.awaitTermination()
    return q, sorted((r.run_id, r.at, r.status, r.n_rows) for r in status.told(spark, f"{tmp}/out").collect())


def batch(spark, rows, late="1 hour"):
    return sorted((r.run_id, r.at, r.status, r.n_rows) for r in status.transitions(spark.createDataFrame(rows, SCHEMA), late).collect())


def test_equals_the_table_in_any_order_within_the_delay(spark, tmp_path):
    r = random.Random(1)
    rows = [(f"run{r.randrange(5)}", T0 + dt.timedelta(minutes=r.uniform(0, 1_000))) for _ in range(150)]
    rows = sorted(((a, t.replace(microsecond=0)) for a, t in rows), key=lambda x: x[1].timestamp() + r.uniform(0, 1_500))  # up to 25 minutes late
    parts = [rows[i : i + 50] for i in range(0, 150, 50)]
    feed(spark, tmp_path / "in", [*parts, [("end", T0 + dt.timedelta(days=3)), (None, T0), ("end", None)]])
    q, got = run(spark, tmp_path, tmp_path / "in")
    assert status.dropped_late(q, f"{tmp_path}/out") == 0
    assert got == batch(spark, [*rows, ("end", T0 + dt.timedelta(days=3))])
    assert {s for _, _, s, _ in got} == {"running", "stalled"} and len(got) > 60
    # nothing new: a restart tells nothing again
    assert run(spark, tmp_path, tmp_path / "in")[1] == got


def test_late_rows_are_dropped_and_counted(spark, tmp_path):
    hour = dt.timedelta(hours=1)
    feed(spark, tmp_path / "in", [[("a", T0)], [("a", T0 + 10 * hour)], [("b", T0 + hour), ("a", T0 + 10 * hour)], [("c", T0 + 20 * hour)]])
    q, got = run(spark, tmp_path, tmp_path / "in")
    assert status.dropped_late(q, f"{tmp_path}/out") == 1 and not [x for x in got if x[0] == "b"]
    assert got == batch(spark, [("a", T0), ("a", T0 + 10 * hour), ("a", T0 + 10 * hour), ("c", T0 + 20 * hour)])
    assert got[1] == ("a", T0 + dt.timedelta(minutes=15), "stalled", 1)
