"""L3 live: runs that turn running with a row and stalled after silent minutes, by timers of event time.

Rows may come in any order within the watermark's delay. A run's rows wait in its state until the watermark has passed them and are
then taken in order, so what is told does not depend on how rows fell into batches: it equals `transitions` over the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from graphloom.shipping import ship

STALE_MINUTES = 15
OUT = "run_id string, status string, at timestamp, n_rows long"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class RunStatus(StatefulProcessor):
    """State of a run: rows not yet passed by the watermark, the last one taken, how many were, and whether it runs."""

    def __init__(self, stale_minutes: float):
        self.stale = int(stale_minutes * 60_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", "last long, n long, runs boolean")
        self.waiting = handle.getListState("waiting", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator:  # noqa: N802, N803  Spark's names
        new = [int(x) for pdf in rows for x in pdf["ms"].tolist()]
        return self.settled(key[0], new, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:  # noqa: N802, N803
        return self.settled(key[0], [], timerValues.getCurrentWatermarkInMs())

    def settled(self, run_id: str, new: list[int], now: int) -> Iterator:
        import pandas as pd

        last, n, runs = self.run.get() if self.run.exists() else (None, 0, False)
        before = [x[0] for x in self.waiting.get()] if self.waiting.exists() else []
        waiting = sorted([*before, *(x for x in new if x > now)])
        told = [(run_id, "late", x, n) for x in new if x <= now]
        ready = [x for x in waiting if x <= now]
        for x in [*ready, None]:
            if runs and last + self.stale <= now and (x is None or x > last + self.stale):
                told.append((run_id, "stalled", last + self.stale, n))
                runs = False
            if x is not None:
                n += 1
                if not runs:
                    told.append((run_id, "running", x, n))
                last, runs = x, True
        waiting = waiting[len(ready) :]
        if waiting:
            self.waiting.put([(x,) for x in waiting])
        else:
            self.waiting.clear()
        if last is not None:
            self.run.update((last, n, runs))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if due := [*waiting[:1], *([last + self.stale] if runs else [])]:
            self.handle.registerTimer(min(due))
        if told:
            frame = pd.DataFrame(told, columns=["run_id", "status", "at", "n_rows"])
            yield frame.assign(at=pd.to_datetime(frame["at"], unit="ms"))

    def close(self) -> None:
        pass


def live_status(rows: DataFrame, late: str = "1 hour", stale_minutes: float = STALE_MINUTES) -> DataFrame:
    """Of a stream of `rows(run_id, ts)`: `run_id, status, at, n_rows` whenever a run turns running or stalled.

    Rows without run or time are dropped. So are those that the watermark has passed: by Spark, whose progress counts them, if it
    had passed them a batch before, else here, as rows of status late; `dropped_late` counts both.
    """
    ship(rows.sparkSession)
    timed = rows.select("run_id", F.col("ts").cast("timestamp").alias("ts")).where("run_id IS NOT NULL AND ts IS NOT NULL")
    timed = timed.withWatermark("ts", late).withColumn("ms", F.unix_millis("ts"))
    return timed.groupBy("run_id").transformWithStateInPandas(RunStatus(stale_minutes), OUT, "Append", "EventTime")


def start(stream: DataFrame, out: str, checkpoint: str):
    """Writes `live_status` to Parquet below `out` with all that is there now; a restart goes on from `checkpoint`."""
    spark = stream.sparkSession
    kept = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)  # timers need it; a query keeps what it starts with
    try:
        return stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", kept)


def told(spark: SparkSession, out: str) -> DataFrame:
    """What was written below `out`."""
    return spark.read.schema(OUT).parquet(out).where("status <> 'late'")


def dropped_late(query, out: str) -> int:
    """Rows that came after the watermark had passed them: in the batches of `query`, or written below `out`."""
    by_spark = sum(int(op["numRowsDroppedByWatermark"]) for p in query.recentProgress for op in p["stateOperators"])
    return by_spark + SparkSession.active().read.schema(OUT).parquet(out).where("status = 'late'").count()


def transitions(rows: DataFrame, late: str = "1 hour", stale_minutes: float = STALE_MINUTES) -> DataFrame:
    """The same over a whole table, as far as a watermark at its end would tell."""
    stale = F.expr(f"INTERVAL '{int(stale_minutes * 60)}' SECOND")
    timed = rows.select("run_id", F.date_trunc("millisecond", F.col("ts").cast("timestamp")).alias("ts")).where("run_id IS NOT NULL AND ts IS NOT NULL")
    end = F.broadcast(timed.agg((F.max("ts") - F.expr(f"INTERVAL {late}")).alias("end")))
    w = Window.partitionBy("run_id").orderBy("ts")
    timed = timed.crossJoin(end).where("ts <= end").withColumns({"before": F.lag("ts").over(w), "after": F.lead("ts").over(w), "n": F.row_number().over(w)})
    began = timed.where(F.col("before").isNull() | (F.col("ts") > F.col("before") + stale)).select("run_id", F.lit("running").alias("status"), F.col("ts").alias("at"), F.col("n").cast("long").alias("n_rows"))
    ended = timed.where((F.col("after").isNull() | (F.col("after") > F.col("ts") + stale)) & (F.col("ts") + stale <= F.col("end")))
    return began.unionByName(ended.select("run_id", F.lit("stalled").alias("status"), (F.col("ts") + stale).alias("at"), F.col("n").cast("long").alias("n_rows")))
