"""Job progress in event time: a stream with keyed state whose rows do not depend on how its input was cut.

Rows of a job may come in any order within ``delay``. They wait in the job's state until the watermark has passed them, so that
nothing earlier can come, and are then told in order of their time: each whose (status, stage, progress) differs from
the one told before. A job that has not ended ``timeout`` after its first row fails at that moment; after an
end nothing is told. State and timers live in RocksDB: a value with what was told last, a list of rows that wait,
and one timer a job, at the next moment at which something is due.

``feed_rows`` gives the same rows of a whole table, for tests and for filling in what a stream has missed; its
last rows can be a stream's initial state.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from docloom.streaming.jobs import FEED, TERMINAL

_ORDER = ("ts", "progress", "status", "stage")
_STATE = "status string, stage string, progress int, first bigint, ended boolean, timer bigint"
ROCKS = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true"}


def feed_rows(rows: DataFrame, timeout: int, until: str | None = None) -> DataFrame:
    """The feed of all rows (FEED) with a time; until, if given, is the moment up to which they are known: jobs that have not ended time out
    by then. Without it every job that does not end times out."""
    rows = rows.where("job_id is not null and ts is not null").select("job_id", "status", "stage", "progress", "ts")
    w = Window.partitionBy("job_id").orderBy(*_ORDER)
    end = F.col("status").isin(*TERMINAL)
    first = F.min("ts").over(Window.partitionBy("job_id"))
    placed = rows.withColumn("deadline", first + F.expr(f"INTERVAL {timeout} SECONDS")).where(F.col("ts") <= F.col("deadline"))
    placed = placed.withColumn("over", F.coalesce(F.bool_or(F.coalesce(end, F.lit(False))).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))).where("not over")
    now = F.struct("status", "stage", "progress")
    told = placed.withColumn("last", F.lag(now).over(w)).where(F.col("last").isNull() | ~now.eqNullSafe(F.col("last")))
    late = placed.groupBy("job_id").agg(F.bool_or(F.coalesce(end, F.lit(False))).alias("ended"), F.max("deadline").alias("ts"), F.max_by("progress", F.struct(*_ORDER)).alias("progress")).where("not ended")
    if until is not None:
        late = late.where(F.col("ts") <= F.lit(until).cast("timestamp"))
    failed = late.select("job_id", F.lit("failed").alias("status"), F.lit("failed").alias("stage"), "progress", "ts")
    return told.select("job_id", "status", "stage", "progress", "ts").unionByName(failed)


class Feed(StatefulProcessor):
    """Of a job: what was told last, the rows that wait, one timer."""

    def __init__(self, timeout: int):
        self.timeout = timeout * 1_000_000

    def init(self, handle) -> None:
        self.handle = handle
        self.told = handle.getValueState("told", _STATE)
        self.waiting = handle.getListState("waiting", "status string, stage string, progress int, ts bigint")

    def close(self) -> None:
        pass

    def handleInitialState(self, key, initialState, timerValues) -> None:
        row = initialState.iloc[0]
        first = int(pd.Timestamp(row["first"]).value // 1000)
        ended = row["status"] in TERMINAL
        self._keep((row["status"], row["stage"], None if pd.isna(row["progress"]) else int(row["progress"]), first, ended, None), [], None)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        state = self.told.get()
        if state is not None and state[4]:
            return  # ended: nothing is told any more
        new = [(r.status, r.stage, None if pd.isna(r.progress) else int(r.progress), int(pd.Timestamp(r.ts).value // 1000)) for part in rows for r in part.itertuples(index=False)]
        waiting = [*self._waiting(), *new]
        first = min([x[3] for x in waiting] + ([state[3]] if state else []))
        self._keep((*state[:3], first, False, state[5]) if state else (None, None, None, first, False, None), waiting, state[5] if state else None)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state, known = self.told.get(), timerValues.getCurrentWatermarkInMs() * 1000
        status, stage, progress, first, ended, _ = state
        deadline, out, left = first + self.timeout, [], []
        empty = lambda x: (x is not None, x)
        for row in sorted(self._waiting(), key=lambda x: (x[3], empty(x[2]), empty(x[0]), empty(x[1]))):
            if row[3] > known or ended:
                left.append(row)
            elif row[3] <= deadline:
                if status is None and stage is None and progress is None or row[:3] != (status, stage, progress):
                    out.append((*row[:3], row[3]))
                status, stage, progress = row[:3]
                ended = status in TERMINAL
        if not ended and deadline <= known:
            out.append(("failed", "failed", progress, deadline))
            status, stage, ended = "failed", "failed", True
        self._keep((status, stage, progress, first, ended, None), [] if ended else left, None)
        if out:
            yield pd.DataFrame({"job_id": key[0], "status": [x[0] for x in out], "stage": [x[1] for x in out], "progress": pd.array([x[2] for x in out], "Int32"), "ts": pd.to_datetime([x[3] for x in out], unit="us", utc=True)})

    def _waiting(self) -> list[tuple]:
        return [tuple(x) for x in self.waiting.get()]

    def _keep(self, state: tuple, waiting: list[tuple], timer: int | None) -> None:
        """Stores the state, and sets the timer to the next moment at which a row or the end of the time is due."""
        due = None if state[4] else -(-min([state[3] + self.timeout, *(x[3] for x in waiting)]) // 1000)
        if due != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if due is not None:
                self.handle.registerTimer(due)
        self.told.update((*state[:5], due))
        if waiting:
            self.waiting.put(waiting)
        else:
            self.waiting.clear()


def event_feed(stream: DataFrame, timeout: int = 600, delay: str = "10 minutes", known: DataFrame | None = None) -> DataFrame:
    """The feed of a stream of rows (FEED), as ``feed_rows`` gives it of all of them, whatever batches they come in.

    Rows later than delay are dropped; those without a job only move the watermark. known (job_id, status, stage, progress, first) is
    what was told last of jobs before the stream began, and the time of their first row. The session must use the RocksDB state store: ``ROCKS``.
    """
    rows = stream.select("job_id", "status", "stage", "progress", "ts").where("ts is not null").withWatermark("ts", delay)
    rows = rows.where(F.when(F.col("ts").isNotNull(), F.col("job_id")).isNotNull())  # names ts, or Spark would filter before it takes the time
    start = None if known is None else known.groupBy("job_id")
    return rows.groupBy("job_id").transformWithStateInPandas(Feed(timeout), FEED, "append", "eventTime", start)


def run_feed(spark: SparkSession, batches: list[DataFrame], folder: str, timeout: int, delay: str, last: str, known: DataFrame | None = None) -> DataFrame:
    """The feed of batches that come one after the other, each to a query started anew on one checkpoint below folder;
    at the end a row without a job moves the time to ``last``."""
    before = {k: spark.conf.get(k, None) for k in ROCKS}
    for k, v in ROCKS.items():
        spark.conf.set(k, v)
    try:
        end = spark.sql(f"SELECT CAST(NULL AS STRING) AS job_id, CAST(NULL AS STRING) AS status, CAST(NULL AS STRING) AS stage, CAST(NULL AS INT) AS progress, TIMESTAMP '{last}' AS ts")
        for rows in [*batches, end]:
            rows.select(F.col("job_id").cast("string"), "status", "stage", F.col("progress").cast("int").alias("progress"), F.col("ts").cast("timestamp").alias("ts")).write.mode("append").parquet(f"{folder}/in")
            stream = spark.readStream.schema(FEED).parquet(f"{folder}/in")
            query = event_feed(stream, timeout, delay, known).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
            query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    return spark.read.schema(FEED).parquet(f"{folder}/out")
