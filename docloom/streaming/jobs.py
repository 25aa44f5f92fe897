"""Job progress as a stream of changes, and as batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

TERMINAL = ("completed", "failed")
FEED = "job_id string, status string, stage string, progress int, ts timestamp"


def changes(rows: DataFrame, order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """Rows whose (status, stage, progress) differs from the job's row before."""
    w = Window.partitionBy("job_id").orderBy(*order)
    now = F.struct("status", "stage", "progress")
    return rows.withColumn("__last", F.lag(now).over(w)).where(F.col("__last").isNull() | ~now.eqNullSafe(F.col("__last"))).drop("__last")


def timed_out(rows: DataFrame, now: str, seconds: int = 600) -> DataFrame:
    """Jobs whose first row is more than so many seconds ago and that have not ended."""
    per_job = rows.groupBy("job_id").agg(F.min("ts").alias("started"), F.bool_or(F.col("status").isin(*TERMINAL)).alias("ended"))
    return per_job.where(~F.col("ended") & (F.col("started") < F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {seconds} SECONDS"))).select("job_id", "started")


def progress_feed(stream: DataFrame, timeout_seconds: int = 600) -> DataFrame:
    """A stream of job rows (FEED) as a stream of changes; a job that has not ended so many seconds after its first
    row gets a failed row, however often it moved since. Rows that come after an end, or in a later batch but with a
    time before the last one told, tell nothing."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        columns = ["job_id", "status", "stage", "progress", "ts"]
        if state.hasTimedOut:
            status, stage, progress, at, until = state.get
            if status in TERMINAL:
                state.remove()
                return
            # Ended: a row that comes later tells nothing. The state goes after another span.
            state.update(("failed", "failed", progress, at, until))
            state.setTimeoutDuration(timeout_seconds * 1000)
            yield pd.DataFrame([[key[0], "failed", "failed", int(progress), pd.Timestamp(at, unit="us")]], columns=columns)
            return
        now = state.getCurrentProcessingTimeMs()
        status, stage, progress, at, until = state.get if state.exists else (None, None, None, None, now + timeout_seconds * 1000)
        rows = pd.concat(list(batches)).sort_values("ts", kind="stable")
        micros = rows["ts"].to_numpy("datetime64[us]").astype("int64")
        rows = rows[(micros >= at) if at is not None else slice(None)]
        ended = rows["status"].isin(TERMINAL).to_numpy()
        if status in TERMINAL:
            rows = rows.iloc[:0]
        elif ended.any():
            rows = rows.iloc[: ended.argmax() + 1]
        told = rows[["status", "stage", "progress"]]
        last = told.shift(1)
        if status is not None and len(last):
            last.iloc[0] = (status, stage, progress)
        fresh = rows[(told.astype(object) != last.astype(object)).any(axis=1).to_numpy()]
        if len(rows):
            end = rows.iloc[-1]
            status, stage, progress, at = end["status"], end["stage"], int(end["progress"]), int(end["ts"].value // 1000)
        if status is not None:
            state.update((status, stage, progress, at, until))
            state.setTimeoutDuration(max(until - now, 1))
        if len(fresh):
            yield fresh[columns]

    return stream.groupBy("job_id").applyInPandasWithState(run, FEED, "status string, stage string, progress int, ts bigint, until bigint", "append", GroupStateTimeout.ProcessingTimeTimeout)


#: Steps of an ingestion and the progress that is told when each begins.
STAGES = (("queued", 5), ("parsing", 15), ("extracting", 40), ("indexing", 70), ("completed", 100))
#: Attempts at a document, and seconds before the next one: twice as long each time, from the first to the last bound.
ATTEMPTS, BACKOFF = 3, (15, 300)


def stage_rows(docs: DataFrame, stage: str, now) -> DataFrame:
    """FEED rows of documents (job_id, error) that enter a stage; those with an error failed."""
    progress = dict(STAGES)[stage]
    status = "completed" if stage == "completed" else "queued" if stage == "queued" else "processing"
    bad = F.col("error").isNotNull()
    return docs.select(F.col("job_id").cast("string"), F.when(bad, "failed").otherwise(status).alias("status"), F.when(bad, "failed").otherwise(stage).alias("stage"), F.lit(progress).alias("progress"), F.lit(now).cast("timestamp").alias("ts"))


def retries(jobs: DataFrame) -> DataFrame:
    """jobs (attempt, from 1, status) with again, whether a failed one is tried once more, and wait, the seconds until then."""
    wait = F.least(F.lit(BACKOFF[1]), F.lit(BACKOFF[0]) * F.pow(F.lit(2), F.col("attempt") - 1)).cast("int")
    again = (F.col("status") == "failed") & (F.col("attempt") <= ATTEMPTS)
    return jobs.withColumns({"again": again, "wait": F.when(again, wait)})


def ingest_stream(stream: DataFrame, ingest, checkpoint: str):
    """Runs ingest(batch, id) on each batch of new documents; ingest overwrites by document, so a batch can run again."""
    return stream.writeStream.foreachBatch(ingest).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events by type and tumbling window; on a stream, rows later than the watermark are dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("events")).select(F.col("window.start").alias("window_start"), "event_type", "events")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("events")).select("user_id", F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "events")
