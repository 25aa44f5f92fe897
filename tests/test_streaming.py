import time
from datetime import datetime

from docloom.streaming import jobs


def test_feed_emits_changes_and_closes(spark, tmp_path):
    ts = lambda s: datetime(2024, 1, 1, 0, 0, s)
    rows = [("a", "queued", "parsing", 0, ts(0)), ("a", "queued", "parsing", 0, ts(1)), ("a", "processing", "parsing", 5, ts(2)), ("a", "completed", "completed", 100, ts(3)), ("a", "queued", "parsing", 0, ts(4)), ("b", "queued", "parsing", 0, ts(1))]
    spark.createDataFrame(rows, jobs.FEED).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(jobs.FEED).parquet(str(tmp_path / "in"))
    q = jobs.progress_feed(stream).writeStream.format("memory").queryName("feed").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    until = time.monotonic() + 90  # a query with timeouts never runs out of batches
    while spark.table("feed").count() < 4 and time.monotonic() < until:
        time.sleep(0.5)
    q.stop()
    got = sorted((r.job_id, r.status, r.progress) for r in spark.table("feed").collect())
    assert got == [("a", "completed", 100), ("a", "processing", 5), ("a", "queued", 0), ("b", "queued", 0)]


def test_ingest_runs_on_each_batch(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "in"))
    seen = []
    stream = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
    jobs.ingest_stream(stream, lambda batch, n: seen.append(batch.count()), str(tmp_path / "cp")).awaitTermination(120)
    assert sum(seen) == 5


def test_a_job_that_keeps_moving_times_out(spark, tmp_path):
    """The time runs from a job's first row, not from its last."""
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(jobs.FEED).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = jobs.progress_feed(stream, 4).writeStream.format("memory").queryName("moving").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    began, i = time.monotonic(), 0
    while time.monotonic() - began < 60:
        rows = [("a", "processing", "parsing", i, datetime(2024, 1, 1, 0, i // 60, i % 60))]
        spark.createDataFrame(rows, jobs.FEED).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        i += 1
        time.sleep(0.5)
        if spark.table("moving").where("status = 'failed'").count():
            break
    q.stop()
    rows = spark.table("moving").orderBy("ts", "progress").collect()
    assert [r.status for r in rows].count("failed") == 1 and i > 3


def test_rows_of_stages_and_retries(spark):
    docs = spark.createDataFrame([(1, None), (2, "bad")], "job_id long, error string")
    got = [(r.job_id, r.status, r.stage, r.progress) for r in jobs.stage_rows(docs, "extracting", "2024-01-01 00:00:00").orderBy("job_id").collect()]
    assert got == [("1", "processing", "extracting", 40), ("2", "failed", "failed", 40)]
    tries = spark.createDataFrame([(1, "failed"), (3, "failed"), (4, "failed"), (1, "completed")], "attempt int, status string")
    assert [(r.again, r.wait) for r in jobs.retries(tries).collect()] == [(True, 15), (True, 60), (False, None), (False, None)]
