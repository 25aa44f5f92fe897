"""The event-time feed: its stream, cut anywhere, against its batch twin."""

import random
from datetime import datetime, timedelta

import pytest

from docloom.store import new_folder
from docloom.streaming import feed
from docloom.streaming.jobs import FEED

T0 = datetime(2024, 1, 1)


def told(df):
    return sorted((r.job_id, r.ts, str(r.progress), r.status, r.stage) for r in df.collect())


def walk(rows, timeout):
    """The rule itself, row by row."""
    out, jobs = [], {}
    for r in rows:
        if r[0] is not None:
            jobs.setdefault(r[0], []).append(r)
    low = lambda x: (x is not None, x)
    for job, own in jobs.items():
        own = sorted(own, key=lambda r: (r[4], low(r[3]), low(r[1]), low(r[2])))
        deadline, last, ended = own[0][4] + timedelta(seconds=timeout), None, False
        for _, status, stage, progress, ts in own:
            if ended or ts > deadline:
                break
            if last != (status, stage, progress):
                out.append((job, ts, str(progress), status, stage))
            last, ended = (status, stage, progress), status in ("completed", "failed")
        if not ended:
            out.append((job, deadline, str(last[2]), "failed", "failed"))
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_any_cut_gives_the_rows_of_the_batch(spark, seed):
    """Rows out of order across batches, repeated rows, ties, null progress, jobs that end, time out, and move after their end."""
    rng = random.Random(seed)
    rows = []
    for job in "abcdefgh":
        at = rng.randint(0, 1500)
        for _ in range(rng.randint(1, 14)):
            status = rng.choice(["queued", "processing", "processing", "processing", "completed" if rng.random() < 0.3 else "processing"])
            rows.append((job, status, rng.choice(["parsing", "extracting"]), rng.choice([None, 5, 5, 40]), T0 + timedelta(seconds=at)))
            if rng.random() < 0.2:
                rows.append(rows[-1])
            at += rng.choice([0, 1, 30, 200])
    want = walk(rows, 900)
    df = spark.createDataFrame(rows, FEED)
    assert told(feed.feed_rows(df, 900)) == want
    come = sorted(rows, key=lambda r: r[4] + timedelta(seconds=rng.randint(0, 599)))  # ten minutes late at most
    cuts = sorted(rng.sample(range(len(come)), 2))
    parts = [spark.createDataFrame(p, FEED) for p in (come[: cuts[0]], come[cuts[0] : cuts[1]], come[cuts[1] :]) if p]
    got = feed.run_feed(spark, parts, new_folder(spark, "feed"), 900, "10 minutes", "2024-01-02 00:00:00")
    assert told(got) == want and any(x[3] == "failed" for x in want) and any(x[3] == "completed" for x in want)


def test_initial_state(spark):
    """A stream that follows on a batch: what was told is not told again, time runs from the first row, ended jobs stay ended."""
    ts = lambda s: T0 + timedelta(seconds=s)
    known = spark.createDataFrame([("a", "processing", "parsing", 5, ts(0)), ("b", "completed", "completed", 100, ts(0)), ("c", "queued", "queued", None, ts(50))], "job_id string, status string, stage string, progress int, first timestamp")
    rows = [("a", "processing", "parsing", 5, ts(100)), ("a", "processing", "extracting", 40, ts(200)), ("b", "queued", "queued", 0, ts(100)), ("d", "queued", "queued", 0, ts(300))]
    got = feed.run_feed(spark, [spark.createDataFrame(rows, FEED)], new_folder(spark, "feed"), 600, "1 minute", "2024-01-02 00:00:00", known)
    assert told(got) == sorted([("a", ts(200), "40", "processing", "extracting"), ("a", ts(600), "40", "failed", "failed"), ("c", ts(650), "None", "failed", "failed"), ("d", ts(300), "0", "queued", "queued"), ("d", ts(900), "0", "failed", "failed")])


def test_known_until(spark):
    rows = [("a", "queued", "queued", 0, T0), ("b", "queued", "queued", 0, T0 + timedelta(seconds=500))]
    got = feed.feed_rows(spark.createDataFrame(rows, FEED), 600, "2024-01-01 00:15:00")
    assert [(r.job_id, r.ts) for r in got.where("status = 'failed'").collect()] == [("a", T0 + timedelta(seconds=600))]
