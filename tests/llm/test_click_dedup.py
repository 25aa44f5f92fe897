"""Expiring deduplication against a walk over sorted copies."""

import hashlib
import math
import zlib
from collections import defaultdict
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest

from docloom.llm import click_dedup
from docloom.llm.queries import op13_click_dedup

EPOCH = datetime(1970, 1, 1)


def windows_of(rows, held, within=72):
    """(closed, open) of sorted (key, hour, hash, n) by the rule itself; held: key -> [start, hash, repeats, conflicts, crc]."""
    closed, held = [], {k: list(v) for k, v in held.items()}
    for key, hour, digest, n in sorted(rows):
        w = held.get(key)
        if w is None or hour > w[0] + within:
            if w is not None:
                closed.append((key, *w))
            w = held[key] = [hour, digest, 0, 0, 0]
            n -= 1
        w[2] += n
        if digest != w[1]:
            w[3] += n
            w[4] += n * zlib.crc32(digest)
    return sorted(closed), held


def copies_of(clicks):
    micro = lambda x: None if x is None else (x - EPOCH) // timedelta(microseconds=1)
    text = lambda x: "" if x is None else str(x)
    for r in clicks:
        if r["click_id"] is None or r["arrived_at"] is None:
            continue
        for j in range(r["click_id"] % 3 + 1):
            c = zlib.crc32(f"{r['click_id']}:{j}".encode())
            hour = micro(r["arrived_at"]) // 3_600_000_000 + 6 * j * (c % 10)
            value = None if r["value"] is None else math.floor(100 * r["value"] + 0.5)
            line = "|".join(map(text, (r["client_id"], r["kind"], value, micro(r["ts"]), r["props"], c % 3)))
            yield hour + c // 10 % 200, r["click_id"], hour, hashlib.sha256(line.encode()).hexdigest().encode()


def expected(clicks, n_batches=12):
    copies = list(copies_of(clicks))
    low, high = min(x[0] for x in copies), max(x[0] for x in copies)
    batches = defaultdict(list)
    for order, *row in copies:
        batches[(order - low) * n_batches // (high - low + 1)].append((*row, 1))
    latest, held, out = None, {}, []
    for b in range(n_batches):
        closed, held = windows_of([r for r in batches[b] if latest is None or r[1] >= latest - 48], held)
        latest = max([x[1] for x in batches[b]] + [latest] * (latest is not None), default=None)
        over = [k for k, w in held.items() if b == n_batches - 1 or w[0] + 72 < latest - 48]
        out += [(k, w[0], b, *w[2:], w[1].decode()) for k, *w in [*closed, *((k, *held.pop(k)) for k in over)]]
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.select("click_id", "start_hour", "closed_batch", "n_repeats", "n_conflicts", "conflict_crc", "hash").collect())


def test_query(spark, sf001):
    got = rows_of(op13_click_dedup(spark, sf001))
    want = expected([r.asDict() for r in spark.read.parquet(f"{sf001}/clicks.parquet").collect()])
    assert got == want
    assert sum(x[3] for x in got) > 100 and sum(x[4] for x in got) > 50 and len({x[2] for x in got}) == 12


ROW = "click_id bigint, ts timestamp_ntz, arrived_at timestamp_ntz, client_id bigint, kind string, value double, props string, Key string, part int"


@pytest.mark.parametrize("groups", [3, None])
def test_odd_rows(spark, tmp_path, groups):
    """Nulls, repeats, a hot key, ties, clashing names, times before 1970; state by group or by key."""
    t = datetime(1969, 12, 20, 5, 30, 0, 7)
    rows = [(None, t, t, 1, "a", 1.0, "{}", "x", 0), (7, t, None, 1, "a", 1.0, "{}", "x", 0), (8, None, t, None, None, None, None, None, None)]
    rows += [(5, t, t + timedelta(hours=i % 400), 1, "a|b", float(i % 2), "é" * (i % 3), "x", 0) for i in range(300)] + [(5, t, t, 1, "a", 1.0, "{}", "x", 0)] * 3
    rows += [(k, t, t + timedelta(hours=31 * k), k, "z", -0.005, None, "x", 0) for k in range(20)]
    df = spark.createDataFrame(rows, ROW)
    got = click_dedup.deduplicate_clicks(df, n_batches=3, groups=groups)
    got = got.selectExpr("key AS click_id", "start_hour", "closed_batch", "n_repeats", "n_conflicts", "conflict_crc", "lower(hex(hash)) AS hash")
    assert rows_of(got) == expected([r.asDict() for r in df.collect()], 3)


def test_empty_table(spark):
    assert click_dedup.deduplicate_clicks(spark.createDataFrame([], ROW)).count() == 0


def test_last_batches_without_rows(spark):
    """Copies of one hour fill the first batch alone; what stays open closes after the last one."""
    t = datetime(2024, 1, 1, 5)
    df = spark.createDataFrame([(3, t, t, 1, "a", 1.0, "{}", "x", 0)], ROW)
    got = click_dedup.deduplicate_clicks(df).selectExpr("key AS click_id", "start_hour", "closed_batch", "n_repeats", "n_conflicts", "conflict_crc", "lower(hex(hash)) AS hash")
    assert rows_of(got) == expected([r.asDict() for r in df.collect()]) and got.first()["closed_batch"] == 11


def test_no_start_after_the_last_batch(spark, monkeypatch):
    """A start opens the stores of all partitions, and each keeps native memory: there is one for each batch with rows."""
    t, starts, made = datetime(2024, 1, 1), [], click_dedup.deduplicate
    monkeypatch.setattr(click_dedup, "deduplicate", lambda *a: starts.append(a[1]) or made(*a))
    df = spark.createDataFrame([(3 * k, t, t + timedelta(hours=100 * k), k, "z", 1.0, None, "x", 0) for k in range(30)], ROW)
    assert click_dedup.deduplicate_clicks(df, n_batches=3).count() == 30 and starts == [0, 1, 2]


def test_stores_without_native_memory(spark, tmp_path, monkeypatch):
    """RocksDB keeps native memory for each store of each start, whatever the session prefers; a store of one map has none."""
    t, name = datetime(2024, 1, 1), "spark.sql.streaming.stateStore.providerClass"
    monkeypatch.setattr(click_dedup, "shared_folder", lambda _: f"file://{tmp_path}")
    monkeypatch.setattr(click_dedup.common, "remove", lambda *_: None)
    df = spark.createDataFrame([(3 * k, t, t + timedelta(hours=100 * k), k, "z", 1.0, None, "x", 0) for k in range(30)], ROW)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        assert click_dedup.deduplicate_clicks(df, n_batches=3).count() == 30 and spark.conf.get(name).endswith("RocksDBStateStoreProvider")
    finally:
        spark.conf.unset(name)
    kinds = {p.suffix for p in tmp_path.glob("docloom-clicks-*/checkpoint/state/0/*/*") if not p.name.startswith((".", "_"))}
    assert ".delta" in kinds and not kinds & {".zip", ".changelog"}


def test_fold_against_the_rule():
    rng = np.random.default_rng(3)
    for _ in range(60):
        digests = [hashlib.sha256(bytes([i])).digest() for i in range(4)]
        rows = {(int(rng.integers(-3, 6)), int(rng.integers(-200, 300)), digests[rng.integers(4)]): int(rng.integers(1, 4)) for _ in range(int(rng.integers(0, 80)))}
        held = {int(k): [int(rng.integers(-300, 0)), digests[rng.integers(4)], 2, 1, 5] for k in rng.choice(9, 4, replace=False)}
        events = np.array([(k, h, zlib.crc32(d), n, d) for (k, h, d), n in rows.items()], click_dedup.EVENT)
        start = np.array([(k, *[w[i] for i in (0, 2, 3, 4, 1)]) for k, w in held.items()], click_dedup.WINDOW)
        closed, left = click_dedup.fold(start, events, 72)
        plain = lambda x: sorted((int(w["key"]), int(w["start"]), w["hash"].tobytes().ljust(32, b"\0"), int(w["n_repeats"]), int(w["n_conflicts"]), int(w["crc"])) for w in x)
        want_closed, want_left = windows_of([(*k, n) for k, n in rows.items()], held)
        assert plain(closed) == want_closed and plain(left) == sorted((k, *w) for k, w in want_left.items())


def test_merged_keeps_counts():
    events = np.array([(1, 2, 3, 1, b"a"), (1, 2, 3, 4, b"a"), (1, 2, 3, 1, b"b"), (1, 3, 3, 1, b"b")], click_dedup.EVENT)
    assert pd.Series(click_dedup.merged(events)["n"]).tolist() == [5, 1, 1]
