"""Expiring deduplication of keyed events by a stateful stream.

Events of a key within ``within`` hours of the one that opened a window repeat it; a later
one closes the window and opens the next. ``deduplicate`` declares the streaming query:
``applyInPandasWithState``, whose state holds the open windows (opener's hour and digest,
counters, sum of checksums), and whose event-time timeouts close the windows that no event on
time can reach any more. ``run_batches`` writes events in numbered batches to the
shared folder and feeds them in order, each to a new start of the query on one checkpoint;
beside the last one's events a sentinel, a row without a key far in the future, moves the
watermark past all windows, which a micro-batch without data then closes.

The fold is by key; state is kept by group of keys: ``groups`` keys' hashes share one state value
and one timeout, so that a call folds all of them at once by array operations. With
``groups=None`` each key has a state of its own and the rows are the same. Before the exchange, each
task sorts what it has read, merges events that are equal in key, hour and digest into one
with a count, and packs a group's events into one row. So a task receives of a hot key its
distinct hours and digests of one batch, once from each task that read them, and nothing else.

Times are moved by SHIFT hours, as Spark's first watermark is 1970, and the watermark lies one
millisecond below ``delay`` hours before the latest event: an event at just that hour is on time.
A group times out once the watermark is past what is set: one millisecond before the last hour of
its earliest window, for at that hour, to the millisecond, the watermark has passed the window.

Defined results: events without an hour are left out; those without a key only move the
watermark; a null digest is the digest of zeros; repeated rows are events each; ties of key
and hour are taken in the order of digests; a batch without events leaves everything as it
is; no events give no windows; other columns are not read, whatever their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from docloom.llm import common
from docloom.store import shared_folder

HOUR_MS, SHIFT = 3_600_000, 1 << 20
#: Batches whose files a task writes side by side; rows of further ones are sorted first.
WRITERS = 32
#: Events that a task packs at once; events of a batch that share a state on average.
PACKED, EVENTS_A_GROUP = 1 << 18, 2048

EVENT = np.dtype([("key", "<i8"), ("hour", "<i4"), ("crc", "<u4"), ("n", "<i8"), ("hash", "S32")])
WINDOW = np.dtype([("key", "<i8"), ("start", "<i8"), ("n_repeats", "<i8"), ("n_conflicts", "<i8"), ("crc", "<i8"), ("hash", "S32")])
OUTPUT = "key bigint, start_hour bigint, closed_batch bigint, n_repeats bigint, n_conflicts bigint, conflict_crc bigint, hash binary"

_STATE = "spark.sql.streaming.stateStore"
#: Stores are many and small, and one key-value map is all they hold: they lie in the heap, and a task drops its own once it is committed. RocksDB keeps native memory for each store that was ever opened.
STORES = {f"{_STATE}.providerClass": "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider", f"{_STATE}.unloadOnCommit": "true"}

#: Whether the state is gone over once more after each start; it is at the next one anyway.
NO_DATA = "spark.sql.streaming.noDataMicroBatches.enabled"


def fold(held: np.ndarray, events: np.ndarray, within: int) -> tuple[np.ndarray, np.ndarray]:
    """(windows that later events closed, windows open after the events); held: open windows, one a key."""
    if not len(events):
        return np.zeros(0, WINDOW), held
    held, events = held[np.argsort(held["key"], kind="stable")], events[np.lexsort((events["hash"], events["hour"], events["key"]))]
    key, hour = events["key"], events["hour"].astype(np.int64)
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    end = np.r_[first[1:], len(events)]
    low, span = hour.min(), hour.max() - hour.min() + 1
    place = np.repeat(np.arange(len(first)), end - first) * span + hour - low

    def past(group: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The first event of each group after its last hour."""
        return np.searchsorted(place, group * span + np.clip(last - low, -1, span - 1), side="right")

    slot = np.searchsorted(held["key"], key[first])
    known = slot < len(held)
    known[known] = held["key"][slot[known]] == key[first][known]
    current, at = np.where(known, slot, -1), first.copy()
    group = np.flatnonzero(known)
    at[group] = past(group, held["start"][slot[group]] + within)
    begins, owners, opened, closed, count = [first[group]], [slot[group]], [], [], len(held)
    while len(group := np.flatnonzero(at < end)):
        ids, opener = count + np.arange(len(group)), at[group]
        closed.append(current[group][current[group] >= 0])
        begins.append(opener)
        owners.append(ids)
        opened.append(opener)
        current[group], at[group], count = ids, past(group, hour[opener] + within), count + len(group)
    opened = np.concatenate([np.zeros(0, np.int64), *opened])
    new = np.zeros(len(opened), WINDOW)
    new["key"], new["start"], new["hash"] = key[opened], hour[opened], events["hash"][opened]
    windows = np.concatenate([held, new])
    begin, owner = np.concatenate(begins), np.concatenate(owners)
    order = np.argsort(begin, kind="stable")  # a held window that no event repeats begins where the next one does, and comes first
    begin, owner = begin[order], owner[order]
    owner = np.repeat(owner, np.diff(np.r_[begin, len(events)]))
    n = events["n"].copy()
    n[opened] -= 1
    unlike = np.where(events["hash"] != windows["hash"][owner], n, 0)
    for name, more in (("n_repeats", n), ("n_conflicts", unlike), ("crc", unlike * events["crc"].astype(np.int64))):
        np.add.at(windows[name], owner, more)
    gone = np.zeros(len(windows), bool)
    gone[np.concatenate([np.zeros(0, np.int64), *closed])] = True
    return windows[gone], windows[~gone]


def merged(events: np.ndarray) -> np.ndarray:
    """Neighbours that are equal in key, hour and digest as one, with their counts added."""
    if len(events) < 2:
        return events
    new = np.r_[True, (events["key"][1:] != events["key"][:-1]) | (events["hour"][1:] != events["hour"][:-1]) | (events["hash"][1:] != events["hash"][:-1])]
    out = events[new]
    out["n"] = np.add.reduceat(events["n"], np.flatnonzero(new))
    return out


class Windows:
    """Open windows of a group of keys; closed ones are the output.

    The watermark of a batch is that of the batches before it: windows that it has passed closed after ``before``,
    the last of those; the batch's own events close others. Once it is past ``last_hour``, if given, all events
    are in, and what is left closes after the batch itself.
    """

    def __init__(self, batch: int, before: int, within: int, last_hour: int | None = None):
        self.batch, self.before, self.within, self.last_hour = batch, before, within, last_hour

    def step(self, key, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = np.frombuffer(state.get[0], WINDOW) if state.exists else np.zeros(0, WINDOW)
        now = state.getCurrentWatermarkMs()
        over = (held["start"] + self.within + SHIFT) * HOUR_MS <= now
        if state.hasTimedOut:
            self._hold(state, held[~over])
            ended = self.last_hour is not None and now > (self.last_hour + SHIFT) * HOUR_MS
            yield from self._out(held[over], self.batch if ended else self.before)
            return
        packed = [np.frombuffer(x, EVENT) for part in rows for x in part["events"]]
        events = np.concatenate(packed) if packed else np.zeros(0, EVENT)
        on_time = (events["hour"].astype(np.int64) + SHIFT) * HOUR_MS > now
        closed, left = fold(held[~over], events[on_time], self.within)
        self._hold(state, left)
        yield from self._out(held[over], self.before)
        yield from self._out(closed, self.batch)

    def _hold(self, state: GroupState, windows: np.ndarray) -> None:
        if len(windows):
            state.update((windows.tobytes(),))
            state.setTimeoutTimestamp(int(windows["start"].min() + self.within + SHIFT) * HOUR_MS - 1)
        elif state.exists:
            state.remove()

    def _out(self, windows: np.ndarray, batch: int) -> Iterator[pd.DataFrame]:
        if len(windows):
            raw = np.ascontiguousarray(windows["hash"]).tobytes()
            yield pd.DataFrame({"key": windows["key"], "start_hour": windows["start"], "closed_batch": np.int64(batch), "n_repeats": windows["n_repeats"], "n_conflicts": windows["n_conflicts"], "conflict_crc": windows["crc"], "hash": [raw[i : i + 32] for i in range(0, len(raw), 32)]})


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, key, hour, crc, hash) to a row for each part, with its events and their last hour."""
    held: list[pa.RecordBatch] = []

    def flush() -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        hours = table.column("hour").to_numpy()
        keyed = table.column("key").is_valid().to_numpy(zero_copy_only=False)
        events = np.zeros(table.num_rows, EVENT)
        for name in ("key", "crc"):
            events[name] = table.column(name).fill_null(0).to_numpy()
        events["hour"], events["n"] = hours, 1
        raw, at = common.utf8_buffer(table.column("hash").cast(pa.binary()))
        if len(raw) == 32 * table.num_rows:
            events["hash"] = np.frombuffer(raw.tobytes(), "S32")
        else:
            filled = np.flatnonzero(np.diff(at) == 32)
            events["hash"][filled] = np.frombuffer(raw.tobytes(), "S32")
        part = table.column("part").fill_null(0).to_numpy()
        order = np.lexsort((np.ascontiguousarray(events["hash"]).view(">u8")[::4], events["hour"], events["key"], part))
        order = order[keyed[order]]
        rows: list[tuple] = [(0, int(hours[~keyed].max()), b"")] if not keyed.all() else []
        events, part = events[order], part[order]
        starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else part
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(part)], strict=False):
            own = merged(events[a:b])
            rows.append((int(part[a]), int(own["hour"].max()), own.tobytes()))
        held.clear()
        parts, last, packed = zip(*rows, strict=True)
        moments = (np.array(last, np.int64) + SHIFT) * HOUR_MS * 1000
        return pa.RecordBatch.from_arrays([pa.array(parts, pa.int64()), pa.array(moments, pa.timestamp("us", "UTC")), pa.array(packed, pa.binary())], ["part", "last", "events"])

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(x.num_rows for x in held) >= PACKED:
            yield flush()
    if held:
        yield flush()
    common.trim_memory()


def deduplicate(events: DataFrame, batch: int, before: int, within: int = 72, delay: int = 48, groups: int | None = None, last_hour: int | None = None) -> DataFrame:
    """The windows that close, as a streaming query over a stream of (key bigint, hour int, crc bigint, hash binary).

    hash is a digest of 32 bytes, crc what is summed for each event unlike its window's opener. batch is the number of the
    events' batch, before that of the one before it, after which the windows closed that the watermark has passed.
    groups may not change on a checkpoint. last_hour is given with the last batch: no event is later.
    """
    part = F.col("key") if groups is None else F.pmod(F.xxhash64("key"), F.lit(groups))
    rows = events.where("hour is not null").select(part.alias("part"), "key", F.col("hour").cast("int").alias("hour"), F.coalesce("crc", F.lit(0)).cast("bigint").alias("crc"), F.coalesce("hash", F.lit(bytes(32))).alias("hash"))
    packed = rows.mapInArrow(_pack, "part bigint, last timestamp, events binary").withWatermark("last", f"{delay} hours 1 millisecond")
    return packed.groupBy("part").applyInPandasWithState(Windows(batch, before, within, last_hour).step, OUTPUT, "windows binary", "append", "EventTimeTimeout")


def _settings(spark: SparkSession, values: dict[str, str]) -> dict[str, str | None]:
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    return before


def run_batches(events: DataFrame, n_batches: int, last_hour: int, within: int = 72, delay: int = 48, groups: int | None = None) -> DataFrame:
    """Feeds (batch, key, hour, crc, hash) in order of batch and gives the windows of all; last_hour: no event is later."""
    spark = events.sparkSession
    root = f"{shared_folder(spark)}/docloom-clicks-{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    store = hadoop.Path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fields = "key bigint, hour int, crc bigint, hash binary"
    settings, last = _settings(spark, STORES | {NO_DATA: "false", "spark.sql.maxConcurrentOutputFileWriters": str(WRITERS)}), 0
    try:
        events.select("batch", F.col("key").cast("bigint").alias("key"), F.col("hour").cast("int").alias("hour"), F.col("crc").cast("bigint").alias("crc"), "hash").write.partitionBy("batch").parquet(f"{root}/cut")
        spark.createDataFrame([(n_batches - 1, None, last_hour + within + delay + 2, None, None)], f"batch int, {fields}").coalesce(1).write.partitionBy("batch").mode("append").parquet(f"{root}/cut")
        store.mkdirs(hadoop.Path(f"{root}/feed"))
        for batch in range(n_batches):
            cut = hadoop.Path(f"{root}/cut/batch={batch}")
            if not store.exists(cut):
                continue  # nothing came: no watermark moves, so nothing closes
            if not store.rename(cut, hadoop.Path(f"{root}/feed/{batch}")):
                raise OSError(f"batch {batch} of {root} can't be moved")
            ends = batch == n_batches - 1
            if ends:
                spark.conf.set(NO_DATA, "true")  # the sentinel's own time closes what is left
            stream = deduplicate(spark.readStream.schema(fields).parquet(f"{root}/feed/*"), batch, last, within, delay, groups, last_hour if ends else None)
            query = stream.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
            query.awaitTermination()
            common.remove(spark, f"{root}/feed/{batch}")
            last = batch
    finally:
        _settings(spark, settings)
    for done in ("cut", "feed", "checkpoint"):
        common.remove(spark, f"{root}/{done}")
    common._LEFT.append(root)
    return spark.read.schema(OUTPUT).parquet(f"{root}/out")


def micros(df: DataFrame, name: str) -> Column:
    """Microseconds since 1970 of a time without a zone, taken as UTC, whatever the session's zone; or of an instant."""
    if df.schema[name].dataType.typeName() == "timestamp":
        return F.unix_micros(name)
    day, second = F.unix_date(F.col(name).cast("date")).cast("bigint"), F.expr(f"extract(SECOND FROM `{name}`)")
    return ((day * 24 + F.hour(name)) * 60 + F.minute(name)) * 60_000_000 + (second * 1_000_000).cast("bigint")


def click_copies(clicks: DataFrame) -> DataFrame:
    """(key, hour, order, crc, hash): click_id % 3 + 1 copies of each row, moved in time; none of rows without click_id or arrival."""
    copies = clicks.where("click_id is not null and arrived_at is not null").select("*", F.explode(F.sequence(F.lit(0), F.pmod("click_id", F.lit(3)).cast("int"))).alias("j"))
    c = F.crc32(F.concat_ws(":", F.col("click_id").cast("string"), F.col("j").cast("string")).cast("binary"))
    copies = copies.withColumn("c", c).withColumn("hour", F.floor(micros(clicks, "arrived_at") / F.lit(3_600_000_000)) + F.col("j") * 6 * (F.col("c") % 10))
    text = [F.col("client_id"), F.col("kind"), F.floor(F.col("value") * 100 + 0.5), micros(clicks, "ts"), F.col("props"), F.col("c") % 3]
    copies = copies.withColumn("digest", F.sha2(F.concat_ws("|", *(F.coalesce(x.cast("string"), F.lit("")) for x in text)).cast("binary"), 256))
    return copies.select(F.col("click_id").cast("bigint").alias("key"), "hour", (F.col("hour") + F.expr("c div 10 % 200")).alias("order"), F.crc32(F.col("digest").cast("binary")).alias("crc"), F.unhex("digest").alias("hash"))


def deduplicate_clicks(clicks: DataFrame, n_batches: int = 12, groups: int | None = -1) -> DataFrame:
    """Copies of clicks in batches of equal spans of their order, through the stream; groups as in ``deduplicate``, -1: by their number."""
    copies = click_copies(clicks)
    low, high, last, n = copies.agg(F.min("order"), F.max("order"), F.max("hour"), F.count("*")).first()
    if not n:
        return clicks.sparkSession.createDataFrame([], OUTPUT)
    if groups == -1:
        groups = 1 << max(0, int(n / n_batches / EVENTS_A_GROUP)).bit_length()
    number = F.expr(f"(order - {low}) * {n_batches} div {high - low + 1}").cast("int")
    return run_batches(copies.withColumn("batch", number), n_batches, int(last), groups=groups)
