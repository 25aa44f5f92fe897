"""Shards of near-equal bytes by histogram sort.

Rows are ordered by the hash of their text, then by the hash of their id, so equal texts
stand together. There is a splitter for each partition of the exchange, and a shard is a
range of partitions. The driver keeps, for each splitter, the interval of keys that holds it
and the exact bytes below. A round sends a few candidate keys into each open interval,
closest where the target should be, and counts the exact bytes between neighbouring
candidates over a narrow table of keys and sizes: one aggregation with map-side combining,
one row for each candidate. A gap between candidates shrinks to the least and greatest key that
it really holds. A splitter is done once some key is within ``tolerance`` of a partition of
its target, or its interval is one key. Equal texts are split only where they alone
exceed that. Rows are exchanged once, sorted and numbered.

Law: ``bytes``. A row's size is the UTF-8 length of its text plus 1. A partition's bounds
are off by ``tolerance`` of a partition or by the size of a row that cannot be split.

The driver holds a few numbers for each partition of ``part_bytes``; nothing else grows.

Defined results: a null text has size 1 and is ordered apart from the empty text; null ids
and repeated rows are ordered like any others, equal ones in any order; whole texts are
hashed, however long; an empty table gives no rows; extra columns are kept, whatever their
names, but output columns replace input columns of the same names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import Scratch, fresh

SHARDS, TOLERANCE = 8, 0.002
#: Bytes of a partition of the exchange, about, and partitions at most.
PART_BYTES, MOST_PARTS = 32 << 20, 1 << 18
#: Candidates of an open splitter in a round after the first.
PROBES = 4
_ONE = 1 << 64
_HALF = 1 << 63


def row_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint") + 1


def _split(key: int) -> tuple[int, int]:
    """A place in the order of keys (k1, k2), as one number from 0 to 2**128, and back."""
    return (key >> 64) - _HALF, (key & (_ONE - 1)) - _HALF


def _joined(k1: int, k2: int) -> int:
    return (k1 + _HALF) << 64 | (k2 + _HALF)


@dataclass
class _Open:
    """A splitter that is sought: keys below ``low`` hold ``below`` bytes, those below ``high`` ``upto``."""

    number: int
    target: int
    low: int
    high: int
    below: int
    upto: int

    def probes(self, n: int) -> list[int]:
        """Candidates: where the target should be if bytes were even, around it, and in the middle."""
        span, bytes_ = self.high - self.low, max(self.upto - self.below, 1)
        guess = self.low + span * (self.target - self.below) // bytes_
        if n == 1:
            return [guess]
        near = max(span >> 6, 1)
        return [guess - near, guess, guess + near, self.low + span // 2][:n]


def find_splitters(keys: DataFrame, parts: int, slack: int, total: int) -> list[tuple[int, int]]:
    """parts - 1 keys (k1, k2), in order; a part holds the rows from its splitter up to the next."""
    done: dict[int, int] = {}
    todo = [_Open(i, total * (i + 1) // parts, 0, _ONE * _ONE, 0, total) for i in range(parts - 1)]
    first = True
    while todo:
        at = sorted({min(max(k, s.low + 1), s.high - 1) for s in todo for k in s.probes(1 if first else PROBES) if s.high - s.low > 1} | (set() if first else {k for s in todo for k in (s.low, s.high)}))
        first = False
        edges = _counted(keys, at, total)
        left = []
        for s in todo:
            s = _narrowed(s, edges)
            near = min((s.low, s.below), (s.high, s.upto), key=lambda x: abs(x[1] - s.target))
            if abs(near[1] - s.target) <= slack or s.high - s.low <= 1:
                done[s.number] = near[0]
            else:
                left.append(s)
        todo = left
    # A splitter past the last key leaves the last parts empty.
    return [_split(min(done[i], _ONE * _ONE - 1)) for i in range(parts - 1)]


def _counted(keys: DataFrame, at: list[int], total: int) -> tuple[np.ndarray, list[int], list[int], list[int]]:
    """Of each stretch between candidates: bytes below it, its first and last key, and its bytes."""
    place = _part_of([_split(min(k, _ONE * _ONE - 1)) for k in at])
    key = F.struct("k1", "k2")
    got = keys.groupBy(place("k1", "k2").alias("part")).agg(F.sum("size").alias("size"), F.min(key).alias("low"), F.max(key).alias("high")).orderBy("part").toArrow()  # a row for each candidate
    low, high = ([_joined(x["k1"], x["k2"]) for x in got[c].to_pylist()] for c in ("low", "high"))
    size = got["size"].to_numpy().astype(np.int64)
    return np.cumsum(size) - size, low, high, size.tolist()


def _narrowed(s: _Open, edges: tuple) -> _Open:
    """The splitter with the interval of the stretch that holds its target."""
    below, low, high, size = edges
    i = max(int(np.searchsorted(below, s.target, "right")) - 1, 0)
    lo, hi, start, end = low[i], high[i] + 1, int(below[i]), int(below[i]) + size[i]
    return _Open(s.number, s.target, lo, hi, start, end)


def shard(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, tolerance: float = TOLERANCE, part_bytes: int = PART_BYTES) -> DataFrame:
    """df with size, shard and slot (place in the shard, gapless from 0), in shard order."""
    text = F.col(text_col)
    k1, k2, part = fresh([*df.columns, "size", "shard", "slot"], "k1", "k2", "part")
    # Rows of one text and one id still differ if another column does.
    keyed = df.withColumns({"size": row_size(text), k1: F.xxhash64(F.lit(1), text, text.isNull()), k2: F.xxhash64(F.lit(2), F.col(id_col).cast("string"))})
    with Scratch(df.sparkSession, "shard") as scratch:
        keys = scratch.write(keyed.select(F.col(k1).alias("k1"), F.col(k2).alias("k2"), "size"), "keys")
        total = keys.agg(F.sum("size")).first()[0]
        if not total:
            return df.limit(0).withColumns({"size": F.lit(0).cast("bigint"), "shard": F.lit(0), "slot": F.lit(0).cast("bigint")})
        each = max(1, min(-(-total // (shards * part_bytes)), MOST_PARTS // shards))
        parts = shards * each
        splitters = find_splitters(keys, parts, max(1, int(tolerance * total / parts)), total)
        place = _part_of(splitters)
        counts = keys.groupBy(place("k1", "k2").alias("part")).count().toArrow()  # a row per part
        rows = np.zeros(parts, np.int64)
        rows[counts["part"].to_numpy()] = counts["count"].to_numpy()
        before = (np.cumsum(rows) - rows).reshape(shards, each)
        first = (before - before[:, :1]).ravel()

        @F.arrow_udf("bigint")
        def start(part: pa.Array) -> pa.Array:
            return pa.array(first[part.to_numpy(zero_copy_only=False)])

        dealt = keyed.withColumn(part, place(k1, k2))
        dealt = dealt.repartitionById(parts, F.col(part)).sortWithinPartitions(part, k1, k2, *[c for c in (id_col,) if c in df.columns])
        slot = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) + start(part)
        return dealt.withColumns({"shard": F.floor(F.col(part) / each).cast("int"), "slot": slot}).drop(k1, k2, part)


def _part_of(splitters: list[tuple[int, int]]):
    one, two = np.array([a for a, _ in splitters], np.int64), np.array([b for _, b in splitters], np.int64)

    @F.arrow_udf("int")
    def part(k1: pa.Array, k2: pa.Array) -> pa.Array:
        a, b = k1.to_numpy(zero_copy_only=False), k2.to_numpy(zero_copy_only=False)
        lo, hi = np.searchsorted(one, a, "left"), np.searchsorted(one, a, "right")
        out = lo.copy()
        for i in np.flatnonzero(hi > lo):  # splitters inside equal texts
            out[i] = lo[i] + np.searchsorted(two[lo[i] : hi[i]], b[i], "right")
        return pa.array(out.astype(np.int32))

    return part


def write_shards(df: DataFrame, path: str, **options) -> None:
    """The shards as Parquet folders shard=0, shard=1, .. ; options as of shard()."""
    shard(df, **options).write.partitionBy("shard").mode("overwrite").parquet(path)
