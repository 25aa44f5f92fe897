"""Groups of rows in tasks: runs of sorted batches, and matrix blocks of groups of any size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a group that one side of a block holds.
BLOCK = 1024


def runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """The rows of each run of equal values in the first ``keys`` columns, whatever batches they came in."""
    held: list[pa.RecordBatch] = []

    def whole() -> pa.Table:
        out = pa.Table.from_batches(held)
        held.clear()
        return out

    for batch in batches:
        if not len(batch):
            continue
        new = np.zeros(len(batch), bool)
        for i in range(keys):
            column = batch.column(i).to_numpy(zero_copy_only=False)
            new[1:] |= column[1:] != column[:-1]
        if held and any(held[-1].column(i)[-1] != batch.column(i)[0] for i in range(keys)):
            yield whole()
        at = 0
        for end in np.flatnonzero(new).tolist():
            held.append(batch.slice(at, end - at))
            at = end
            yield whole()
        held.append(batch.slice(at))
    if held:
        yield whole()


def blocked(rows: DataFrame, by: str, item_id: str, block: int = BLOCK) -> DataFrame:
    """rows, sorted in tasks by (by, lo, hi), two blocks of a group of which every pair meets once: left rows
    are of block lo, the others of hi. A group of up to ``block`` rows is one block, which meets itself."""
    counts = rows.groupBy(by).agg(F.ceil(F.count("*") / block).cast("int").alias("__n"))
    counts = counts.withColumn("__several", F.col("__n") > 1)
    own = rows.join(counts, by).withColumn("__own", F.pmod(F.xxhash64(item_id), F.col("__n")).cast("int"))
    met = own.withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)))
    lo, hi = F.least("__own", "__other"), F.greatest("__own", "__other")
    met = met.select(by, lo.alias("lo"), hi.alias("hi"), (F.col("__own") == lo).alias("left"), F.col("__several").alias("several"), *[c for c in rows.columns if c != by])
    return met.repartition(by, "lo", "hi").sortWithinPartitions(by, "lo", "hi")
