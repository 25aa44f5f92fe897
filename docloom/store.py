"""Cutting a plan's lineage in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Bytes of a table's rows that a task holds until it writes them, and reads at once.
ROW_GROUP = 16 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; where all runs in one process and none is named, a temporary one."""
    for conf in (spark.sparkContext.getConf().get("spark.checkpoint.dir"), spark.conf.get("spark.checkpoint.dir", "")):
        if conf:
            return conf.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="docloom-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/docloom-{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df as it was computed now, read from the shared folder; what made it is not run again."""
    spark = df.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """As cut, as a compressed table; how the rows were partitioned and ordered is not kept."""
    spark = df.sparkSession
    path = new_folder(spark, "rows")
    df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """What runs within it reads tables, and hands rows to Python, at most so many rows at once. A task holds such a batch whole, in
    Python a second time; the defaults of 4096 and 10000 rows are much where a row is a text or a list of its words."""
    keys = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize")
    were = {k: spark.conf.get(k) for k in keys}
    for k, was in were.items():
        if not 0 < int(was) <= rows:
            spark.conf.set(k, str(rows))
    try:
        yield
    finally:
        for k, was in were.items():
            spark.conf.set(k, was)
