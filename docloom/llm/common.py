"""Helpers shared by the operators: table reading, scratch tables, Arrow buffers."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.store import shared_folder


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(columns: list[str], *names: str) -> list[str]:
    """The names, each with underscores before it until no column has it (in any case)."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


@lru_cache(maxsize=1)
def _trimmer():
    with contextlib.suppress(OSError, AttributeError):
        return ctypes.CDLL("libc.so.6").malloc_trim
    return lambda _: None


def trim_memory() -> None:
    """Gives memory that this Python process no longer uses back to the system; workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    _trimmer()(0)


def trim_driver(spark: SparkSession, collect: bool = False) -> None:
    """Has the driver's JVM give native memory that it no longer uses back to the system, as far as it can.

    Plans, their compilation and the threads of exchanges leave much of it behind. With
    ``collect`` garbage goes first, and with it the broadcasts and shuffles of finished plans.
    """
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    if collect:
        gc.collect()
        jvm.System.gc()
    with contextlib.suppress(Exception):  # a JVM without this command keeps its memory
        of = jvm.java.lang.Class.forName
        kinds, args = gateway.new_array(jvm.java.lang.Class, 4), gateway.new_array(jvm.java.lang.Object, 4)
        for i, name in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
            kinds[i] = of(name)
        args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        of("javax.management.MBeanServerConnection").getMethod("invoke", kinds).invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args)
    trim_memory()


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder; nothing happens if it is already gone."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    with contextlib.suppress(Exception):
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


#: Folders that operators have left for plans that still read them.
_LEFT: list[str] = []


@contextlib.contextmanager
def removing_left(spark: SparkSession):
    """On leaving, removes the tables that operators inside kept for their lazy results: those must be written by then."""
    before = len(_LEFT)
    yield
    for path in _LEFT[before:]:
        remove(spark, path)
    del _LEFT[before:]


class Scratch:
    """Tables written to the shared folder to cut lineage or to be read more than once.

    Lost executors cost nothing that has been written. ``drop`` removes a table that
    no remaining plan reads; leaving the ``with`` block removes all but those kept, which
    lazy results still read: ``removing_left`` removes them once the results are written.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/docloom-{label}-{uuid.uuid4().hex}"
        self.paths: dict[str, str] = {}
        self.kept: set[str] = set()

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *exc) -> None:
        for name in [n for n in self.paths if n not in self.kept]:
            self.drop(name)
        _LEFT.extend(self.paths.values())
        trim_driver(self.spark, collect=True)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str, keep: bool = False, **options: str) -> DataFrame:
        self.paths[name] = self.path(name)
        if keep:
            self.kept.add(name)
        df.write.options(**{"compression": "zstd"} | options).mode("overwrite").parquet(self.path(name))
        trim_driver(self.spark)
        return self.read(name, df)

    def read(self, name: str, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            remove(self.spark, self.paths.pop(name))


def crc32_of_id(column: Column | str) -> Column:
    """crc32 of an id written as text; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary") if isinstance(column, str) else column.cast("string").cast("binary"))


def utf8_buffer(array: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary array and its n + 1 offsets; a null is empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if array.null_count:
        array = array.fill_null(b"" if pa.types.is_binary(array.type) or pa.types.is_large_binary(array.type) else "")
    kind = np.int64 if pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type) else np.int32
    if not len(array):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = array.buffers()
    at = np.frombuffer(offsets, kind)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0]
