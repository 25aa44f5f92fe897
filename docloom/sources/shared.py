"""Small files and whole folders of the shared store: text in and out, and moves that never replace anything."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _hadoop(spark: SparkSession, path: str):
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs
    where, conf = fs.Path(path), spark.sparkContext._jsc.hadoopConfiguration()
    return fs, where, conf


def publish(spark: SparkSession, made: str, final: str) -> bool:
    """Moves a file or folder to its final name in one step; False, and nothing happens, if that name is taken."""
    fs, target, conf = _hadoop(spark, final)
    context = fs.FileContext.getFileContext(target.toUri(), conf)
    context.mkdir(target.getParent(), fs.permission.FsPermission.getDirDefault(), True)
    kind = spark.sparkContext._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename")
    how = spark.sparkContext._gateway.new_array(fs.Options.Rename, 1)
    how[0] = kind.getEnumConstants()[0]  # NONE: no overwriting
    try:
        context.rename(fs.Path(made), target, how)
    except Exception:
        if context.util().exists(target):
            return False
        raise
    return True


def names(spark: SparkSession, folder: str) -> list[str]:
    """The names in a folder, in order; none if it does not exist."""
    _, where, conf = _hadoop(spark, folder)
    store = where.getFileSystem(conf)
    return sorted(x.getPath().getName() for x in store.listStatus(where)) if store.exists(where) else []


def read_text(spark: SparkSession, path: str) -> str:
    _, where, conf = _hadoop(spark, path)
    stream = where.getFileSystem(conf).open(where)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    _, where, conf = _hadoop(spark, path)
    stream = where.getFileSystem(conf).create(where, False)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def remove(spark: SparkSession, path: str) -> None:
    _, where, conf = _hadoop(spark, path)
    where.getFileSystem(conf).delete(where, True)
