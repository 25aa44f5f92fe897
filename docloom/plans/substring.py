"""Keyword search inside texts by stored trigrams: candidates from the index, then the texts of candidates alone.

The index holds lists of the ids of each three characters that occur in a lower-cased text, sorted by them, a list for each few thousand texts. A keyword's rarest
trigrams give candidates, which must hold all of those; their texts are compared with the keyword. Keywords
of one or two characters have no trigram: they are looked for in all texts, in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.plans.retrieval import LITERAL_TERMS
from docloom.store import cut, written

#: Trigrams of a keyword that candidates are taken from, the rarest first; short keywords looked for at once.
RAREST, SHORT_BLOCK = 4, 256
#: Texts whose trigrams are listed together.
TEXTS = 2048


def trigrams(text: Column) -> Column:
    """The distinct three characters in a row of a short text, lower-cased; none of a text of fewer."""
    low = F.lower(text)
    return F.when(F.length(low) >= 3, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(low) - 2), lambda i: F.substring(low, i, F.lit(3))))).otherwise(F.array().cast("array<string>"))


def write_trigrams(docs: DataFrame, path: str, id_col: str, text: str) -> None:
    """Stores the postings (gram, ids) and the number of texts of each gram below path; a search counts rows of one id as one."""
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.where(F.col(id_col).isNotNull() & F.col(text).isNotNull()).select(id_col, F.lower(text).alias("__low"))

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The ids of each trigram among TEXTS texts."""
        for batch in batches:
            for at in range(0, len(batch), TEXTS):
                part = batch.slice(at, TEXTS)
                grams = [sorted({t[i : i + 3] for i in range(len(t) - 2)}) for t in part.column(1).to_pylist()]
                coded = pa.array([g for own in grams for g in own], pa.string()).dictionary_encode()
                codes = coded.indices.to_numpy(zero_copy_only=False)
                order = np.argsort(codes, kind="stable")
                ends = np.concatenate([[0], np.cumsum(np.bincount(codes, minlength=len(coded.dictionary)))])
                of = np.repeat(np.arange(len(grams)), [len(own) for own in grams])[order]
                yield pa.RecordBatch.from_arrays([coded.dictionary, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), part.column(0).take(pa.array(of, pa.int64())))], ["gram", "ids"])

    rows = written(texts.mapInArrow(lists, f"gram string, ids array<{kind}>"))  # ranges are cut from what is stored, not from the texts again
    rows.repartitionByRange("gram", F.col("ids")[0]).sortWithinPartitions("gram").write.option("parquet.block.size", 8 << 20).parquet(f"{path}/postings")
    counts = spark.read.parquet(f"{path}/postings").groupBy("gram").agg(F.sum(F.size("ids")).alias("df"))
    counts.repartitionByRange("gram").sortWithinPartitions("gram").write.parquet(f"{path}/grams")


def candidates(keywords: DataFrame, path: str, id_col: str) -> DataFrame:
    """(query_id, keyword, id) that hold the rarest trigrams of keywords (query_id, keyword) of three characters or more."""
    spark = keywords.sparkSession
    asked = keywords.select("query_id", "keyword", trigrams(F.col("keyword")).alias("grams")).where(F.size("grams") > 0)
    grams = asked.select("query_id", "keyword", F.size("grams").alias("all"), F.explode("grams").alias("gram"))
    listed = [r["gram"] for r in grams.select("gram").distinct().limit(LITERAL_TERMS + 1).collect()]
    narrow = lambda df: df.where(F.col("gram").isin(listed)) if len(listed) <= LITERAL_TERMS else df.join(grams.select("gram").distinct(), "gram", "left_semi")
    known = grams.join(narrow(spark.read.parquet(f"{path}/grams")), "gram")
    w = Window.partitionBy("query_id", "keyword")
    # A keyword with a trigram that no text holds has no candidates.
    rare = known.withColumn("n", F.count("*").over(w)).where(F.col("n") == F.col("all")).withColumn("r", F.row_number().over(w.orderBy("df", "gram"))).where(F.col("r") <= RAREST)
    rare = cut(rare.select("query_id", "keyword", "gram", F.least("n", F.lit(RAREST)).alias("n")))
    few = [r["gram"] for r in rare.select("gram").distinct().limit(LITERAL_TERMS + 1).collect()]
    postings = spark.read.parquet(f"{path}/postings")
    postings = postings.where(F.col("gram").isin(few)) if len(few) <= LITERAL_TERMS else postings
    own = postings.join(rare, "gram").select("query_id", "keyword", "gram", "n", F.explode("ids").alias(id_col))
    held = own.groupBy("query_id", "keyword", id_col).agg(F.size(F.collect_set("gram")).alias("held"), F.first("n").alias("n"))  # RAREST grams at most
    return held.where(F.col("held") == F.col("n")).select("query_id", "keyword", id_col)


def search_substrings(keywords: DataFrame, docs: DataFrame, path: str, id_col: str, text: str) -> DataFrame:
    """(query_id, id): texts that contain the keyword of (query_id, keyword), upper and lower case alike; docs are those that the index is of.

    A null keyword is in no text, an empty one in all with a text.
    """
    asked = keywords.where(F.col("query_id").isNotNull() & F.col("keyword").isNotNull()).select("query_id", "keyword").distinct()
    texts = docs.where(F.col(id_col).isNotNull() & F.col(text).isNotNull()).select(id_col, F.lower(text).alias("__text"))
    maybe = cut(candidates(asked, path, id_col))
    found = texts.join(maybe, id_col).where(F.contains("__text", F.lower("keyword"))).select("query_id", id_col)
    short = cut(asked.where(F.length(F.lower("keyword")) < 3))
    blocks = -(-short.count() // SHORT_BLOCK)
    for block in range(blocks):
        own = short.where(F.pmod(F.xxhash64("query_id", "keyword"), F.lit(blocks)) == block)
        found = found.unionByName(texts.join(F.broadcast(own), F.contains("__text", F.lower("keyword"))).select("query_id", id_col))  # about SHORT_BLOCK keywords of two characters
    return found.distinct()
