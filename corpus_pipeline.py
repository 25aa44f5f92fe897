"""A training corpus from raw documents: each stage works on what the one before it kept.

Stages take (spark, docs, sf_dir); all but the last return the columns of ``documents``, extra
ones too. Documents without text or letters go in the first stage; those whose text is empty
once repeated lines are removed go in the second; of equal documents the first of the least id
stays; ids may be null. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import decontamination, lang_id, line_dedup, near_dedup
from docloom.llm.bpe import decode_ids, encode_documents
from docloom.llm.common import Scratch, fresh, read_table, removing_left
from docloom.llm.queries import vocabulary


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that no language model accepts: no text, no letters, or nothing like any language learned."""
    models = lang_id.train(docs, "doc_id", "text", "lang")
    name = fresh(docs.columns, "judged")[0]
    judged = docs.withColumn(name, lang_id.identify("text", models, spark))
    return judged.where(~F.col(f"{name}.rejected")).drop(name)


#: Columns that line deduplication adds.
COUNTS = ("n_lines", "n_exact", "n_near")


def remove_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes repeated lines from the texts, and documents that nothing is left of."""
    own = {c: fresh([*docs.columns, *COUNTS], f"own_{c}")[0] for c in docs.columns if c.lower() in COUNTS}
    done = line_dedup.dedup_lines(docs.withColumnsRenamed(own))
    left = ((F.col("n_exact") + F.col("n_near")) == 0) | F.col("text").rlike(r"\S")
    done = done.where(F.coalesce(left, F.lit(True))).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return done.drop(*COUNTS).withColumnsRenamed({to: c for c, to in own.items()}).select(*docs.columns)


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates, that of the least id."""
    return near_dedup.keep_one(docs)


def remove_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    return decontamination.without_leaks(docs, read_table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes and decodes the texts: number and digest of the ids, digest of the decoded text."""
    path = vocabulary()
    ids = encode_documents(docs.select("doc_id", "text"), path).select("doc_id", "ids")
    return ids.select("doc_id", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(decode_ids(F.col("ids"), path).cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", remove_repeated_lines),
    ("near_dedup", remove_near_duplicates),
    ("decontamination", remove_benchmark_leaks),
    ("bpe", encode),
]

#: SQL cannot express the language models, signatures, tilings and merges; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    with Scratch(spark, "pipeline") as scratch:
        for i, (name, stage) in enumerate(STAGES):
            last = i == len(STAGES) - 1
            with removing_left(spark):
                docs = scratch.write(stage(spark, docs, sf_dir), name, keep=last)
            if i:
                scratch.drop(STAGES[i - 1][0])
    return docs
