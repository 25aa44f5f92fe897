"""Chunks from elements: sections, and one chunk for each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions.scalar import content_hash, strip
from docloom.operators.sequence import sections


def fallback_chunks(elements: DataFrame, level: int = 1) -> DataFrame:
    """(doc_id, section, title, content, content_hash, n_elements): texts of a section's elements, joined by line ends; blank ones make no chunk."""
    rows = sections(elements, level).where(strip(F.coalesce("text", F.lit(""))) != "")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"])
    out = rows.groupBy("doc_id", "section").agg(F.array_join(parts, "\n").alias("content"), F.min(F.when(F.col("element_type") == "title", F.struct("seq", "text"))).alias("t"), F.count("*").alias("n_elements"))
    return out.select("doc_id", "section", F.coalesce("t.text", F.lit("")).alias("title"), "content", content_hash(F.col("content")).alias("content_hash"), "n_elements")
