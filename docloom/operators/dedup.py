"""Exact duplicates by content hash, and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def upload_outcomes(uploads: DataFrame, docs: DataFrame, order: str) -> DataFrame:
    """uploads with outcome and existing_id: duplicate if an active or processing document, or an earlier upload, has the hash."""
    live = docs.where(F.col("status").isin("active", "processing")).groupBy("source_hash").agg(F.min("doc_id").alias("live_id"))
    w = Window.partitionBy("source_hash").orderBy(order)
    first = uploads.withColumn("earlier", F.first(order).over(w)).join(live, "source_hash", "left")
    existing = F.coalesce(F.col("live_id"), F.when(F.col("earlier") < F.col(order), F.col("earlier")))
    return first.withColumn("existing_id", existing).withColumn("outcome", F.when(F.col("existing_id").isNull(), "success").otherwise("duplicate")).drop("live_id", "earlier")


def hash_violations(docs: DataFrame) -> DataFrame:
    """Hashes that more than one active or processing document holds."""
    return docs.where(F.col("status").isin("active", "processing")).groupBy("source_hash").agg(F.count("*").alias("count")).where("count > 1")


def duplicates_of_others(rows: DataFrame, key: str, content_hash: str = "content_hash") -> DataFrame:
    """(key, other): rows whose content another row has, with the least such key."""
    w = Window.partitionBy(content_hash)
    least = F.min(key).over(w)
    second = F.min(F.when(F.col(key) != F.col("__least"), F.col(key))).over(w)
    found = rows.select(key, content_hash).withColumn("__least", least).withColumn("__second", second)
    return found.select(key, F.when(F.col(key) == F.col("__least"), F.col("__second")).otherwise(F.col("__least")).alias("other")).where("other is not null")


def reuse_assets(assets: DataFrame) -> DataFrame:
    """Assets whose content an earlier ready asset has take its place and extracted text."""
    firsts = assets.where(F.col("status") == "ready").groupBy("content_hash").agg(F.min(F.struct("asset_id", "storage_uri", "extracted_text")).alias("f"))
    both = assets.join(firsts, "content_hash", "left")
    other = F.col("f.asset_id") < F.col("asset_id")
    return both.withColumns({"reused_from": F.when(other, F.col("f.asset_id")), "storage_uri": F.when(other, F.col("f.storage_uri")).otherwise(F.col("storage_uri")), "extracted_text": F.when(other, F.col("f.extracted_text")).otherwise(F.col("extracted_text"))}).drop("f")


def first_of_each(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(order)
    return rows.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def restore_hash(docs: DataFrame) -> DataFrame:
    """source_hash that a deleted document gets on restoring: its own, or restored:<id> if a live one holds it."""
    live = docs.where(F.col("status").isin("active", "processing")).select("source_hash").distinct().withColumn("__held", F.lit(True))
    gone = docs.where(F.col("status") == "deleted").join(live, "source_hash", "left")
    return gone.select("doc_id", F.when(F.col("__held"), F.concat(F.lit("restored:"), F.col("doc_id").cast("string"))).otherwise(F.col("source_hash")).alias("restored_hash"))


def merge_items(existing: DataFrame, incoming: DataFrame, keys: tuple[str, ...], order: str) -> DataFrame:
    """Upsert-union with outcome: manual rows stay (skipped), automatic ones are replaced (updated), new ones added.

    Blank queries are dropped; of incoming rows with equal keys the last wins.
    """
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    new = incoming.where(F.btrim("query") != "").withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")
    values = [c for c in existing.columns if c not in keys]
    both = existing.withColumn("__old", F.lit(True)).join(new.select(*keys, *[F.col(c).alias(f"__n_{c}") for c in values]).withColumn("__new", F.lit(True)), list(keys), "full")
    manual = F.col("__old") & (F.col("source") == "manual")
    outcome = F.when(F.col("__new").isNull(), "kept").when(F.col("__old").isNull(), "added").when(manual, "skipped").otherwise("updated")
    taken = F.col("__new").isNotNull() & F.coalesce(~manual, F.lit(True))
    return both.select(*keys, outcome.alias("outcome"), *[F.when(taken, F.col(f"__n_{c}")).otherwise(F.col(c)).alias(c) for c in values])
