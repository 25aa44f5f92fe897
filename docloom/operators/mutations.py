"""Writes as snapshots: each function returns the table as it is after the change.

Tables are rewritten to a new place, never read and overwritten in one plan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.scalar import content_hash, sha256_id
from docloom.schema import CHUNK_STATUS, DEFAULT_CATEGORY, KNOWLEDGE_TYPES


def insert(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Adds rows; a key that is there already, or twice in rows, raises when the result is read."""
    found = table.select(key).unionByName(rows.select(key)).groupBy(key).count().where("count > 1").select(key)
    guarded = rows.join(found.withColumn("__dup", F.lit(True)), key, "left")
    guarded = guarded.where(F.when(F.col("__dup"), F.raise_error(F.concat(F.lit(f"duplicate {key}: "), F.col(key).cast("string"))).cast("boolean")).otherwise(F.lit(True)))
    return table.unionByName(guarded.drop("__dup"), allowMissingColumns=True)


def last_of_batch(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Of rows with equal keys the last by order."""
    w = Window.partitionBy(key).orderBy(F.col(order).desc())
    return rows.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def upsert(table: DataFrame, rows: DataFrame, key: str, keep: Sequence[str] = ("created_at",)) -> DataFrame:
    """Replaces rows of equal key, keeping the columns in keep, and adds new ones. Keys of rows are unique."""
    new = rows.select(*[F.col(c).alias(f"__n_{c}") for c in rows.columns], F.lit(True).alias("__new"))
    both = table.withColumn("__old", F.lit(True)).join(new, F.col(key) == F.col(f"__n_{key}"), "full")
    pick = []
    for c in table.columns:
        if c not in rows.columns:
            pick.append(F.col(c))
        elif c in keep:
            pick.append(F.coalesce(F.col(c), F.col(f"__n_{c}")).alias(c))
        else:
            pick.append(F.when(F.col("__new"), F.col(f"__n_{c}")).otherwise(F.col(c)).alias(c))
    return both.select(*pick)


def patch(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Overlays the non-null columns of rows on the rows of equal key; other keys in rows are ignored."""
    new = rows.select(*[F.col(c).alias(f"__n_{c}") for c in rows.columns])
    both = table.join(new, F.col(key) == F.col(f"__n_{key}"), "left")
    return both.select(*[F.coalesce(F.col(f"__n_{c}"), F.col(c)).alias(c) if c in rows.columns and c != key else F.col(c) for c in table.columns])


def missing(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not in the table: an update of them is an error."""
    return rows.join(table.select(key), key, "left_anti")


def update_where(table: DataFrame, condition: Column, **values) -> DataFrame:
    return table.withColumns({c: F.when(condition, v if isinstance(v, Column) else F.lit(v)).otherwise(F.col(c)) for c, v in values.items()})


def delete(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return table.join(keys.select(key).distinct(), key, "left_anti")


def delete_cascade(keys: DataFrame, tables: dict[str, DataFrame], key: str = "doc_id") -> dict[str, DataFrame]:
    """Every table without the rows of the given documents."""
    return {name: delete(t, keys, key) for name, t in tables.items()}


def cascade_counts(keys: DataFrame, tables: dict[str, DataFrame], key: str = "doc_id") -> DataFrame:
    """(table, count): rows that a cascade would delete."""
    out = None
    for name, t in tables.items():
        one = t.join(keys.select(key).distinct(), key, "left_semi").agg(F.lit(name).alias("table"), F.count("*").alias("count"))
        out = one if out is None else out.unionByName(one)
    return out


# -- lifecycle

def soft_delete(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """Sets deleted and remembers the status before; documents that are deleted already stay as they are."""
    hit = docs.join(keys.select("doc_id").distinct().withColumn("__hit", F.lit(True)), "doc_id", "left")
    change = F.coalesce(F.col("__hit"), F.lit(False)) & (F.col("status") != "deleted")
    return update_where(hit, change, previous_status=F.col("status"), status="deleted").drop("__hit").select(*docs.columns)


def restore(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """Deleted documents that were active become active; those that were not are to be ingested again."""
    hit = docs.join(keys.select("doc_id").distinct().withColumn("__hit", F.lit(True)), "doc_id", "left")
    change = F.coalesce(F.col("__hit"), F.lit(False)) & (F.col("status") == "deleted")
    status = F.when(F.col("previous_status") == "active", "active").otherwise("processing")
    return hit.withColumns({"status": F.when(change, status).otherwise(F.col("status")), "previous_status": F.when(change, F.lit(None).cast("string")).otherwise(F.col("previous_status"))}).drop("__hit").select(*docs.columns)


def follow_documents(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """Chunks of deleted documents are deleted, those of active documents active."""
    state = docs.select("doc_id", F.when(F.col("status") == "deleted", "deleted").when(F.col("status") == "active", "active").alias("__state"))
    return chunks.join(state, "doc_id", "left").withColumn("status", F.coalesce("__state", "status")).drop("__state").select(*chunks.columns)


def fail_stale(table: DataFrame, now: str, minutes: int, message: str, statuses: Sequence[str] = ("processing",)) -> DataFrame:
    """Rows that were last touched more than so many minutes ago and are still in work become failed."""
    old = F.col("status").isin(*statuses) & (F.col("updated_at") < F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {minutes} MINUTES"))
    return update_where(table, old, status="failed", error_message=message)


def sync_index(index: DataFrame, chunks: DataFrame) -> DataFrame:
    """Index rows of deleted chunks go; the others take status, category and type of their chunk."""
    state = chunks.select("chunk_id", F.col("status").alias("__status"), F.col("category").alias("__category"), F.col("knowledge_type").alias("__type"))
    both = index.join(state, "chunk_id", "left").where("__status is null or __status <> 'deleted'")
    return both.withColumns({"status": F.coalesce("__status", "status"), "category": F.coalesce("__category", "category"), "knowledge_type": F.coalesce("__type", "knowledge_type")}).select(*index.columns)


# -- batches of requests: an outcome for each asked id

def batch_restore(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """(doc_id, outcome) of asked (doc_id): restored if it was active before it was deleted, re_ingested if it had
    failed or was in work, skipped if it is missing or not deleted. A deleted one of unknown state before is restored."""
    state = docs.select("doc_id", "status", "previous_status")
    again = F.col("previous_status").isin("failed", "processing")
    outcome = F.when(F.col("status") != "deleted", "skipped").when(F.col("status").isNull(), "skipped").when(F.coalesce(again, F.lit(False)), "re_ingested").otherwise("restored")
    return asked.select("doc_id").distinct().join(state, "doc_id", "left").select("doc_id", outcome.alias("outcome"))


def batch_retry(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """(doc_id, outcome) of asked (doc_id): submitted if it failed, else skipped."""
    return asked.select("doc_id").distinct().join(docs.select("doc_id", "status"), "doc_id", "left").select("doc_id", F.when(F.col("status") == "failed", "submitted").otherwise("skipped").alias("outcome"))


def apply_batch(docs: DataFrame, outcomes: DataFrame) -> DataFrame:
    """docs after a batch: restored ones active, those to be ingested again in work, submitted retries too."""
    both = docs.join(outcomes, "doc_id", "left")
    status = F.when(F.col("outcome") == "restored", "active").when(F.col("outcome").isin("re_ingested", "submitted"), "processing").otherwise(F.col("status"))
    before = F.when(F.col("outcome").isin("restored", "re_ingested"), F.lit(None).cast("string")).otherwise(F.col("previous_status"))
    return both.withColumns({"status": status, "previous_status": before}).select(*docs.columns)


def outcome_counts(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy("outcome").agg(F.count("*").alias("count"))


# -- chunks

def set_chunk_status(chunks: DataFrame, keys: DataFrame, status: str) -> DataFrame:
    """Chunks with the status (deleted or active) on those of the given ids; others stay."""
    if status not in CHUNK_STATUS:
        raise ValueError(f"unknown status {status}")
    hit = chunks.join(keys.select("chunk_id").distinct().withColumn("__hit", F.lit(True)), "chunk_id", "left")
    return update_where(hit, F.coalesce(F.col("__hit"), F.lit(False)), status=status).drop("__hit").select(*chunks.columns)


def create_chunks(requests: DataFrame, docs: DataFrame, chunks: DataFrame, order: str) -> DataFrame:
    """requests (order, doc_id, title, content, knowledge_type, category) as chunks written by hand, each with outcome:
    created, no_document, or duplicate of other if a chunk or an earlier request has its content.

    The metadata says that they are manual; they refer to their document and to no element.
    """
    new = requests.withColumns({"content_hash": content_hash(F.col("content")), "chunk_id": sha256_id("chunk", F.col("doc_id").cast("string"), F.col(order).cast("string"))})
    new = new.join(docs.select("doc_id", F.lit(True).alias("__there")), "doc_id", "left")
    held = chunks.groupBy("content_hash").agg(F.min(F.col("chunk_id").cast("string")).alias("__held"))
    first = F.min(F.when(F.col("__there"), F.struct(F.col(order), F.col("chunk_id")))).over(Window.partitionBy("content_hash"))
    both = new.join(held, "content_hash", "left").withColumn("__first", first)
    other = F.coalesce(F.col("__held"), F.when(F.col(f"__first.{order}") < F.col(order), F.col("__first.chunk_id")))
    outcome = F.when(F.col("__there").isNull(), "no_document").when(other.isNotNull(), "duplicate").otherwise("created")
    kind = F.when(F.col("knowledge_type").isin(*KNOWLEDGE_TYPES), F.col("knowledge_type")).otherwise("declarative")
    refs = F.array(F.struct(F.col("doc_id").cast("string").alias("doc_id"), F.lit("").alias("element_id")))
    return both.withColumns({"outcome": outcome, "other": F.when(F.col("__there"), other), "knowledge_type": kind, "category": F.coalesce("category", F.lit(DEFAULT_CATEGORY)), "title": F.coalesce("title", F.lit("")), "status": F.lit("active"), "source_refs": refs, "metadata": F.create_map(F.lit("manual"), F.lit("true"))}).drop("__there", "__held", "__first")


def update_chunks(chunks: DataFrame, changes: DataFrame, reindex: bool = True) -> DataFrame:
    """(chunk_id, outcome, index, and the columns after the change) of changes (chunk_id, and title, content, category,
    knowledge_type or null for no change): not_found, invalid for an unknown type, duplicate if another chunk has the
    new content, else updated. index: rebuild if the content changed and reindex is set, none if it is not, sync if
    only other columns changed. The hash follows the content. One change a chunk."""
    new = changes.select("chunk_id", *[F.col(c).alias(f"__n_{c}") for c in ("title", "content", "category", "knowledge_type")])
    both = new.join(chunks.withColumn("__there", F.lit(True)), "chunk_id", "left")
    changed = F.coalesce(F.col("__n_content") != F.col("content"), F.lit(False))
    both = both.withColumns({"__changed": changed, "__hash": F.when(changed, content_hash(F.col("__n_content"))).otherwise(F.col("content_hash"))})
    held = chunks.groupBy(F.col("content_hash").alias("__hash")).agg(F.min("chunk_id").alias("__one"), F.max("chunk_id").alias("__two"))
    both = both.join(held, "__hash", "left")
    duplicate = F.col("__changed") & F.coalesce((F.col("__one") != F.col("chunk_id")) | (F.col("__two") != F.col("chunk_id")), F.lit(False))
    invalid = F.coalesce(~F.col("__n_knowledge_type").isin(*KNOWLEDGE_TYPES), F.lit(False))
    outcome = F.when(F.col("__there").isNull(), "not_found").when(invalid, "invalid").when(duplicate, "duplicate").otherwise("updated")
    both = both.withColumn("outcome", outcome)
    done = F.col("outcome") == "updated"
    index = F.when(done, F.when(F.col("__changed"), "rebuild" if reindex else "none").otherwise("sync"))
    values = {c: F.when(done, F.coalesce(f"__n_{c}", c)).otherwise(F.col(c)) for c in ("title", "content", "category", "knowledge_type")}
    return both.withColumns(values | {"content_hash": F.when(done, F.col("__hash")).otherwise(F.col("content_hash")), "index": index}).select("outcome", "index", *chunks.columns)
