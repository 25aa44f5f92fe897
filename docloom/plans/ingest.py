"""Ingestion of batches: uploads, parsing, assets, chunks; failures are rows, not exceptions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.scalar import blob_key, content_hash, looks_like_html, sha256_id, sniff_image, sniff_video, source_type
from docloom.operators.dedup import reuse_assets, upload_outcomes
from docloom.operators.mutations import delete, soft_delete
from docloom.sources.model import Registry, asset_rows, element_rows, parse_documents

MAX_BYTES = 100 << 20


def upload(files: DataFrame, docs: DataFrame, order: str = "upload_id", max_bytes: int = MAX_BYTES) -> DataFrame:
    """files (upload_id, file_name, content) with doc_id, source_type, source_hash, outcome and existing_id."""
    rows = files.withColumns({"source_hash": content_hash(F.col("content")), "source_type": source_type(F.col("file_name")), "size": F.octet_length("content").cast("bigint")})
    judged = upload_outcomes(rows, docs, order)
    failed = F.when(F.col("size") > max_bytes, "too large").when(F.col("source_type") == "unknown", "unsupported format")
    judged = judged.withColumn("error_message", failed)
    return judged.withColumns({"outcome": F.when(failed.isNotNull(), "failed").otherwise(F.col("outcome")), "doc_id": sha256_id("doc", F.col("source_hash"), F.col(order).cast("string"))})


def replace(old: DataFrame, docs: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents with the replaced ones deleted, new documents that take title, category and lineage of the active ones they replace).

    old: doc_id, new_id.
    """
    live = docs.where("status = 'active'").join(old, "doc_id")
    lineage = live.select(F.col("new_id").alias("doc_id"), F.col("doc_id").alias("previous_doc_id"), F.col("title").alias("__title"), F.col("category").alias("__category"))
    heirs = new.drop("previous_doc_id").join(lineage, "doc_id").withColumns({"title": F.col("__title"), "category": F.col("__category")}).drop("__title", "__category")
    return soft_delete(docs, live), heirs


def ingest(docs: DataFrame, registry: Registry, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Parses docs (doc_id, source_type, content) and replaces all that the tables have of them.

    Gives elements, assets and outcomes (doc_id, status, error_message); running it again gives the same.
    """
    parsed = parse_documents(docs.select("doc_id", "source_type", "content"), registry)
    out = {"elements": element_rows(parsed), "assets": asset_rows(parsed)}
    kept = {name: delete(tables[name], docs, "doc_id").unionByName(rows, allowMissingColumns=True) if name in tables else rows for name, rows in out.items()}
    error = F.col("parsed.error")
    kept["outcomes"] = parsed.select("doc_id", "source_hash", F.when(error.isNull(), "active").otherwise("failed").alias("status"), error.alias("error_message"))
    return kept


def process_assets(assets: DataFrame) -> DataFrame:
    """assets with content_hash, mime, storage_uri and status, from their data.

    Pictures and videos are told by their first bytes; a page instead of a file, or a
    picture of no known kind, fails; a video of no known kind is taken for MP4. Equal
    contents are stored once. Assets without data stay ready as links.
    """
    data, video = F.col("data"), F.col("asset_type").isin("video", "video_link")
    mime = F.when(video, F.coalesce(sniff_video(data), F.lit("video/mp4"))).otherwise(sniff_image(data))
    failed = F.when(data.isNull(), None).when(looks_like_html(data), "a page instead of a file").when(mime.isNull(), "unknown picture format")
    rows = assets.withColumns({"mime": F.when(data.isNotNull(), mime), "error_message": failed, "content_hash": F.when(data.isNotNull(), content_hash(data))})
    rows = rows.withColumns({"status": F.when(failed.isNotNull(), "failed").otherwise("ready"), "storage_uri": F.when(failed.isNull() & data.isNotNull(), blob_key(F.sha2(data, 256), F.col("mime"))), "extracted_text": F.lit(None).cast("string")})
    with_data = reuse_assets(rows.where("data is not null"))
    return with_data.unionByName(rows.where("data is null").withColumn("reused_from", F.lit(None).cast(rows.schema["asset_id"].dataType)))


def blobs(assets: DataFrame) -> DataFrame:
    """(storage_uri, data) of processed assets, each content once."""
    w = Window.partitionBy("storage_uri").orderBy("asset_id")
    rows = assets.where("status = 'ready' and storage_uri is not null").withColumn("rn", F.row_number().over(w)).where("rn = 1")
    return rows.select("storage_uri", "data")


def linked_documents(assets: DataFrame, docs: DataFrame, depth: int, max_depth: int = 3) -> DataFrame:
    """New documents of document links: parent, root and the asset they come from; unknown suffixes and deeper levels fail."""
    links = assets.where("asset_type = 'document_link'").withColumn("kind", source_type(F.col("original_uri"), None))
    parents = docs.select(F.col("doc_id").alias("parent_doc_id"), F.coalesce("root_doc_id", "doc_id").alias("root_doc_id"))
    rows = links.withColumnRenamed("doc_id", "parent_doc_id").join(parents, "parent_doc_id")
    error = F.when(F.col("kind").isNull(), "unsupported_document_type").when(F.lit(depth) >= max_depth, "too deep")
    return rows.select(sha256_id("doc", F.col("parent_doc_id").cast("string"), F.col("original_uri")).alias("doc_id"), "parent_doc_id", "root_doc_id", "asset_id", F.col("original_uri").alias("source_uri"), F.col("kind").alias("source_type"), F.when(error.isNull(), "pending").otherwise("failed").alias("status"), error.alias("error_message"))


def child_documents(assets: DataFrame, docs: DataFrame, depth: int, max_depth: int = 3, together: bool = True) -> DataFrame:
    """Document links with outcome. assets: as linked_documents, with data and fetch_error.

    failed: not fetched (download_failed: why), of no known suffix, or too deep; reused: a live document holds the
    content, whose place (storage_uri) and id (existing_id) the asset takes, or an earlier link of this batch does;
    child: a new document, queued as a job of its own. One content makes one child; unless the links are taken together,
    each is judged by the live documents alone, as if it were the only one.
    """
    live = docs.where(F.col("status").isin("active", "processing")).groupBy("source_hash").agg(F.min(F.struct("doc_id", "source_uri")).alias("__live"))
    rows = linked_documents(assets, docs, depth, max_depth).drop("parent_doc_id").withColumnRenamed("doc_id", "child_id")
    rows = assets.where("asset_type = 'document_link'").join(rows.withColumnRenamed("error_message", "__why"), "asset_id", "left")
    missing = F.col("data").isNull()
    error = F.when(missing, F.concat(F.lit("download_failed: "), F.coalesce("fetch_error", F.lit("empty")))).otherwise(F.col("__why"))
    rows = rows.withColumns({"error_message": error, "source_hash": F.when(~missing, content_hash(F.col("data")))}).join(live, "source_hash", "left")
    first = F.min(F.when(F.col("error_message").isNull(), F.struct("asset_id", "child_id"))).over(Window.partitionBy("source_hash"))
    rows = rows.withColumn("__first", first)
    again = (F.col("__first.asset_id") < F.col("asset_id")) & F.lit(together)
    outcome = F.when(F.col("error_message").isNotNull(), "failed").when(F.col("__live").isNotNull() | again, "reused").otherwise("child")
    rows = rows.withColumn("outcome", outcome)
    taken = F.col("outcome") == "reused"
    existing = F.when(taken, F.coalesce(F.col("__live.doc_id").cast("string"), F.col("__first.child_id")))
    job = F.when(F.col("outcome") == "child", sha256_id("job", F.col("child_id")))
    return rows.withColumns({"storage_uri": F.when(taken, F.col("__live.source_uri")), "existing_id": existing, "job_id": job, "status": F.when(F.col("outcome") == "failed", "failed").otherwise("ready")}).drop("__why", "__live", "__first")


#: Bytes of a part in which a file is put into the store.
PART = 10 << 20


def parts_of(files: DataFrame, key: str = "doc_id", data: str = "content", size: int = PART) -> DataFrame:
    """(key, part, data) of each file: parts of ``size`` bytes from 0, the last one shorter; an empty file has one empty part."""
    n = F.greatest(F.lit(1), F.ceil(F.octet_length(data) / size).cast("int"))
    return files.select(key, data, F.explode(F.sequence(F.lit(0), n - 1)).alias("part")).select(key, "part", F.substring(F.col(data), F.col("part") * size + 1, F.lit(size)).alias("data"))


def store_records(judged: DataFrame, stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records of uploads with a stored file: source_uri, doc_id, file_name, size, title, category; ids whose placeholder is to go).

    judged: uploads with outcome (as upload gives); stored: doc_id, source_uri or null, error_message. What was not
    stored is compensated: its document must not stay, and its outcome is failed.
    """
    both = judged.where("outcome = 'success'").join(stored, "doc_id", "left")
    done = both.where("source_uri is not null")
    title = F.regexp_replace("file_name", r"\.[^.]*$", "")
    category = F.col("category") if "category" in judged.columns else F.lit(None).cast("string")
    return done.select("source_uri", "doc_id", "file_name", "size", title.alias("title"), category.alias("category")), both.where("source_uri is null").select("doc_id")
