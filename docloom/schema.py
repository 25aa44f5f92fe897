"""Schemas of the entities and the closed domains of their columns."""

from __future__ import annotations

from pyspark.sql import types as T

DOC_STATUS = ("pending", "active", "deleted", "failed", "processing")
ASSET_STATUS = ("downloading", "ready", "failed")
CHUNK_STATUS = ("active", "deleted")
KNOWLEDGE_TYPES = ("declarative", "relational", "procedural")
ELEMENT_TYPES = ("title", "paragraph", "list", "table", "code", "unknown")
ASSET_TYPES = ("image", "video", "image_link", "video_link", "document_link", "web_link")
JOB_STATUS = ("queued", "processing", "completed", "failed")
JOB_STAGES = ("parsing", "extracting", "indexing", "completed", "failed")
DEFAULT_CATEGORY = "通用"

_META = "metadata MAP<STRING, STRING>"
_LOCATION = "source_location STRUCT<page: INT, section_path: ARRAY<STRING>, table_path: ARRAY<MAP<STRING, STRING>>>"
_TABLE = "structured_data STRUCT<`table`: STRUCT<caption: STRING, headers: ARRAY<STRUCT<text: STRING>>, rows: ARRAY<STRUCT<cells: ARRAY<STRUCT<text: STRING, metadata: MAP<STRING, STRING>>>>>, metadata: MAP<STRING, STRING>>>"

DDL = {
    "documents": f"doc_id STRING, title STRING, source_type STRING, source_uri STRING, source_hash STRING, version INT, status STRING, category STRING, parent_doc_id STRING, root_doc_id STRING, previous_doc_id STRING, error_message STRING, created_at TIMESTAMP, updated_at TIMESTAMP, {_META}",
    "elements": f"element_id STRING, doc_id STRING, doc_version INT, parent_element_id STRING, sequence_order INT, element_type STRING, text STRING, {_TABLE}, asset_data ARRAY<STRUCT<placeholder: STRING, asset_id: STRING>>, {_LOCATION}, created_at TIMESTAMP, {_META}",
    "assets": f"asset_id STRING, doc_id STRING, element_id STRING, doc_version INT, asset_type STRING, original_uri STRING, storage_uri STRING, display_text STRING, content_hash STRING, status STRING, extracted_text STRING, error_message STRING, created_at TIMESTAMP, {_META}, data BINARY",
    "chunks": f"chunk_id STRING, doc_id STRING, title STRING, content STRING, content_hash STRING, knowledge_type STRING, category STRING, status STRING, asset_refs ARRAY<STRUCT<asset_id: STRING, caption: STRING>>, source_refs ARRAY<STRUCT<doc_id: STRING, doc_version: INT, element_id: STRING, {_LOCATION.replace(' STRUCT', ': STRUCT', 1)}>>, created_at TIMESTAMP, updated_at TIMESTAMP, {_META}",
    "chunk_index": "chunk_id STRING, doc_id STRING, doc_title STRING, title STRING, content STRING, dense_vector ARRAY<FLOAT>, category STRING, knowledge_type STRING, status STRING, source_refs STRING, asset_refs STRING, metadata STRING",
    "jobs": "job_id STRING, doc_id STRING, message_id STRING, status STRING, stage STRING, progress INT, error_message STRING, created_at TIMESTAMP, updated_at TIMESTAMP",
    "eval_items": "query STRING, expected_chunk_ids ARRAY<STRING>, expected_content_contains ARRAY<STRING>, doc_id STRING, doc_version INT, source STRING",
    "eval_history": "timestamp STRING, search_params MAP<STRING, STRING>, metrics MAP<STRING, DOUBLE>, query_count INT, success_count INT, failure_count INT",
}


def schema(entity: str) -> T.StructType:
    return T.StructType.fromDDL(DDL[entity])


def create_stores(spark, database: str, entities: tuple[str, ...] = tuple(DDL)) -> None:
    """Creates an empty Parquet table for each entity."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    for e in entities:
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{e} ({DDL[e]}) USING parquet")


def drop_stores(spark, database: str, entities: tuple[str, ...] = tuple(DDL)) -> None:
    for e in entities:
        spark.sql(f"DROP TABLE IF EXISTS {database}.{e}")
