"""Entities as stored rows and back: nested columns as JSON text, nulls as the entity's defaults."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.schema import DEFAULT_CATEGORY, schema

# What a null in a stored row stands for.
DEFAULTS = {
    "documents": {"version": 1, "status": "pending", "category": DEFAULT_CATEGORY},
    "elements": {"doc_version": 1, "element_type": "unknown", "text": ""},
    "assets": {"doc_version": 1, "status": "downloading"},
    "chunks": {"title": "", "knowledge_type": "declarative", "category": DEFAULT_CATEGORY, "status": "active"},
    "jobs": {"status": "queued", "progress": 0},
}


def is_nested(kind: T.DataType) -> bool:
    return isinstance(kind, (T.ArrayType, T.MapType, T.StructType))


def to_row(df: DataFrame) -> DataFrame:
    """df with every nested column as JSON text."""
    return df.select(*[F.to_json(f.name).alias(f.name) if is_nested(f.dataType) else F.col(f.name) for f in df.schema])


def from_row(rows: DataFrame, entity: str) -> DataFrame:
    """Rows as an entity: JSON text parsed, bad or missing JSON as nothing in it, nulls by DEFAULTS; other columns stay."""
    kinds, defaults, out = {f.name: f.dataType for f in schema(entity)}, DEFAULTS.get(entity, {}), []
    for name in rows.columns:
        value, kind = F.col(name), kinds.get(name)
        if kind is not None and is_nested(kind) and isinstance(rows.schema[name].dataType, T.StringType):
            value = decoded(value, kind)
        if name in defaults:
            value = F.coalesce(value, F.lit(defaults[name]))
        out.append(value.alias(name))
    return rows.select(*out)


def decoded(text: Column, kind: T.DataType | str) -> Column:
    """JSON text as a value of a type; an empty list or map where it is missing or cannot be read."""
    kind = kind if isinstance(kind, str) else kind.simpleString()
    value = F.from_json(text, kind, {"mode": "PERMISSIVE"})
    if kind.startswith("array"):
        # A text that is no list parses to a list of one null.
        value = F.when(F.btrim(text).startswith("["), value)
        return F.coalesce(F.filter(value, lambda x: x.isNotNull()), F.array().cast(kind))
    if kind.startswith("map"):
        return F.coalesce(value, F.create_map().cast(kind))
    return value


def renderable_uri(uri: Column) -> Column:
    """A stored place as something a client can open: known schemes stay, a path becomes a file URI; empty stays."""
    path = F.regexp_replace(F.replace(uri, F.lit("\\"), F.lit("/")), "^/+", "")
    return F.when(F.coalesce(uri, F.lit("")) == "", uri).when(uri.rlike("^(http|https|file|minio)://"), uri).otherwise(F.concat(F.lit("file:///"), path))


def public_url(url: Column, bucket: Column | str, endpoint: str | None, place: str = "assets") -> Column:
    """A signed URL of the inner store as the public one: scheme and host of the endpoint, the bucket's first
    place in the path as ``place``; query and fragment stay. Without an endpoint the URL itself."""
    if not endpoint:
        return url
    bucket = F.lit(bucket) if isinstance(bucket, str) else bucket
    scheme, _, rest = endpoint.partition("://")
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    tail = F.regexp_extract(url, r"([?#].*)?$", 0)
    at = F.position(F.concat(F.lit("/"), bucket, F.lit("/")), path)
    moved = F.when(at > 0, F.concat(F.substring(path, F.lit(1), at - 1), F.lit(f"/{place}/"), F.substring(path, at + F.length(bucket) + 2, F.length(path)))).otherwise(path)
    return F.concat(F.lit(f"{scheme}://{rest.partition('/')[0]}"), moved, tail)


def source_label(page: Column, path: Column, element_id: Column) -> Column:
    """Where a chunk comes from, for a reader: 第 n 页 · a › b, either part alone, else the element's id."""
    parts = F.filter(F.array(F.when(page.isNotNull(), F.concat(F.lit("第 "), page.cast("string"), F.lit(" 页"))), F.nullif(F.array_join(path, " › "), F.lit(""))), lambda x: x.isNotNull())
    return F.when(F.size(parts) > 0, F.array_join(parts, " · ")).otherwise(element_id)
