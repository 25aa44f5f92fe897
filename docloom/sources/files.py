"""Sources: folders, bytes by URI, shared pages, evaluation files; and the default parsers."""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.scalar import SOURCE_TYPE_BY_SUFFIX, basename, content_hash, sha256_id, source_type, stem
from docloom.sources.html import parse_html
from docloom.sources.markdown import parse_markdown
from docloom.sources.model import Registry
from docloom.sources.office import parse_docx, parse_pptx, parse_xlsx
from docloom.sources.pdf import parse_pdf


def default_registry() -> Registry:
    out = Registry()
    out.register(parse_markdown, "markdown", "md", "txt", "text")
    out.register(parse_html, "html", "htm")
    out.register(parse_docx, "docx")
    out.register(parse_xlsx, "xlsx")
    out.register(parse_pptx, "pptx")
    out.register(parse_pdf, "pdf")
    return out


def read_folder(spark: SparkSession, path: str) -> DataFrame:
    """Files of known suffixes below path, without hidden ones: path, file_name, title, source_type, source_hash, doc_id, content."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "content")
    below = F.substring_index(F.col("path"), path.rstrip("/").rpartition("/")[2], -1)
    kinds = "|".join(x[1:] for x in SOURCE_TYPE_BY_SUFFIX)
    rows = rows.where(~below.rlike(r"/\.") & F.col("path").rlike(rf"(?i)\.({kinds})$"))
    name = F.url_decode(basename(F.col("path")))
    rows = rows.withColumns({"file_name": name, "title": stem(name), "source_type": source_type(name), "source_hash": content_hash(F.col("content"))})
    return rows.withColumn("doc_id", sha256_id("doc", F.col("path")))


def scheme(uri: Column) -> Column:
    """minio, file or http; bare paths are files; null for any other scheme."""
    found = F.lower(F.regexp_extract(uri, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    return F.when(found.isin("", "file"), "file").when(found == "minio", "minio").when(found.isin("http", "https"), "http")


def read_uris(rows: DataFrame, uri: str, fetch: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """rows with content and error: each scheme by its own fetcher; an unknown one or a missing fetcher is an error."""
    kind, content = scheme(F.col(uri)), F.lit(None).cast("binary")
    for name, f in fetch.items():
        content = F.when(kind == name, f(F.col(uri))).otherwise(content)
    error = F.when(kind.isNull(), F.concat(F.lit("unknown scheme: "), F.col(uri))).when(~kind.isin(*fetch), F.concat(F.lit("no fetcher: "), kind))
    return rows.withColumns({"content": content, "error": error})


def fetcher(get: Callable[[str, float], bytes], timeout: float = 30.0):
    """A fetcher of http(s) URLs for read_uris: get(url, seconds) gives the bytes or raises. An empty URL, one of another
    scheme, an empty answer and a failure give no content; fetch_errors tells why."""

    @F.arrow_udf("struct<content: binary, error: string>")
    def run(uri: pa.Array) -> pa.Array:
        out = []
        for u in uri.to_pylist():
            if not u or not re.match("https?://", u):
                out.append({"content": None, "error": f"not an http URL: {u or ''}"})
                continue
            try:
                data = get(u, timeout)
                out.append({"content": data, "error": None} if data else {"content": None, "error": "empty"})
            except Exception as e:  # a failure is a value
                out.append({"content": None, "error": f"{type(e).__name__}: {e}"[:2000]})
        return pa.array(out, pa.struct([("content", pa.binary()), ("error", pa.string())]))

    return run


def download(rows: DataFrame, uri: str, get: Callable[[str, float], bytes], timeout: float = 30.0) -> DataFrame:
    """rows with data and fetch_error of their http(s) URLs."""
    got = rows.withColumn("__got", fetcher(get, timeout)(F.col(uri)))
    return got.withColumns({"data": F.col("__got.content"), "fetch_error": F.col("__got.error")}).drop("__got")


def share_page_json(html: Column, variable: str) -> Column:
    """The value of a JavaScript object in a page as JSON text: calls unwrapped, hex escapes and trailing commas mended."""
    raw = F.regexp_extract(html, rf"(?s){variable}\s*=\s*(\{{.*?\}})\s*;?\s*</script>", 1)
    out = F.regexp_replace(raw, r"(?:Boolean|Number|String)\(([^()]*)\)", "$1")
    out = F.regexp_replace(out, r"\\x([0-9A-Fa-f]{2})", r"\\u00$1")
    return F.nullif(F.regexp_replace(out, r",\s*([}\]])", "$1"), F.lit(""))


def read_eval_items(spark: SparkSession, path: str, doc_id: str | None = None) -> DataFrame:
    """Items of evaluation files: those without a query or without any label are left out. With a document's id, of
    the files below path whose names begin with it."""
    if doc_id is not None:
        path = f"{path.rstrip('/')}/{re.sub(r'([*?{}[\]\\])', r'\\\1', doc_id)}*.json"
    rows = spark.read.option("multiLine", "true").schema("items ARRAY<STRUCT<query: STRING, expected_chunk_ids: ARRAY<STRING>, expected_content_contains: ARRAY<STRING>, doc_id: STRING, source_doc_id: STRING, doc_version: INT, source: STRING>>").json(path)
    items = rows.select(F.explode("items").alias("i")).select("i.*")
    labels = F.coalesce(F.size("expected_chunk_ids"), F.lit(0)) + F.coalesce(F.size("expected_content_contains"), F.lit(0))
    return items.where((F.btrim("query") != "") & (labels > 0)).withColumn("doc_id", F.coalesce("doc_id", "source_doc_id")).drop("source_doc_id")


def write_eval_items(items: DataFrame, path: str) -> None:
    """One folder for each document; those of documents in items are replaced."""
    spark = items.sparkSession
    was = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        items.write.partitionBy("doc_id").mode("overwrite").json(path)
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", was)
