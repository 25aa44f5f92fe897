"""The catalogue's tables made from the driver's, in Spark and as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.scalar import content_hash, derive_title
from docloom.plans.chunking import fallback_chunks

STAGE_OF = {"signup": "queued", "view": "parsing", "click": "extracting", "purchase": "completed", "error": "failed"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of the catalogue: category is the language, status follows the labels."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    rows = table(spark, sf_dir, "documents").join(labels, "doc_id", "left")
    status = F.when(F.col("toxic") == 1, "deleted").when(F.col("quality") == 0, "failed").when(F.col("doc_id") % 17 == 0, "processing").otherwise("active")
    at = lambda minutes: F.timestamp_seconds(F.lit(1704067200) + 60 * minutes)
    return rows.select(
        "doc_id",
        derive_title(F.col("text")).alias("title"),
        F.col("source").alias("source_type"),
        F.concat(F.lit("file:///"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("source_uri"),
        content_hash(F.col("text")).alias("source_hash"),
        status.alias("status"),
        F.col("lang").alias("category"),
        F.when(F.col("doc_id") % 4 != 0, F.col("doc_id") - 1).alias("previous_doc_id"),
        F.when(F.col("doc_id") % 5 != 0, F.floor(F.col("doc_id") / 5) * 5).alias("parent_doc_id"),
        F.when(F.col("doc_id") % 10 == 5, F.col("doc_id") - 5).alias("root_doc_id"),
        F.lit(None).cast("string").alias("previous_status"),
        at(F.col("doc_id")).alias("created_at"),
        at(F.col("doc_id") * 7 % 10000).alias("updated_at"),
    )


DOCUMENTS = """docs AS (
  SELECT d.doc_id,
    CASE WHEN length(regexp_replace(split_part(split_part(d.text, '。', 1), '？', 1), '^\\s+|\\s+$', '', 'g')) > 40
      THEN substr(regexp_replace(split_part(split_part(d.text, '。', 1), '？', 1), '^\\s+|\\s+$', '', 'g'), 1, 40) || '...'
      ELSE regexp_replace(split_part(split_part(d.text, '。', 1), '？', 1), '^\\s+|\\s+$', '', 'g') END AS title,
    d.source AS source_type, 'file:///' || d.source || '/' || d.doc_id || '.txt' AS source_uri,
    'sha256:' || sha256(d.text) AS source_hash,
    CASE WHEN l.toxic = 1 THEN 'deleted' WHEN l.quality = 0 THEN 'failed' WHEN d.doc_id % 17 = 0 THEN 'processing' ELSE 'active' END AS status,
    d.lang AS category,
    CASE WHEN d.doc_id % 4 <> 0 THEN d.doc_id - 1 END AS previous_doc_id,
    CASE WHEN d.doc_id % 5 <> 0 THEN (d.doc_id // 5) * 5 END AS parent_doc_id,
    CASE WHEN d.doc_id % 10 = 5 THEN d.doc_id - 5 END AS root_doc_id,
    TIMESTAMP '2024-01-01 00:00:00' + to_minutes(d.doc_id) AS created_at,
    TIMESTAMP '2024-01-01 00:00:00' + to_minutes(d.doc_id * 7 % 10000) AS updated_at
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"""


def elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of each document: short ones are titles, of a level by their length."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "text"))
    title = F.length("text") <= 24
    return rows.select("doc_id", (F.col("pos") + 1).cast("bigint").alias("seq"), "text", F.when(title, "title").otherwise("paragraph").alias("element_type"), F.when(title, 1 + F.length("text") % 3).alias("heading_level"))


ELEMENTS = """lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS seq FROM documents),
elements AS (SELECT doc_id, CAST(seq AS BIGINT) AS seq, text, CASE WHEN length(text) <= 24 THEN 'title' ELSE 'paragraph' END AS element_type,
  CASE WHEN length(text) <= 24 THEN 1 + length(text) % 3 END AS heading_level FROM lines)"""

SECTIONS = (
    ELEMENTS
    + """,
sectioned AS (SELECT *, CAST(sum(CASE WHEN rn = 1 THEN 1 WHEN element_type = 'title' AND heading_level = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS section
  FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS rn FROM elements))"""
)


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chunk for each section of a document."""
    rows = fallback_chunks(elements(spark, sf_dir))
    docs = documents(spark, sf_dir).select("doc_id", "status", "category")
    kind = F.when(F.col("section") % 3 == 0, "declarative").when(F.col("section") % 3 == 1, "relational").otherwise("procedural")
    joined = rows.join(docs, "doc_id")
    return joined.select((F.col("doc_id") * 100000 + F.col("section")).alias("chunk_id"), "doc_id", "section", "title", "content", "content_hash", "n_elements", kind.alias("knowledge_type"), "category", F.when(F.col("status") == "deleted", "deleted").otherwise("active").alias("status"))


CHUNKS = (
    DOCUMENTS
    + ",\n"
    + SECTIONS
    + """,
grouped AS (SELECT doc_id, section, string_agg(text, chr(10) ORDER BY seq) AS content, coalesce(arg_min(text, seq) FILTER (WHERE element_type = 'title'), '') AS title, count(*) AS n_elements
  FROM sectioned WHERE regexp_replace(text, '\\s', '', 'g') <> '' GROUP BY doc_id, section),
chunks AS (SELECT g.doc_id * 100000 + g.section AS chunk_id, g.doc_id, g.section, g.title, g.content, 'sha256:' || sha256(g.content) AS content_hash, g.n_elements,
  CASE g.section % 3 WHEN 0 THEN 'declarative' WHEN 1 THEN 'relational' ELSE 'procedural' END AS knowledge_type, d.category,
  CASE WHEN d.status = 'deleted' THEN 'deleted' ELSE 'active' END AS status
  FROM grouped g JOIN docs d ON d.doc_id = g.doc_id)"""
)


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Job rows from events: a job for each user, its stage from the event's type."""
    stage = F.create_map(*[F.lit(x) for kv in STAGE_OF.items() for x in kv])[F.col("event_type")]
    status = F.when(stage.isin("completed", "failed", "queued"), stage).otherwise("processing")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), "event_id", "ts", status.alias("status"), stage.alias("stage"), F.floor("value").cast("bigint").alias("progress"))


JOBS = """jobs AS (SELECT user_id AS job_id, event_id, ts,
  CASE event_type WHEN 'signup' THEN 'queued' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'processing' END AS status,
  CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'parsing' WHEN 'click' THEN 'extracting' WHEN 'purchase' THEN 'completed' ELSE 'failed' END AS stage,
  CAST(floor(value) AS BIGINT) AS progress FROM events)"""


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages' URLs, some with a suffix added so that every kind of link occurs."""
    kinds = ["", "/a.PNG", "/b.mp4", "/c.mp3?x=1", "/d.pdf", "/e.tar.gz", "/youtube.com/w", "/f.md/"]
    ends = F.get(F.array(*map(F.lit, kinds)), (F.col("page_id") % len(kinds)).cast("int"))
    base = F.regexp_replace("url", r"[?#].*$", "")
    return table(spark, sf_dir, "pages").select("page_id", F.concat(base, ends).alias("link"), ends.alias("name"))


LINKS = """links AS (SELECT page_id, regexp_replace(url, '[?#].*$', '') || e AS link, e AS name
  FROM (SELECT page_id, url, list_extract(['', '/a.PNG', '/b.mp4', '/c.mp3?x=1', '/d.pdf', '/e.tar.gz', '/youtube.com/w', '/f.md/'], CAST(page_id % 8 AS BIGINT) + 1) AS e FROM pages))"""


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layout spans from line items: an order is a page, a line item a box."""
    q, n = F.col("l_quantity"), F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), n.cast("bigint").alias("span"), (q * 2).alias("x0"), (n * 15.0 + q % 7).alias("y0"), (q * 2 + 60 + q % 11).alias("x1"), (n * 15.0 + q % 7 + 12).alias("y1"), F.col("l_returnflag").alias("text"), (10 + F.col("l_partkey") % 9).cast("double").alias("size"))


BOXES = """boxes AS (SELECT l_orderkey AS doc, CAST(l_linenumber AS BIGINT) AS span, l_quantity * 2 AS x0, l_linenumber * 15.0 + l_quantity % 7 AS y0, l_quantity * 2 + 60 + l_quantity % 11 AS x1,
  l_linenumber * 15.0 + l_quantity % 7 + 12 AS y1, l_returnflag AS text, CAST(10 + l_partkey % 9 AS DOUBLE) AS size FROM lineitem)"""
