"""Index maintenance, references, outcomes, formats."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom import seams
from docloom.functions import scalar as S
from docloom.operators import catalog as C
from docloom.operators import mutations as M
from docloom.plans import extraction as X
from docloom.plans import retrieval as R
from docloom.queries import tables as T

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _assets(spark, d):
    """An asset for each order's line, and chunks (orders) that refer to them and to some that do not exist."""
    lines = T.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_returnflag").dropDuplicates(["l_orderkey", "l_linenumber"])
    key = F.concat(F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string"))
    return lines.select(key.alias("asset_id"), F.when(F.col("l_linenumber") % 2 == 0, "image").otherwise("web_link").alias("asset_type"), F.concat(F.lit("s/"), key).alias("storage_uri"))


@query("asset_refs_resolved", "WITH a AS (SELECT DISTINCT l_orderkey AS k, l_linenumber AS n FROM lineitem), r AS (SELECT o_orderkey AS chunk_id, n FROM orders, (SELECT unnest([3, 1, 9]) AS n)) SELECT r.chunk_id, string_agg(CASE WHEN a.n IS NULL THEN 'unknown' WHEN a.n % 2 = 0 THEN 'image' ELSE 'web_link' END || '|' || coalesce('s/' || a.k || '-' || a.n, ''), ';' ORDER BY CASE r.n WHEN 3 THEN 1 WHEN 1 THEN 2 ELSE 3 END) AS refs FROM r LEFT JOIN a ON a.k = r.chunk_id AND a.n = r.n GROUP BY 1")
def asset_refs_resolved(spark, d):
    ref = lambda n: F.struct(F.concat(F.col("o_orderkey").cast("string"), F.lit(f"-{n}")).alias("asset_id"), F.lit("c").alias("caption"))
    chunks = T.table(spark, d, "orders").select(F.col("o_orderkey").alias("chunk_id"), F.array(ref(3), ref(1), ref(9)).alias("asset_refs"))
    rows = C.with_assets(chunks, _assets(spark, d))
    return rows.select("chunk_id", F.array_join(F.transform("assets", lambda a: F.concat(a["asset_type"], F.lit("|"), a["storage_uri"])), ";").alias("refs"))


@query("chunks_citing_document", "WITH r AS (SELECT l_orderkey AS chunk_id, list(DISTINCT l_suppkey) AS refs FROM lineitem GROUP BY 1) SELECT count(*) AS citing FROM r WHERE list_contains(refs, 3)")
def chunks_citing_document(spark, d):
    rows = T.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.struct(F.col("l_suppkey").alias("doc_id"))).alias("source_refs"))
    return rows.where(C.cites(3)).agg(F.count("*").alias("citing"))


@query("index_sync", f"WITH {T.CHUNKS} SELECT c.chunk_id, c.category || '!' AS category FROM chunks c WHERE c.status <> 'deleted'")
def index_sync(spark, d):
    chunks = T.chunks(spark, d).withColumn("category", F.concat("category", F.lit("!")))
    index = chunks.select("chunk_id", F.lit("active").alias("status"), F.lit("old").alias("category"), F.lit("declarative").alias("knowledge_type"))
    return M.sync_index(index, chunks).select("chunk_id", "category")


@query("index_patch", f"WITH {T.CHUNKS} SELECT chunk_id, CASE WHEN chunk_id % 2 = 0 THEN 'patched' ELSE title END AS title, category FROM chunks")
def index_patch(spark, d):
    chunks = T.chunks(spark, d).select("chunk_id", "title", "category")
    new = chunks.where("chunk_id % 2 = 0").select("chunk_id", F.lit("patched").alias("title"), F.lit(None).cast("string").alias("category"))
    return M.patch(chunks, new, "chunk_id")


@query("index_rows", f"WITH {T.CHUNKS} SELECT c.chunk_id, substr(d.title, 1, 512) AS doc_title, length(substr(c.content, 1, 65535)) AS chars FROM chunks c JOIN docs d ON d.doc_id = c.doc_id WHERE c.status = 'active'")
def index_rows(spark, d):
    rows = R.index_rows(T.chunks(spark, d), T.documents(spark, d), seams.hashing_embedding(32))
    rows = R.checked_vectors(rows, "dense_vector", 32)
    return rows.where(F.size("dense_vector") == 32).select("chunk_id", "doc_title", F.length("content").cast("bigint").alias("chars"))


@query("upload_summary", f"WITH {T.DOCUMENTS} SELECT count(*) FILTER (WHERE status = 'active') AS success, count(*) FILTER (WHERE status = 'processing') AS duplicate, count(*) FILTER (WHERE status = 'failed') AS failed FROM docs")
def upload_summary(spark, d):
    outcome = F.when(F.col("status") == "active", "success").when(F.col("status") == "processing", "duplicate").otherwise(F.col("status"))
    return C.upload_summary(T.documents(spark, d).withColumn("outcome", outcome))


@query("health_rollup", "SELECT user_id, CASE WHEN count(*) FILTER (WHERE event_type = 'error' OR value IS NULL) > 0 THEN 'degraded' ELSE 'ok' END AS status, count(*) AS checks FROM events GROUP BY 1")
def health_rollup(spark, d):
    """Each user's events as checks, of which errors and those without a value fail."""
    bad = (F.col("event_type") == "error") | F.col("value").isNull()
    rows = T.table(spark, d, "events").withColumn("status", F.when(bad, "error").otherwise("ok"))
    return C.health(rows.groupBy("user_id")).join(rows.groupBy("user_id").agg(F.count("*").alias("checks")), "user_id")


@query("display_formats", "SELECT o_orderkey AS id, CASE WHEN k < 1024 THEN k || ' B' WHEN k < 1048576 THEN format('{:,.1f}', k / 1024) || ' KB' ELSE format('{:,.1f}', k / 1048576) || ' MB' END AS size, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS at FROM (SELECT *, o_orderkey * 640 AS k FROM orders)")
def display_formats(spark, d):
    return T.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), S.byte_size(F.col("o_orderkey") * 640).alias("size"), S.iso_time(F.col("o_orderdate")).alias("at"))


@query("answer_json", "SELECT item_id, CASE WHEN item_id % 5 = 1 THEN 2 ELSE 1 END AS chunks, text AS content FROM benchmark WHERE item_id % 5 <> 3 AND item_id % 5 <> 4")
def answer_json(spark, d):
    """Answers with JSON in a fence, in prose, alone, broken, and without the key that is asked for."""
    one = F.struct(F.col("text").alias("content"))
    k = F.col("item_id") % 5
    body = F.to_json(F.struct(F.when(k == 1, F.array(one, one)).otherwise(F.array(one)).alias("chunks")))
    answer = F.when(k == 0, F.concat(F.lit("Sure:\n```json\n"), body, F.lit("\n```\ndone {x}"))).when(k == 1, F.concat(F.lit("It is "), body, F.lit(" as asked"))).when(k == 2, body).when(k == 3, F.substring(body, F.lit(1), F.length(body) - 3)).otherwise(F.replace(body, F.lit('"chunks"'), F.lit('"parts"')))
    rows = T.table(spark, d, "benchmark").select("item_id", S.json_in_text(answer).alias("j"))
    found = F.from_json("j", X.ANSWER)["chunks"]
    return rows.where(S.has_keys(F.col("j"), ("chunks",))).select("item_id", F.size(found).alias("chunks"), found[0]["content"].alias("content"))


@query("query_rewrite", "SELECT item_id, trim(text) AS rewritten_query, len(list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'))) AS keywords FROM benchmark")
def query_rewrite(spark, d):
    q = seams.rewrite_query(F.col("text"))
    return T.table(spark, d, "benchmark").select("item_id", q["rewritten_query"].alias("rewritten_query"), F.size(q["keywords"]).cast("bigint").alias("keywords"))


@query("section_cuts")
def section_cuts(spark, d):
    """Recursive cutting is not plain SQL; tests hold it against worked cases."""
    rows = X.cut_documents(T.elements(spark, d), 1000, 800)
    return rows.groupBy("doc_id", "section").agg(F.min("seq").alias("first"), F.max("seq").alias("last"), F.count("*").alias("elements"))
