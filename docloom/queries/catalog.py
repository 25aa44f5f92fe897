"""Catalogue queries: listing, joins, facets, writes, lifecycle, duplicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions import scalar as S
from docloom.operators import catalog as C
from docloom.operators import dedup as D
from docloom.operators import mutations as M
from docloom.queries import tables as T

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


@query("doc_list_page", f"WITH {T.DOCUMENTS} SELECT doc_id, title, category, strftime(updated_at, '%Y-%m-%dT%H:%M:%SZ') AS updated_at FROM docs WHERE (title ILIKE '%on%' OR source_uri ILIKE '%on%') AND status = 'active' AND category = 'en' ORDER BY docs.updated_at DESC NULLS FIRST, doc_id LIMIT 20 OFFSET 20")
def doc_list_page(spark, d):
    rows = T.documents(spark, d).where(C.document_filter("on", status="active", category="en"))
    return C.document_items(C.page(rows, C.ordering(rows, "updated_at", "desc", "doc_id"), 2, 20)).select("doc_id", "title", "category", "updated_at")


@query("doc_list_total", f"WITH {T.DOCUMENTS} SELECT count(*) AS total, CAST(ceil(count(*) / 20.0) AS BIGINT) AS total_pages FROM docs WHERE status = 'active'")
def doc_list_total(spark, d):
    return C.page_info(T.documents(spark, d).where(C.document_filter(status="active")), 20)


@query("doc_get_batch", f"WITH {T.DOCUMENTS} SELECT doc_id, title FROM docs WHERE doc_id IN (SELECT item_id * 3 FROM benchmark)")
def doc_get_batch(spark, d):
    keys = T.table(spark, d, "benchmark").select((F.col("item_id") * 3).alias("doc_id"))
    return C.get_batch(T.documents(spark, d), "doc_id", keys).select("doc_id", "title")


@query("doc_stats_join", f"WITH {T.CHUNKS} SELECT d.doc_id, coalesce(e.n, 0) AS elements_count, coalesce(c.n, 0) AS chunks_count FROM docs d LEFT JOIN (SELECT doc_id, count(*) n FROM elements GROUP BY 1) e ON e.doc_id = d.doc_id LEFT JOIN (SELECT doc_id, count(*) n FROM chunks GROUP BY 1) c ON c.doc_id = d.doc_id")
def doc_stats_join(spark, d):
    return C.with_child_counts(T.documents(spark, d), elements=T.elements(spark, d), chunks=T.chunks(spark, d)).select("doc_id", "elements_count", "chunks_count")


@query("chunk_doc_title_search", f"WITH {T.CHUNKS} SELECT c.chunk_id, d.title AS doc_title, d.source_type FROM chunks c JOIN docs d ON d.doc_id = c.doc_id WHERE d.title ILIKE '%the%' AND c.status = 'active'")
def chunk_doc_title_search(spark, d):
    rows = C.with_document(T.chunks(spark, d), T.documents(spark, d), how="inner")
    return rows.where(C.chunk_filter("the", "doc_title", status="active")).select("chunk_id", "doc_title", "source_type")


@query("chunk_preview", f"WITH {T.CHUNKS} SELECT chunk_id, CASE WHEN length(content) > 200 THEN substr(content, 1, 200) || '...' ELSE content END AS content_preview, n_elements AS source_count FROM chunks WHERE knowledge_type = 'relational'")
def chunk_preview(spark, d):
    rows = T.chunks(spark, d).where(C.chunk_filter(knowledge_type="relational")).withColumn("source_refs", F.sequence(F.lit(1), F.col("n_elements")))
    return C.chunk_items(rows).select("chunk_id", "content_preview", "source_count")


@query("array_nonempty_filter", f"WITH {T.CHUNKS} SELECT doc_id, count(*) AS empty FROM chunks WHERE n_elements <= 1 GROUP BY doc_id")
def array_nonempty_filter(spark, d):
    rows = T.chunks(spark, d).withColumn("source_refs", F.filter(F.sequence(F.lit(1), F.col("n_elements")), lambda x: x > 1))
    return rows.where(C.non_empty("source_refs", False)).groupBy("doc_id").agg(F.count("*").alias("empty"))


@query("time_range_filter", f"WITH {T.DOCUMENTS} SELECT doc_id FROM docs WHERE created_at >= TIMESTAMP '2024-01-01 03:00:00' AND updated_at <= TIMESTAMP '2024-01-05 00:00:00'")
def time_range_filter(spark, d):
    return T.documents(spark, d).where(C.time_filter(created_after="2024-01-01 03:00:00", updated_before="2024-01-05 00:00:00")).select("doc_id")


@query("filename_match", f"WITH {T.DOCUMENTS} SELECT a.doc_id, count(*) AS same FROM docs a JOIN docs b ON lower(regexp_extract(a.source_uri, '[^/]*$')) = lower(regexp_extract(b.source_uri, '[^/]*$')) WHERE b.status = 'active' GROUP BY a.doc_id")
def filename_match(spark, d):
    docs = T.documents(spark, d)
    return C.same_names(docs, docs.where("status = 'active'"), S.basename(F.col("source_uri")))


@query("count_by_status", f"WITH {T.DOCUMENTS} SELECT status, count(*) AS count FROM docs GROUP BY status")
def count_by_status(spark, d):
    return C.count_by_status(T.documents(spark, d))


@query("facets", f"WITH {T.CHUNKS} SELECT 'category' AS facet, category AS value, count(*) AS count FROM chunks GROUP BY 2 UNION ALL SELECT 'knowledge_type', knowledge_type, count(*) FROM chunks GROUP BY 2 UNION ALL SELECT 'status', status, count(*) FROM chunks GROUP BY 2")
def facets(spark, d):
    return C.facets(T.chunks(spark, d))


@query("category_facet", f"WITH {T.DOCUMENTS} SELECT coalesce(nullif(category, ''), '通用') AS value, count(*) AS count FROM docs GROUP BY 1")
def category_facet(spark, d):
    return C.category_facet(T.documents(spark, d))


@query("dashboard_kpis", f"WITH {T.CHUNKS} SELECT (SELECT count(*) FROM docs) AS documents, (SELECT count(*) FROM docs WHERE status = 'failed') AS failed, (SELECT count(*) FROM docs WHERE status = 'processing') AS processing, (SELECT count(*) FROM chunks) AS chunks")
def dashboard_kpis(spark, d):
    return C.dashboard(T.documents(spark, d), T.chunks(spark, d))


@query("chunk_counts_by_category", f"WITH {T.CHUNKS} SELECT d.category, count(*) AS documents, CAST(coalesce(sum(n), 0) AS BIGINT) AS chunks FROM docs d LEFT JOIN (SELECT doc_id, count(*) n FROM chunks GROUP BY 1) c ON c.doc_id = d.doc_id GROUP BY 1")
def chunk_counts_by_category(spark, d):
    return C.chunk_counts_by_category(T.documents(spark, d), T.chunks(spark, d))


@query("latest_active_job", f"WITH {T.JOBS} SELECT doc_id, event_id, status FROM (SELECT job_id AS doc_id, event_id, status, row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, event_id DESC) rn FROM jobs WHERE status IN ('queued', 'processing')) WHERE rn = 1")
def latest_active_job(spark, d):
    rows = T.jobs(spark, d).select(F.col("job_id").alias("doc_id"), F.col("event_id").alias("job_id"), F.col("ts").alias("created_at"), "status")
    return C.latest_active_job(rows).select("doc_id", F.col("job_id").alias("event_id"), "status")


@query("stale_recovery", f"WITH {T.DOCUMENTS} SELECT doc_id, CASE WHEN status = 'processing' AND updated_at < TIMESTAMP '2024-01-04 00:00:00' - INTERVAL 30 MINUTE THEN 'failed' ELSE status END AS status FROM docs")
def stale_recovery(spark, d):
    docs = T.documents(spark, d).withColumn("error_message", F.lit(None).cast("string"))
    return M.fail_stale(docs, "2024-01-04 00:00:00", 30, "timed out").select("doc_id", "status")


@query("root_resolution", f"WITH {T.DOCUMENTS} SELECT c.doc_id, coalesce(p.root_doc_id, p.doc_id) AS root FROM docs c LEFT JOIN docs p ON p.doc_id = c.parent_doc_id")
def root_resolution(spark, d):
    return C.with_root(T.documents(spark, d)).select("doc_id", "root")


@query("version_chain", f"WITH RECURSIVE {T.DOCUMENTS}, chain AS (SELECT doc_id, doc_id AS ancestor, 0 AS depth FROM docs UNION ALL SELECT c.doc_id, d.previous_doc_id, c.depth + 1 FROM chain c JOIN docs d ON d.doc_id = c.ancestor JOIN docs p ON p.doc_id = d.previous_doc_id) SELECT doc_id, ancestor, CAST(depth AS BIGINT) AS depth FROM chain")
def version_chain(spark, d):
    docs = T.documents(spark, d)
    return C.version_chain(docs, docs.select("doc_id")).select("doc_id", "ancestor", "depth")


@query("version_history", "WITH RECURSIVE v AS (SELECT doc_id, CASE WHEN doc_id % 1300 <> 0 THEN doc_id - 1 END AS prev FROM documents), chain AS (SELECT doc_id, doc_id AS ancestor, 0 AS depth FROM v WHERE doc_id NOT IN (SELECT prev FROM v WHERE prev IS NOT NULL) UNION ALL SELECT c.doc_id, p.doc_id, c.depth + 1 FROM chain c JOIN v ON v.doc_id = c.ancestor JOIN v p ON p.doc_id = v.prev) SELECT doc_id, ancestor, CAST(depth AS BIGINT) AS depth FROM chain")
def version_history(spark, d):
    """Chains of up to 1300 versions, each from its newest one."""
    docs = T.table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 1300 != 0, F.col("doc_id") - 1).alias("previous_doc_id"))
    return C.version_chain(docs)


@query("cleanup_anti", f"WITH {T.CHUNKS} SELECT doc_id, count(*) AS chunks FROM chunks WHERE doc_id NOT IN (SELECT doc_id FROM docs WHERE status = 'failed') GROUP BY doc_id")
def cleanup_anti(spark, d):
    gone = T.documents(spark, d).where("status = 'failed'")
    return M.delete_cascade(gone, {"chunks": T.chunks(spark, d)})["chunks"].groupBy("doc_id").agg(F.count("*").alias("chunks"))


@query("cascade_preview", f"WITH {T.CHUNKS}, gone AS (SELECT doc_id FROM docs WHERE category = 'de') SELECT 'chunks' AS \"table\", count(*) AS count FROM chunks WHERE doc_id IN (SELECT doc_id FROM gone) UNION ALL SELECT 'elements', count(*) FROM elements WHERE doc_id IN (SELECT doc_id FROM gone)")
def cascade_preview(spark, d):
    gone = T.documents(spark, d).where("category = 'de'")
    return M.cascade_counts(gone, {"chunks": T.chunks(spark, d), "elements": T.elements(spark, d)})


_BATCH = "batch AS (SELECT doc_id + 2 * (SELECT count(*) FROM documents) // 3 AS doc_id, title, status, seq FROM (SELECT doc_id, 'new ' || title AS title, 'pending' AS status, doc_id AS seq FROM docs WHERE category = 'fr' UNION ALL SELECT doc_id, 'late ' || title, 'active', doc_id + 1000000 FROM docs WHERE category = 'fr' AND doc_id % 2 = 0)), last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY seq DESC) rn FROM batch) WHERE rn = 1)"


@query("upsert_merge", f"WITH {T.DOCUMENTS}, {_BATCH} SELECT coalesce(d.doc_id, b.doc_id) AS doc_id, CASE WHEN b.doc_id IS NOT NULL THEN b.title ELSE d.title END AS title, CASE WHEN b.doc_id IS NOT NULL THEN b.status ELSE d.status END AS status FROM docs d FULL JOIN last b ON b.doc_id = d.doc_id")
def upsert_merge(spark, d):
    docs = T.documents(spark, d)
    shift = docs.count() * 2 // 3
    fr = docs.where("category = 'fr'")
    one = fr.select((F.col("doc_id") + shift).alias("doc_id"), F.concat(F.lit("new "), "title").alias("title"), F.lit("pending").alias("status"), F.col("doc_id").alias("seq"))
    two = fr.where("doc_id % 2 = 0").select((F.col("doc_id") + shift).alias("doc_id"), F.concat(F.lit("late "), "title").alias("title"), F.lit("active").alias("status"), (F.col("doc_id") + 1000000).alias("seq"))
    batch = M.last_of_batch(one.unionByName(two), "doc_id", "seq").drop("seq")
    return M.upsert(docs.select("doc_id", "title", "status"), batch, "doc_id")


@query("soft_delete_cascade", f"WITH {T.CHUNKS} SELECT c.chunk_id, CASE WHEN d.status = 'deleted' OR d.category = 'es' THEN 'deleted' WHEN d.status = 'active' THEN 'active' ELSE c.status END AS status, CASE WHEN d.category = 'es' AND d.status <> 'deleted' THEN d.status END AS previous_status FROM chunks c JOIN docs d ON d.doc_id = c.doc_id")
def soft_delete_cascade(spark, d):
    docs = T.documents(spark, d)
    after = M.soft_delete(docs, docs.where("category = 'es'"))
    return M.follow_documents(T.chunks(spark, d), after).join(after.select("doc_id", "previous_status"), "doc_id").select("chunk_id", "status", "previous_status")


@query("restore_roundtrip", f"WITH {T.DOCUMENTS} SELECT doc_id, CASE WHEN status = 'active' THEN 'active' WHEN status = 'deleted' THEN 'processing' ELSE 'processing' END AS status, category <> 'es' AND status = 'deleted' AS still FROM docs WHERE category = 'es' UNION ALL SELECT doc_id, status, status = 'deleted' FROM docs WHERE category = 'fr'")
def restore_roundtrip(spark, d):
    """Deleting and restoring Spanish documents; French ones, some deleted before, are left alone."""
    docs = T.documents(spark, d).where("category in ('es', 'fr')")
    asked = docs.where("category = 'es'")
    after = M.restore(M.soft_delete(docs, asked), asked)
    return after.select("doc_id", "status", (F.col("status") == "deleted").alias("still"))


@query("content_hash_dedup", "WITH u AS (SELECT doc_id, 'sha256:' || sha256(text) AS h FROM documents), live AS (SELECT h, min(doc_id) AS id FROM u WHERE doc_id % 3 = 0 GROUP BY h) SELECT u.doc_id, CASE WHEN live.id IS NOT NULL OR first_id < u.doc_id THEN 'duplicate' ELSE 'success' END AS outcome, coalesce(live.id, CASE WHEN first_id < u.doc_id THEN first_id END) AS existing_id FROM (SELECT *, min(doc_id) OVER (PARTITION BY h) AS first_id FROM u WHERE doc_id % 3 <> 0) u LEFT JOIN live ON live.h = u.h")
def content_hash_dedup(spark, d):
    rows = T.table(spark, d, "documents").select("doc_id", S.content_hash(F.col("text")).alias("source_hash"))
    live = rows.where("doc_id % 3 = 0").withColumn("status", F.lit("active"))
    return D.upload_outcomes(rows.where("doc_id % 3 <> 0"), live, "doc_id").select("doc_id", "outcome", "existing_id")


@query("hash_violations", f"WITH {T.DOCUMENTS} SELECT source_hash, count(*) AS count FROM docs WHERE status IN ('active', 'processing') GROUP BY 1 HAVING count(*) > 1")
def hash_violations(spark, d):
    return D.hash_violations(T.documents(spark, d))


@query("chunk_dedup_exclude_self", f"WITH {T.CHUNKS} SELECT a.chunk_id, min(b.chunk_id) AS other FROM chunks a JOIN chunks b ON b.content_hash = a.content_hash AND b.chunk_id <> a.chunk_id GROUP BY 1")
def chunk_dedup_exclude_self(spark, d):
    return D.duplicates_of_others(T.chunks(spark, d), "chunk_id")


@query("asset_dedup_reuse", f"WITH {T.DOCUMENTS} SELECT a.doc_id AS asset_id, CASE WHEN f.id < a.doc_id THEN f.id END AS reused_from, CASE WHEN f.id < a.doc_id THEN f.uri ELSE a.source_uri END AS storage_uri FROM docs a LEFT JOIN (SELECT source_hash, min(doc_id) AS id, arg_min(source_uri, doc_id) AS uri FROM docs WHERE status = 'active' GROUP BY 1) f ON f.source_hash = a.source_hash")
def asset_dedup_reuse(spark, d):
    docs = T.documents(spark, d)
    assets = docs.select(F.col("doc_id").alias("asset_id"), F.col("source_hash").alias("content_hash"), F.col("source_uri").alias("storage_uri"), F.when(F.col("status") == "active", "ready").otherwise("failed").alias("status"), F.col("title").alias("extracted_text"))
    return D.reuse_assets(assets).select("asset_id", "reused_from", "storage_uri")


@query("restore_collision", f"WITH {T.DOCUMENTS} SELECT doc_id, CASE WHEN source_hash IN (SELECT source_hash FROM docs WHERE status IN ('active', 'processing')) THEN 'restored:' || doc_id ELSE source_hash END AS restored_hash FROM docs WHERE status = 'deleted'")
def restore_collision(spark, d):
    return D.restore_hash(T.documents(spark, d))


_SUFFIX = "CASE WHEN regexp_matches(n, '^\\.*[^.].*\\.[^.]+$') THEN lower(regexp_extract(n, '(\\.[^.]+)$', 1)) ELSE '' END"


def _isin(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def _ending(values) -> str:
    return "'(" + "|".join(v.replace(".", "\\.") for v in values) + ")$'"


@query(
    "classify_link",
    f"WITH {T.LINKS}, p AS (SELECT *, regexp_replace(lower(link), '/+$', '') AS low FROM links), q AS (SELECT *, regexp_replace(regexp_replace(low, '^[a-z]+:', ''), '^//[^/]*', '') AS pp FROM (SELECT *, regexp_replace(low, '[?#].*$', '') AS low2 FROM p)), r AS (SELECT *, regexp_replace(regexp_replace(low2, '^[a-z]+:', ''), '^//[^/]*', '') AS path FROM q) "
    f"SELECT page_id, CASE WHEN regexp_matches(path, {_ending(S.LINK_IMAGE_SUFFIXES)}) THEN 'image' WHEN regexp_matches(path, {_ending(S.LINK_VIDEO_SUFFIXES)}) OR regexp_matches(low, 'youtube\\.com|youtu\\.be|bilibili\\.com|vimeo\\.com') THEN 'video' WHEN regexp_matches(path, {_ending(S.LINK_AUDIO_SUFFIXES)}) THEN 'audio' WHEN regexp_matches(path, {_ending(S.LINK_DOCUMENT_SUFFIXES)}) THEN 'document' ELSE 'url' END AS kind FROM r",
)
def classify_link(spark, d):
    return T.links(spark, d).select("page_id", S.classify_link(F.col("link")).alias("kind"))


@query(
    "link_suffix_types",
    f"WITH {T.LINKS}, s AS (SELECT page_id, {_SUFFIX} AS x FROM (SELECT page_id, regexp_extract(regexp_replace(split_part(link, '?', 1), '/+$', ''), '[^/]*$') AS n FROM links)) "
    f"SELECT page_id, x AS suffix, CASE WHEN x IN {_isin(S.TEXT_IMAGE_SUFFIXES)} THEN 'image_link' WHEN x IN {_isin(S.TEXT_VIDEO_SUFFIXES)} THEN 'video_link' WHEN x IN {_isin(S.ATTACHMENT_SUFFIXES)} THEN 'document_link' ELSE 'web_link' END AS text_type, "
    f"CASE x {' '.join(f'WHEN {chr(39)}{k}{chr(39)} THEN {chr(39)}{v}{chr(39)}' for k, v in S.MIME_BY_SUFFIX.items())} ELSE 'application/octet-stream' END AS mime, CASE x {' '.join(f'WHEN {chr(39)}{k}{chr(39)} THEN {chr(39)}{v}{chr(39)}' for k, v in S.SOURCE_TYPE_BY_SUFFIX.items())} ELSE 'unknown' END AS source_type, x IN {_isin(S.ATTACHMENT_SUFFIXES)} AS attachment FROM s",
)
def link_suffix_types(spark, d):
    x = F.col("link")
    return T.links(spark, d).select("page_id", S.suffix(x).alias("suffix"), S.classify_link_text(x).alias("text_type"), S.guess_mime(x, F.lit("document_link")).alias("mime"), S.source_type(x).alias("source_type"), S.is_attachment_url(x).alias("attachment"))


@query("text_functions", "SELECT doc_id, greatest(1, CAST(floor(length(text) / 1.2) AS BIGINT)) AS tokens, CASE WHEN length(text) > 250 THEN substr(text, 1, 250) || '…' ELSE text END AS shown, regexp_replace(regexp_replace('{{image:' || doc_id || '}} ' || text, '\\{\\{(image|doc|video|web|res):\\d+\\}\\}', '', 'g'), '^\\s+|\\s+$', '', 'g') AS plain, regexp_replace(regexp_replace(text, '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g') AS flat FROM documents")
def text_functions(spark, d):
    text = F.col("text")
    return T.table(spark, d, "documents").select("doc_id", S.token_estimate(F.length(text)).alias("tokens"), S.truncate(text, 250, "…").alias("shown"), S.strip_placeholders(F.concat(F.lit("{{image:"), F.col("doc_id").cast("string"), F.lit("}} "), text)).alias("plain"), S.normalize_text(text).alias("flat"))


@query("blob_keys", "SELECT page_id, CASE WHEN page_id % 7 <> 0 THEN substr(h, 1, 2) || '/' || h || CASE page_id % 3 WHEN 0 THEN '.pdf' WHEN 1 THEN '.png' ELSE '' END END AS key, CASE WHEN page_id % 7 <> 0 THEN 'b' || page_id % 5 END AS bucket, page_id % 7 <> 0 AS valid FROM (SELECT page_id, sha256(html) AS h FROM pages)")
def blob_keys(spark, d):
    """Places of contents of a known, another and no known type in several buckets; some of another store."""
    i = F.col("page_id")
    mime = F.when(i % 3 == 0, "application/pdf").when(i % 3 == 1, "image/png").otherwise("x/unknown")
    key = S.blob_key(F.sha2(F.col("html").cast("binary"), 256), mime)
    uri = F.concat(F.when(i % 7 == 0, "other").otherwise("minio"), F.lit("://b"), (i % 5).cast("string"), F.lit("/"), key)
    return T.table(spark, d, "pages").select("page_id", S.parse_store_uri(uri).alias("u")).select("page_id", "u.key", "u.bucket", "u.valid")


_MAGIC = ["89504E470D0A1A0A00000000", "FFD8FFE000104A4649460001", "474946383961010001000000", "524946460000000057454250", "424D00000000000000000000", "000000186674797069736F6D", "000000146674797071742020", "1A45DFA30100000000000000", "524946460000000041564920", "0A203C68746D6C3E00000000"]
_TYPES = ["image/png", "image/jpeg", "image/gif", "image/webp", "image/bmp", "video/mp4", "video/quicktime", "video/webm", "video/avi", "html"]


_HEX = f"hex(unhex(concat(list_extract([{', '.join(repr(x) for x in _MAGIC)}], CAST(doc_id % 10 AS BIGINT) + 1)[1:24 - 2 * (doc_id // 10 % 4)])) || encode(text))"


@query("mime_sniff", f"WITH h AS (SELECT doc_id, {_HEX} AS h FROM documents), k AS (SELECT doc_id, h, h[1:24] AS a, length(h) >= 24 AS f FROM h) SELECT doc_id, CASE WHEN a LIKE '89504E470D0A1A0A%' THEN 'image/png' WHEN a LIKE 'FFD8FF%' THEN 'image/jpeg' WHEN a LIKE '474946383761%' OR a LIKE '474946383961%' THEN 'image/gif' WHEN a LIKE '52494646________57454250' THEN 'image/webp' WHEN a LIKE '424D%' THEN 'image/bmp' WHEN a LIKE '________6674797071742020%' THEN 'video/quicktime' WHEN f AND a LIKE '________66747970%' THEN 'video/mp4' WHEN a LIKE '1A45DFA3%' THEN 'video/webm' WHEN a LIKE '52494646________41564920' THEN 'video/avi' WHEN regexp_matches(h[1:400], '^(20|09|0A|0B|0C|0D)*3C') THEN 'html' END AS kind FROM k")
def mime_sniff(spark, d):
    """First bytes of files of many kinds, whole or cut short by up to three bytes, before the documents' texts."""
    i = F.col("doc_id")
    head = F.substring(F.get(F.array(*map(F.lit, _MAGIC)), (i % 10).cast("int")), F.lit(1), F.lit(24) - 2 * (F.floor(i / 10) % 4).cast("int"))
    data = F.concat(F.unhex(head), F.col("text").cast("binary"))
    return T.table(spark, d, "documents").select("doc_id", F.coalesce(S.sniff_image(data), S.sniff_video(data), F.when(S.looks_like_html(data), "html")).alias("kind"))


@query("customer_orders", "SELECT c.c_custkey AS custkey, n.n_name AS nation, count(o.o_orderkey) AS orders, round(coalesce(sum(o.o_totalprice), 0), 2) AS total FROM customer c JOIN nation n ON n.n_nationkey = c.c_nationkey LEFT JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY 1, 2")
def customer_orders(spark, d):
    orders = T.table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("orders"), F.sum("o_totalprice").alias("total"))
    rows = T.table(spark, d, "customer").join(T.table(spark, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey")).join(orders, F.col("o_custkey") == F.col("c_custkey"), "left")
    return rows.select(F.col("c_custkey").alias("custkey"), F.col("n_name").alias("nation"), F.coalesce("orders", F.lit(0)).alias("orders"), F.round(F.coalesce("total", F.lit(0.0)), 2).alias("total"))
