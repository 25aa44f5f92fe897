"""Queries along sequences and pages: sections, batches, layout, job feeds."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions import scalar as S
from docloom.operators import layout as L
from docloom.operators import sequence as Q
from docloom.queries import tables as T
from docloom.streaming import jobs as J

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


@query("section_split", f"WITH {T.SECTIONS} SELECT doc_id, seq, section FROM sectioned")
def section_split(spark, d):
    return Q.sections(T.elements(spark, d), 1).select("doc_id", "seq", "section")


@query("fallback_chunks", f"WITH {T.CHUNKS} SELECT chunk_id, title, content_hash, n_elements FROM chunks")
def fallback_chunks(spark, d):
    return T.chunks(spark, d).select("chunk_id", "title", "content_hash", "n_elements")


@query("section_paths", f"WITH RECURSIVE {T.ELEMENTS}, heads AS (SELECT doc_id, seq, text, heading_level, row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS k FROM elements WHERE element_type = 'title'), walk AS (SELECT doc_id, seq, k, [text] AS path FROM heads WHERE k = 1 UNION ALL SELECT h.doc_id, h.seq, h.k, list_append(w.path[1:least(len(w.path), h.heading_level - 1)], h.text) FROM walk w JOIN heads h ON h.doc_id = w.doc_id AND h.k = w.k + 1) SELECT e.doc_id, e.seq, coalesce(array_to_string(w.path, ' > '), '') AS path FROM elements e ASOF LEFT JOIN walk w ON w.doc_id = e.doc_id AND w.seq <= e.seq")
def section_paths(spark, d):
    return Q.heading_paths(T.elements(spark, d)).select("doc_id", "seq", F.array_join("section_path", " > ").alias("path"))


@query("contiguous_groups", "WITH v AS (SELECT DISTINCT l_suppkey AS k, l_orderkey AS v FROM lineitem), g AS (SELECT k, v, v - row_number() OVER (PARTITION BY k ORDER BY v) AS grp FROM v) SELECT k, min(v) AS first, max(v) AS last, count(*) AS size FROM g GROUP BY k, grp")
def contiguous_groups(spark, d):
    rows = T.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("k"), F.col("l_orderkey").alias("v"))
    return Q.islands(rows, ["k"], "v")


@query("cell_regions", "WITH c AS (SELECT l_orderkey AS k, CAST(l_linenumber AS BIGINT) AS row, CAST(l_quantity AS BIGINT) % 9 AS col FROM lineitem), r AS (SELECT k, min(v) r0, max(v) r1 FROM (SELECT k, v, v - row_number() OVER (PARTITION BY k ORDER BY v) g FROM (SELECT DISTINCT k, row AS v FROM c)) GROUP BY k, g), q AS (SELECT k, min(v) c0, max(v) c1 FROM (SELECT k, v, v - row_number() OVER (PARTITION BY k ORDER BY v) g FROM (SELECT DISTINCT k, col AS v FROM c)) GROUP BY k, g) SELECT r.k, r0, r1, c0, c1 FROM r JOIN q ON q.k = r.k WHERE EXISTS (SELECT 1 FROM c WHERE c.k = r.k AND c.row BETWEEN r0 AND r1 AND c.col BETWEEN c0 AND c1)")
def cell_regions(spark, d):
    rows = T.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").cast("bigint").alias("row"), (F.col("l_quantity").cast("bigint") % 9).alias("col"))
    return Q.regions(rows, ["k"])


@query("row_batching", "SELECT doc, batch, count(*) AS rows, min(span) AS first FROM (SELECT l_orderkey AS doc, CAST(l_linenumber AS BIGINT) AS span, CAST(floor((row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1) / 5) AS BIGINT) AS batch FROM lineitem) GROUP BY doc, batch")
def row_batching(spark, d):
    return Q.row_batches(T.boxes(spark, d), ["doc"], "span").groupBy("doc", "batch").agg(F.count("*").alias("rows"), F.min("span").alias("first"))


@query("placeholder_counter", "SELECT event_id, '{{' || event_type || ':' || row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) || '}}' AS placeholder FROM events")
def placeholder_counter(spark, d):
    return Q.placeholders(T.table(spark, d, "events"), ["user_id"], "event_type", "event_id").select("event_id", "placeholder")


_SIMILAR = "sims AS (SELECT vec_id, label, CASE WHEN nxt IS NOT NULL THEN round(list_dot_product(e, nxt) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(nxt, nxt))), 6) END AS similarity FROM (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e, CAST(lead(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS DOUBLE[]) AS nxt FROM embeddings))"


@query("semantic_breakpoints", f"WITH {_SIMILAR}, t AS (SELECT label, list_extract(list_sort(list(similarity)), CAST(floor(count(similarity) * 0.3) AS BIGINT) + 1) AS threshold FROM sims WHERE similarity IS NOT NULL GROUP BY label) SELECT s.vec_id, s.similarity, coalesce(CAST(sum(CASE WHEN s.similarity <= t.threshold THEN 1 ELSE 0 END) OVER (PARTITION BY s.label ORDER BY s.vec_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS section FROM sims s LEFT JOIN t ON t.label = s.label")
def semantic_breakpoints(spark, d):
    rows = Q.neighbour_similarity(T.table(spark, d, "embeddings"), ["label"], "vec_id", "embedding")
    rows = rows.withColumn("similarity", F.round("similarity", 6))
    return Q.breakpoints(rows, ["label"], "vec_id").select("vec_id", "similarity", "section")


_PACKING = f"""WITH RECURSIVE {T.ELEMENTS}, s AS (SELECT doc_id, list(length(text) ORDER BY seq) AS c, count(*) AS n, greatest(1, CAST(floor(count(*) * 0.2) AS BIGINT)) AS back FROM elements GROUP BY doc_id),
walk AS (SELECT doc_id, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS first, greatest(1, CAST(floor(c[1] / 1.2) AS BIGINT)) AS used, CAST(NULL AS BIGINT) AS wf, CAST(NULL AS BIGINT) AS wl FROM s UNION ALL
  SELECT doc_id, i, CASE WHEN closes THEN begin ELSE first END, CASE WHEN closes THEN greatest(1, CAST(floor(greatest(coalesce(list_sum(shared), 0) + len(shared) - 1, 0) / 1.2) AS BIGINT)) ELSE used END + own, CASE WHEN closes THEN first END, CASE WHEN closes THEN i - 1 END
  FROM (SELECT *, used + own > 400 AS closes, [x for x in c[begin + 1:begin + least(back, i - begin + 1)] if x > 0] AS shared
    FROM (SELECT w.doc_id, w.i + 1 AS i, w.first, w.used, s.c, s.back, greatest(1, CAST(floor(s.c[w.i + 2] / 1.2) AS BIGINT)) AS own, greatest(w.first, w.i + 1 - s.back) AS begin FROM walk w JOIN s ON s.doc_id = w.doc_id AND w.i + 1 < s.n)))
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY wl) - 1 AS "window", wf AS first, wl AS last FROM (SELECT doc_id, wf, wl FROM walk WHERE wf IS NOT NULL UNION ALL SELECT w.doc_id, w.first, s.n - 1 FROM walk w JOIN s ON s.doc_id = w.doc_id AND w.i = s.n - 1)"""


@query("token_packing", _PACKING)
def token_packing(spark, d):
    sizes = T.elements(spark, d).groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", F.length("text").alias("n")))), lambda x: x["n"]).alias("sizes"))
    return sizes.select("doc_id", F.posexplode(Q.pack_budget(F.col("sizes"), 400)).alias("window", "w")).select("doc_id", "window", "w.first", "w.last")


@query("bbox_best_match", f"WITH {T.BOXES}, links AS (SELECT doc, span AS link, x0 + 5 AS x0, y0 + 3 AS y0, x1 - 3 AS x1, y1 + 9 AS y1 FROM boxes WHERE span % 2 = 1), m AS (SELECT l.doc, l.link, b.span, round(greatest(0, least(l.x1, b.x1) - greatest(l.x0, b.x0)) * greatest(0, least(l.y1, b.y1) - greatest(l.y0, b.y0)) / ((b.x1 - b.x0) * (b.y1 - b.y0)), 12) AS share FROM links l JOIN boxes b ON b.doc = l.doc) SELECT doc, link, span, round(share, 6) AS share FROM (SELECT *, row_number() OVER (PARTITION BY doc, link ORDER BY share DESC, span) rn FROM m WHERE share >= 0.1) WHERE rn = 1")
def bbox_best_match(spark, d):
    b = T.boxes(spark, d)
    links = b.where("span % 2 = 1").select("doc", F.col("span").alias("link"), (F.col("x0") + 5).alias("x0"), (F.col("y0") + 3).alias("y0"), (F.col("x1") - 3).alias("x1"), (F.col("y1") + 9).alias("y1"))
    return L.best_overlap(links, b, ["doc"], "link", "span").withColumn("share", F.round("share", 6))


@query("interval_antijoin", f"WITH {T.BOXES}, t AS (SELECT doc, y0, y1 + 14 AS y1 FROM boxes WHERE text = 'R') SELECT doc, span FROM boxes b WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.doc = b.doc AND b.y0 <= t.y1 AND b.y1 >= t.y0)")
def interval_antijoin(spark, d):
    b = T.boxes(spark, d)
    tables = b.where("text = 'R'").select("doc", "y0", (F.col("y1") + 14).alias("y1"))
    return L.outside_ranges(b, tables, ["doc"]).select("doc", "span")


@query("header_footer_detect", "WITH b AS (SELECT l_suppkey AS file, l_orderkey AS page, l_linenumber * 15.0 AS y0, l_returnflag AS text FROM lineitem) SELECT file, CAST(floor(y0 / 10.0) AS BIGINT) AS y_bucket, text, count(DISTINCT page) AS pages FROM b GROUP BY 1, 2, 3 HAVING count(DISTINCT page) >= 3")
def header_footer_detect(spark, d):
    rows = T.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("file"), F.col("l_orderkey").alias("page"), (F.col("l_linenumber") * 15.0).alias("y0"), F.col("l_returnflag").alias("text"))
    return L.repeated_lines(rows, ["file"])


@query("block_fonts", f"WITH {T.BOXES}, f AS (SELECT doc, avg(size) AS size, bool_or(text = 'A') AS bold, string_agg(text, '' ORDER BY span, text) AS text FROM boxes GROUP BY doc) SELECT doc, round(size, 6) AS size, bold, text, CASE WHEN length(text) > 80 THEN 0 WHEN size >= 18 THEN 1 WHEN size >= 16 THEN 2 WHEN size >= 14 THEN 3 WHEN bold AND size BETWEEN 12 AND 13 THEN 3 ELSE 0 END AS level FROM f")
def block_fonts(spark, d):
    rows = T.boxes(spark, d).withColumnRenamed("span", "seq").withColumn("bold", F.col("text") == "A")
    fonts = L.block_fonts(rows, ["doc"])
    return fonts.withColumn("level", L.heading_level()).withColumn("size", F.round("size", 6)).select("doc", "size", "bold", "text", "level")


@query("a1_references", "SELECT l_orderkey AS doc, l_linenumber AS n, CASE WHEN c > 26 THEN chr(CAST(64 + (c - 1) // 26 AS INTEGER)) ELSE '' END || chr(CAST(65 + (c - 1) % 26 AS INTEGER)) || l_linenumber AS cell FROM (SELECT *, CAST(l_quantity AS BIGINT) * 3 + 1 AS c FROM lineitem)")
def a1_references(spark, d):
    c = (F.col("l_quantity").cast("bigint") * 3 + 1)
    return T.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("n"), F.concat(S.a1_column(c), F.col("l_linenumber").cast("string")).alias("cell"))


_CHANGES = "SELECT job_id, event_id, status, stage, progress FROM (SELECT *, lag(status || '|' || stage || '|' || progress) OVER (PARTITION BY job_id ORDER BY ts, event_id) AS was FROM jobs) WHERE was IS NULL OR was <> status || '|' || stage || '|' || progress"


@query("job_progress_changes", f"WITH {T.JOBS} {_CHANGES}")
def job_progress_changes(spark, d):
    return J.changes(T.jobs(spark, d)).select("job_id", "event_id", "status", "stage", "progress")


@query("job_timeouts", f"WITH {T.JOBS} SELECT job_id, count(*) AS n FROM jobs GROUP BY job_id HAVING NOT bool_or(status IN ('completed', 'failed')) AND min(ts) < TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 600 SECOND")
def job_timeouts(spark, d):
    rows = T.jobs(spark, d)
    return J.timed_out(rows, "2024-01-20 00:00:00").select("job_id").join(rows, "job_id").groupBy("job_id").agg(F.count("*").alias("n"))


@query("event_windows", "SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS events FROM events GROUP BY 1, 2")
def event_windows(spark, d):
    return J.windowed_counts(T.table(spark, d, "events")).withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))


@query("event_sessions", "WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events), n AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS session_start, count(*) AS events FROM n GROUP BY user_id, s")
def event_sessions(spark, d):
    return J.sessions(T.table(spark, d, "events")).select("user_id", F.date_format("session_start", "yyyy-MM-dd HH:mm:ss").alias("session_start"), "events")
