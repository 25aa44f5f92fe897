"""Scans, single writes, links in texts, small functions, merged cells, model answers, stored evaluation files."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions import scalar as S
from docloom.operators import catalog as C
from docloom.operators import mutations as M
from docloom.operators import sequence as Q
from docloom.plans import evaluation as E
from docloom.plans import extraction as X
from docloom.queries import retrieval as RQ
from docloom.queries import tables as T
from docloom.sources import files, model
from docloom.store import new_folder

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


# -- scans

@query("get_by_key", f"WITH {T.DOCUMENTS} SELECT doc_id, title, status FROM docs WHERE doc_id = 37")
def get_by_key(spark, d):
    return C.get(T.documents(spark, d), "doc_id", 37).select("doc_id", "title", "status")


@query("children_scan", f"WITH {T.CHUNKS} SELECT doc_id, 'element' AS kind, seq AS place, text FROM elements WHERE doc_id % 11 = 3 UNION ALL SELECT doc_id, 'chunk', section, content FROM chunks WHERE doc_id % 11 = 3")
def children_scan(spark, d):
    """All elements and chunks of some documents, by their key."""
    keys = T.table(spark, d, "documents").where("doc_id % 11 = 3").select("doc_id")
    one = lambda t, kind, place, text: C.get_batch(t, "doc_id", keys).select("doc_id", F.lit(kind).alias("kind"), F.col(place).alias("place"), F.col(text).alias("text"))
    return one(T.elements(spark, d), "element", "seq", "text").unionByName(one(T.chunks(spark, d), "chunk", "section", "content"))


@query("chunk_scan", f"WITH {T.CHUNKS} SELECT chunk_id, row_number() OVER (ORDER BY chunk_id) AS place FROM chunks WHERE category = 'de'")
def chunk_scan(spark, d):
    """All chunks of a category in the order of their ids, each with its place: what an ordered scan gives."""
    return C.numbered(T.chunks(spark, d).where("category = 'de'").select("chunk_id"), ["chunk_id"], "place")


@query("jobs_by_status", f"WITH {T.JOBS} SELECT job_id, event_id FROM jobs WHERE status IN ('failed', 'queued')")
def jobs_by_status(spark, d):
    return T.jobs(spark, d).where(F.col("status").isin("failed", "queued")).select("job_id", "event_id")


@query("element_page", f"WITH {T.ELEMENTS} SELECT doc_id, seq, text FROM elements ORDER BY doc_id DESC, seq LIMIT 50 OFFSET 100")
def element_page(spark, d):
    rows = T.elements(spark, d)
    return C.page(rows, [F.col("doc_id").desc(), F.col("seq")], 3, 50).select("doc_id", "seq", "text")


@query("all_ids", f"WITH {T.CHUNKS} SELECT 'document' AS kind, doc_id AS id FROM docs WHERE status = 'active' UNION ALL SELECT 'chunk', chunk_id FROM chunks WHERE status = 'active'")
def all_ids(spark, d):
    one = lambda t, kind, key: t.where("status = 'active'").select(F.lit(kind).alias("kind"), F.col(key).alias("id"))
    return one(T.documents(spark, d), "document", "doc_id").unionByName(one(T.chunks(spark, d), "chunk", "chunk_id"))


# -- writes

@query("insert_update_touch", f"WITH {T.DOCUMENTS} SELECT doc_id, CASE WHEN doc_id % 5 = 1 THEN 'changed' ELSE title END AS title, CASE WHEN doc_id % 5 IN (1, 2) THEN TIMESTAMP '2025-01-01 00:00:00' ELSE updated_at END AS updated_at, true AS known FROM docs UNION ALL SELECT -doc_id - 1, 'new', TIMESTAMP '2025-01-01 00:00:00', false FROM docs WHERE doc_id % 10 = 0")
def insert_update_touch(spark, d):
    """New documents, changes that stamp the time, and rows whose time alone is stamped."""
    docs = T.documents(spark, d).select("doc_id", "title", "updated_at").withColumn("known", F.lit(True))
    now = F.lit("2025-01-01 00:00:00").cast("timestamp")
    new = docs.where("doc_id % 10 = 0").select((-F.col("doc_id") - 1).alias("doc_id"), F.lit("new").alias("title"), now.alias("updated_at"), F.lit(False).alias("known"))
    after = M.update_where(M.insert(docs, new, "doc_id"), F.col("known") & (F.col("doc_id") % 5 == 1), title=F.lit("changed"), updated_at=now)
    return M.update_where(after, F.col("known") & (F.col("doc_id") % 5 == 2), updated_at=now)


@query("job_update", f"WITH {T.JOBS}, j AS (SELECT event_id, job_id, status, progress FROM jobs) SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'completed' ELSE status END AS status, CASE WHEN event_id % 3 = 0 THEN 100 ELSE progress END AS progress, 0 AS missing FROM j UNION ALL SELECT -1, NULL, NULL, count(*) FROM j WHERE event_id % 4 = 0")
def job_update(spark, d):
    """Jobs with a third of them updated; and how many updates are of jobs that do not exist, which is an error."""
    jobs = T.jobs(spark, d).select("event_id", "status", "progress")
    done = jobs.where("event_id % 3 = 0").select("event_id", F.lit("completed").alias("status"), F.lit(100).cast("bigint").alias("progress"))
    after = M.upsert(jobs, done, "event_id", keep=()).withColumn("missing", F.lit(0).cast("bigint"))
    lost = M.missing(jobs, jobs.where("event_id % 4 = 0").select((-F.col("event_id") - 5).alias("event_id")), "event_id")
    return after.unionByName(lost.agg(F.count("*").alias("missing")).select(F.lit(-1).cast("bigint").alias("event_id"), F.lit(None).cast("string").alias("status"), F.lit(None).cast("bigint").alias("progress"), "missing"))


@query("eval_files", f"WITH {RQ._ITEMS} SELECT query, CASE WHEN doc_id % 2 = 0 THEN 'again' ELSE source END AS source, count(*) AS items FROM items WHERE expected IS NOT NULL OR len(keywords) > 0 GROUP BY 1, 2")
def eval_files(spark, d):
    """Evaluation items written by document, those of half the documents again, and read."""
    path = new_folder(spark, "eval")
    rows = RQ._items(spark, d).select("query", F.transform("expected", lambda x: x.cast("string")).alias("expected_chunk_ids"), F.col("keywords").alias("expected_content_contains"), F.col("doc_id").cast("string").alias("doc_id"), F.lit(1).alias("doc_version"), "source")
    files.write_eval_items(rows, path)
    files.write_eval_items(rows.where("doc_id % 2 = 0").withColumn("source", F.lit("again")), path)
    back = spark.read.json(path)
    kept = back.where((F.btrim("query") != "") & (F.coalesce(F.size("expected_chunk_ids"), F.lit(0)) + F.coalesce(F.size("expected_content_contains"), F.lit(0)) > 0))
    return kept.groupBy("query", "source").agg(F.count("*").alias("items"))


@query("eval_history", "SELECT 'run ' || (item_id % 3) AS timestamp, count(*) AS query_count, CAST(count(*) FILTER (WHERE item_id % 2 = 0) AS BIGINT) AS failure_count FROM benchmark GROUP BY 1")
def eval_history(spark, d):
    """Records of runs, appended one after another and read again."""
    path = new_folder(spark, "history")
    items = T.table(spark, d, "benchmark")
    for k in range(3):
        rows = items.where(F.col("item_id") % 3 == k).select(F.when(F.col("item_id") % 2 == 0, "down").alias("error"), *[F.lit(0.5).alias(n) for n in ("precision", "recall", "mrr", "hit")])
        E.append_history(E.run_record(rows, {"k": "5"}, f"run {k}"), path)
    return spark.read.json(path).select("timestamp", "query_count", "failure_count")


# -- small functions

@query("text_links", "WITH t AS (SELECT doc_id, 'see HTTPS://a.org/' || doc_id || '.mp4, (https://b.org/p?x=' || doc_id || ') or \"http://youtu.be/' || doc_id || '\" and ftp://c ' || text AS x FROM documents) SELECT doc_id, ['HTTPS://a.org/' || doc_id || '.mp4,', 'https://b.org/p?x=' || doc_id, 'http://youtu.be/' || doc_id][1] AS first, 3 + len(regexp_extract_all(text, '(?i)https?://[^\\s\\])<\"'']+')) AS links, 2 + len([u for u in regexp_extract_all(text, '(?i)https?://[^\\s\\])<\"'']+') if regexp_matches(u, '(?i)youtube\\.com|youtu\\.be|vimeo\\.com|\\.mp4|\\.webm|\\.mov|\\.m4v')]) AS films FROM t JOIN documents USING (doc_id)")
def text_links(spark, d):
    i = F.col("doc_id").cast("string")
    text = F.concat(F.lit("see HTTPS://a.org/"), i, F.lit(".mp4, (https://b.org/p?x="), i, F.lit(') or "http://youtu.be/'), i, F.lit('" and ftp://c '), F.col("text"))
    found = S.extract_urls(text)
    return T.table(spark, d, "documents").select("doc_id", found[0].alias("first"), F.size(found).cast("bigint").alias("links"), F.size(F.filter(found, S.is_video_url)).cast("bigint").alias("films"))


@query("link_asset_types", f"WITH {T.LINKS} SELECT page_id, CASE page_id % 8 WHEN 1 THEN 'image_link' WHEN 2 THEN 'video_link' WHEN 3 THEN 'video_link' WHEN 4 THEN 'document_link' WHEN 6 THEN 'video_link' WHEN 7 THEN 'document_link' ELSE 'web_link' END AS kind FROM links")
def link_asset_types(spark, d):
    """Audio counts as video; a link of no known kind as a page."""
    return T.links(spark, d).select("page_id", S.link_asset_type(F.col("link")).alias("kind"))


@query("line_functions", "SELECT doc_id, regexp_replace(regexp_replace(regexp_replace('  ' || text || ' \t x', '[ \\t\\r\\f\\v]+', ' ', 'g'), '^ +', ''), ' +$', '') AS flat, CASE doc_id % 4 WHEN 0 THEN 'py' WHEN 1 THEN 'c++' END AS language, doc_id % 6 <> 5 AS page_number, 'do/' || doc_id || CASE WHEN doc_id % 2 = 0 THEN '/asset/' ELSE '/' END || 'f.pdf' AS key, CASE WHEN doc_id % 2 = 0 THEN '[]' ELSE '[{\"a\":' || doc_id || '}]' END AS json, CAST(10.0 * doc_id AS DOUBLE) AS x FROM documents")
def line_functions(spark, d):
    i, s = F.col("doc_id"), F.col("doc_id").cast("string")
    css = F.when(i % 4 == 0, "code language-py x").when(i % 4 == 1, "lang-c++").when(i % 4 == 2, "slang-x").otherwise("plain")
    number = F.when(i % 6 == 0, s).when(i % 6 == 1, " xiv ").when(i % 6 == 2, "3 / 20").when(i % 6 == 3, "- 7 -").when(i % 6 == 4, "第 9 页").otherwise("page 5")
    whole, part = S.document_key(F.concat(F.lit("do"), s), F.lit("f.pdf")), S.document_key(F.concat(F.lit("do"), s), F.lit("f.pdf"), asset=True)
    key = F.replace(F.when(i % 2 == 0, part).otherwise(whole), F.lit("/do"), F.lit("/"))
    value = F.when(i % 2 == 1, F.array(F.struct(i.alias("a"))))
    return T.table(spark, d, "documents").select("doc_id", S.normalize_lines(F.concat(F.lit("  "), "text", F.lit(" \t x"))).alias("flat"), S.code_language(css).alias("language"), S.is_page_number(number).alias("page_number"), key.alias("key"), S.json_or_empty(value).alias("json"), S.scale_coordinate(i * 2.0, F.lit(200.0)).alias("x"))


@query("file_paths", "SELECT page_id, CASE page_id % 4 WHEN 0 THEN '/data/a b/' || page_id WHEN 1 THEN '/data/' || page_id || '+x' WHEN 2 THEN '/root/rel/' || page_id ELSE '/host/' || page_id END AS path, CASE page_id % 3 WHEN 0 THEN 'http' WHEN 1 THEN 'file' END AS scheme FROM pages")
def file_paths(spark, d):
    i = F.col("page_id")
    s = i.cast("string")
    uri = F.when(i % 4 == 0, F.concat(F.lit("file:///data/a%20b/"), s)).when(i % 4 == 1, F.concat(F.lit("/data/"), s, F.lit("+x"))).when(i % 4 == 2, F.concat(F.lit("rel/"), s)).otherwise(F.concat(F.lit("file://localhost/host/"), s))
    place = F.when(i % 3 == 0, "HTTPS://x").when(i % 3 == 1, "rel/x").otherwise("ftp://x")
    return T.table(spark, d, "pages").select("page_id", S.resolve_file_uri(uri, "/root").alias("path"), files.scheme(place).alias("scheme"))


@query("failed_parses", "SELECT page_id AS doc_id, CASE page_id % 3 WHEN 0 THEN 'ValueError: unsupported format: odd' ELSE 'ValueError: the page is empty' END AS error_message, length(CASE page_id % 3 WHEN 0 THEN 'ValueError: unsupported format: odd' ELSE 'ValueError: the page is empty' END) AS chars FROM pages WHERE page_id % 3 <> 2")
def failed_parses(spark, d):
    """Failures as rows; whole pages parse."""
    i = F.col("page_id")
    docs = T.table(spark, d, "pages").select(i.alias("doc_id"), F.when(i % 3 == 0, "odd").otherwise("html").alias("source_type"), F.when(i % 3 == 1, "  ").otherwise(F.col("html")).alias("content"))
    return model.failures(model.parse_documents(docs, files.default_registry())).select("doc_id", "error_message", F.length("error_message").cast("bigint").alias("chars"))


# -- tables and answers

@query("merged_cells", "WITH l AS (SELECT l_orderkey AS sheet, l_linenumber AS r, min(l_partkey) AS p FROM lineitem GROUP BY 1, 2), c AS (SELECT sheet, r, k AS col, p * 10 + k AS v FROM l, (SELECT unnest([1, 2, 3]) AS k)), t AS (SELECT sheet, v FROM c WHERE r = 2 AND col = 1) SELECT c.sheet, c.r AS row, c.col, CASE WHEN c.r BETWEEN 2 AND 4 AND c.col < 3 THEN t.v ELSE c.v END AS value FROM c LEFT JOIN t ON t.sheet = c.sheet")
def merged_cells(spark, d):
    """Line items as cells of three columns, one a place; in each sheet a range of rows 2 to 4 and columns 1 to 2 is merged."""
    lines = T.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("sheet"), F.col("l_linenumber").alias("row")).agg(F.min("l_partkey").alias("part"))
    cells = lines.select("sheet", "row", F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("col"), "part").select("sheet", "row", "col", (F.col("part") * 10 + F.col("col")).alias("value"))
    merges = cells.select("sheet").distinct().select("sheet", F.lit(2).alias("r0"), F.lit(1).alias("c0"), F.lit(4).alias("r1"), F.lit(2).alias("c1"))
    return Q.fill_merged(cells, merges, ["sheet"])


@query("carried_cells", "WITH c AS (SELECT l_orderkey AS sheet, l_linenumber AS r, min(l_partkey) AS v, min(l_partkey) % 3 = 0 AS continued FROM lineitem GROUP BY 1, 2) SELECT sheet, r AS row, last_value(CASE WHEN NOT continued THEN v END IGNORE NULLS) OVER (PARTITION BY sheet ORDER BY r ROWS UNBOUNDED PRECEDING) AS value FROM c")
def carried_cells(spark, d):
    """Vertically merged cells: a third of them continue the one above."""
    lines = T.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("sheet"), F.col("l_linenumber").alias("row")).agg(F.min("l_partkey").alias("value"))
    cells = lines.withColumns({"col": F.lit(1), "continued": F.col("value") % 3 == 0})
    return Q.carry_down(cells, ["sheet"]).select("sheet", "row", "value")


@query("answer_chunks", f"WITH {T.SECTIONS}, s AS (SELECT doc_id, section, min(seq) AS low, count(*) AS n, string_agg(text, chr(10) ORDER BY seq) FILTER (WHERE regexp_replace(text, '\\s', '', 'g') <> '') AS body FROM sectioned GROUP BY 1, 2) SELECT doc_id, section, CASE WHEN section % 3 = 0 THEN 'c' || section ELSE body END AS content, CASE WHEN section % 3 = 0 THEN 'procedural' ELSE 'declarative' END AS knowledge_type, CASE WHEN section % 3 = 0 AND section % 2 = 0 THEN 1 ELSE n END AS refs FROM s WHERE section % 3 = 0 OR body IS NOT NULL")
def answer_chunks(spark, d):
    """Answers for every third section, with a reference of its own or none it knows; the others fall back to their texts."""
    sections = Q.sections(T.elements(spark, d), 1).select("doc_id", "section", "seq", F.concat_ws("-", "doc_id", "seq").alias("element_id"), "text", F.array().cast("array<string>").alias("asset_ids"))
    first = sections.groupBy("doc_id", "section").agg(F.min_by("element_id", "seq").alias("e"))
    ref = F.when(F.col("section") % 2 == 0, F.col("e")).otherwise("none")
    chunk = F.to_json(F.struct(F.array(F.struct(F.concat(F.lit("c"), F.col("section").cast("string")).alias("content"), F.lit("procedural").alias("knowledge_type"), F.array(F.struct(ref.alias("element_id")), F.struct(ref.alias("element_id"))).alias("source_refs")), F.struct(F.lit(" ").alias("content"), F.lit("x").alias("knowledge_type"), F.array(F.struct(ref.alias("element_id"))).alias("source_refs"))).alias("chunks")))
    answers = first.where("section % 3 = 0").select("doc_id", "section", F.concat(F.lit("```json\n"), chunk, F.lit("\n```")).alias("answer"))
    assets = spark.createDataFrame([], "doc_id long, asset_id string, asset_type string, original_uri string, display_text string")
    return X.chunks_of_answers(answers, sections, assets).select("doc_id", "section", "content", "knowledge_type", F.size("source_refs").cast("bigint").alias("refs"))


@query("section_titles", f"WITH {T.SECTIONS} SELECT doc_id, section, 'Part ' || section || ' > ' || arg_min(text, seq) AS path FROM sectioned WHERE text <> '' GROUP BY 1, 2")
def section_titles(spark, d):
    """The first path of each section that is not empty."""
    rows = Q.sections(T.elements(spark, d), 1)
    path = F.when(F.col("text") == "", F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("Part "), F.col("section").cast("string")), F.col("text")))
    return X.section_title_path(rows.withColumn("section_path", path)).where("path is not null")


@query("first_refs", f"WITH {T.CHUNKS} SELECT chunk_id, doc_id AS first, least(n_elements, 2) AS refs FROM chunks")
def first_refs(spark, d):
    """A chunk's document by its first reference; repeated references count once, in the order they came."""
    rows = T.chunks(spark, d)
    refs = F.concat(F.array(F.struct(F.col("doc_id").alias("doc_id"))), F.transform(F.sequence(F.lit(1), F.col("n_elements")), lambda i: F.struct(F.when(i % 2 == 0, F.col("doc_id")).otherwise(F.col("doc_id") + F.when(F.col("n_elements") > 1, 1).otherwise(0)).alias("doc_id"))))
    own = F.array_distinct(refs)
    return rows.select("chunk_id", F.try_element_at(own, F.lit(1))["doc_id"].alias("first"), F.size(own).cast("bigint").alias("refs"))


@query("option_projection", f"WITH {T.CHUNKS} SELECT chunk_id, 0 AS assets, n_elements AS sources, false AS scored FROM chunks")
def option_projection(spark, d):
    """Search options: no assets, all sources, no parts of the score."""
    rows = T.chunks(spark, d).select("chunk_id", F.array(F.lit("a")).alias("asset_refs"), F.sequence(F.lit(1), F.col("n_elements")).alias("source_refs"), F.lit(1.0).alias("score_components"))
    shown = C.search_options(rows, include_assets=False)
    return shown.select("chunk_id", F.size("asset_refs").cast("bigint").alias("assets"), F.size("source_refs").cast("bigint").alias("sources"), F.lit("score_components" in shown.columns).alias("scored"))
