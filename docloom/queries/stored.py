"""Queries of stored tables and indexes; each makes its store in a new folder, and removes it once its rows are kept."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from docloom.operators import catalog as C
from docloom.operators import commits
from docloom.plans import bm25_blocks as B
from docloom.plans import dense_index as D
from docloom.plans import substring as G
from docloom.queries import similar
from docloom.queries import tables as T
from docloom.queries.retrieval import _BM25, _COS, _top, asked
from docloom.sources import shared
from docloom.store import cut, new_folder
from docloom.streaming import feed

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


_V = similar._CHUNKS + ", vecs AS (SELECT vec_id, v FROM c)"


def _index(spark, d):
    rows = similar.chunk_vectors(spark, d).select("vec_id", "doc", F.col("v").alias("embedding"))
    return rows, D.DenseIndex.build(rows, new_folder(spark, "dense"), "vec_id", "embedding", 64)


def _kept(spark, path, df):
    out = cut(df)
    shared.remove(spark, path)
    return out


@query("dense_index_topk", f"WITH {_V} SELECT query_id, vec_id, score, rank FROM ({_top(f'SELECT q.vec_id AS query_id, i.vec_id, {_COS} AS score FROM vecs q, vecs i WHERE q.vec_id % 20 = 0', 10)}) WHERE score > 0")
def dense_index_topk(spark, d):
    """The exact search of a stored index of vectors that lie in clusters."""
    rows, index = _index(spark, d)
    return _kept(spark, index.path, index.search(rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), 10))


@query("dense_index_recall", f"WITH {_V} SELECT vec_id AS query_id, CAST(least(10, (SELECT count(*) FROM vecs) ) AS BIGINT) AS wanted, true AS reached FROM vecs WHERE vec_id % 20 = 0")
def dense_index_recall(spark, d):
    """Whether the approximate search, over all queries together, finds 0.9 of what the exact one finds."""
    rows, index = _index(spark, d)
    queries = rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    exact = index.search(queries, 10, positive=False).select("query_id", "vec_id")
    near = index.search(queries, 10, exact=False, positive=False).select("query_id", "vec_id", F.lit(1).alias("hit"))
    each = exact.join(near, ["query_id", "vec_id"], "left").groupBy("query_id").agg(F.count("*").alias("wanted"), F.count("hit").alias("found"))
    share = each.agg((F.sum("found") >= 0.9 * F.sum("wanted")).alias("reached"))
    return _kept(spark, index.path, each.select("query_id", "wanted").crossJoin(F.broadcast(share)))  # one row


@query("dense_index_changed", f"WITH {_V}, now AS (SELECT vec_id, v FROM vecs WHERE vec_id % 10 NOT IN (3, 5) UNION ALL SELECT vec_id, list_transform(v, lambda x: -x) FROM vecs WHERE vec_id % 10 = 5 UNION ALL SELECT vec_id + 1000000, v FROM vecs WHERE vec_id % 10 = 7) SELECT query_id, vec_id, score, rank FROM ({_top(f'SELECT q.vec_id AS query_id, i.vec_id, {_COS} AS score FROM vecs q, now i WHERE q.vec_id % 20 = 0', 10)}) WHERE score > 0")
def dense_index_changed(spark, d):
    """The same after vectors were added, replaced and deleted: no segment is made anew."""
    rows, index = _index(spark, d)
    turned = rows.where("vec_id % 10 = 5").select("vec_id", F.transform("embedding", lambda x: -x).alias("embedding"))
    more = rows.where("vec_id % 10 = 7").select((F.col("vec_id") + 1000000).alias("vec_id"), "embedding")
    index.add(turned.unionByName(more), "embedding")
    index.delete(rows.where("vec_id % 10 = 3").select("vec_id"))
    return _kept(spark, index.path, index.search(rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), 10))


@query("cleanup_committed", f"WITH {T.CHUNKS} SELECT 1 AS version, 'chunks' AS name, category AS grp, count(*) AS n FROM chunks GROUP BY 3 UNION ALL SELECT 1, 'elements', NULL, count(*) FROM elements UNION ALL SELECT 1, 'documents', status, count(*) FROM docs GROUP BY 3 UNION ALL SELECT 2, 'chunks', category, count(*) FROM chunks WHERE doc_id % 7 <> 2 GROUP BY 3 UNION ALL SELECT 2, 'elements', NULL, count(*) FROM elements WHERE doc_id % 7 <> 2 UNION ALL SELECT 2, 'documents', CASE WHEN doc_id % 7 = 2 THEN 'processing' ELSE status END, count(*) FROM docs GROUP BY 3")
def cleanup_committed(spark, d):
    """Rows of three tables before and after documents are taken up again: all change in one commit, and a repeated batch changes nothing."""
    tables = commits.TableSet(spark, new_folder(spark, "tables"))
    one = {"documents": T.documents(spark, d), "chunks": T.chunks(spark, d).select("doc_id", "category"), "elements": T.elements(spark, d).select("doc_id", "seq")}
    tables.commit(tables.at(), one, ("load", 0))

    def again(base):
        docs = base.read("documents")
        ids = docs.where("doc_id % 7 = 2").select("doc_id")
        moved = docs.withColumn("status", F.when(F.col("doc_id") % 7 == 2, "processing").otherwise(F.col("status")))
        return {"documents": moved} | {n: base.read(n).join(ids, "doc_id", "left_anti") for n in ("chunks", "elements")}

    for _ in range(2):
        tables.update(again, ("upload", 0))
    out = None
    for version in (1, 2):
        at = tables.at(version)
        for name, group in (("documents", F.col("status")), ("chunks", F.col("category")), ("elements", F.lit(None).cast("string"))):
            rows = at.read(name).groupBy(group.alias("grp")).agg(F.count("*").alias("n")).select(F.lit(version).alias("version"), F.lit(name).alias("name"), "grp", "n")
            out = rows if out is None else out.unionByName(rows)
    return _kept(spark, tables.root, out)


_FEED = f"""WITH {T.JOBS}, j AS (SELECT job_id, status, stage, CAST(progress AS INTEGER) AS progress, ts, min(ts) OVER (PARTITION BY job_id) + INTERVAL 36 HOUR AS deadline FROM jobs WHERE job_id IS NOT NULL),
o AS (SELECT *, coalesce(bool_or(status IN ('completed', 'failed')) OVER (PARTITION BY job_id ORDER BY ts, progress, status, stage ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS over FROM j WHERE ts <= deadline),
l AS (SELECT *, lag({{'a': status, 'b': stage, 'c': progress}}) OVER (PARTITION BY job_id ORDER BY ts, progress, status, stage) AS last FROM o WHERE NOT over),
f AS (SELECT job_id, status, stage, progress, ts FROM l WHERE last IS NULL OR last IS DISTINCT FROM {{'a': status, 'b': stage, 'c': progress}} UNION ALL SELECT job_id, 'failed', 'failed', arg_max(progress, {{'a': ts, 'b': progress, 'c': status, 'd': stage}}), max(deadline) FROM o WHERE NOT over GROUP BY job_id HAVING NOT bool_or(status IN ('completed', 'failed')))
SELECT CAST(job_id AS VARCHAR) AS job_id, status, stage, progress, epoch_us(ts) AS at FROM f"""


@query("job_feed", _FEED)
def job_feed(spark, d):
    """Changes of jobs in order of time, and jobs that fail 36 hours after their first row."""
    rows = T.jobs(spark, d).select(F.col("job_id").cast("string"), "status", "stage", F.col("progress").cast("int").alias("progress"), F.col("ts").cast("timestamp").alias("ts"))
    return feed.feed_rows(rows, 36 * 3600).select("job_id", "status", "stage", "progress", F.unix_micros("ts").alias("at"))


@query("job_feed_stream", _FEED)
def job_feed_stream(spark, d):
    """The same from a stream with keyed state: rows come up to six hours late, in three cuts, to a query started anew for each."""
    rows = T.jobs(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))
    come = F.unix_seconds("ts") + F.pmod(F.xxhash64("event_id"), F.lit(6 * 3600))
    rows = rows.withColumn("come", come)
    low, high, last = rows.agg(F.min("come"), F.max("come"), F.max("ts")).first()
    cuts = [rows.where(F.floor((F.col("come") - low) * 3 / (high - low + 1)) == i).drop("come") for i in range(3)]
    path = new_folder(spark, "feed")
    out = feed.run_feed(spark, cuts, path, 36 * 3600, "6 hours", str(last + timedelta(days=9)))
    return _kept(spark, path, out.select("job_id", "status", "stage", "progress", F.unix_micros("ts").alias("at")))


_PAGES = f"WITH {T.ELEMENTS}, o AS (SELECT doc_id, seq, text, row_number() OVER (ORDER BY doc_id DESC, seq) - 1 AS place FROM elements), n AS (SELECT max(place) // 60 AS n FROM o)"


@query("deep_pages", f"{_PAGES} SELECT doc_id, seq, text FROM o, n WHERE place // 20 IN (0, n.n, 2 * n.n)")
def deep_pages(spark, d):
    """The first page of all elements, one a third of the way down and one two thirds down, from the ranges that hold them."""
    path = new_folder(spark, "pages")
    pages = C.SortedPages.write(T.elements(spark, d).select("doc_id", "seq", "text"), [F.col("doc_id").desc(), F.col("seq")], path, 16)
    step = (pages.total() - 1) // 60
    out = pages.page(1, 20).unionByName(pages.page(step + 1, 20)).unionByName(pages.page(2 * step + 1, 20))
    return _kept(spark, path, out.distinct() if step == 0 else out)


_KEYWORDS = "k AS (SELECT item_id AS query_id, CASE WHEN item_id % 10 = 3 THEN substr(text, 1, 2) WHEN item_id % 10 = 4 THEN upper(substr(text, 5, 9)) ELSE substr(text, 3, 12) END AS keyword FROM benchmark)"


@query("substring_search", f"WITH {_KEYWORDS} SELECT DISTINCT query_id, doc_id FROM k JOIN documents ON contains(lower(text), lower(keyword))")
def substring_search(spark, d):
    """Documents that contain a stretch of each benchmark passage, from a stored index of trigrams."""
    path = new_folder(spark, "trigrams")
    docs, i = T.table(spark, d, "documents").select("doc_id", "text"), F.col("item_id") % 10
    keyword = F.when(i == 3, F.substring("text", 1, 2)).when(i == 4, F.upper(F.substring("text", 5, 9))).otherwise(F.substring("text", 3, 12))
    G.write_trigrams(docs, path, "doc_id", "text")
    asked_ = T.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), keyword.alias("keyword"))
    return _kept(spark, path, G.search_substrings(asked_, docs, path, "doc_id", "text"))


@query("bm25_blocks_topk", f"WITH {_BM25} SELECT query_id, doc_id, score, rank FROM bm25")
def bm25_blocks_topk(spark, d):
    """The search of postings in blocks that skips those that can't reach the top."""
    path = new_folder(spark, "blocks")
    B.write_blocks(T.table(spark, d, "documents"), path, "doc_id", "text")
    return _kept(spark, path, B.search_blocks(asked(spark, d), path, 30, "doc_id").select("query_id", "doc_id", "score", "rank"))
