"""Retrieval and evaluation queries. Searches ask every row whose id is divisible by 20."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom import seams
from docloom.operators import dedup as D
from docloom.plans import evaluation as E
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


_COS = "round(list_dot_product(q.v, i.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(i.v, i.v))), 6)"
_VEC = "vecs AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"


def _top(rows: str, k: int, order: str = "score DESC, vec_id") -> str:
    return f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {order}) AS rank FROM ({rows})) WHERE rank <= {k}"


def _vectors(spark, d):
    rows = T.table(spark, d, "embeddings")
    return rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), rows


@query("vector_topk", f"WITH {_VEC} SELECT query_id, vec_id, score, rank FROM ({_top(f'SELECT q.vec_id AS query_id, i.vec_id, {_COS} AS score FROM vecs q, vecs i WHERE q.vec_id % 20 = 0', 30)}) WHERE score > 0")
def vector_topk(spark, d):
    return R.vector_topk(*_vectors(spark, d), 30, "vec_id")


@query("vector_topk_filtered", f"WITH {_VEC} SELECT query_id, vec_id, score, rank FROM ({_top(f'SELECT q.vec_id AS query_id, i.vec_id, {_COS} AS score FROM vecs q, vecs i WHERE q.vec_id % 20 = 0 AND i.label IN (1, 3)', 10)}) WHERE score > 0")
def vector_topk_filtered(spark, d):
    queries, items = _vectors(spark, d)
    return R.vector_topk(queries, items.where(F.col("label").isin(1, 3)), 10, "vec_id")


@query("post_filter_topk", f"WITH {_VEC} SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank, count(*) OVER (PARTITION BY query_id) AS total_count FROM ({_top(f'SELECT q.vec_id AS query_id, i.vec_id, i.label, {_COS} AS score FROM vecs q, vecs i WHERE q.vec_id % 20 = 0', 30)}) WHERE score > 0 AND label = 2 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank) <= 5")
def post_filter_topk(spark, d):
    queries, items = _vectors(spark, d)
    ranked = R.vector_topk(queries, items, 30, "vec_id").join(items.select("vec_id", "label"), "vec_id")
    return R.post_filter(ranked, F.col("label") == 2, 5).select("query_id", "vec_id", "score", "rank", "total_count")


_ALL_PAIRS = f"WITH {_VEC}, p AS (SELECT q.label, {_COS} AS similarity FROM vecs q JOIN vecs i ON i.label = q.label AND q.vec_id % 20 = 0 AND (i.vec_id > q.vec_id OR i.vec_id % 20 <> 0))"


@query("pairwise_similarity_stats", _ALL_PAIRS + " SELECT label, count(*) AS pairs, round(avg(similarity), 6) AS mean, round(median(similarity), 6) AS median, round(stddev_pop(similarity), 6) AS std, min(similarity) AS min, max(similarity) AS max, count(*) FILTER (WHERE similarity >= 0.9) AS ge_90 FROM p GROUP BY label")
def pairwise_similarity_stats(spark, d):
    """Pairs of the vectors that searches ask for with every vector of their label."""
    rows = T.table(spark, d, "embeddings")
    queries = rows.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    return R.pair_summary(queries, rows, "vec_id", "label")


@query("cross_label_max_similarity", f"WITH {_VEC} SELECT q.vec_id AS query_id, max({_COS}) AS similarity FROM vecs q JOIN vecs i ON i.label <> q.label AND q.vec_id % 20 = 0 GROUP BY 1")
def cross_label_max_similarity(spark, d):
    """The greatest similarity of each vector that searches ask for to those of other labels."""
    rows = T.table(spark, d, "embeddings")
    queries = rows.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    return R.nearest_of_others(queries, rows, "vec_id", "label")


_WORDS = "words AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents), post AS (SELECT doc_id, len(w) AS dl, unnest(w) AS term FROM words), tf AS (SELECT doc_id, term, count(*) AS tf, any_value(dl) AS dl FROM post GROUP BY 1, 2)"
_BM25 = _WORDS + ", asked AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS term FROM benchmark WHERE item_id % 20 = 0), st AS (SELECT count(*) AS n, avg(len(w)) AS a FROM words), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), bm AS (SELECT a.query_id, t.doc_id, round(sum(ln(1 + (st.n - df.df + 0.5) / (df.df + 0.5)) * t.tf * 2.2 / (t.tf + 1.2 * (1 - 0.75 + 0.75 * t.dl / st.a))), 6) AS score FROM asked a JOIN tf t ON t.term = a.term JOIN df ON df.term = a.term, st GROUP BY 1, 2), bm25 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM bm) WHERE rank <= 30)"


def asked(spark, d):
    return T.table(spark, d, "benchmark").where("item_id % 20 = 0").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


@query("bm25_postings", f"WITH {_WORDS} SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM tf GROUP BY term")
def bm25_postings(spark, d):
    rows = R.postings(T.table(spark, d, "documents"), "doc_id", "text")
    return rows.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


@query("bm25_topk", f"WITH {_BM25} SELECT query_id, doc_id, score, rank FROM bm25")
def bm25_topk(spark, d):
    return R.bm25_topk(asked(spark, d), T.table(spark, d, "documents"), 30, "doc_id", "text").select("query_id", "doc_id", "score", "rank")


def corpus(spark, d):
    """Documents with the embedding of the same id, and queries with that of theirs."""
    vectors = T.table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    docs = T.table(spark, d, "documents").select("doc_id", "text", "lang").join(vectors, "doc_id", "left")
    asked_ = asked(spark, d).join(vectors.withColumnRenamed("doc_id", "query_id"), "query_id", "left")
    return asked_, docs


_DENSE = f"dense AS (SELECT * FROM ({_top(f'SELECT q.vec_id AS query_id, i.vec_id AS doc_id, {_COS} AS score FROM vecs q JOIN benchmark b ON b.item_id = q.vec_id AND b.item_id % 20 = 0, vecs i JOIN documents d ON d.doc_id = i.vec_id', 30, 'score DESC, doc_id')}) WHERE score > 0)"
_FUSED = f"WITH {_BM25}, {_VEC}, {_DENSE}, fused AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, vector_rank NULLS LAST, bm25_rank NULLS LAST, doc_id) AS fused_rank FROM (SELECT coalesce(v.query_id, t.query_id) AS query_id, coalesce(v.doc_id, t.doc_id) AS doc_id, coalesce(v.score, 0) AS vector, coalesce(t.score, 0) AS bm25, v.rank AS vector_rank, t.rank AS bm25_rank, round(coalesce(1.0 / (60 + v.rank), 0) + coalesce(1.0 / (60 + t.rank), 0), 9) AS rrf FROM dense v FULL JOIN bm25 t ON t.query_id = v.query_id AND t.doc_id = v.doc_id)) WHERE fused_rank <= 15)"


@query("rrf_fusion", _FUSED + " SELECT query_id, doc_id, vector, bm25, rrf, fused_rank FROM fused")
def rrf_fusion(spark, d):
    queries, docs = corpus(spark, d)
    return R.hybrid_search(queries, docs, "doc_id", "text", debug=True)["fused"].select("query_id", "doc_id", "vector", "bm25", "rrf", "fused_rank")


@query("hybrid_search", _FUSED + " SELECT query_id, doc_id, rrf AS score, fused_rank AS rank, (SELECT count(*) FROM fused g WHERE g.query_id = f.query_id) AS total_count FROM fused f WHERE fused_rank <= 5")
def hybrid_search(spark, d):
    queries, docs = corpus(spark, d)
    return R.hybrid_search(queries, docs, "doc_id", "text").select("query_id", "doc_id", "score", "rank", "total_count")


@query("hybrid_vector_only", f"WITH {_VEC}, {_DENSE} SELECT query_id, doc_id, round(1.0 / (60 + rank), 9) AS score, rank FROM dense WHERE rank <= 5")
def hybrid_vector_only(spark, d):
    queries, docs = corpus(spark, d)
    return R.hybrid_search(queries, docs, "doc_id", "text", hybrid=False).select("query_id", "doc_id", "score", "rank")


_TERMS = "list_distinct(regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}]+'))"
_RATED = f", rated AS (SELECT f.*, CAST(len(list_intersect({_TERMS.format('b.text')}, {_TERMS.format('d.text')})) AS DOUBLE) / len({_TERMS.format('b.text')}) AS s FROM fused f JOIN benchmark b ON b.item_id = f.query_id JOIN documents d ON d.doc_id = f.doc_id)"


@query("rerank_overlap", _FUSED + _RATED + " SELECT query_id, doc_id, round(s, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, fused_rank) AS rank FROM rated) WHERE rank <= 5")
def rerank_overlap(spark, d):
    queries, docs = corpus(spark, d)
    return R.hybrid_search(queries, docs, "doc_id", "text", scorer=seams.overlap_score).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


@query("rerank_all_or_nothing", _FUSED + _RATED + ", parts AS (SELECT *, CASE WHEN doc_id % 2 = 0 THEN s END AS part, bool_and(doc_id % 2 = 0) OVER (PARTITION BY query_id) AS every FROM rated) SELECT query_id, doc_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN every THEN part ELSE rrf END DESC, CASE WHEN every THEN part ELSE 0 END DESC, fused_rank) AS rank FROM parts) WHERE rank <= 5")
def rerank_all_or_nothing(spark, d):
    queries, docs = corpus(spark, d)
    texts = R.hybrid_search(queries, docs, "doc_id", "text", debug=True)["fused"].join(docs.select("doc_id", "text"), "doc_id").join(queries.select("query_id", "query"), "query_id")
    score = F.when(F.col("doc_id") % 2 == 0, seams.overlap_score(F.col("query"), F.col("text")))
    return R.rerank(texts, score, 5, "doc_id").select("query_id", "doc_id", "rank")


def relevant(spark, d):
    """(query_id, doc_id): documents that hold the passage."""
    items = T.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("passage"))
    return E.holders(items, T.table(spark, d, "documents"), "doc_id", "text")


_REL = "rel AS (SELECT b.item_id AS query_id, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"


@query("eval_relevant", f"WITH {_REL} SELECT query_id, doc_id FROM rel")
def eval_relevant(spark, d):
    return relevant(spark, d)


@query("eval_metrics", _FUSED + f", {_REL}, top AS (SELECT query_id, list(doc_id ORDER BY fused_rank) AS r FROM fused GROUP BY 1), exp AS (SELECT query_id, list(doc_id) AS e FROM rel GROUP BY 1), m AS (SELECT top.query_id, r, e, len(list_intersect(r[1:5], e)) AS hits, (SELECT min(f.fused_rank) FROM fused f WHERE f.query_id = top.query_id AND list_contains(exp.e, f.doc_id)) AS first FROM top LEFT JOIN exp ON exp.query_id = top.query_id) SELECT query_id, CASE WHEN e IS NOT NULL THEN round(hits / 5.0, 6) END AS precision, CASE WHEN e IS NOT NULL THEN round(hits / CAST(len(e) AS DOUBLE), 6) END AS recall, CASE WHEN e IS NOT NULL THEN round(coalesce(1.0 / first, 0), 6) END AS mrr, CASE WHEN e IS NOT NULL THEN CASE WHEN hits > 0 THEN 1.0 ELSE 0.0 END END AS hit FROM m")
def eval_metrics(spark, d):
    queries, docs = corpus(spark, d)
    found = R.hybrid_search(queries, docs, "doc_id", "text", debug=True)["fused"]
    lists = found.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("fused_rank", "doc_id"))), lambda x: x["doc_id"]).alias("results"))
    labels = relevant(spark, d).groupBy("query_id").agg(F.collect_list("doc_id").alias("expected"))
    both = lists.join(labels, "query_id", "left")
    return both.select("query_id", *[F.round(v, 6).alias(n) for n, v in E.metrics(F.col("results"), F.col("expected"), 5).items()])


def _items(spark, d):
    """Items with ids of which some do not exist, keywords, and a source."""
    items = T.table(spark, d, "benchmark")
    i = F.col("item_id")
    return items.select("item_id", F.concat(F.lit("q"), (i % 30).cast("string")).alias("query"), (i % 7).alias("doc_id"), F.when(i % 3 == 0, "manual").otherwise("auto").alias("source"), F.when(i % 5 != 0, F.transform(F.sequence(F.lit(0), (i % 3).cast("int")), lambda j: i * 37 + j * 100003)).alias("expected"), F.slice(F.split("text", r"\s+"), 1, 2).alias("keywords"))


def _texts(spark, d):
    return T.table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"))


_ITEMS = "items AS (SELECT item_id, 'q' || (item_id % 30) AS query, item_id % 7 AS doc_id, CASE WHEN item_id % 3 = 0 THEN 'manual' ELSE 'auto' END AS source, CASE WHEN item_id % 5 <> 0 THEN [item_id * 37 + j * 100003 for j in range(0, item_id % 3 + 1)] END AS expected, regexp_split_to_array(text, '\\s+')[1:2] AS keywords FROM benchmark), ids AS (SELECT item_id, unnest(expected) AS id FROM items)"


@query("eval_stale_filter", f"WITH {_ITEMS}, k AS (SELECT item_id, count(*) AS n FROM ids WHERE id IN (SELECT doc_id FROM documents) GROUP BY 1) SELECT i.item_id, CASE WHEN expected IS NULL THEN 0 ELSE k.n END AS labels FROM items i LEFT JOIN k ON k.item_id = i.item_id WHERE expected IS NULL OR k.n IS NOT NULL")
def eval_stale_filter(spark, d):
    return E.drop_stale(_items(spark, d), _texts(spark, d)).select("item_id", F.coalesce(F.size("expected"), F.lit(0)).cast("bigint").alias("labels"))


@query("eval_label_validation", f"WITH {_ITEMS}, u AS (SELECT item_id, count(*) AS n FROM ids WHERE id NOT IN (SELECT doc_id FROM documents) GROUP BY 1), kw AS (SELECT DISTINCT item_id, unnest(keywords) AS k FROM items), m AS (SELECT item_id, count(*) AS n FROM kw WHERE NOT EXISTS (SELECT 1 FROM ids JOIN documents d ON d.doc_id = ids.id WHERE ids.item_id = kw.item_id AND contains(lower(d.text), lower(kw.k))) GROUP BY 1) SELECT i.item_id, coalesce(u.n, 0) AS unknown_ids, coalesce(m.n, 0) AS missing_keywords FROM items i LEFT JOIN u ON u.item_id = i.item_id LEFT JOIN m ON m.item_id = i.item_id")
def eval_label_validation(spark, d):
    return E.check_labels(_items(spark, d), _texts(spark, d))


@query("eval_merge", f"WITH {_ITEMS}, old AS (SELECT query, doc_id, min(item_id) AS item_id, arg_min(source, item_id) AS source FROM items WHERE item_id % 2 = 0 GROUP BY 1, 2), new AS (SELECT query, doc_id, max(item_id) AS item_id, arg_max(source, item_id) AS source FROM items WHERE item_id % 2 = 1 OR item_id % 4 = 0 GROUP BY 1, 2) SELECT coalesce(o.query, n.query) AS query, coalesce(o.doc_id, n.doc_id) AS doc_id, CASE WHEN n.query IS NULL THEN 'kept' WHEN o.query IS NULL THEN 'added' WHEN o.source = 'manual' THEN 'skipped' ELSE 'updated' END AS outcome, CASE WHEN n.query IS NULL OR o.source = 'manual' THEN o.item_id ELSE n.item_id END AS item_id FROM old o FULL JOIN new n ON n.query = o.query AND n.doc_id = o.doc_id")
def eval_merge(spark, d):
    items = _items(spark, d).select("query", "doc_id", "item_id", "source")
    old = D.first_of_each(items.where("item_id % 2 = 0"), ["query", "doc_id"], "item_id")
    return D.merge_items(old, items.where("item_id % 2 = 1 or item_id % 4 = 0"), ("query", "doc_id"), "item_id").select("query", "doc_id", "outcome", "item_id")


@query("eval_profile", f"WITH {_ITEMS}, p AS (SELECT doc_id, count(*) AS n FROM items GROUP BY 1) SELECT 'source' AS kind, source AS value, count(*) AS count FROM items GROUP BY 2 UNION ALL SELECT 'per_doc', CASE WHEN n <= 3 THEN '1-3' WHEN n <= 5 THEN '4-5' WHEN n <= 10 THEN '6-10' ELSE '10+' END, count(*) FROM p GROUP BY 2 UNION ALL SELECT 'labels', CAST(coalesce(len(expected), -1) AS VARCHAR), count(*) FROM items GROUP BY 2")
def eval_profile(spark, d):
    return E.profile(_items(spark, d).withColumn("expected", F.coalesce("expected", F.lit(None)))).withColumn("value", F.coalesce("value", F.lit("-1")))


@query("eval_generation_batches", f"WITH {T.CHUNKS}, n AS (SELECT doc_id, count(*) AS n FROM chunks GROUP BY 1), b AS (SELECT doc_id, n, unnest(range(0, (n - 1) // 80 + 1)) AS batch FROM n), s AS (SELECT *, least(80, n - batch * 80) AS size FROM b) SELECT doc_id, batch, size AS chunks, least(greatest(1, least(10, size)), greatest(0, 20 - batch * greatest(1, least(10, size)))) AS quota FROM s")
def eval_generation_batches(spark, d):
    return E.generation_batches(T.chunks(spark, d), 10)
