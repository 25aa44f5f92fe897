"""Queries of near and semantic duplicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom import seams
from docloom.plans import similar as S
from docloom.queries import tables as T

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


# The bits of a text by the MD5 of its words: a sum for each bit, then the bits put together.
_SIM = """words AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS term FROM documents),
tf AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY 1, 2),
coded AS (SELECT term, CAST('0x' || substr(md5(term), 1, 16) AS UBIGINT) AS h FROM (SELECT DISTINCT term FROM tf)),
ones AS (SELECT tf.doc_id, b, sum(CASE WHEN (h >> b) & 1 = 1 THEN tf ELSE -tf END) AS s FROM tf JOIN coded ON coded.term = tf.term, (SELECT CAST(unnest(range(64)) AS UBIGINT) AS b) GROUP BY 1, 2),
sim AS MATERIALIZED (SELECT doc_id, CAST(sum(CASE WHEN s > 0 THEN CAST(1 AS HUGEINT) << CAST(b AS HUGEINT) ELSE CAST(0 AS HUGEINT) END) AS UBIGINT) AS bits FROM ones GROUP BY 1)"""


@query("simhash_pairs", f"WITH {_SIM}, v AS (SELECT bits, min(doc_id) AS id FROM sim GROUP BY 1) SELECT x.id AS a, y.id AS b, CAST(bit_count(xor(x.bits, y.bits)) AS INTEGER) AS distance FROM v x JOIN v y ON x.id < y.id AND bit_count(xor(x.bits, y.bits)) <= 3")
def simhash_pairs(spark, d):
    """Documents whose SimHash values lie within 3 bits, by the first document of each value."""
    docs = S.simhash_rows(T.table(spark, d, "documents"), seams.tokens(F.col("text")), "doc_id")
    return S.hamming_pairs(docs, "doc_id", "bits", 3)


@query("simhash_groups", f"WITH {_SIM} SELECT doc_id, min(doc_id) OVER (PARTITION BY bits) AS first, count(*) OVER (PARTITION BY bits) AS texts FROM sim")
def simhash_groups(spark, d):
    """The documents of each SimHash value: what simhash_pairs says of a value holds for all of them."""
    docs = S.simhash_rows(T.table(spark, d, "documents"), seams.tokens(F.col("text")), "doc_id").where("bits is not null")
    values = docs.groupBy("bits").agg(F.min("doc_id").alias("first"), F.count("*").alias("texts"))
    return docs.join(values, "bits").select("doc_id", "first", "texts")


@query("dedup_funnel", f"""WITH {_SIM}, firsts AS (SELECT sha256(text) AS digest, min(doc_id) AS first FROM documents WHERE text IS NOT NULL GROUP BY 1),
c AS (SELECT doc_id, bits FROM sim WHERE doc_id IN (SELECT first FROM firsts)), v AS (SELECT bits, min(doc_id) AS head FROM c GROUP BY 1), t AS (SELECT doc_id, head, c.bits FROM c JOIN v ON v.bits = c.bits),
p AS (SELECT head AS a, doc_id AS b FROM t WHERE doc_id <> head UNION SELECT least(x.head, y.doc_id), greatest(x.head, y.doc_id) FROM t x JOIN t y ON x.doc_id = x.head AND x.bits <> y.bits AND bit_count(xor(x.bits, y.bits)) <= 3),
size AS (SELECT doc_id, sqrt(sum(tf * tf)) AS n FROM tf GROUP BY 1), dots AS (SELECT a, b, sum(x.tf * y.tf) AS dot FROM p JOIN tf x ON x.doc_id = a JOIN tf y ON y.doc_id = b AND y.term = x.term GROUP BY 1, 2),
near AS (SELECT dots.b AS doc_id, min(dots.a) AS near FROM dots JOIN size x ON x.doc_id = dots.a JOIN size y ON y.doc_id = dots.b WHERE round(dot / (x.n * y.n), 6) >= 0.9 GROUP BY 1)
SELECT d.doc_id, CASE WHEN first < d.doc_id THEN 'exact' WHEN near IS NOT NULL THEN 'similar' ELSE 'unique' END AS stage, CASE WHEN first < d.doc_id THEN first ELSE near END AS of FROM documents d LEFT JOIN firsts ON firsts.digest = sha256(d.text) LEFT JOIN near ON near.doc_id = d.doc_id""")
def dedup_funnel(spark, d):
    """Copies by hash, then by SimHash, then by the cosine of word counts."""
    return S.funnel(T.table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text", 3, 0.9)


# Vectors of a document of up to 64 chunks: that of its first one, and a part, larger from chunk to chunk, of another.
_CHUNKS = """base AS (SELECT vec_id, vec_id // 64 AS doc, CAST(embedding AS DOUBLE[]) AS own FROM embeddings),
c AS MATERIALIZED (SELECT b.vec_id, b.doc, CASE WHEN b.vec_id = b.doc * 64 THEN b.own ELSE list_transform(range(1, len(b.own) + 1), lambda i: f.own[i] + (b.vec_id % 16) * 0.06 * b.own[i]) END AS v, b.vec_id * 7919 % 1000 AS n_chars, b.vec_id % 9 = 4 AS manual FROM base b JOIN base f ON f.vec_id = b.doc * 64)"""
_COS = "round(list_dot_product(x.v, y.v) / (sqrt(list_dot_product(x.v, x.v)) * sqrt(list_dot_product(y.v, y.v))), 6)"


def chunk_vectors(spark, d):
    base = T.table(spark, d, "embeddings").select("vec_id", F.floor(F.col("vec_id") / 64).alias("doc"), F.col("embedding").cast("array<double>").alias("own"))
    first = base.where("vec_id % 64 = 0").select("doc", F.col("own").alias("centre"))
    part = (F.col("vec_id") % 16) * F.lit(0.06)
    v = F.when(F.col("vec_id") == F.col("doc") * 64, F.col("own")).otherwise(F.zip_with("centre", "own", lambda x, y: x + part * y))
    return base.join(first, "doc").select("vec_id", "doc", v.alias("v"), (F.col("vec_id") * 7919 % 1000).alias("n_chars"), (F.col("vec_id") % 9 == 4).alias("manual"))


_GREEDY = f"""WITH RECURSIVE {_CHUNKS}, r AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY NOT manual, n_chars DESC, vec_id) AS r FROM c),
w AS (SELECT doc, CAST(0 AS BIGINT) AS r, CAST(NULL AS BIGINT) AS vec_id, CAST(NULL AS BIGINT) AS merged_into, CAST([] AS STRUCT(id BIGINT, v DOUBLE[])[]) AS kept FROM (SELECT DISTINCT doc FROM r) UNION ALL
  SELECT doc, r, vec_id, CASE WHEN NOT manual THEN t END, CASE WHEN manual OR t IS NULL THEN list_append(kept, {{'id': vec_id, 'v': v}}) ELSE kept END FROM
    (SELECT r.*, w.kept, list_filter(w.kept, lambda k: round(list_dot_product(k.v, r.v) / (sqrt(list_dot_product(k.v, k.v)) * sqrt(list_dot_product(r.v, r.v))), 6) >= 0.95)[1].id AS t FROM w JOIN r ON r.doc = w.doc AND r.r = w.r + 1))"""


@query("semantic_merge", _GREEDY + " SELECT vec_id, merged_into FROM w WHERE vec_id IS NOT NULL")
def semantic_merge(spark, d):
    """Chunks merged within their document by priority: by hand before others, then the longer."""
    return S.semantic_duplicates(chunk_vectors(spark, d), "vec_id", "doc", "v", "n_chars", "manual")[0]


@query("semantic_related", _GREEDY + f", k AS (SELECT c.* FROM c JOIN w ON w.vec_id = c.vec_id WHERE merged_into IS NULL) SELECT x.vec_id AS a, y.vec_id AS b, {_COS} AS similarity FROM k x JOIN k y ON x.doc = y.doc AND x.vec_id < y.vec_id WHERE {_COS} >= 0.88 AND {_COS} < 0.95")
def semantic_related(spark, d):
    """Chunks that stay and are related to others of their document."""
    return S.semantic_duplicates(chunk_vectors(spark, d), "vec_id", "doc", "v", "n_chars", "manual")[1]


@query("within_similarity_stats", f"WITH {_CHUNKS}, p AS (SELECT x.doc, {_COS} AS s FROM c x JOIN c y ON x.doc = y.doc AND x.vec_id < y.vec_id) SELECT doc, count(*) AS pairs, round(avg(s), 6) AS mean, round(median(s), 6) AS median, round(stddev_pop(s), 6) AS std, min(s) AS min, max(s) AS max, count(*) FILTER (WHERE s >= 0.95) AS ge_95, count(*) FILTER (WHERE s >= 0.9) AS ge_90, count(*) FILTER (WHERE s >= 0.8) AS ge_80, count(*) FILTER (WHERE s >= 0.7) AS ge_70 FROM p GROUP BY doc")
def within_similarity_stats(spark, d):
    """Figures of all pairs of chunks of each document."""
    return S.within_summary(chunk_vectors(spark, d), "vec_id", "doc", "v")
