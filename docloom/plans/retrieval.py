"""Dense, BM25 and hybrid retrieval for tables of queries."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom import seams
from docloom.functions.codecs import decoded
from docloom.functions.scalar import strip_placeholders
from docloom.schema import DEFAULT_CATEGORY, KNOWLEDGE_TYPES
from docloom.store import cut, written

#: Query vectors that are broadcast at once, and items that they are multiplied with at once.
QUERY_BLOCK, TILE = 1024, 1024
SCALE = 6
#: Terms of queries up to which the postings' scan is filtered by a list.
LITERAL_TERMS = 1000
#: Pairs of a query and a term that are broadcast.
ASKED_TERMS = 100_000


@dataclass(frozen=True)
class SearchConfig:
    vector_top_k: int = 30
    bm25_top_k: int = 30
    fusion_top_k: int = 15
    final_top_k: int = 5
    rrf_k: int = 60
    k1: float = 1.2
    b: float = 0.75


def rank(df: DataFrame, k: int, *order: Column, by: str = "query_id", name: str = "rank") -> DataFrame:
    """The first k rows of each query, numbered."""
    w = Window.partitionBy(by).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)


# -- dense

def vector_topk(queries: DataFrame, items: DataFrame, k: int, item_id: str, vector: str = "embedding", positive: bool = True) -> DataFrame:
    """(query_id, item, score, rank): exact cosine top k of queries (query_id, vector) over items.

    Query vectors are taken in blocks, which bounds what is broadcast; each task keeps the
    best k of its items for every query of the block, so at most k rows for each query and
    task are exchanged. Cuts to k first and then, if positive, drops scores of 0 and less.
    Vectors without length score 0; scores are rounded to 6 digits, ties go to the lesser id.
    """
    spark, kind = queries.sparkSession, queries.schema["query_id"].dataType.simpleString()
    n = queries.count()
    blocks = max(1, -(-n // QUERY_BLOCK))
    id_type = items.schema[item_id].dataType.simpleString()
    out = None
    for block in range(blocks):
        own = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block).select("query_id", F.col(vector).cast("array<double>")).toArrow()
        if not len(own) and out is not None:
            continue
        sent = spark.sparkContext.broadcast((own.column(0).combine_chunks(), _unit(_matrix(own.column(1)))))
        found = items.select(item_id, F.col(vector).cast("array<double>")).mapInArrow(_best(sent, k), f"query_id {kind}, {item_id} {id_type}, score double")
        ranked = rank(found, k, F.col("score").desc(), F.col(item_id))
        if blocks > 1:  # so that one block's vectors are held at a time
            ranked = cut(ranked)
            sent.destroy()
        out = ranked if out is None else out.unionByName(ranked)
    return out.where("score > 0") if positive else out


def _matrix(vectors: pa.Array | pa.ChunkedArray) -> np.ndarray:
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    if len(vectors) and not vectors.null_count and pc.count_distinct(pc.list_value_length(vectors)).as_py() == 1 and not vectors.flatten().null_count:
        return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)
    rows = vectors.to_pylist()
    return np.array(rows, np.float64) if rows else np.zeros((0, 0))


def _unit(m: np.ndarray) -> np.ndarray:
    size = np.sqrt((m * m).sum(1, keepdims=True))
    return np.divide(m, size, out=np.zeros_like(m), where=size > 0)


def _best(sent, k: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, queries = sent.value
        held_id, held_score = None, None  # the best k so far of each query
        for batch in batches:
            for i in range(0, len(batch) if len(queries) else 0, TILE):
                part = batch.slice(i, TILE)
                scores = np.round(queries @ _unit(_matrix(part.column(1))).T, SCALE) + 0.0
                ids = np.broadcast_to(part.column(0).to_numpy(zero_copy_only=False), scores.shape)
                if held_id is not None:
                    ids, scores = np.concatenate([held_id, ids], 1), np.concatenate([held_score, scores], 1)
                order = np.lexsort((ids, -scores), axis=1)[:, :k]
                held_id, held_score = np.take_along_axis(ids, order, 1), np.take_along_axis(scores, order, 1)
        if held_id is not None:
            query = np.repeat(np.arange(len(held_score)), held_score.shape[1])
            yield pa.RecordBatch.from_arrays([names.take(pa.array(query)), pa.array(held_id.ravel()), pa.array(held_score.ravel())], ["query_id", "item", "score"])

    return run


# -- BM25

def postings(docs: DataFrame, id_col: str, text: str, tokenize: Callable[[Column], Column] = seams.tokens) -> DataFrame:
    """(id, term, tf, dl) of every term of every document."""
    words = docs.select(id_col, tokenize(F.col(text)).alias("__words"))
    rows = words.select(id_col, F.size("__words").alias("dl"), F.explode("__words").alias("term"))
    return rows.groupBy(id_col, "term").agg(F.count("*").alias("tf"), F.first("dl").cast("bigint").alias("dl"))


def stored_postings(docs: DataFrame, id_col: str, text: str, tokenize: Callable[[Column], Column]) -> DataFrame:
    """The postings of docs, written once: they are ranged, counted and added up from there, not from the texts. The
    texts are exchanged by id, which are a fraction of the postings, and their terms counted where they come."""
    return written(postings(docs.select(id_col, text).repartition(id_col), id_col, text, tokenize))


def corpus_figures(docs: DataFrame, tf: DataFrame, id_col: str, text: str, tokenize: Callable[[Column], Column]) -> DataFrame:
    """(n_docs, avgdl) of docs, whose rows with an id, at least, have the postings tf: words are added up from those."""
    n, known = docs.count(), tf.where(F.col(id_col).isNotNull()).agg(F.sum("tf")).first()[0] or 0
    rest = docs.where(F.col(id_col).isNull()).agg(F.sum(F.size(tokenize(F.col(text))))).first()[0] or 0
    return docs.sparkSession.range(1).select(F.lit(n).cast("bigint").alias("n_docs"), F.lit((known + rest) / n if n else None).cast("double").alias("avgdl"))


def bm25_topk(queries: DataFrame, docs: DataFrame, k: int, id_col: str, text: str, config: SearchConfig = SearchConfig(), tokenize: Callable[[Column], Column] = seams.tokens) -> DataFrame:
    """(query_id, id, score, rank) of queries (query_id, query) over docs.

    idf is ln(1 + (N - df + 0.5) / (df + 0.5)); N, df and the mean length are those of docs.
    Only terms of the queries are counted, so nothing but their postings is exchanged. For more
    than one search of the same documents, store their postings: write_bm25_index.
    """
    asked = queries.select("query_id", F.explode(F.array_distinct(tokenize(F.col("query")))).alias("term"))
    words, few = docs.select(id_col, tokenize(F.col(text)).alias("__words")), _few_terms(asked)
    if few is not None:  # one pass over the texts, of which a document's length and the asked words are left
        rows = cut(words.select(id_col, F.size("__words").alias("dl"), F.filter("__words", lambda x: x.isin(few) if few else F.lit(False)).alias("hits")))
        stats = rows.agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl"))
        rows = rows.select(id_col, "dl", F.explode("hits").alias("term"))
    else:
        stats = words.agg(F.count("*").alias("n_docs"), F.avg(F.size("__words")).alias("avgdl"))
        rows = words.select(id_col, F.size("__words").alias("dl"), F.explode("__words").alias("term")).join(asked.select("term").distinct(), "term", "left_semi")
    tf = rows.groupBy(id_col, "term").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))
    return _scored(asked, tf, tf.groupBy("term").agg(F.count("*").alias("df")), stats, k, id_col, config, few is not None)


def _few_terms(asked: DataFrame) -> list[str] | None:
    """The distinct terms of the queries, or None if there are more than LITERAL_TERMS."""
    terms = [r["term"] for r in asked.select("term").distinct().limit(LITERAL_TERMS + 1).collect()]
    return terms if len(terms) <= LITERAL_TERMS else None


def _scored(asked: DataFrame, tf: DataFrame, df: DataFrame, stats: DataFrame, k: int, id_col: str, config: SearchConfig, few: bool) -> DataFrame:
    """Scores of postings. With few terms their counts and askers are broadcast, so a frequent term's postings stay where they are."""
    small = F.broadcast if few and asked.count() <= ASKED_TERMS else lambda x: x
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = tf.join(small(df), "term").join(F.broadcast(stats))  # one row
    part = idf * F.col("tf") * (config.k1 + 1) / (F.col("tf") + config.k1 * (1 - config.b + config.b * F.col("dl") / F.col("avgdl")))
    weight = weight.select("term", id_col, part.alias("part"))
    scores = weight.join(small(asked), "term").groupBy("query_id", id_col).agg(F.round(F.sum("part"), SCALE).alias("score"))
    return rank(scores, k, F.col("score").desc(), F.col(id_col))


def write_bm25_index(docs: DataFrame, path: str, id_col: str, text: str, tokenize: Callable[[Column], Column] = seams.tokens) -> None:
    """Stores postings, term counts and corpus figures below path, for any number of searches.

    Postings are ranged and sorted by term and id: a frequent term takes several files, and the
    least and greatest term of a file's row groups let a search skip those without its terms.
    """
    rows = stored_postings(docs, id_col, text, tokenize)
    corpus_figures(docs, rows, id_col, text, tokenize).write.mode("overwrite").parquet(f"{path}/stats")
    rows.repartitionByRange("term", id_col).sortWithinPartitions("term", id_col).write.mode("overwrite").parquet(f"{path}/postings")
    spark = docs.sparkSession
    terms = spark.read.parquet(f"{path}/postings").groupBy("term").agg(F.count("*").alias("df"))
    terms.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/terms")


def search_bm25_index(queries: DataFrame, path: str, k: int, id_col: str, config: SearchConfig = SearchConfig(), tokenize: Callable[[Column], Column] = seams.tokens) -> DataFrame:
    """As bm25_topk, over a stored index: reads the postings of the queries' terms only."""
    spark = queries.sparkSession
    asked = queries.select("query_id", F.explode(F.array_distinct(tokenize(F.col("query")))).alias("term"))
    stats, terms, tf = (spark.read.parquet(f"{path}/{name}") for name in ("stats", "terms", "postings"))
    few = _few_terms(asked)
    if few is not None:
        terms, tf = (x.where(F.col("term").isin(few)) for x in (terms, tf))
    else:
        terms, tf = (x.join(asked.select("term").distinct(), "term", "left_semi") for x in (terms, tf))
    return _scored(asked, tf, terms, stats, k, id_col, config, few is not None)


# -- fusion

def rrf(vector: DataFrame, bm25: DataFrame, id_col: str, k: int = 60) -> DataFrame:
    """(query_id, id, rrf, vector, bm25, vector_rank, bm25_rank): sum of 1 / (k + rank) over both lists."""
    v = vector.select("query_id", id_col, F.col("score").alias("vector"), F.col("rank").alias("vector_rank"))
    t = bm25.select("query_id", id_col, F.col("score").alias("bm25"), F.col("rank").alias("bm25_rank"))
    both = v.join(t, ["query_id", id_col], "full")
    one = lambda c: F.coalesce(F.lit(1.0) / (F.lit(k) + F.col(c)), F.lit(0.0))
    return both.withColumn("rrf", F.round(one("vector_rank") + one("bm25_rank"), 9)).withColumns({"vector": F.coalesce("vector", F.lit(0.0)), "bm25": F.coalesce("bm25", F.lit(0.0))})


def fused_topk(fused: DataFrame, k: int, id_col: str) -> DataFrame:
    """The best k by rrf; ties keep the order of the vector list, then of the other."""
    return rank(fused, k, F.col("rrf").desc(), F.col("vector_rank").asc_nulls_last(), F.col("bm25_rank").asc_nulls_last(), F.col(id_col), name="fused_rank")


def rerank(candidates: DataFrame, score: Column, k: int, id_col: str) -> DataFrame:
    """The best k by score if every candidate of the query has one, else by rrf; score is clamped to 0 .. 1."""
    every = F.bool_and(F.col("rerank").isNotNull()).over(Window.partitionBy("query_id"))
    scored = candidates.withColumn("rerank", seams.clamp(score)).withColumn("__all", every)
    scored = scored.withColumn("score", F.when(F.col("__all"), F.col("rerank")).otherwise(F.col("rrf"))).withColumn("rerank", F.when(F.col("__all"), F.col("rerank")))
    return rank(scored, k, F.col("score").desc(), F.coalesce("rerank", F.lit(0.0)).desc(), F.col("fused_rank")).drop("__all")


def hybrid_search(queries: DataFrame, items: DataFrame, id_col: str, text: str, vector: str = "embedding", config: SearchConfig = SearchConfig(), hybrid: bool = True, scorer: Callable[[Column, Column], Column] | None = None, where: Column | None = None, debug: bool = False, bm25_index: str | None = None):
    """Queries (query_id, query, vector) over items: dense and BM25 lists, fusion, optional reranking, the final list.

    where filters items before ranking. bm25_index is the folder of stored postings of all items, which are searched
    instead of the texts (then without where). With debug a dict of the DataFrame of each stage.
    """
    if where is not None:
        if bm25_index:
            raise ValueError("stored postings are of all items: filter their results instead")
        items = items.where(where)
    dense = vector_topk(queries.where(F.col(vector).isNotNull()), items.where(F.col(vector).isNotNull()), config.vector_top_k, id_col, vector)
    if not hybrid:
        words = dense.limit(0)
    elif bm25_index:
        words = search_bm25_index(queries, bm25_index, config.bm25_top_k, id_col, config)
    else:
        words = bm25_topk(queries, items, config.bm25_top_k, id_col, text, config)
    fused = fused_topk(rrf(dense, words, id_col, config.rrf_k), config.fusion_top_k, id_col)
    if scorer is None:
        final = rerank(fused, F.lit(None).cast("double"), config.final_top_k, id_col)
    else:
        texts = fused.join(items.select(id_col, F.col(text).alias("__text")), id_col).join(queries.select("query_id", "query"), "query_id")
        final = rerank(texts, scorer(F.col("query"), F.col("__text")), config.final_top_k, id_col).drop("__text", "query")
    total = fused.groupBy("query_id").agg(F.count("*").alias("total_count"))
    final = final.join(total, "query_id")
    return {"vector": dense, "bm25": words, "fused": fused, "final": final} if debug else final


def post_filter(results: DataFrame, condition: Column, k: int) -> DataFrame:
    """Filters ranked results, then cuts to k; total_count counts what is left before the cut."""
    left = results.where(condition)
    counted = left.withColumn("total_count", F.count("*").over(Window.partitionBy("query_id")))
    return counted.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).where(F.col("rank") <= k)


# -- index rows

def index_rows(chunks: DataFrame, docs: DataFrame, embed: Callable[[Column], Column], category: str | None = None, limit: int | None = None, key: str = "chunk_id") -> DataFrame:
    """Index rows of active chunks, of a category and the first ``limit`` by key if given: title and document
    title up to 512 characters, content up to 65535. The vector is that of the whole content without placeholders."""
    side = docs.select("doc_id", F.substring("title", 1, 512).alias("doc_title"))
    rows = chunks.where("status = 'active'")
    if category is not None:
        rows = rows.where(F.col("category") == category)
    if limit is not None:
        rows = rows.orderBy(key).limit(limit)
    rows = rows.join(side, "doc_id", "left")
    return rows.withColumns({"title": F.substring("title", 1, 512), "dense_vector": embed(F.btrim(strip_placeholders(F.col("content"))))}).withColumn("content", F.substring("content", 1, 65535))


def reindex(index: DataFrame, chunks: DataFrame, docs: DataFrame, embed: Callable[[Column], Column], size: int) -> tuple[DataFrame, DataFrame]:
    """(the index with the chunks' rows anew, outcomes (chunk_id, outcome)): failed where the vector has another
    size, whose rows in the index stay as they were; succeeded otherwise, with zeros where there is no vector."""
    rows = cut(index_rows(chunks, docs, embed).withColumn("outcome", F.when(F.size("dense_vector") == size, "succeeded").when(F.col("dense_vector").isNull(), "succeeded").otherwise("failed")))
    zeros = F.array_repeat(F.lit(0.0).cast("float"), size)
    new = rows.where("outcome = 'succeeded'").withColumn("dense_vector", F.coalesce("dense_vector", zeros))
    new = new.select(*[c for c in index.columns if c in new.columns])
    kept = index.join(new.select("chunk_id"), "chunk_id", "left_anti")
    return kept.unionByName(new, allowMissingColumns=True), rows.select("chunk_id", "outcome")


def merged_fields(vector: DataFrame, bm25: DataFrame, id_col: str, fields: Sequence[str]) -> DataFrame:
    """(query_id, id, fields) of both lists: a result of both has the fields of the BM25 list, null ones too."""
    one = lambda df, name: df.select("query_id", id_col, F.struct(*fields).alias(name))
    both = one(vector, "__v").join(one(bm25, "__t"), ["query_id", id_col], "full")
    return both.select("query_id", id_col, F.coalesce("__t", "__v").alias("f")).select("query_id", id_col, "f.*")


def decoded_results(rows: DataFrame, refs: dict[str, str]) -> DataFrame:
    """Results with the given columns of JSON text as values of their types, empty where the JSON is bad or
    missing; an unknown knowledge_type is declarative, a missing status active and category the default."""
    values = {c: decoded(F.col(c), kind) for c, kind in refs.items()}
    if "knowledge_type" in rows.columns:
        values["knowledge_type"] = F.when(F.col("knowledge_type").isin(*KNOWLEDGE_TYPES), F.col("knowledge_type")).otherwise("declarative")
    for name, default in (("status", "active"), ("category", DEFAULT_CATEGORY)):
        values[name] = F.coalesce(name, F.lit(default)) if name in rows.columns else F.lit(default)
    return rows.withColumns(values)


def checked_vectors(rows: DataFrame, vector: str, size: int) -> DataFrame:
    """rows; reading them raises if a vector has another dimension. A null vector becomes zeros."""
    zeros = F.array_repeat(F.lit(0.0).cast("float"), size)
    ok = F.when(F.size(vector) != size, F.raise_error(F.concat(F.lit("dimension "), F.size(vector).cast("string"))).cast("array<float>")).otherwise(F.coalesce(F.col(vector), zeros))
    return rows.withColumn(vector, ok)


#: Bins of width 1 / BINS that similarities from -1 to 1 are counted in.
BINS = 1000


def pair_summary(queries: DataFrame, items: DataFrame, item_id: str, by: str, vector: str = "embedding") -> DataFrame:
    """(by, pairs, mean, median, std, min, max, ge_90) of the cosines, rounded to 6 digits, of every pair of a query
    (query_id, by, vector) and an item (item_id, by, vector) of equal ``by``.

    An item of a query's own id is no pair, and two that are both queries are one. Two passes: tasks
    count similarities in bins, with their sums; then they count the single values in the bins of the
    middle only, two for each ``by``. So a task passes on a bounded number of rows for each ``by``.
    """
    counted = cut(_pairs_by(queries, items, item_id, by, vector, None).groupBy(by, "bin").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.sum("squares").alias("squares"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum("ge_90").alias("ge_90")))
    mean = F.sum("total") / F.sum("n")
    figures = counted.groupBy(by).agg(F.sum("n").alias("pairs"), mean.alias("mean"), F.sqrt(F.greatest(F.sum("squares") / F.sum("n") - mean * mean, F.lit(0.0))).alias("std"), F.min("low").alias("min"), F.max("high").alias("max"), F.sum("ge_90").alias("ge_90"))
    w = Window.partitionBy(by).orderBy("bin")
    placed = counted.withColumn("upto", F.sum("n").over(w)).join(figures.select(by, "pairs"), by)
    one, two = F.floor((F.col("pairs") + 1) / 2), F.floor(F.col("pairs") / 2) + 1
    bins = placed.where(((F.col("upto") >= one) & (F.col("upto") - F.col("n") < one)) | ((F.col("upto") >= two) & (F.col("upto") - F.col("n") < two))).select(by, "bin", (F.col("upto") - F.col("n")).alias("before"))
    wanted: dict = {}
    for r in bins.collect():  # two rows for each by
        wanted.setdefault(r[by], set()).add(r["bin"])
    values = _pairs_by(queries, items, item_id, by, vector, wanted).groupBy(by, "bin", "similarity").agg(F.sum("n").alias("n"))
    values = values.join(bins, [by, "bin"]).withColumn("upto", F.col("before") + F.sum("n").over(Window.partitionBy(by, "bin").orderBy("similarity"))).join(figures.select(by, "pairs"), by)
    at = lambda x: F.min(F.when(F.col("upto") >= x, F.col("similarity")))
    median = values.groupBy(by).agg(((at(one) + at(two)) / 2).alias("median"))
    return figures.join(median, by).select(by, "pairs", F.round("mean", SCALE).alias("mean"), F.round("median", SCALE).alias("median"), F.round("std", SCALE).alias("std"), "min", "max", "ge_90")


def _asked(queries: DataFrame, by: str, vector: str) -> Iterator[tuple]:
    """Broadcasts of the queries' ids, groups and unit vectors, a block at a time."""
    rows = queries.where(F.col("query_id").isNotNull() & F.col(by).isNotNull()).select("query_id", by, F.col(vector).cast("array<double>").alias("v"))
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    for block in range(blocks):
        own = rows.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block).toArrow()
        yield queries.sparkSession.sparkContext.broadcast((own.column(0).combine_chunks(), own.column(1).combine_chunks(), _unit(_matrix(own.column(2))))), blocks > 1


def _pairs_by(queries: DataFrame, items: DataFrame, item_id: str, by: str, vector: str, wanted: dict | None) -> DataFrame:
    """Counts of similarities by bin, or, for the wanted bins, by value."""
    kind = queries.schema[by].dataType.simpleString()
    both = queries.select(F.col("query_id").alias(item_id), F.lit(True).alias("__asked")).distinct()
    rows = items.where(F.col(item_id).isNotNull() & F.col(by).isNotNull()).join(both, item_id, "left").select(item_id, by, F.col(vector).cast("array<double>"), F.coalesce("__asked", F.lit(False)).alias("asked"))
    out = None
    for sent, several in _asked(queries, by, vector):
        more = "total double, squares double, low double, high double, ge_90 bigint" if wanted is None else "similarity double"
        found = rows.mapInArrow(_binned(sent, by, wanted), f"{by} {kind}, bin bigint, n bigint, {more}")
        if several:
            found = cut(found)
            sent.destroy()
        out = found if out is None else out.unionByName(found)
    return out


def _binned(sent, by: str, wanted: dict | None) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, groups, queries = sent.value
        ids, kinds = names.to_numpy(zero_copy_only=False), groups.to_numpy(zero_copy_only=False)
        held: dict = {}  # of each group: sums by bin, or counts by value
        for batch in batches:
            for i in range(0, len(batch) if len(ids) else 0, TILE):
                part = batch.slice(i, TILE)
                item, kind, both = (part.column(j).to_numpy(zero_copy_only=False) for j in (0, 1, 3))
                for k in np.unique(kind):
                    mine, theirs = kinds == k, kind == k
                    if not mine.any():
                        continue
                    scores = np.round(queries[mine] @ _unit(_matrix(part.column(2).filter(pa.array(theirs)))).T, SCALE) + 0.0
                    use = np.where(both[theirs][None, :], ids[mine][:, None] < item[theirs][None, :], True)
                    _count(held.setdefault(k, {}), scores[use], None if wanted is None else wanted.get(k, set()))
        for k, bins in held.items():
            rows = sorted(bins.items())
            keys = [x for x, _ in rows] if wanted is None else [_bin(np.array([x]))[0] for x, _ in rows]
            columns = [pa.array([k] * len(rows), groups.type), pa.array(keys, pa.int64())]
            if wanted is None:
                columns += [pa.array([int(v[0]) for _, v in rows], pa.int64()), *(pa.array([float(v[j]) for _, v in rows]) for j in (1, 2, 3, 4)), pa.array([int(v[5]) for _, v in rows], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, [by, "bin", "n", "total", "squares", "low", "high", "ge_90"])
            else:
                yield pa.RecordBatch.from_arrays([*columns, pa.array([int(v) for _, v in rows], pa.int64()), pa.array([float(x) for x, _ in rows])], [by, "bin", "n", "similarity"])

    return run


def _bin(scores: np.ndarray) -> np.ndarray:
    return np.floor(scores * BINS + 1e-9).astype(np.int64)


def _count(held: dict, scores: np.ndarray, wanted: set | None) -> None:
    bins = _bin(scores)
    if wanted is not None:
        values, n = np.unique(scores[np.isin(bins, [*wanted])], return_counts=True)
        for x, c in zip(values.tolist(), n.tolist(), strict=True):
            held[x] = held.get(x, 0) + c
        return
    keys, which = np.unique(bins, return_inverse=True)
    low, high = np.full(len(keys), np.inf), np.full(len(keys), -np.inf)
    np.minimum.at(low, which, scores)
    np.maximum.at(high, which, scores)
    sums = np.bincount(which), np.bincount(which, scores), np.bincount(which, scores * scores), low, high, np.bincount(which, scores >= 0.9)
    for j, key in enumerate(keys.tolist()):
        new, old = [x[j] for x in sums], held.get(key)
        held[key] = new if old is None else [old[0] + new[0], old[1] + new[1], old[2] + new[2], min(old[3], new[3]), max(old[4], new[4]), old[5] + new[5]]


def nearest_of_others(queries: DataFrame, items: DataFrame, item_id: str, by: str, vector: str = "embedding") -> DataFrame:
    """(query_id, similarity): the greatest cosine, rounded to 6 digits, of each query (query_id, by, vector) to the
    items of another ``by``. Queries are broadcast in blocks; a task passes on one row for each query."""
    kind = queries.schema["query_id"].dataType.simpleString()
    rows, out = items.where(F.col(item_id).isNotNull() & F.col(by).isNotNull()).select(by, F.col(vector).cast("array<double>")), None

    def best_of(sent):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, groups, queries = sent.value
            kinds, best = groups.to_numpy(zero_copy_only=False), np.full(len(names), -np.inf)
            for batch in batches:
                for i in range(0, len(batch) if len(names) else 0, TILE):
                    part = batch.slice(i, TILE)
                    scores = np.round(queries @ _unit(_matrix(part.column(1))).T, SCALE) + 0.0
                    other = kinds[:, None] != part.column(0).to_numpy(zero_copy_only=False)[None, :]
                    best = np.maximum(best, np.where(other, scores, -np.inf).max(1))
            met = np.isfinite(best)
            yield pa.RecordBatch.from_arrays([names.filter(pa.array(met)), pa.array(best[met])], ["query_id", "similarity"])

        return run

    for sent, several in _asked(queries, by, vector):
        found = rows.mapInArrow(best_of(sent), f"query_id {kind}, similarity double")
        if several:
            found = cut(found)
            sent.destroy()
        out = found if out is None else out.unionByName(found)
    return out.groupBy("query_id").agg(F.max("similarity").alias("similarity"))


def similarity_summary(pairs, score: str = "similarity") -> DataFrame:
    """Figures of a table of pairs, or of each group of a grouped one."""
    s = F.col(score)
    edges = {f"ge_{int(x * 100)}": F.count_if(s >= x) for x in (0.95, 0.9, 0.8, 0.7)}
    return pairs.agg(F.count("*").alias("pairs"), F.round(F.avg(s), SCALE).alias("mean"), F.round(F.median(s), SCALE).alias("median"), F.round(F.stddev_pop(s), SCALE).alias("std"), F.min(s).alias("min"), F.max(s).alias("max"), *[v.alias(n) for n, v in edges.items()])
