"""BM25 over stored postings in blocks with score bounds: blocks that can't reach the top are not read.

Documents are numbered in order of their ids, and the postings of a term are cut at the same numbers for
all terms: a block holds a term's postings of BLOCK documents, with the highest part any of them adds to a score.

A search takes, for each query, the terms in order of their bound, rarest first, and looks for the least set
of them without which no document can reach the k-th score; postings of the other, frequent terms are
looked up only for documents that are still in the race:

1. the rarest terms, up to FIRST postings a query, are scored; with the k-th of these
   partial scores as the floor, terms whose bounds together stay below it are set aside;
2. blocks of the terms that are left are read where their bound and those of all others reach the floor;
3. blocks of the terms set aside are read, rarer ones in an earlier of TURNS turns, where a document is left that,
   with the bounds of the terms still to come, reaches the floor.

Every document of the top k is scored in full, so results are those of ``bm25_topk``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom import seams
from docloom.plans.retrieval import LITERAL_TERMS, SCALE, SearchConfig, postings, rank
from docloom.store import cut, written

#: Documents of a block, and postings that the first floors are made from, for each query.
BLOCK, FIRST = 1024, 20_000
#: Turns in which terms set aside are looked up, after each of which fewer documents are left.
TURNS = 3
#: Rounding of a score, and of a sum of parts in another order.
SLACK = 10.0**-SCALE


def write_blocks(docs: DataFrame, path: str, id_col: str, text: str, config: SearchConfig = SearchConfig(), tokenize: Callable[[Column], Column] = seams.tokens) -> None:
    """Stores blocks, term figures, the documents' numbers and corpus figures below path. Rows of one id count as one document."""
    spark = docs.sparkSession
    ids = docs.where(F.col(id_col).isNotNull()).select(id_col).distinct().repartitionByRange(id_col).sortWithinPartitions(id_col)
    placed = cut(ids.withColumn("place", F.monotonically_increasing_id()))
    parts = placed.groupBy(F.shiftright("place", 33).alias("part")).agg(F.count("*").alias("n"), F.min("place").alias("first"))
    before = parts.select("part", (F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) - F.col("first")).alias("shift"))  # a row for each part
    numbers = placed.withColumn("part", F.shiftright("place", 33)).join(before, "part").select(id_col, (F.col("place") + F.col("shift")).alias("no"))
    numbers.write.mode("overwrite").parquet(f"{path}/numbers")
    # Numbers are joined to the texts, and postings come together in blocks at once; a term's count and what it adds follow from the blocks.
    known = docs.where(F.col(id_col).isNotNull()).select(id_col, text).join(spark.read.parquet(f"{path}/numbers"), id_col)
    tf = postings(known.select("no", text).repartition("no"), "no", text, tokenize)
    entry = F.struct("no", "tf", "dl")
    plain = written(tf.groupBy("term", F.floor(F.col("no") / BLOCK).alias("block")).agg(F.sum("tf").alias("words"), F.count("*").alias("n"), F.collect_list(entry).alias("entries")))  # BLOCK entries at most
    rest = docs.where(F.col(id_col).isNull()).agg(F.sum(F.size(tokenize(F.col(text))))).first()[0] or 0
    n, words = docs.count(), (plain.agg(F.sum("words")).first()[0] or 0) + rest
    avgdl = words / n if n else None
    spark.range(1).select(F.lit(n).cast("bigint").alias("n_docs"), F.lit(avgdl).cast("double").alias("avgdl")).write.mode("overwrite").parquet(f"{path}/stats")
    df = plain.groupBy("term").agg(F.sum("n").alias("df"))
    idf = F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = lambda e: idf * e["tf"] * (config.k1 + 1) / (e["tf"] + config.k1 * (1 - config.b + config.b * e["dl"] / F.lit(avgdl).cast("double")))
    entries = F.transform("entries", lambda e: F.struct(e["no"].alias("no"), part(e).alias("part")))
    blocks = plain.join(df, "term").select("term", "block", "n", entries.alias("entries"))
    blocks = written(blocks.select("term", "block", F.array_max(F.transform("entries", lambda e: e["part"])).alias("most"), "n", "entries"))
    blocks.repartitionByRange("term", "block").sortWithinPartitions("term", "block").write.mode("overwrite").parquet(f"{path}/blocks")
    spark.read.parquet(f"{path}/blocks").groupBy("term").agg(F.max("most").alias("most"), F.sum("n").alias("df")).write.mode("overwrite").parquet(f"{path}/terms")


def search_blocks(queries: DataFrame, path: str, k: int, id_col: str, tokenize: Callable[[Column], Column] = seams.tokens, read: list | None = None) -> DataFrame:
    """(query_id, id, score, rank), as bm25_topk with the figures that the index was written with. read, if given, gets
    a DataFrame (term, block, n) of the blocks of each step."""
    spark = queries.sparkSession
    asked = queries.select("query_id", F.explode(F.array_distinct(tokenize(F.col("query")))).alias("term")).distinct()
    terms = cut(asked.join(spark.read.parquet(f"{path}/terms"), "term"))
    listed = [r["term"] for r in terms.select("term").distinct().limit(LITERAL_TERMS + 1).collect()]
    blocks = spark.read.parquet(f"{path}/blocks")
    blocks = blocks.where(F.col("term").isin(listed)) if len(listed) <= LITERAL_TERMS else blocks.join(terms.select("term").distinct(), "term", "left_semi")
    told = (lambda df: df) if read is None else (lambda df: (read.append(df.select("term", "block", "n").distinct()), df)[1])
    # Rarest first: how many postings come with a term and those before it, and what those after it add at most.
    w = Window.partitionBy("query_id").orderBy("df", "term")
    order = terms.withColumn("upto", F.sum("df").over(w)).withColumn("after", F.sum("most").over(Window.partitionBy("query_id")) - F.sum("most").over(w)).withColumn("total", F.sum("most").over(Window.partitionBy("query_id"))).withColumn("at", F.row_number().over(w))
    order = cut(order)
    begin = order.where((F.col("upto") <= FIRST) | (F.col("at") == 1))

    def scored(rows: DataFrame) -> DataFrame:
        """(query_id, no, part) of blocks with query_id."""
        return rows.select("query_id", "term", F.inline("entries"))

    start = scored(told(blocks.join(begin.select("query_id", "term"), "term"))).groupBy("query_id", "no").agg(F.sum("part").alias("s"))
    floor = rank(start, k, F.col("s").desc(), F.col("no"), name="r").where(F.col("r") == k).select("query_id", (F.col("s") - SLACK).alias("floor"))
    order = cut(order.join(floor, "query_id", "left").withColumn("floor", F.coalesce("floor", F.lit(-1.0))))
    # A document that holds only terms after which less than the floor is left can't reach it: those are set aside.
    main = order.where(F.col("after") + F.col("most") >= F.col("floor"))
    aside = order.where(F.col("after") + F.col("most") < F.col("floor"))
    ours = cut(blocks.select("term", "block", F.col("most").alias("block_most")).join(main.select("query_id", "term", "most", "total", "floor"), "term"))
    # In a block, the terms that are left add their own block's bound, those set aside that of the term.
    rest = aside.groupBy("query_id").agg(F.sum("most").alias("rest"))
    bound = ours.groupBy("query_id", "block").agg(F.sum("block_most").alias("sum"), F.first("floor").alias("floor")).join(rest, "query_id", "left")
    wanted = bound.where(F.col("sum") + F.coalesce("rest", F.lit(0.0)) >= F.col("floor")).select("query_id", "block")
    pairs = ours.join(wanted, ["query_id", "block"]).select("query_id", "term", "block")
    partial = scored(told(blocks.join(pairs, ["term", "block"]))).groupBy("query_id", "no").agg(F.sum("part").alias("s"))
    left = partial.join(rest, "query_id", "left").join(order.select("query_id", "floor").distinct(), "query_id")
    left = cut(left.select("query_id", "no", "s", "floor", F.coalesce("rest", F.lit(0.0)).alias("rest")).where(F.col("s") + F.col("rest") >= F.col("floor")))
    turns = aside.withColumn("turn", F.ntile(TURNS).over(Window.partitionBy("query_id").orderBy("df", "term"))).select("query_id", "term", "turn", "after")
    for turn in range(1, TURNS + 1):
        own = turns.where(F.col("turn") == turn)
        looked = left.select("query_id", F.floor(F.col("no") / BLOCK).alias("block")).distinct().join(own.select("query_id", "term"), "query_id")
        more = scored(told(blocks.join(looked, ["term", "block"]))).groupBy("query_id", "no").agg(F.sum("part").alias("part"))
        after = own.groupBy("query_id").agg(F.min("after").alias("after"))
        left = left.join(more, ["query_id", "no"], "left").join(after, "query_id", "left")
        left = left.select("query_id", "no", (F.col("s") + F.coalesce("part", F.lit(0.0))).alias("s"), "floor", F.coalesce("after", "rest").alias("rest"))
        left = cut(left.where(F.col("s") + F.col("rest") >= F.col("floor")))
    full = left.select("query_id", "no", F.round("s", SCALE).alias("score"))
    numbers = spark.read.parquet(f"{path}/numbers")
    # Numbers follow ids, so ties go to the lesser id.
    best = cut(rank(full, k, F.col("score").desc(), F.col("no")))
    return best.join(numbers, "no").select("query_id", id_col, "score", "rank")
