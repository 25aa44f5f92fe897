"""Retrieval quality: metrics, label checks, runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def metrics(results: Column, expected: Column, k: int) -> dict[str, Column]:
    """precision, recall, mrr and hit of a ranked list; null without labels.

    Precision divides by k even if there are fewer results, recall by the number of labels
    as given; the reciprocal rank looks at the whole list.
    """
    labelled = F.coalesce(F.size(expected), F.lit(0)) > 0
    top = F.slice(results, 1, k)
    hits = F.size(F.array_intersect(top, expected))
    places = F.transform(results, lambda x, i: F.when(F.array_contains(expected, x), i + 1))
    first = F.array_min(F.filter(places, lambda x: x.isNotNull()))
    out = {"precision": hits / k, "recall": hits / F.size(expected), "mrr": F.coalesce(1 / first, F.lit(0.0)), "hit": F.when(hits > 0, 1.0).otherwise(0.0)}
    return {name: F.when(labelled, value) for name, value in out.items()}


def drop_stale(items: DataFrame, chunks: DataFrame) -> DataFrame:
    """Items with those of their expected ids that exist; items go if all their ids are gone, unless they have keywords only."""
    known = items.select("item_id", F.explode("expected").alias("chunk_id")).join(chunks.select("chunk_id").distinct(), "chunk_id", "left_semi")
    kept = known.groupBy("item_id").agg(F.sort_array(F.collect_list("chunk_id")).alias("__kept"))
    both = items.join(kept, "item_id", "left")
    had = F.coalesce(F.size("expected"), F.lit(0)) > 0
    return both.where(~had | F.col("__kept").isNotNull()).withColumn("expected", F.coalesce("__kept", "expected")).drop("__kept")


def check_labels(items: DataFrame, chunks: DataFrame) -> DataFrame:
    """(item_id, unknown_ids, missing_keywords): counts of ids that do not exist and of keywords that no labelled chunk holds."""
    ids = items.select("item_id", F.explode("expected").alias("chunk_id")).join(chunks.select("chunk_id", F.lower("content").alias("content")), "chunk_id", "left")
    unknown = ids.groupBy("item_id").agg(F.count_if(F.col("content").isNull()).alias("unknown_ids"))
    words = items.select("item_id", F.explode("keywords").alias("keyword"))
    held = words.join(ids.where("content is not null").select("item_id", "content"), "item_id", "left").groupBy("item_id", "keyword").agg(F.bool_or(F.coalesce(F.contains("content", F.lower("keyword")), F.lit(False))).alias("held"))
    missing = held.groupBy("item_id").agg(F.count_if(~F.col("held")).alias("missing_keywords"))
    zero = F.lit(0).cast("bigint")
    return items.select("item_id").join(unknown, "item_id", "left").join(missing, "item_id", "left").withColumns({"unknown_ids": F.coalesce("unknown_ids", zero), "missing_keywords": F.coalesce("missing_keywords", zero)})


def averages(rows: DataFrame, names: tuple[str, ...] = ("precision", "recall", "mrr", "hit")) -> DataFrame:
    """Means over rows with labels, and counts of rows and failures (no metric and an error)."""
    return rows.agg(F.count("*").alias("query_count"), *[F.round(F.avg(n), 6).alias(n) for n in names])


def profile(items: DataFrame) -> DataFrame:
    """(kind, value, count): items by source, documents by number of items in buckets, items by number of labels."""
    per_doc = items.groupBy("doc_id").agg(F.count("*").alias("n"))
    bucket = F.when(F.col("n") <= 3, "1-3").when(F.col("n") <= 5, "4-5").when(F.col("n") <= 10, "6-10").otherwise("10+")
    one = lambda df, kind, value: df.groupBy(value.cast("string").alias("value")).agg(F.count("*").alias("count")).select(F.lit(kind).alias("kind"), "value", "count")
    return one(items, "source", F.col("source")).unionByName(one(per_doc, "per_doc", bucket)).unionByName(one(items, "labels", F.size("expected")))


def profile_summary(items: DataFrame) -> DataFrame:
    """One row: items, documents, and the least, greatest and mean number of items of a document."""
    per_doc = items.groupBy("doc_id").agg(F.count("*").alias("n"))
    return per_doc.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("items"), F.count("*").alias("documents"), F.min("n").alias("least"), F.max("n").alias("most"), F.round(F.avg("n"), 1).alias("mean"))


def run(items: DataFrame, results: DataFrame, k: int, key: str = "query_id") -> DataFrame:
    """A row for each item (key, expected): the metrics of its results (key, results, error). An item whose search
    failed, or that has no results row, has an error and null metrics; it counts as failed, not as found nothing."""
    both = items.join(results, key, "left")
    error = F.when(F.col("results").isNull(), F.coalesce("error", F.lit("no results"))).otherwise(F.col("error"))
    failed = error.isNotNull()
    figures = {name: F.when(~failed, F.round(value, 6)) for name, value in metrics(F.col("results"), F.col("expected"), k).items()}
    return both.select(key, error.alias("error"), *[v.alias(n) for n, v in figures.items()])


def run_record(rows: DataFrame, params: dict[str, str], now: str) -> DataFrame:
    """One row of the history: averages over rows with labels, and how many queries succeeded and failed."""
    names = ("precision", "recall", "mrr", "hit")
    figures = F.create_map(*[x for n in names for x in (F.lit(n), F.round(F.avg(n), 6))])
    search = F.create_map(*[F.lit(x) for kv in sorted(params.items()) for x in kv]) if params else F.create_map().cast("map<string,string>")
    failed = F.count_if(F.col("error").isNotNull())
    return rows.agg(F.lit(now).alias("timestamp"), search.alias("search_params"), figures.alias("metrics"), F.count("*").cast("int").alias("query_count"), (F.count("*") - failed).cast("int").alias("success_count"), failed.cast("int").alias("failure_count"))


def chosen_documents(docs: DataFrame, mode: str, value: str | None = None) -> DataFrame:
    """The documents that an evaluation set is generated for: one by id (doc), those of a category, or all; only active ones."""
    live = docs.where("status = 'active'")
    if mode == "doc":
        return live.where(F.col("doc_id").cast("string") == value)
    if mode == "category":
        return live.where(F.col("category") == value)
    if mode != "all":
        raise ValueError(f"unknown mode {mode}")
    return live


def generation_list(docs: DataFrame, chunks: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, title, chunks, items) of each active document: what there is to ask about, and what is asked already."""
    count = lambda t, name: t.groupBy("doc_id").agg(F.count("*").alias(name))
    rows = chosen_documents(docs, "all").select("doc_id", "title").join(count(chunks, "chunks"), "doc_id", "left").join(count(items, "items"), "doc_id", "left")
    return rows.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("chunks", "items")})


def append_history(record: DataFrame, path: str) -> None:
    record.write.mode("append").json(path)


def generation_batches(chunks: DataFrame, wanted: int, batch: int = 80) -> DataFrame:
    """(doc_id, batch, chunks, quota): chunks of a document in batches, and the queries to write for each, 2 * wanted in all at most."""
    rows = chunks.groupBy("doc_id").agg(F.count("*").alias("n"))
    out = rows.select("doc_id", "n", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / batch).cast("int"))).alias("batch"))
    size = F.least(F.lit(batch), F.col("n") - F.col("batch") * batch)
    quota = F.greatest(F.lit(1), F.least(F.lit(wanted), size))
    left = F.greatest(F.lit(0), F.lit(2 * wanted) - F.col("batch") * quota)
    return out.select("doc_id", F.col("batch").cast("bigint").alias("batch"), size.cast("bigint").alias("chunks"), F.least(quota, left).cast("bigint").alias("quota"))


#: Short passages that are looked for in every text at once.
SHORT_BLOCK = 256


def holders(passages: DataFrame, docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """(query_id, id): the documents whose text contains the passage of a query (query_id, passage), character by character.

    A passage of five words or more holds three whole ones, so a text that contains it has those three in a row: their hashes are
    joined, of which a text brings each once, with its id alone; only the texts of hits are then compared. Shorter
    passages may lie inside words, and are looked for in each text, in blocks of SHORT_BLOCK. A null passage is in no text,
    an empty one in all.
    """
    asked = passages.where(F.col("passage").isNotNull() & F.col("query_id").isNotNull()).select("query_id", "passage").withColumn("__w", F.split("passage", r"\s+"))
    key = lambda w, i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
    long = asked.where(F.size("__w") >= 5).select("query_id", "passage", key(F.col("__w"), F.lit(1)).alias("__k"))
    texts = docs.where(F.col(id_col).isNotNull() & F.col(text).isNotNull()).select(id_col, F.col(text).alias("__text"))
    words = texts.select(id_col, F.split("__text", r"\s+").alias("__w")).where(F.size("__w") >= 3)
    keys = words.select(id_col, F.explode(F.array_distinct(F.transform(F.sequence(F.lit(0), F.size("__w") - 3), lambda i: key(F.col("__w"), i)))).alias("__k"))
    hits = keys.join(long, "__k").select("query_id", "passage", id_col)
    found = texts.join(hits, id_col).where(F.contains("__text", "passage")).select("query_id", id_col)
    short = asked.where(F.size("__w") < 5).select("query_id", "passage")
    blocks = -(-short.count() // SHORT_BLOCK)
    for block in range(blocks):
        own = short.where(F.pmod(F.xxhash64("query_id", "passage"), F.lit(blocks)) == block)
        found = found.unionByName(texts.join(F.broadcast(own), F.contains("__text", "passage")).select("query_id", id_col))  # about SHORT_BLOCK passages of four words
    return found.distinct()
