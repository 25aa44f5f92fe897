"""Listing, filtering, paging, counting and joining catalogue tables."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.functions.scalar import basename, iso_time, total_pages, truncate
from docloom.schema import DEFAULT_CATEGORY
from docloom.store import cut

#: Keys up to which a lookup is a literal list in the scan's filter.
LITERAL_KEYS = 1000


# -- scans

def get(df: DataFrame, key: str, value) -> DataFrame:
    return df.where(F.col(key) == F.lit(value))


def get_batch(df: DataFrame, key: str, values: Sequence | DataFrame) -> DataFrame:
    """Rows of the given keys; missing keys are silently absent."""
    if isinstance(values, DataFrame):
        return df.join(values.select(key).distinct(), key, "left_semi")
    if len(values) <= LITERAL_KEYS:
        return df.where(F.col(key).isin(list(values)))
    return df.join(df.sparkSession.createDataFrame([(v,) for v in values], df.select(key).schema), key, "left_semi")


def children(df: DataFrame, parents: DataFrame, key: str = "doc_id", order: str | None = None) -> DataFrame:
    out = df.join(parents.select(key).distinct(), key, "left_semi")
    return out.orderBy(key, order) if order else out


# -- predicates

def equal_filters(**values) -> Column:
    """Conjunction of equalities; None is no condition."""
    out = F.lit(True)
    for name, value in values.items():
        if value is not None:
            out = out & (F.col(name) == F.lit(value))
    return out


def keyword_filter(keyword: str | None, *columns: str) -> Column:
    """Whether a column holds the keyword, in any case; % and _ in it are wildcards."""
    out = F.lit(False)
    for c in columns:
        out = out | F.col(c).ilike(f"%{keyword}%")
    return out if keyword else F.lit(True)


def document_filter(keyword: str | None = None, **values) -> Column:
    return keyword_filter(keyword, "title", "source_uri") & equal_filters(**values)


def chunk_filter(keyword: str | None = None, mode: str = "chunk_title", has_assets: bool | None = None, has_sources: bool | None = None, **values) -> Column:
    columns = ("doc_title",) if mode == "doc_title" else ("title", "content")
    return keyword_filter(keyword, *columns) & equal_filters(**values) & non_empty("asset_refs", has_assets) & non_empty("source_refs", has_sources)


def non_empty(column: str, wanted: bool | None) -> Column:
    if wanted is None:
        return F.lit(True)
    some = F.coalesce(F.size(column), F.lit(0)) > 0
    return some if wanted else ~some


def cites(doc_id, refs: str = "source_refs") -> Column:
    """Whether any reference of the chunk is to the document."""
    return F.exists(F.col(refs), lambda r: r["doc_id"] == F.lit(doc_id))


def index_filter(categories: Sequence[str] | None = None, knowledge_types: Sequence[str] | None = None) -> Column:
    """Active rows of the given categories and types; none given is no condition."""
    out = F.col("status") == "active"
    for name, values in (("category", categories), ("knowledge_type", knowledge_types)):
        if values:
            out = out & F.col(name).isin(list(values))
    return out


def time_filter(created_after=None, created_before=None, updated_after=None, updated_before=None) -> Column:
    out = F.lit(True)
    for name, value, after in (("created_at", created_after, True), ("created_at", created_before, False), ("updated_at", updated_after, True), ("updated_at", updated_before, False)):
        if value is not None:
            edge = F.lit(value).cast("timestamp")
            out = out & ((F.col(name) >= edge) if after else (F.col(name) <= edge))
    return out


def same_file_name(uri: str, name: str | Column) -> Column:
    return (F.col("status") == "active") & (F.lower(basename(F.col(uri))) == F.lower(F.lit(name) if isinstance(name, str) else name))


def stale(now: str | Column, minutes: int, updated: str = "updated_at") -> Column:
    return F.col(updated) < (F.lit(now).cast("timestamp") if isinstance(now, str) else now) - F.expr(f"INTERVAL {minutes} MINUTES")


# -- order and pages

def ordering(df: DataFrame, sort_by: str | None, order: str, key: str, default: str = "updated_at") -> list[Column]:
    """Sort columns: unknown names give the default, all but asc is descending, nulls as the greatest, ties by key."""
    column = F.col(sort_by if sort_by in df.columns else default)
    return [column.asc_nulls_last() if order == "asc" else column.desc_nulls_first(), F.col(key).asc()]


def page(df: DataFrame, order: list[Column], number: int = 1, size: int = 20) -> DataFrame:
    if not 1 <= size <= 200:
        raise ValueError("a page has 1 to 200 rows")
    return df.orderBy(*order).offset((max(number, 1) - 1) * size).limit(size)


def numbered(df: DataFrame, by: list[str], name: str = "place") -> DataFrame:
    """df with each row's place in the order of by, from 1 without gaps; ties in any order. Ranges are sorted apart
    and their counts added up, so no task gets more than a range."""
    ranged = cut(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__at", F.monotonically_increasing_id()))
    parts = ranged.groupBy(F.shiftright("__at", 33).alias("__part")).agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))  # a row for each range
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = parts.select("__part", (before - F.col("__first") + 1).alias("__shift"))
    return ranged.withColumn("__part", F.shiftright("__at", 33)).join(shifts, "__part").select(*df.columns, (F.col("__at") + F.col("__shift")).alias(name))


class SortedPages:
    """A table stored in the order that its pages have, with the row counts of its ranges: a page reads the ranges that hold it,
    however deep it lies, and a seek the rows after a key."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.counts = sorted((r["range"], r["n"]) for r in spark.read.parquet(f"{path}/counts").collect())  # a number for each range

    @classmethod
    def write(cls, df: DataFrame, order: list[Column], path: str, ranges: int) -> SortedPages:
        spark = df.sparkSession
        ranged = df.repartitionByRange(ranges, *order).withColumn("__range", F.spark_partition_id())
        ranged.sortWithinPartitions("__range", *order).withColumn("__at", F.monotonically_increasing_id()).write.partitionBy("__range").parquet(f"{path}/rows")
        spark.read.parquet(f"{path}/rows").groupBy(F.col("__range").alias("range")).agg(F.count("*").alias("n")).coalesce(1).write.parquet(f"{path}/counts")
        return cls(spark, path)

    def total(self) -> int:
        return sum(n for _, n in self.counts)

    def page(self, number: int = 1, size: int = 20) -> DataFrame:
        """As page() of the whole table."""
        if not 1 <= size <= 200:
            raise ValueError("a page has 1 to 200 rows")
        first, at, wanted, skipped = (max(number, 1) - 1) * size, 0, [], 0
        for part, n in self.counts:
            if at + n > first and at < first + size:
                wanted.append(part)
            elif at + n <= first:
                skipped = at + n
            at += n
        rows = self.spark.read.parquet(f"{self.path}/rows").where(F.col("__range").isin(wanted))
        return rows.orderBy("__range", "__at").offset(first - skipped).limit(size).drop("__range", "__at")

    def after(self, beyond: Column, size: int = 20) -> DataFrame:
        """The first rows for which beyond holds, which must hold for all rows after its first: a seek from the last row of the page before."""
        rows = self.spark.read.parquet(f"{self.path}/rows").where(beyond)
        return rows.orderBy("__range", "__at").limit(size).drop("__range", "__at")


def page_info(df: DataFrame, size: int) -> DataFrame:
    return df.agg(F.count("*").alias("total")).select("total", total_pages(F.col("total"), size).alias("total_pages"))


# -- projections

def document_items(df: DataFrame) -> DataFrame:
    return df.withColumns({"created_at": iso_time(F.col("created_at")), "updated_at": iso_time(F.col("updated_at"))})


def chunk_items(df: DataFrame, size: int = 200) -> DataFrame:
    """Chunks with a preview of their content and the number of their assets and sources."""
    count = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("bigint") if c in df.columns else F.lit(0).cast("bigint")
    return df.withColumns({"content_preview": truncate(F.col("content"), size), "asset_count": count("asset_refs"), "source_count": count("source_refs")}).drop("content", "asset_refs", "source_refs")


def search_options(df: DataFrame, include_assets: bool = True, include_sources: bool = True, include_score_components: bool = False) -> DataFrame:
    for name, wanted in (("asset_refs", include_assets), ("source_refs", include_sources)):
        if not wanted and name in df.columns:
            df = df.withColumn(name, F.array().cast(df.schema[name].dataType))
    return df if include_score_components else df.drop("score_components")


# -- joins

def with_document(chunks: DataFrame, docs: DataFrame, columns: Sequence[str] = ("title", "source_type"), how: str = "left") -> DataFrame:
    """Chunks with columns of the document of their first source; inner drops chunks without one."""
    side = docs.select("doc_id", *[F.col(c).alias(f"doc_{c}" if c in chunks.columns or c == "title" else c) for c in columns])
    return chunks.join(side, "doc_id", how)


def with_child_counts(docs: DataFrame, **tables: DataFrame) -> DataFrame:
    """Documents with <name>_count of each child table."""
    for name, table in tables.items():
        counts = table.groupBy("doc_id").agg(F.count("*").alias(f"{name}_count"))
        docs = docs.join(counts, "doc_id", "left").withColumn(f"{name}_count", F.coalesce(f"{name}_count", F.lit(0)))
    return docs


def with_assets(chunks: DataFrame, assets: DataFrame) -> DataFrame:
    """asset_refs with the type and place of each asset, in their order; unknown if missing."""
    refs = chunks.select("chunk_id", F.posexplode("asset_refs").alias("pos", "ref"))
    found = refs.join(assets.select("asset_id", "asset_type", "storage_uri"), F.col("ref.asset_id") == F.col("asset_id"), "left")
    one = F.struct("pos", F.col("ref.asset_id").alias("asset_id"), F.col("ref.caption").alias("caption"), F.coalesce("asset_type", F.lit("unknown")).alias("asset_type"), F.coalesce("storage_uri", F.lit("")).alias("storage_uri"))
    grouped = found.groupBy("chunk_id").agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x.dropFields("pos")).alias("assets"))
    return chunks.join(grouped, "chunk_id", "left")


def with_root(docs: DataFrame) -> DataFrame:
    """root: the parent's root, or the parent itself if it has none; null without a parent."""
    parents = docs.select(F.col("doc_id").alias("parent_doc_id"), F.coalesce(F.nullif(F.col("root_doc_id"), F.lit("").cast(docs.schema["root_doc_id"].dataType)) if docs.schema["root_doc_id"].dataType.simpleString() == "string" else F.col("root_doc_id"), F.col("doc_id")).alias("root"))
    return docs.join(parents, "parent_doc_id", "left")


def version_chain(docs: DataFrame, starts: DataFrame | None = None) -> DataFrame:
    """(doc_id, ancestor, depth): each start (doc_id) with itself and all its earlier versions, to the end of the chain.

    Starts are, unless given, the documents that no other one follows, which makes a row for each
    document of an unbranched chain. Pointer doubling: a round joins what a start has reached with
    what that reaches in as many steps, so a chain of n versions takes log2(n) rounds; each is
    written, and they end when nothing more is reached. A missing version ends the walk, a cycle
    where it returns; the documents of a cycle that nothing follows from outside are no default starts.
    """
    link = docs.select("doc_id", F.col("previous_doc_id").alias("next")).join(docs.select(F.col("doc_id").alias("next")), "next", "left_semi").select("doc_id", "next")
    if starts is None:
        starts = docs.select("doc_id").join(link.select(F.col("next").alias("doc_id")), "doc_id", "left_anti")
    reach = cut(starts.select("doc_id", F.col("doc_id").alias("ancestor"), F.lit(0).cast("bigint").alias("depth")))
    jump, step, size = cut(link), 1, reach.count()
    while True:
        further = reach.join(jump.select(F.col("doc_id").alias("ancestor"), "next"), "ancestor").select("doc_id", F.col("next").alias("ancestor"), (F.col("depth") + step).alias("depth"))
        reach = cut(reach.unionByName(further).groupBy("doc_id", "ancestor").agg(F.min("depth").alias("depth")))
        before, size = size, reach.count()
        if size == before:
            return reach
        jump = cut(jump.join(jump.select(F.col("doc_id").alias("next"), F.col("next").alias("far")), "next").select("doc_id", F.col("far").alias("next")))
        step *= 2


def same_names(docs: DataFrame, others: DataFrame, name: Column) -> DataFrame:
    """(doc_id, same): how many of others have the file name of each document, in any case; without any, no row.

    Names are counted before they are joined, so a common name makes a row for each document only.
    """
    held = others.groupBy(F.lower(name).alias("name")).agg(F.count("*").alias("same"))
    return docs.select("doc_id", F.lower(name).alias("name")).join(held, "name").select("doc_id", "same")


# -- named projections

#: Columns of each view of an entity; those that a table lacks are left out.
VIEWS = {
    "element": ("element_id", "sequence_order", "element_type", "text", "structured_data", "asset_data", "source_location", "metadata"),
    "chunk": ("chunk_id", "doc_id", "title", "content", "content_hash", "knowledge_type", "category", "status", "asset_refs", "source_refs", "created_at", "updated_at", "metadata"),
    "hit": ("chunk_id", "doc_id", "doc_title", "title", "content", "category", "knowledge_type", "source_refs", "asset_refs"),
}


def view(df: DataFrame, name: str) -> DataFrame:
    """The columns of a view, in its order. A hit has no status and no vector."""
    return df.select(*[c for c in VIEWS[name] if c in df.columns])


def chunk_detail(chunks: DataFrame, assets: DataFrame) -> DataFrame:
    """Chunks in full, with the type and place of each of their assets."""
    return with_assets(chunks, assets)


def random_sample(df: DataFrame, n: int, seed: int, key: str) -> DataFrame:
    """n rows in random order: the least hashes of key and seed, so the same ones for a seed; for another seed others."""
    return df.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key).limit(n)


# -- counts

def count_by_status(df: DataFrame) -> DataFrame:
    return df.groupBy("status").agg(F.count("*").alias("count"))


def facets(df: DataFrame, columns: Sequence[str] = ("category", "knowledge_type", "status"), default: str = DEFAULT_CATEGORY) -> DataFrame:
    """(facet, value, count) of several columns in one pass; an empty category counts as the default."""
    pairs = F.array(*[F.struct(F.lit(c).alias("facet"), (F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(default)) if c == "category" else F.col(c)).alias("value")) for c in columns])
    return df.select(F.inline(pairs)).groupBy("facet", "value").agg(F.count("*").alias("count"))


def category_facet(docs: DataFrame) -> DataFrame:
    return docs.groupBy(F.coalesce(F.nullif(F.col("category"), F.lit("")), F.lit(DEFAULT_CATEGORY)).alias("value")).agg(F.count("*").alias("count")).orderBy("value")


def dashboard(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    a = docs.agg(F.count("*").alias("documents"), F.count_if(F.col("status") == "failed").alias("failed"), F.count_if(F.col("status") == "processing").alias("processing"))
    return a.join(chunks.agg(F.count("*").alias("chunks")))  # one row each


def upload_summary(outcomes: DataFrame) -> DataFrame:
    return outcomes.agg(*[F.count_if(F.col("outcome") == x).alias(x) for x in ("success", "duplicate", "failed")])


def health(checks) -> DataFrame:
    """degraded if any of a table's checks, or of a group's, is an error."""
    return checks.agg(F.when(F.bool_or(F.col("status") == "error"), "degraded").otherwise("ok").alias("status"))


def probe(spark: SparkSession, checks: dict[str, Callable[[], object]]) -> DataFrame:
    """(service, status, error, seconds): each check is called once; one that raises is an error, told in 200 characters."""
    rows = []
    for name, check in checks.items():
        began, error = time.perf_counter(), None
        try:
            check()
        except Exception as e:  # a service that is down is a row
            error = f"{type(e).__name__}: {e}"[:200]
        rows.append((name, "error" if error else "ok", error, round(time.perf_counter() - began, 3)))
    return spark.createDataFrame(rows, "service string, status string, error string, seconds double")


def latest_active_job(jobs: DataFrame) -> DataFrame:
    """Of each document the latest job that is queued or being processed."""
    w = Window.partitionBy("doc_id").orderBy(F.col("created_at").desc(), F.col("job_id").desc())
    active = jobs.where(F.col("status").isin("queued", "processing"))
    return active.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def chunk_counts_by_category(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    per_doc = chunks.groupBy("doc_id").agg(F.count("*").alias("n"))
    return docs.join(per_doc, "doc_id", "left").groupBy("category").agg(F.count("*").alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("chunks")).orderBy(F.col("chunks").desc(), "category")
