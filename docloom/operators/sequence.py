"""Computations along an ordered sequence: sections, islands, batches, breakpoints, packing."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.vectors import cosine
from docloom.store import written


#: Rows of a sheet that are matched with merged ranges together.
BAND = 64
#: Rows of a task that looks for runs, and numbers of a range in which it does.
TASK_ROWS, SPAN = 1 << 20, 1 << 20


def _along(keys: list[str], order: str):
    return Window.partitionBy(*keys).orderBy(order)


def sections(elements: DataFrame, level: int, keys: list[str] | None = None, order: str = "seq") -> DataFrame:
    """elements with section: a new one begins at each title of the level."""
    starts = ((F.col("element_type") == "title") & (F.col("heading_level") == level)).cast("int")
    first = F.row_number().over(_along(keys or ["doc_id"], order)) == 1
    return elements.withColumn("section", F.sum(F.when(first, 1).otherwise(F.coalesce(starts, F.lit(0)))).over(_along(keys or ["doc_id"], order)).cast("bigint"))


def heading_paths(elements: DataFrame, order: str = "seq") -> DataFrame:
    """(doc_id, seq, section_path) of every element: the headings that stand above it.

    A document's headings are folded once into their paths; an element then takes the path of
    the last heading up to it.
    """
    title = (F.col("element_type") == "title") & F.col("heading_level").isNotNull()
    heads = elements.where(title).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), F.col("heading_level").cast("int").alias("level"), F.col("text").alias("title")))).alias("heads"))  # the headings of one document
    level, names, at = F.col("heads.level"), F.col("heads.title"), F.col("heads.at")
    paths = heads.select("doc_id", F.inline(F.arrays_zip(at.alias(order), _paths()(level, names).alias("__path"))))
    w = _along(["doc_id"], order).rowsBetween(Window.unboundedPreceding, 0)
    none = F.array().cast("array<string>")
    return elements.join(paths, ["doc_id", order], "left").withColumn("section_path", F.coalesce(F.last("__path", ignorenulls=True).over(w), none)).drop("__path").select(*[c for c in elements.columns if c != "section_path"], "section_path")


def _paths():
    """The path at each heading of a list of levels and one of titles: a heading cuts the path to fewer than its level and is appended."""

    @F.arrow_udf("array<array<string>>")
    def run(levels: pa.Array, titles: pa.Array) -> pa.Array:
        out = []
        for own, names in zip(levels.to_pylist(), titles.to_pylist(), strict=True):
            path, paths = [], []
            for level, name in zip(own or [], names or [], strict=True):
                path = [*path[: max(level - 1, 0)], name]
                paths.append(path)
            out.append(paths)
        return pa.array(out, pa.list_(pa.list_(pa.string())))

    return run


def islands(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, first, last, size) of each run of consecutive whole numbers.

    A task takes about TASK_ROWS rows: values are dealt by key and range of SPAN, sorted, and cut into runs there. Only runs
    that touch both sides of a range's edge are then put together by key.
    """
    n = max(1, -(-df.count() // TASK_ROWS))
    reach = F.floor(F.col(value) / SPAN)
    w = Window.partitionBy(*keys, "__range").orderBy(value)
    placed = df.select(*keys, value, reach.alias("__range")).repartition(n, *keys, "__range")
    once = placed.withColumn("__before", F.lag(value).over(w)).where(F.col("__before").isNull() | (F.col("__before") < F.col(value)))
    marked = once.withColumn("__group", F.col(value) - F.row_number().over(w))
    runs = marked.groupBy(*keys, "__range", "__group").agg(F.min(value).alias("first"), F.max(value).alias("last"), F.count("*").alias("size"))
    edge = (F.pmod("first", F.lit(SPAN)) == 0) | (F.pmod("last", F.lit(SPAN)) == SPAN - 1)
    runs = written(runs.withColumn("__edge", F.coalesce(edge, F.lit(False))))
    along = Window.partitionBy(*keys).orderBy("first")
    open_ = runs.where("__edge").withColumn("__new", F.coalesce(F.col("first") - F.lag("last").over(along) > 1, F.lit(True)).cast("int")).withColumn("__group", F.sum("__new").over(along))
    joined = open_.groupBy(*keys, "__group").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("size").alias("size"))
    names = [*keys, "first", "last", "size"]
    return runs.where("not __edge").select(*names).unionByName(joined.select(*names))


def regions(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Rectangles of row runs and column runs that hold at least one cell; cells: row, col.

    Each cell is told the runs of its row and its column by equality, so rectangles without cells are never made.
    """

    def runs(value: str, first: str, last: str) -> DataFrame:
        marked = cells.select(*keys, value).distinct().withColumn("__run", F.col(value) - F.row_number().over(Window.partitionBy(*keys).orderBy(value)))
        w = Window.partitionBy(*keys, "__run")
        return marked.select(*[F.col(k).alias(f"__{value}_{k}") for k in keys], F.col(value).alias(f"__{value}"), F.min(value).over(w).alias(first), F.max(value).over(w).alias(last))

    out = cells.select(*keys, "row", "col")
    for value, first, last in (("row", "r0", "r1"), ("col", "c0", "c1")):
        on = F.col(value) == F.col(f"__{value}")
        for k in keys:
            on = on & F.col(k).eqNullSafe(F.col(f"__{value}_{k}"))
        out = out.join(runs(value, first, last), on)
    return out.select(*keys, "r0", "r1", "c0", "c1").distinct()


def row_batches(rows: DataFrame, keys: list[str], order: str, size: int = 5) -> DataFrame:
    """rows with batch, from 0: so many rows each."""
    return rows.withColumn("batch", F.floor((F.row_number().over(_along(keys, order)) - 1) / size).cast("bigint"))


def placeholders(assets: DataFrame, keys: list[str], prefix: str, order: str) -> DataFrame:
    """assets with placeholder {{prefix:n}}, counted for each prefix."""
    n = F.row_number().over(Window.partitionBy(*keys, prefix).orderBy(order))
    return assets.withColumn("placeholder", F.concat(F.lit("{{"), F.col(prefix), F.lit(":"), n.cast("string"), F.lit("}}")))


def neighbour_similarity(df: DataFrame, keys: list[str], order: str, vector: str) -> DataFrame:
    """df with similarity: cosine to the next row; null at the end."""
    following = F.lead(vector).over(_along(keys, order))
    return df.withColumn("__next", following).withColumn("similarity", F.when(F.col("__next").isNotNull(), cosine(F.col(vector), F.col("__next")))).drop("__next")


def breakpoints(df: DataFrame, keys: list[str], order: str, share: float = 0.3) -> DataFrame:
    """df (with similarity) with threshold and section: cut after rows whose similarity is at most the sorted list's element at int(n * share)."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("similarity"))
    numbered = df.where("similarity is not null").select(*keys, "similarity", place.alias("__place"))
    wanted = numbered.groupBy(*keys).agg((F.floor(F.count("*") * share) + 1).alias("__place"))
    limits = numbered.join(wanted, [*keys, "__place"]).select(*keys, F.col("similarity").alias("threshold"))
    both = df.join(limits, keys, "left")
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    cut = F.when(F.col("similarity") <= F.col("threshold"), 1).otherwise(0)
    return both.withColumn("section", F.coalesce(F.sum(cut).over(w), F.lit(0)).cast("bigint"))


def pack_budget(chars: Column, limit: int, overlap: float = 0.2) -> Column:
    """array<struct<first, last>>: windows of consecutive elements, of so many characters each, that fit a token budget.

    A window closes before the element that would exceed the limit. The next one begins with
    the last max(1, overlap * number of elements) elements of the closed window and that
    element; its count begins with the tokens of as many of its first elements, joined by
    spaces, and those of the element, which is counted twice if the closed window was shorter.
    """
    n = F.size(chars)
    back = F.greatest(F.lit(1), F.floor(n * overlap).cast("int"))
    tokens = lambda c: F.greatest(F.lit(1), F.floor(c / 1.2).cast("int"))
    zero = F.struct(F.array().cast("array<struct<first:int,last:int>>").alias("done"), F.lit(0).alias("first"), F.lit(0).alias("used"))

    def joined(first: Column, count: Column) -> Column:
        some = F.filter(F.slice(chars, first + 1, count), lambda y: y > 0)
        return F.aggregate(some, F.lit(0), lambda s, y: s + y.cast("int") + 1) - F.when(F.size(some) > 0, 1).otherwise(0)

    def step(state: Column, x: Column) -> Column:
        i, own = x["i"], tokens(x["chars"])
        closes = (state["used"] + own > limit) & (i > state["first"])
        begin = F.greatest(state["first"], i - back)
        again = tokens(joined(begin, F.least(back, i - begin + 1))) + own
        done = F.concat(state["done"], F.array(F.struct(state["first"].alias("first"), (i - 1).alias("last"))))
        return F.struct(F.when(closes, done).otherwise(state["done"]).alias("done"), F.when(closes, begin).otherwise(state["first"]).alias("first"), F.when(closes, again).otherwise(state["used"] + own).alias("used"))

    numbered = F.transform(chars, lambda x, i: F.struct(i.alias("i"), x.alias("chars")))
    last = F.when(n > 0, F.aggregate(numbered, zero, step))
    return F.when(n > 0, F.concat(last["done"], F.array(F.struct(last["first"].alias("first"), (n - 1).alias("last")))))


def fill_merged(cells: DataFrame, merges: DataFrame, keys: list[str]) -> DataFrame:
    """Cells inside a merged range (r0, c0, r1, c1) take the value of its first cell.

    Each row of cells is one row of the result: of a first cell that occurs more than once the least value
    counts (null only if there is no other), and of ranges that overlap at a cell the first by (r0, c0, r1, c1).
    """
    first = cells.groupBy(*keys, F.col("row").alias("r0"), F.col("col").alias("c0")).agg(F.min("value").alias("__top"))
    merges = merges.select(*keys, "r0", "c0", "r1", "c1").distinct()
    band = lambda c: F.floor(F.col(c) / BAND).cast("bigint")
    # A range stands under each band of rows that it touches; a cell under its own.
    ranges = merges.join(first, [*keys, "r0", "c0"], "left").withColumn("__band", F.explode(F.sequence(band("r0"), band("r1"))))
    on = (F.col("c.__band") == F.col("m.__band")) & F.col("row").between(F.col("r0"), F.col("r1")) & F.col("col").between(F.col("c0"), F.col("c1"))
    for k in keys:
        on = on & (F.col(f"m.{k}") == F.col(f"c.{k}"))
    places = cells.select(*keys, "row", "col").distinct().withColumn("__band", band("row")).alias("c").join(ranges.alias("m"), on)
    tops = places.groupBy(*[F.col(f"c.{k}").alias(k) for k in keys], "row", "col").agg(F.min_by(F.struct(F.col("__top").alias("top")), F.struct("r0", "c0", "r1", "c1")).alias("__in"))
    both = cells.join(tops, [*keys, "row", "col"], "left")
    return both.select(*keys, "row", "col", F.when(F.col("__in").isNotNull(), F.col("__in.top")).otherwise(F.col("value")).alias("value"))


def carry_down(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Values of vertically merged cells (continued is true) are those of the last cell above that is not continued."""
    w = Window.partitionBy(*keys, "col").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    return cells.withColumn("value", F.last(F.when(~F.col("continued"), F.col("value")), ignorenulls=True).over(w))
