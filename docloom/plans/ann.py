"""Approximate dense search by an inverted file of cells.

Cell centres are fitted by spherical k-means on a bounded sample; every vector is then entered
in the cells of its nearest centres. A search looks into the cells nearest to the query and
scores their vectors exactly, so scores are those of the exact search and only recall is less.
Searching all cells is the exact search. How many cells a recall takes is up to the vectors:
those without any structure, as the test tables hold, take three eighths of them for 0.9.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.plans.retrieval import SCALE, _matrix, _unit, rank

#: Vectors that centres are fitted on at most, and rounds of fitting.
FIT_ROWS, ROUNDS = 20_000, 12
#: Vectors that one task scores of a cell; a larger cell is dealt to several.
CELL_ROWS = 20_000


def fit_cells(items: DataFrame, item_id: str, vector: str, cells: int, rows: int = FIT_ROWS) -> np.ndarray:
    """Unit vectors of the cells' centres, from the ``rows`` items with the least hash of their id."""
    sample = items.where(F.col(vector).isNotNull()).orderBy(F.xxhash64(item_id), item_id).limit(rows).select(F.col(vector).cast("array<double>")).toArrow()
    x = _unit(_matrix(sample.column(0)))
    x = x[np.any(x != 0, axis=1)] if len(x) else x
    if not len(x):
        return np.zeros((1, 1))
    centres = x[np.linspace(0, len(x) - 1, min(cells, len(x))).astype(int)]
    for _ in range(ROUNDS):
        nearest = (x @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, x)
        empty = np.bincount(nearest, minlength=len(centres)) == 0
        sums[empty] = centres[empty]
        centres = _unit(sums)
    return centres


def build_index(items: DataFrame, item_id: str, vector: str, centres: np.ndarray, entries: int = 2) -> DataFrame:
    """(cell, item id, vector): every item with a vector, in the cells of its ``entries`` nearest centres."""
    sent = items.sparkSession.sparkContext.broadcast(centres)
    return items.where(F.col(vector).isNotNull()).select(F.explode(_cells(sent, entries)(F.col(vector).cast("array<double>"))).alias("cell"), item_id, F.col(vector).cast("array<double>").alias("vector"))


def _cells(sent, n: int):
    """The n cells nearest to a vector, nearest first."""

    @F.arrow_udf("array<int>")
    def run(vector: pa.Array) -> pa.Array:
        out = []
        for i in range(0, len(vector), 1024):
            near = -(_unit(_matrix(vector.slice(i, 1024))) @ sent.value.T)
            out += np.argsort(near, axis=1, kind="stable")[:, :n].tolist()
        return pa.array(out, pa.list_(pa.int32()))

    return run


def search_index(queries: DataFrame, index: DataFrame, centres: np.ndarray, k: int, item_id: str, probes: int, vector: str = "embedding", positive: bool = True) -> DataFrame:
    """(query_id, item, score, rank): the best k of queries (query_id, vector) in their ``probes`` nearest cells.

    A task scores the queries of a cell against at most CELL_ROWS of its vectors and passes on k rows
    a query. Scores are rounded and ties broken as by vector_topk.
    """
    sent = queries.sparkSession.sparkContext.broadcast(centres)
    v = F.col(vector).cast("array<double>")
    asked = queries.select("query_id", v.alias("vector"), F.explode(_cells(sent, probes)(v)).alias("cell"))
    parts = index.groupBy("cell").agg(F.ceil(F.count("*") / CELL_ROWS).cast("int").alias("parts"))
    asked = asked.join(parts, "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "query_id", "vector")
    held = index.join(parts, "cell").select("cell", F.pmod(F.xxhash64(item_id), F.col("parts")).cast("int").alias("part"), item_id, "vector")
    fields = {f.name: f.dataType.simpleString() for f in (*queries.schema.fields, *index.schema.fields)}

    def best(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        empty = pa.Table.from_arrays([mine.column("query_id").slice(0, 0), theirs.column(item_id).slice(0, 0), pa.array([], pa.float64())], ["query_id", item_id, "score"])
        if not len(mine) or not len(theirs):
            return empty
        items, names, ids, out = _unit(_matrix(theirs.column("vector"))), mine.column("query_id").combine_chunks(), theirs.column(item_id).combine_chunks(), []
        plain = ids.to_numpy(zero_copy_only=False)
        for i in range(0, len(names), 256):
            scores = np.round(_unit(_matrix(mine.column("vector").slice(i, 256))) @ items.T, SCALE) + 0.0
            order = np.lexsort((np.broadcast_to(plain, scores.shape), -scores), axis=1)[:, :k]
            query = np.repeat(np.arange(len(scores)) + i, order.shape[1])
            out.append(pa.Table.from_arrays([names.take(pa.array(query)), ids.take(pa.array(order.ravel())), pa.array(np.take_along_axis(scores, order, 1).ravel())], ["query_id", item_id, "score"]))
        return pa.concat_tables(out)

    found = asked.groupBy("cell", "part").cogroup(held.groupBy("cell", "part")).applyInArrow(best, f"query_id {fields['query_id']}, {item_id} {fields[item_id]}, score double")
    ranked = rank(found.distinct(), k, F.col("score").desc(), F.col(item_id))
    return ranked.where("score > 0") if positive else ranked


def recall(found: DataFrame, exact: DataFrame, item_id: str) -> DataFrame:
    """(query_id, recall): share of the exact results that were found."""
    hits = exact.join(found.select("query_id", item_id, F.lit(1).alias("hit")), ["query_id", item_id], "left")
    return hits.groupBy("query_id").agg((F.count("hit") / F.count("*")).alias("recall"))
