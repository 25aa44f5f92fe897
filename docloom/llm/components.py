"""Connected components of an edge table: in one task of bounded size, or by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import Scratch


#: Edges (16 bytes each) that one task contracts; more are contracted in rounds.
MOST_EDGES = 1 << 20


def connected_components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, root): each node of edges (bigint columns a, b) with the least node it is connected to.

    Up to MOST_EDGES edges, which 16 MB hold, are contracted by one task. More take rounds of
    two joins on the node, written to the shared folder, whose number grows with the logarithm
    of the longest path. Only counts reach the driver. Both ways give the same rows. Loops and
    repeated edges are allowed, null ends are not; no edges give no rows.
    """
    now = scratch.write(_canonical(edges.select(F.col("a"), F.col("b"))), f"{name}-0")
    if now.count() <= MOST_EDGES:
        return scratch.write(now.repartition(1).mapInArrow(_contracted, "node bigint, root bigint"), f"{name}-roots")
    step, state = 0, _state(now)
    while state[0]:
        large = _star(now, larger=True)
        step += 1
        following = scratch.write(_canonical(_star(large, larger=False)), f"{name}-{step}")
        scratch.drop(f"{name}-{step - 1}")
        reached = _state(following)
        now = following
        if reached == state and _is_stars(now):
            break
        state = reached
    roots = now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
    return scratch.write(roots.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()), f"{name}-roots")


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) of all edges of a task."""
    parts = [(x.column(0).to_numpy(), x.column(1).to_numpy()) for x in batches]
    a, b = (np.concatenate([np.zeros(0, np.int64), *[p[i] for p in parts]]) for i in (0, 1))
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = place[: len(a)], place[len(a) :]
    root = np.arange(len(nodes))
    while len(a):
        # The greater root of an edge points to the lesser one; then every node to its root's root.
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]
        a, b = root[a], root[b]
        apart = a != b
        a, b = a[apart], b[apart]
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[root])], ["node", "root"])


def _canonical(edges: DataFrame) -> DataFrame:
    """Each edge once, from the greater node a to the lesser node b."""
    return edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """Links the greater (or the lesser) neighbours of each node to the least one of the node and its neighbours."""
    if larger:
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("other")))
        least = both.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("m", "node").alias("m"))
        return both.where("other > node").join(least, "node").select(F.col("other").alias("a"), F.col("m").alias("b")).where("a <> b")
    least = edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
    joined = edges.withColumnRenamed("a", "node").join(least, "node")
    return joined.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(least.select(F.col("node").alias("a"), F.col("m").alias("b")))


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def _is_stars(edges: DataFrame) -> bool:
    """Whether every node has one lesser neighbour, which has none."""
    return edges.groupBy("a").count().where("count > 1").isEmpty() and edges.join(edges.select(F.col("a").alias("b")).distinct(), "b", "left_semi").isEmpty()
