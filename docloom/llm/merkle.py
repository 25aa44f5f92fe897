"""Merkle manifest of a table: a tree of digests for each group, a tree over the groups, proofs.

Leaves of a group stand in order; while a level has several nodes, every ARITY consecutive ones
become their parent. The trees are built as ``combineByKey`` builds values, event by event:
a node that arrives joins its parent's partial list of indexed children; once the list
has as many as the parent's place and the size of its group give it, the parent is emitted and
arrives at its own parent at once. Tasks begin on ranges of leaves, so whatever lies within a
range is finished there; the partial lists left at the edges of ranges are exchanged, in each
round by ancestors BLOCK levels higher, until nothing is left. A finished parent leaves a link to
its children. Proofs go back along the links from the roots: BLOCK levels at a time, a block's
links meet the path above it, and in the last step its leaves.

A hot group is many ranges; no task gets more than a range of leaves or a block of
ARITY ** BLOCK of them. The driver holds the number of groups, the largest size and the root.

Defined results: a null field is written as ``-``; leaves whose key is null come first, ties
stand in order of their digests, so repeated rows are leaves each and interchangeable; a null
group is a group, and comes first; texts are hashed whole; an empty table has no root and no
proofs; columns of ``leaves`` are kept in ``row``, so names can't clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import Scratch

BITS, BLOCK = 3, 3
ARITY = 1 << BITS
#: Rows that a task hands on at once.
ROWS = 2048

_NODES = "kind int, tree bigint, size bigint, level int, idx bigint, data binary"
WAITING, LINK, ROOT = 0, 1, 2


def field(column: Column) -> Column:
    text = column.cast("string")
    return F.when(column.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(*columns: Column) -> Column:
    """Digest of a row as binary: each field preceded by its length, so that no two rows read alike."""
    return F.unhex(F.sha2(F.concat(*map(field, columns)).cast("binary"), 256))


def digest_of(children: bytes) -> bytes:
    """A parent's digest: over its children's, written in hex."""
    return hashlib.sha256(children.hex().encode()).digest()


def width(size: int, level: int) -> int:
    return -(-size >> BITS * level)


def height(size: int) -> int:
    level = 0
    while width(size, level) > 1:
        level += 1
    return level


def _absorb(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes in any order to links, roots and the nodes whose parents are not complete."""
    partial: dict[tuple, tuple[int, dict[int, bytes]]] = {}
    rows: list[tuple] = []

    def pack() -> pa.RecordBatch:
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
        out = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["kind", "tree", "size", "level", "idx", "data"])
        rows.clear()
        return out

    for batch in batches:
        for tree, size, level, idx, data in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            while (wide := width(size, level)) > 1:
                parent, slot = idx >> BITS, idx & (ARITY - 1)
                children = partial.setdefault((tree, level, parent), (size, {}))[1]
                children[slot] = data
                if len(children) < (arity := min(ARITY, wide - (parent << BITS))):
                    break
                del partial[tree, level, parent]
                data = b"".join([children[i] for i in range(arity)])
                level, idx = level + 1, parent
                rows.append((LINK, tree, size, level, idx, data))
                data = digest_of(data)
            else:
                rows.append((ROOT, tree, size, level, 0, data))
        if len(rows) >= ROWS:
            yield pack()
    for (tree, level, parent), (size, children) in partial.items():
        rows += [(WAITING, tree, size, level, (parent << BITS) + slot, data) for slot, data in children.items()]
        if len(rows) >= ROWS:
            yield pack()
    if rows:
        yield pack()


def _grow(nodes: DataFrame, largest: int, scratch: Scratch, name: str) -> tuple[DataFrame, DataFrame]:
    """(links, roots) of the trees over nodes (tree, size, level, idx, data)."""
    done = [scratch.write(nodes.mapInArrow(_absorb, _NODES), f"{name}0", keep=True)]
    for step in range(1, -(-height(largest) // BLOCK) + 1):
        waiting = done[-1].where(F.col("kind") == WAITING).drop("kind")
        if waiting.isEmpty():
            break
        up = F.greatest(F.lit(step * BLOCK) - F.col("level"), F.lit(0))
        ancestor = F.expr("shiftrightunsigned(idx, CAST(up AS INT))")
        meeting = waiting.withColumn("up", up * BITS).withColumn("ancestor", ancestor).repartition("tree", "ancestor", F.greatest(F.col("level"), F.lit(step * BLOCK))).drop("up", "ancestor")
        done.append(scratch.write(meeting.mapInArrow(_absorb, _NODES), f"{name}{step}", keep=True))
    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)
    return found.where(F.col("kind") == LINK).drop("kind"), found.where(F.col("kind") == ROOT).drop("kind")


def _step(slot: int, children: str) -> str:
    """A step of a path: the own place among the children, and the others' digests."""
    return f"{slot}:{children[: 64 * slot]}{children[64 * (slot + 1) :]}/"


def _descend(leaves: bool):
    """Rows of a block, sorted by kind (the path above it, its links, its leaves), to a path for each leaf or each node at its foot."""

    def descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, above, links, known, order = None, None, {}, {}, []

        def path(level: int, idx: int) -> str:
            """From the node of this level to the root."""
            if (level, idx) not in known:
                children = links.get((level + 1, idx >> BITS))
                known[level, idx] = above[0] if children is None else _step(idx & (ARITY - 1), children) + path(level + 1, idx >> BITS)
            return known[level, idx]

        def foot() -> list[tuple]:
            low = min((level for level, _ in links), default=0)
            return [(tree, (idx << BITS) + slot, path(low - 1, (idx << BITS) + slot), *above[1:]) for tree, level, idx in order if level == low for slot in range(len(links[level, idx]) // 64)]

        def pack(batch: pa.RecordBatch | None, taken: list[int], rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            if leaves:
                return pa.RecordBatch.from_arrays([batch.column("row").take(pa.array(taken)), *(pa.array(c, pa.string()) for c in columns)], ["row", "path", "subroot", "root"])
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()), strict=True)], ["tree", "idx", "path", "subroot", "root"])

        for whole in batches:
            for start in range(0, len(whole), ROWS):
                batch = whole.slice(start, ROWS)
                rows, taken = [], []
                names = ("tree", "block", "kind", "level", "idx", "data", "path", "subroot", "root")
                for i, (tree, block, kind, level, idx, data, *up) in enumerate(zip(*(batch.column(x).to_pylist() for x in names), strict=True)):
                    if (tree, block) != at:
                        if not leaves and links:
                            rows += foot()
                        at, above, links, known, order = (tree, block), None, {}, {}, []
                    if kind == 0:
                        above = up
                    elif kind == 1:
                        links[level, idx] = data.hex()
                        order.append((tree, level, idx))
                    else:
                        children = links.get((1, idx >> BITS))
                        rows.append((above[0] if children is None else _step(idx & (ARITY - 1), children) + path(1, idx >> BITS), *above[1:]))
                        taken.append(i)
                if rows:
                    yield pack(batch, taken, rows)
        if not leaves and links:
            yield pack(None, [], foot())

    return descend


def _paths(links: DataFrame, tops: DataFrame, leaves: DataFrame, largest: int, scratch: Scratch, name: str) -> DataFrame:
    """(row, path, subroot, root) of leaves (tree, idx, row), from tops (tree, size, path, subroot, root), the paths above the trees."""
    kind = leaves.schema["row"].dataType
    none = lambda t: F.lit(None).cast(t)
    steps = max(1, -(-height(largest) // BLOCK))
    blocks = [ARITY ** (BLOCK * k) for k in range(1, steps)]
    first = F.lit(0)
    for size in blocks:
        first = first + (F.col("size") > size).cast("int")  # the uppermost block that the tree reaches
    tops = tops.withColumn("step", first)
    above = None
    for step in reversed(range(steps)):
        own = tops.where(F.col("step") == step).select("tree", F.lit(0).cast("bigint").alias("block"), "path", "subroot", "root")
        own = own if above is None else own.unionByName(above)
        inner = links.where((F.col("level") > step * BLOCK) & (F.col("level") <= (step + 1) * BLOCK))
        inner = inner.select("tree", F.expr(f"shiftrightunsigned(idx, {BITS} * ({(step + 1) * BLOCK} - level))").alias("block"), F.lit(1).alias("kind"), "level", "idx", "data", *(none("string").alias(x) for x in ("path", "subroot", "root")), none(kind).alias("row"))
        own = own.select("tree", "block", F.lit(0).alias("kind"), none("int").alias("level"), none("bigint").alias("idx"), none("binary").alias("data"), "path", "subroot", "root", none(kind).alias("row"))
        rows = own.unionByName(inner)
        if step == 0:
            block = F.expr(f"shiftrightunsigned(idx, {BITS * BLOCK})")
            rows = rows.unionByName(leaves.select("tree", block.alias("block"), F.lit(2).alias("kind"), none("int").alias("level"), "idx", none("binary").alias("data"), *(none("string").alias(x) for x in ("path", "subroot", "root")), "row"))
        rows = rows.repartition("tree", "block").sortWithinPartitions("tree", "block", "kind", "idx")
        if step:
            found = scratch.write(rows.mapInArrow(_descend(False), "tree bigint, idx bigint, path string, subroot string, root string"), f"{name}{step}", keep=True)
            above = found.withColumnRenamed("idx", "block")
        else:
            rows = rows.mapInArrow(_descend(True), f"row {kind.simpleString()}, path string, subroot string, root string")
    return rows


def _ranged(df: DataFrame, by: list[str], group: Column, scratch: Scratch, name: str) -> tuple[DataFrame, DataFrame]:
    """df in ranges of by, which begins with group; and for each range and group how many rows come before, from where, and the group's size."""
    ranged = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("place", F.monotonically_increasing_id())
    rows = scratch.write(ranged, name, keep=True).withColumn("range", F.expr("shiftright(place, 33)"))
    runs = rows.groupBy("range", group.alias("own")).agg(F.min("place").alias("first"), F.count("*").alias("n"))
    before = F.expr("coalesce(sum(n) OVER (PARTITION BY own ORDER BY range ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)")
    return rows, scratch.write(runs.select(F.col("range").alias("run"), "own", (before - F.col("first")).alias("shift"), F.expr("sum(n) OVER (PARTITION BY own)").alias("size")), f"{name}_runs", keep=True)


def _placed(rows: DataFrame, runs: DataFrame, group: Column) -> DataFrame:
    """rows with idx, the place in the group, and what runs say of the group."""
    joined = rows.join(runs, (F.col("range") == F.col("run")) & group.eqNullSafe(F.col("own")))
    return joined.withColumn("idx", F.col("place") + F.col("shift"))


class Manifest:
    """Written trees: ``links`` (tree, size, level, idx, data: the children's digests), ``roots`` (tree, size, data), ``groups`` (grp, tree, size), ``root`` in hex."""

    def __init__(self, df: DataFrame, digest: str, group: str, order: str, scratch: Scratch):
        """df's column digest: binary of 32 bytes, one a leaf."""
        self.scratch = scratch
        leaves = df.select(F.col(group).alias("grp"), F.col(order).alias("ord"), F.col(digest).alias("digest"), F.struct(*df.columns).alias("row"))
        ranged, runs = _ranged(leaves, ["grp", "ord", "digest"], F.col("grp"), scratch, "ranges")
        self.empty = runs.isEmpty()
        if self.empty:
            self.leaves, self.root = ranged.select("row"), None
            return
        groups = runs.groupBy(F.col("own").alias("grp")).agg(F.max("size").alias("leaves"))
        ordered = _placed(*_ranged(groups, ["grp"], F.lit(0), scratch, "groups_ranged"), F.lit(0))
        self.groups = scratch.write(ordered.select("grp", F.col("idx").alias("tree"), F.col("leaves").alias("size")), "groups", keep=True)
        self.n_groups, self.largest = self.groups.agg(F.count("*"), F.max("size")).first()
        runs = runs.join(self.groups.select("grp", "tree"), F.col("grp").eqNullSafe(F.col("own"))).drop("grp")
        numbered = _placed(ranged, runs, F.col("grp")).select("tree", "size", F.lit(0).alias("level"), "idx", F.col("digest").alias("data"), "row")
        self.leaves = scratch.write(numbered, "leaves", keep=True)
        self.links, self.roots = _grow(self.leaves.drop("row"), self.largest, scratch, "trees")
        heads = self.roots.select(F.lit(0).cast("bigint").alias("tree"), F.lit(self.n_groups).cast("bigint").alias("size"), F.lit(0).alias("level"), F.col("tree").alias("idx"), "data")
        self.head_links, head = _grow(heads, self.n_groups, scratch, "heads")
        self.root = head.first()["data"].hex()

    def proofs(self) -> DataFrame:
        """df's columns, and for each leaf its path, the subroot of its group and the root, in hex."""
        if self.empty:
            return self.leaves.select("row.*", *(F.lit(None).cast("string").alias(x) for x in ("path", "subroot", "root")))
        spark = self.leaves.sparkSession
        start = spark.createDataFrame([(0, self.n_groups, "", None, self.root)], "tree bigint, size bigint, path string, subroot string, root string")
        heads = self.roots.select(F.lit(0).cast("bigint").alias("tree"), F.col("tree").alias("idx"), F.struct("tree", "size", F.lower(F.hex("data")).alias("subroot")).alias("row"))
        tops = self.scratch.write(_paths(self.head_links, start, heads, self.n_groups, self.scratch, "above").select("row.tree", "row.size", "path", "row.subroot", "root"), "tops", keep=True)
        return _paths(self.links, tops, self.leaves.select("tree", "idx", "row"), self.largest, self.scratch, "paths").select("row.*", "path", "subroot", "root")


def siblings(path: Column | str) -> Column:
    """The digests of a path as one text, from the leaf's siblings to the root's children."""
    return F.regexp_replace(path, "[0-7]:|/", "")


def fold(digest: Column | str, path: Column | str) -> Column:
    """The root, in hex, that a leaf's digest (binary) and a path give."""

    @F.arrow_udf("string")
    def folded(digest: pa.Array, path: pa.Array) -> pa.Array:
        out = []
        for own, steps in zip(digest.to_pylist(), path.to_pylist(), strict=True):
            if own is None or steps is None:
                out.append(None)
                continue
            text = own.hex()
            for step in steps.split("/")[:-1]:
                slot, others = int(step[0]), step[2:]
                text = hashlib.sha256(f"{others[: 64 * slot]}{text}{others[64 * slot :]}".encode()).hexdigest()
            out.append(text)
        return pa.array(out, pa.string())

    return folded(digest, path)


def document_manifest(docs: DataFrame, scratch: Scratch) -> Manifest:
    """The manifest of documents by language, each leaf over doc_id, source, lang, n_chars and text; tampered is the digest
    with the text's A-Z lower-cased where 3 divides the checksum of doc_id, else null."""
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    head = [F.col(x) for x in ("doc_id", "source", "lang", "n_chars")]
    marked = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    leaves = docs.select("doc_id", "lang", leaf_digest(*head, F.col("text")).alias("leaf"), F.when(marked, leaf_digest(*head, lower)).alias("tampered"))
    return Manifest(scratch.write(leaves, "digests", keep=True), "leaf", "lang", "doc_id", scratch)
