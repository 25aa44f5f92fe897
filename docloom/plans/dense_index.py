"""A stored dense index: cells of unit vectors with product-quantised residuals, in segments.

``build`` fits centres and code books on a bounded sample and writes the first segment; ``add`` and ``delete`` write further
segments without touching those there. A segment holds, sorted by cell, each vector's code (one byte for each part of
its difference from the centre), how far the code is off, and the vector itself; for each cell the
widest angle of its vectors; and the ids whose rows in earlier segments no longer count.
A segment appears under its number in one step, so a search sees all of it or nothing, and of two
writers one takes the next number. ``compact`` makes one segment of all.

A search is exact or approximate. It first looks into each query's nearest cells. There codes alone
rank the vectors, and only the best are read and scored. The k-th score found, and the widest angles, then
tell which other cells may hold something better, and how far the codes are off tells which
vectors there may be: an exact search looks into just those. What is read follows from how
the vectors lie: of clustered ones a few cells, of vectors without any structure nearly all.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.groups import runs
from docloom.plans.ann import FIT_ROWS, fit_cells
from docloom.plans.retrieval import SCALE, _matrix, _unit, rank
from docloom.sources import shared
from docloom.store import cut

#: Dimensions of a part that one byte stands for, and rounds in which its 256 values are fitted.
PART, ROUNDS = 8, 8
#: Vectors of a cell that one task ranks; a larger cell is dealt to several.
CELL_ROWS = 20_000
#: Of an approximate search: vectors that are scored for each result asked for.
SHORTLIST = 12
#: Cells that a scan is filtered by as a list.
LISTED = 2000
#: Half a unit of the last digit of scores, which are rounded before they are ranked.
HALF = 0.5 * 10**-SCALE + 1e-9


class Codes:
    """Centres of the cells, and the values of each part of a residual."""

    def __init__(self, centres: np.ndarray, books: list[np.ndarray]):
        self.centres, self.books = centres, books

    @classmethod
    def fit(cls, sample: np.ndarray, centres: np.ndarray) -> Codes:
        x = sample - centres[(sample @ centres.T).argmax(1)]
        rng, books = np.random.default_rng(7), []
        for at in range(0, centres.shape[1], PART):
            part = x[:, at : at + PART]
            book = part[rng.permutation(len(part))[:256]] if len(part) else np.zeros((1, min(PART, centres.shape[1] - at)))
            for _ in range(ROUNDS):
                near = cls._nearest(part, book)
                sums, n = np.zeros_like(book), np.bincount(near, minlength=len(book))
                np.add.at(sums, near, part)
                book = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], book)
            books.append(book)
        return cls(centres, books)

    @staticmethod
    def _nearest(part: np.ndarray, book: np.ndarray) -> np.ndarray:
        return ((book * book).sum(1) - 2 * part @ book.T).argmin(1) if len(part) else np.zeros(0, np.int64)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Cell, code, distance of the code from the unit vector, angle to the centre."""
        near = x @ self.centres.T
        cell = near.argmax(1)
        rest = x - self.centres[cell]
        code = np.stack([self._nearest(rest[:, i * PART : (i + 1) * PART], book) for i, book in enumerate(self.books)], axis=1).astype(np.uint8)
        off = np.linalg.norm(rest - self.decode(code), axis=1)
        return cell, code, off, np.arccos(np.clip(near[np.arange(len(x)), cell], -1, 1))

    def decode(self, code: np.ndarray) -> np.ndarray:
        return np.concatenate([book[code[:, i]] for i, book in enumerate(self.books)], axis=1)

    def scores(self, queries: np.ndarray, cell: int, code: np.ndarray) -> np.ndarray:
        """[query, vector] product of the query with what the code stands for."""
        out = np.repeat((queries @ self.centres[cell])[:, None], len(code), axis=1)
        for i, book in enumerate(self.books):
            out += (queries[:, i * PART : (i + 1) * PART] @ book.T)[:, code[:, i]]
        return out

    def bytes(self) -> list[tuple[str, int, int, bytes]]:
        return [(name, *m.shape, m.astype("<f8").tobytes()) for name, m in [("centres", self.centres), *((f"book{i:04d}", b) for i, b in enumerate(self.books))]]


class DenseIndex:
    """A stored index below a folder of the shared store; ids are of any type that orders."""

    def __init__(self, spark: SparkSession, path: str, item_id: str):
        self.spark, self.path, self.item_id = spark, path.rstrip("/"), item_id
        rows = {r["name"]: np.frombuffer(r["data"], "<f8").reshape(r["n"], r["width"]) for r in spark.read.parquet(f"{self.path}/codes").collect()}  # of the size that the number of cells bounds
        self.codes = Codes(rows["centres"], [rows[k] for k in sorted(rows) if k != "centres"])

    @classmethod
    def build(cls, items: DataFrame, path: str, item_id: str, vector: str, cells: int) -> DenseIndex:
        spark, path = items.sparkSession, path.rstrip("/")
        centres = fit_cells(items, item_id, vector, cells)
        sample = items.where(F.col(vector).isNotNull()).orderBy(F.xxhash64(item_id), item_id).limit(FIT_ROWS).select(F.col(vector).cast("array<double>")).toArrow()
        x = _unit(_matrix(sample.column(0))) if len(sample) else np.zeros((0, centres.shape[1]))
        made = f"{path}/made-{uuid.uuid4().hex}"
        spark.createDataFrame([(n, a, b, bytearray(d)) for n, a, b, d in Codes.fit(x, centres).bytes()], "name string, n int, width int, data binary").coalesce(1).write.parquet(made)
        if not shared.publish(spark, made, f"{path}/codes"):
            shared.remove(spark, made)
            raise ValueError(f"there is an index in {path}")
        index = cls(spark, path, item_id)
        index.add(items, vector, replace=False)
        return index

    # -- segments

    def segments(self) -> list[str]:
        return shared.names(self.spark, f"{self.path}/segments")

    def _write(self, rows: DataFrame | None, dead: DataFrame, taken: list[str] | None = None) -> str:
        """A segment under the next free number. taken: the segments that it stands for, of which none may have been added to."""
        made = f"{self.path}/made-{uuid.uuid4().hex}"
        if rows is not None:
            rows.repartitionByRange("cell", self.item_id).sortWithinPartitions("cell", self.item_id).write.option("parquet.block.size", 4 << 20).parquet(f"{made}/rows")
            self.spark.read.parquet(f"{made}/rows").groupBy("cell").agg(F.max("angle").alias("angle"), F.count("*").alias("n")).coalesce(1).write.parquet(f"{made}/cells")
        dead.write.parquet(f"{made}/dead")
        while True:
            there = self.segments()
            if taken is not None and there != taken:
                shared.remove(self.spark, made)
                raise ValueError(f"segments were added to {self.path} meanwhile")
            name = f"{int(there[-1]) + 1 if there else 0:08d}"
            if shared.publish(self.spark, made, f"{self.path}/segments/{name}"):
                return name

    def add(self, items: DataFrame, vector: str, replace: bool = True) -> str:
        """Enters vectors, in place of those of the same ids; of repeated ids any one. Raises, before anything is entered, at another dimension."""
        width, kind = self.codes.centres.shape[1], items.schema[self.item_id].dataType.simpleString()
        v = F.col(vector).cast("array<double>")
        checked = F.when(F.size(v) == width, v).otherwise(F.raise_error(F.concat(F.lit("dimension "), F.size(v).cast("string"))).cast("array<double>"))
        rows = items.where(F.col(self.item_id).isNotNull() & F.col(vector).isNotNull()).select(self.item_id, checked.alias("vector")).dropDuplicates([self.item_id])
        codes = self.codes

        def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(0, len(batch), 1024):
                    part = batch.slice(i, 1024)
                    cell, code, off, angle = codes.encode(_unit(_matrix(part.column(1))))
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(cell.astype(np.int32)), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(off), pa.array(angle)], [self_id, "vector", "cell", "code", "off", "angle"])

        self_id = self.item_id
        coded = cut(rows.mapInArrow(encode, f"`{self_id}` {kind}, vector array<double>, cell int, code binary, off double, angle double"))
        return self._write(coded, coded.select(self.item_id) if replace else coded.select(self.item_id).limit(0))

    def delete(self, ids: DataFrame) -> str:
        """Takes out the vectors of ids (the item id)."""
        return self._write(None, ids.select(self.item_id).where(F.col(self.item_id).isNotNull()).distinct())

    def compact(self) -> str:
        """One segment of all that still counts; the earlier ones go once it is there."""
        there = self.segments()
        rows = self.live().drop("seg")
        name = self._write(rows, rows.select(self.item_id).limit(0), there)
        for old in there:
            shared.remove(self.spark, f"{self.path}/segments/{old}")
        return name

    def _parts(self, what: str) -> DataFrame | None:
        out = None
        for name in self.segments():
            if what in shared.names(self.spark, f"{self.path}/segments/{name}"):
                df = self.spark.read.parquet(f"{self.path}/segments/{name}/{what}").withColumn("seg", F.lit(int(name)))
                out = df if out is None else out.unionByName(df)
        return out

    def live(self, cells: DataFrame | None = None) -> DataFrame:
        """The rows that count, of some cells (cell) if given."""
        rows, dead = self._parts("rows"), self._parts("dead")
        if cells is not None:
            listed = [r["cell"] for r in cells.select("cell").distinct().limit(LISTED + 1).collect()]
            rows = rows.where(F.col("cell").isin(listed)) if len(listed) <= LISTED else rows.join(cells.select("cell").distinct(), "cell", "left_semi")
        dead = dead.groupBy(F.col(self.item_id).alias("__dead")).agg(F.max("seg").alias("__since"))
        return rows.join(dead, (F.col(self.item_id) == F.col("__dead")) & (F.col("seg") < F.col("__since")), "left_anti")

    def metadata(self, ids: DataFrame) -> DataFrame:
        """(item id, cell, seg) of ids that are there."""
        return self.live().join(ids.select(self.item_id).distinct(), self.item_id, "left_semi").select(self.item_id, "cell", "seg")

    # -- search

    def search(self, queries: DataFrame, k: int, probes: int = 4, vector: str = "embedding", exact: bool = True, positive: bool = True) -> DataFrame:
        """(query_id, item id, score, rank): the best k of queries (query_id, vector) by the cosine, rounded as by vector_topk.

        Approximate: within the nearest ``probes`` cells, the best SHORTLIST * k by codes are scored. Exact: then also all that could be better.
        """
        codes, n_cells, id_col = self.codes, len(self.codes.centres), self.item_id
        v = F.col(vector).cast("array<double>")
        asked = cut(queries.where(F.col("query_id").isNotNull() & F.col(vector).isNotNull()).select("query_id", v.alias("q")))
        widest = np.full(n_cells, -np.inf)
        for r in self._parts("cells").groupBy("cell").agg(F.max("angle").alias("angle")).collect():  # a row for each cell
            widest[r["cell"]] = r["angle"]
        kind = asked.schema["query_id"].dataType.simpleString()

        def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """The cells to look into: the nearest, or with a floor those that may hold as much and were not looked into."""
            for batch in batches:
                for i in range(0, len(batch), 256):
                    part = batch.slice(i, 256)
                    cosine = np.clip(_unit(_matrix(part.column(1))) @ codes.centres.T, -1, 1)
                    cosine[:, np.isinf(widest)] = -2
                    first = np.argsort(-cosine, axis=1, kind="stable")[:, :probes]
                    want = np.zeros(cosine.shape, bool)
                    np.put_along_axis(want, first, True, axis=1)
                    want &= cosine > -2
                    if len(part.columns) > 2:
                        most = np.cos(np.maximum(np.arccos(np.clip(cosine, -1, 1)) - widest[None, :] - 1e-7, 0))
                        floor = np.array([-2.0 if x is None else x for x in part.column(2).to_pylist()])
                        want = ~want & (cosine > -2) & (most >= floor[:, None] - HALF)
                    q, cell = np.nonzero(want)
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(q)), pa.array(cell.astype(np.int32))], ["query_id", "cell"])

        first = cut(asked.mapInArrow(near, f"query_id {kind}, cell int"))
        found = cut(self._scored(asked, self._shortlist(asked, first, SHORTLIST * k)))
        if exact:
            w = "row_number() OVER (PARTITION BY query_id ORDER BY score DESC)"
            floors = found.withColumn("__n", F.expr(w)).where(F.col("__n") == k).select("query_id", F.col("score").alias("floor"))
            # Cells looked into are gone over again for what the codes ranked too low.
            floored = cut(asked.join(floors, "query_id", "left"))
            more = floored.select("query_id", "q", "floor").mapInArrow(near, f"query_id {kind}, cell int").unionByName(first)
            found = found.unionByName(self._reached(floored, cut(more), k)).distinct()
        ranked = rank(found, k, F.col("score").desc(), F.col(id_col))
        return ranked.where("score > 0") if positive else ranked

    def _met(self, asked: DataFrame, cells: DataFrame, columns: list[str]) -> tuple[DataFrame, dict[str, str]]:
        """(queries (side 0) and rows (side 1) of each cell, sorted by cell and part in tasks; the columns' types)."""
        id_col = self.item_id
        rows = self.live(cells).select("cell", id_col, *columns)
        parts = rows.groupBy("cell").agg(F.ceil(F.count("*") / CELL_ROWS).cast("int").alias("parts"))
        kinds = {f.name: f.dataType.simpleString() for f in (*asked.schema.fields, *rows.schema.fields)}
        none = lambda c: F.lit(None).cast(kinds[c]).alias(c)
        own = [c for c in asked.columns if c != "query_id"]
        ask = cells.join(asked, "query_id").join(parts, "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("side"), "query_id", *own, *map(none, (id_col, *columns)))
        held = rows.join(parts, "cell").select("cell", F.pmod(F.xxhash64(id_col), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("side"), *map(none, ("query_id", *own)), id_col, *columns)
        return ask.unionByName(held).repartition("cell", "part").sortWithinPartitions("cell", "part", "side"), kinds

    def _shortlist(self, asked: DataFrame, cells: DataFrame, most: int) -> DataFrame:
        """(query_id, item id, cell): by codes, the best ``most`` of a query."""
        codes, id_col = self.codes, self.item_id
        met, kinds = self._met(asked, cells, ["code"])

        def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for mine, theirs, cell in _sides(batches):
                code = _codes(theirs)
                names, ids = mine.column("query_id").combine_chunks(), theirs.column(id_col).combine_chunks()
                for i in range(0, len(mine), 256):
                    scores = codes.scores(_unit(_matrix(mine.column("q").slice(i, 256))), cell, code)
                    order = np.argpartition(-scores, min(most, scores.shape[1]) - 1, axis=1)[:, :most]
                    q, x = np.repeat(np.arange(len(scores)), order.shape[1]), order.ravel()
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(q + i)), ids.take(pa.array(x)), pa.array(np.full(len(x), cell, np.int32)), pa.array(scores[q, x])], ["query_id", id_col, "cell", "guess"])

        found = met.mapInArrow(best, f"query_id {kinds['query_id']}, `{id_col}` {kinds[id_col]}, cell int, guess double")
        return rank(found, most, F.col("guess").desc(), F.col(id_col)).select("query_id", id_col, "cell")

    def _reached(self, asked: DataFrame, cells: DataFrame, k: int) -> DataFrame:
        """(query_id, item id, score): of each part of a cell the best k that reach the floor of a query (asked: query_id, q, floor).

        Codes tell which vectors may; these are multiplied where they lie, so no pair leaves a task but those k.
        """
        codes, id_col = self.codes, self.item_id
        met, kinds = self._met(asked, cells, ["code", "off", "vector"])

        def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for mine, theirs, cell in _sides(batches):
                code, off = _codes(theirs), theirs.column("off").to_numpy()
                names, ids = mine.column("query_id").combine_chunks(), theirs.column(id_col).combine_chunks()
                plain, vectors = ids.to_numpy(zero_copy_only=False), _unit(_matrix(theirs.column("vector")))
                for i in range(0, len(mine), 256):
                    part = mine.slice(i, 256)
                    own, floors = _unit(_matrix(part.column("q"))), part.column("floor").fill_null(-2.0).to_numpy()[:, None]
                    may = codes.scores(own, cell, code) + off[None, :] >= floors - HALF
                    some = np.flatnonzero(may.any(0))
                    scores = np.round(own @ vectors[some].T, SCALE) + 0.0
                    q, x = np.nonzero(may[:, some] & (scores >= floors - HALF))
                    order = np.lexsort((plain[some[x]], -scores[q, x], q))
                    q, x = q[order], x[order]
                    first = np.arange(len(q)) - np.searchsorted(q, q) < k
                    q, x = q[first], x[first]
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(q + i)), ids.take(pa.array(some[x])), pa.array(scores[q, x])], ["query_id", id_col, "score"])

        return met.mapInArrow(best, f"query_id {kinds['query_id']}, `{id_col}` {kinds[id_col]}, score double")

    def _scored(self, asked: DataFrame, pairs: DataFrame) -> DataFrame:
        """pairs with their cosines; only the vectors of pairs are read into products."""
        pairs, id_col = cut(pairs), self.item_id
        vectors = self.live(pairs).join(pairs.select(id_col).distinct(), id_col, "left_semi").select(id_col, "vector")
        rows = pairs.select("query_id", id_col).join(vectors, id_col).join(asked, "query_id")
        kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                a, b = (_unit(_matrix(batch.column(i))) for i in (2, 3))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.round((a * b).sum(1), SCALE) + 0.0 if len(batch) else np.zeros(0))], ["query_id", id_col, "score"])

        return rows.select("query_id", id_col, "vector", "q").mapInArrow(score, f"query_id {kinds['query_id']}, `{id_col}` {kinds[id_col]}, score double")


def _sides(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, pa.Table, int]]:
    """The queries, the rows and the number of each cell's part that has both."""
    for group in runs(batches, 2):
        side = group.column("side").to_numpy()
        mine, theirs = group.filter(pa.array(side == 0)), group.filter(pa.array(side == 1))
        if len(mine) and len(theirs):
            yield mine, theirs, group.column("cell")[0].as_py()


def _codes(rows: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(rows.column("code").to_pylist()), np.uint8).reshape(len(rows), -1)
