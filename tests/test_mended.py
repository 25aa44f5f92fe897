"""Merged cells, passages held by texts, places, and pages from ranges, against plain versions."""

import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docloom import seams
from docloom.operators import catalog as C
from docloom.operators import sequence
from docloom.plans import evaluation as E
from docloom.store import new_folder


def test_merged_cells_stay_one_row_each(spark):
    """A first cell, a later cell and a range that occur twice; ranges that overlap; a range whose first cell is missing or null."""
    cells = [("a", 1, 1, "top"), ("a", 1, 1, "zzz"), ("a", 1, 2, "x"), ("a", 2, 2, "y"), ("a", 2, 2, "y"), ("a", 3, 3, "in two"), ("a", 9, 9, "free"), ("b", 2, 2, "no first"), ("b", 5, 5, None), ("b", 5, 6, "n"), ("b", 700, 1, "deep")]
    merges = [("a", 1, 1, 2, 2), ("a", 1, 1, 2, 2), ("a", 2, 2, 3, 3), ("a", 3, 3, 4, 4), ("b", 1, 1, 3, 3), ("b", 5, 5, 5, 6), ("b", 5, 5, 900, 5)]
    df = spark.createDataFrame(cells, "sheet string, row int, col int, value string")
    got = sequence.fill_merged(df, spark.createDataFrame(merges, "sheet string, r0 int, c0 int, r1 int, c1 int"), ["sheet"]).collect()
    assert len(got) == len(cells)
    first = {}
    for s, r, c, v in cells:
        first[s, r, c] = v if first.get((s, r, c)) is None or (v is not None and v < first[s, r, c]) else first[s, r, c]
    want = []
    for s, r, c, v in cells:
        own = sorted(m[1:] for m in merges if m[0] == s and m[1] <= r <= m[3] and m[2] <= c <= m[4])
        want.append((s, r, c, first.get((s, *own[0][:2])) if own else v))
    key = lambda x: tuple(map(str, x))
    assert sorted((tuple(r) for r in got), key=key) == sorted(want, key=key)


def test_passages_held_by_texts(spark):
    """Passages of one to many words, cut inside words, with other white space, empty, null, repeated; all as plain containment finds them."""
    texts = ["alpha beta gamma delta epsilon zeta", "alpha beta gamma delta epsil", "", None, "beta  gamma", "x\nbeta gamma\tdelta epsilon zeta eta theta", "100% _sure_ of it and more words here", "alpha beta gamma delta epsilon zeta"]
    passages = ["beta gamma delta", "beta gamma delta epsil", "a beta gamma delta epsil", "eta", "beta gamma\tdelta epsilon zeta", "alpha beta gamma delta epsilon zeta", "gamma delta epsilon zeta eta theta iota", "", None, "beta  gamma", "%", "_sure_ of it and more", "beta gamma delta", " beta gamma delta epsilon z"]
    passages += [f"none {i}" for i in range(600)]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, body string")
    asked = spark.createDataFrame(list(enumerate(passages)), "query_id int, passage string")
    got = sorted((r.query_id, r.id) for r in E.holders(asked, docs, "id", "body").collect())
    assert got == sorted((q, i) for q, p in enumerate(passages) for i, t in enumerate(texts) if p is not None and t is not None and p in t)


def test_places(spark):
    df = spark.range(5000).selectExpr("CAST(id * 7919 % 1000 AS INT) AS k", "id").repartition(7)
    rows = sorted((r.place, r.k) for r in C.numbered(df, ["k", "id"]).collect())
    assert [p for p, _ in rows] == list(range(1, 5001)) and [k for _, k in rows] == sorted(k for _, k in rows)
    assert C.numbered(df.limit(0), ["k"]).count() == 0


def test_a_deep_page_reads_one_range(spark):
    df = spark.range(20000).selectExpr("id", "CAST(id % 97 AS INT) AS k", "IF(id % 50 = 0, NULL, id % 13) AS v").repartition(5)
    order = [F.col("v").desc_nulls_first(), F.col("k"), F.col("id")]
    pages = C.SortedPages.write(df, order, new_folder(spark, "pages"), 16)
    assert pages.total() == 20000
    for number, size in ((1, 20), (7, 200), (100, 200), (63, 199), (1000, 20), (101, 200), (0, 5)):
        got = pages.page(number, size)
        assert [tuple(r) for r in got.collect()] == [tuple(r) for r in C.page(df, order, number, size).collect()]
    plan = pages.page(900, 20)._jdf.queryExecution().executedPlan().toString()
    read = re.search(r"PartitionFilters: \[[^\]]*__range#\d+ (?:= (\d+)|IN \(([\d,]+)\))", plan)
    wanted = [int(x) for x in (read[1] or read[2]).split(",")]
    assert spark.read.parquet(f"{pages.path}/rows").where(F.col("__range").isin(wanted)).count() < 20000 / 8
    last = pages.page(40, 50).collect()[-1]
    after = pages.after((F.col("v") < last["v"]) | ((F.col("v") == last["v"]) & ((F.col("k") > last["k"]) | ((F.col("k") == last["k"]) & (F.col("id") > last["id"])))), 50)
    assert [tuple(r) for r in after.collect()] == [tuple(r) for r in pages.page(41, 50).collect()]
    with pytest.raises(ValueError):
        pages.page(1, 201)


def test_embedding_hashes_a_word_once(monkeypatch):
    """vectors are those of a loop over the words, and a word of many texts is hashed once."""
    rng = np.random.default_rng(4)
    texts = [[f"w{i}é" for i in rng.integers(0, 40, rng.integers(0, 60))] for _ in range(200)] + [None, [], ["a"]]
    want = []
    for row in texts:
        v = np.zeros(32)
        for w in row or []:
            h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
            v[h % 32] += 1.0 if h >> 63 else -1.0
        n = np.sqrt(v @ v)
        want.append((v / n if n else v).astype(np.float32).tolist())
    hashed, plain = [], hashlib.blake2b
    monkeypatch.setattr(hashlib, "blake2b", lambda w, **k: hashed.append(w) or plain(w, **k))
    arrays = pa.array(texts, pa.list_(pa.string()))
    assert seams.hashed_vectors(arrays, 32).to_pylist() == want and len(hashed) == len(set(hashed)) == 41
    assert seams.hashed_vectors(arrays[200:202], 32).to_pylist() == want[200:202]
    assert len(seams.hashed_vectors(arrays[:0], 32)) == 0 and seams.hashed_vectors(pa.array([[], None], arrays.type), 2).to_pylist() == [[0, 0]] * 2
