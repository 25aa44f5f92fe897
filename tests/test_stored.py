"""Stored tables and indexes: commits over several tables, and the dense index."""

import subprocess
import sys
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.operators import commits
from docloom.plans import dense_index as D
from docloom.plans import retrieval as R
from docloom.store import new_folder

FOUR = ("chunks", "chunk_index", "elements", "assets")


def ids_of(tables, name, version=None):
    return sorted(r[0] for r in tables.at(version).read(name).select("doc_id").collect())


@pytest.fixture()
def tables(spark):
    out = commits.TableSet(spark, new_folder(spark, "commits"))
    rows = spark.createDataFrame([(i % 5, f"row {i}") for i in range(20)], "doc_id long, body string")
    out.commit(out.at(), {n: rows for n in (*FOUR, "documents")})
    return out


def test_four_tables_change_together(spark, tables):
    before = tables.at()
    assert commits.remove_artifacts(tables, spark.createDataFrame([(2,), (3,), (3,), (99,)], "doc_id long")) == 2
    assert all(set(ids_of(tables, n)) == {0, 1, 4} for n in FOUR)
    assert set(ids_of(tables, "documents")) == {0, 1, 2, 3, 4}
    assert before.read("chunks").count() == 20 and all(set(ids_of(tables, n, 1)) == {0, 1, 2, 3, 4} for n in FOUR)  # a reader of the version before


def test_a_failure_between_tables_changes_nothing(spark, tables):
    base = tables.at()
    bad = base.read("elements").withColumn("body", F.raise_error(F.lit("no")).cast("string"))
    with pytest.raises(Exception, match="no"):
        tables.commit(base, {"chunks": base.read("chunks").limit(1), "elements": bad})
    assert tables.versions() == [1] and tables.at().read("chunks").count() == 20
    assert any(x.startswith("chunks-") for x in tables.clean())
    assert tables.at().read("elements").count() == 20


def test_a_batch_runs_once(spark, tables):
    new = spark.createDataFrame([(7, "new")], "doc_id long, body string")
    add = lambda base: {"chunks": base.read("chunks").unionByName(new)}
    assert tables.update(add, ("ingest", 0)) == 2 and tables.update(add, ("ingest", 0)) == 2
    assert tables.update(add, ("other", 0)) == 3 and tables.update(add, ("ingest", 1)) == 4 and tables.update(add, ("ingest", 0)) == 4
    assert ids_of(tables, "chunks").count(7) == 3


def test_conflicts(spark, tables):
    one, two, three = tables.at(), tables.at(), tables.at()
    tables.commit(one, {"chunks": one.read("chunks").where("doc_id = 1")})
    with pytest.raises(commits.Conflict):
        tables.commit(two, {"chunks": two.read("chunks").where("doc_id = 2")})
    with pytest.raises(commits.Conflict):  # it changes another table, but has read the one that changed
        tables.commit(three, {"assets": three.read("chunks").where("doc_id = 2")})
    four = tables.at(1)
    assert tables.commit(four, {"assets": four.read("assets").where("doc_id = 3")}) == 3  # neither read nor changed
    assert set(ids_of(tables, "chunks")) == {1} and set(ids_of(tables, "assets")) == {3}


def test_writers_at_once_lose_nothing(spark, tables):
    def write(k):
        new = spark.createDataFrame([(100 + k, "x")], "doc_id long, body string")
        tables.update(lambda base: {"chunks": base.read("chunks").unionByName(new)}, ("w", k) if k == 9 else None, tries=50)

    threads = [threading.Thread(target=write, args=(k,)) for k in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert [x for x in ids_of(tables, "chunks") if x >= 100] == [100, 101, 102, 103] and tables.versions() == [1, 2, 3, 4, 5]


KILLED = """
import os, sys
from pyspark.sql import SparkSession
from docloom.operators import commits
from docloom.sources import shared
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
tables = commits.TableSet(spark, sys.argv[1])
shared.publish = lambda *a: os._exit(9)  # both tables' rows and the manifest are written, the manifest is not published
tables.update(lambda base: {"chunks": base.read("chunks").limit(0), "elements": base.read("elements").limit(0)}, ("ingest", 5))
"""


def test_a_killed_writer_leaves_no_trace(spark, tables):
    run = subprocess.run([sys.executable, "-c", KILLED, tables.root], capture_output=True, timeout=300)
    assert run.returncode == 9, run.stderr[-2000:]
    assert tables.versions() == [1] and tables.at().read("chunks").count() == 20
    assert commits.remove_artifacts(tables, spark.createDataFrame([(1,)], "doc_id long"), batch=("ingest", 5)) == 2  # the batch runs again elsewhere
    tables.clean()
    assert set(ids_of(tables, "chunks")) == {0, 2, 3, 4} and tables.versions() == [2]


def test_ingest_and_stream_sink(spark, tables):
    doc = spark.createDataFrame([(4, "again"), (8, "new")], "doc_id long, body string")
    made = {"chunks": spark.createDataFrame([(4, "c"), (8, "c"), (8, "d")], "doc_id long, body string")}
    commits.ingest(tables, doc, made, ("up", 0))
    assert ids_of(tables, "chunks").count(4) == 1 and ids_of(tables, "chunks").count(8) == 2
    assert sorted(r.body for r in tables.at().read("documents").where("doc_id in (4, 8)").collect()) == ["again", "new"]
    sink = tables.sink("stream", lambda base, rows: {"assets": base.read("assets").unionByName(rows)})
    for number in (0, 0, 1):
        sink(doc, number)
    assert ids_of(tables, "assets").count(8) == 2


# -- the dense index


def clustered(n=4000, centres=50, seed=1):
    rng = np.random.default_rng(seed)
    at = rng.normal(size=(centres, 32))
    return [(i, [float(x) for x in at[i % centres] + 0.15 * rng.normal(size=32)]) for i in range(n)]


def frame(spark, rows, name="id"):
    return spark.createDataFrame(rows, f"{name} long, embedding array<double>")


def lists(df):
    return sorted((r.query_id, r["rank"], r.id, r.score) for r in df.collect())


def test_exact_search_and_little_scored(spark, monkeypatch):
    rows = clustered()
    items, queries = frame(spark, rows), frame(spark, rows[::97], "query_id")
    index = D.DenseIndex.build(items, new_folder(spark, "dense"), "id", "embedding", 50)
    scored = []
    plain = D.DenseIndex._scored
    monkeypatch.setattr(D.DenseIndex, "_scored", lambda self, asked, pairs: (scored.append(pairs.count()), plain(self, asked, pairs))[1])
    want = lists(R.vector_topk(queries, items, 10, "id"))
    assert lists(index.search(queries, 10)) == want
    assert sum(scored) <= queries.count() * len(rows) / 10
    found = {(q, i) for q, _, i, _ in lists(index.search(queries, 10, exact=False))}
    assert len(found & {(q, i) for q, _, i, _ in want}) >= 0.9 * len(want)


def test_vectors_without_structure_are_found_too(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=12)]) for i in range(600)] + [(1000, [0.0] * 12), (1001, None)]
    items, queries = frame(spark, rows), frame(spark, [*rows[:300:10], (7777, [0.0] * 12), (7778, None)], "query_id")
    index = D.DenseIndex.build(items, new_folder(spark, "dense"), "id", "embedding", 16)
    assert lists(index.search(queries, 15, probes=2)) == lists(R.vector_topk(queries.where("embedding is not null"), items.where("embedding is not null"), 15, "id"))


def test_add_replace_delete_compact(spark):
    rows = dict(clustered(600, 12))
    items = lambda: frame(spark, sorted(rows.items()))
    queries = frame(spark, clustered(60, 12, seed=1)[::3], "query_id")
    index = D.DenseIndex.build(items(), new_folder(spark, "dense"), "id", "embedding", 12)
    with pytest.raises(ValueError):
        D.DenseIndex.build(items(), index.path, "id", "embedding", 12)

    def agrees():
        again = D.DenseIndex(spark, index.path, "id")
        assert lists(again.search(queries, 8)) == lists(R.vector_topk(queries, items(), 8, "id"))

    new = {5000: rows[3], 7: [-x for x in rows[7]], 8: rows[9]}  # one more, one turned round, one like another
    index.add(frame(spark, sorted(new.items())), "embedding")
    rows |= new
    agrees()
    index.delete(spark.createDataFrame([(3,), (9,), (123456,)], "id long"))
    rows.pop(3), rows.pop(9)
    agrees()
    index.add(frame(spark, [(3, rows[6])]), "embedding")  # a deleted id comes back
    rows[3] = rows[6]
    agrees()
    assert len(index.segments()) == 4 and {r.id: r.seg for r in index.metadata(spark.createDataFrame([(3,), (9,), (10,)], "id long")).collect()} == {3: 3, 10: 0}
    index.compact()
    assert len(index.segments()) == 1
    agrees()
    with pytest.raises(Exception, match="dimension 5"):
        index.add(frame(spark, [(1, [1.0] * 5)]), "embedding")
    agrees()


def test_no_vectors(spark):
    index = D.DenseIndex.build(frame(spark, [(1, None)]), new_folder(spark, "dense"), "id", "embedding", 4)
    assert index.search(frame(spark, [(1, [1.0])], "query_id"), 3).count() == 0


# -- BM25 in blocks


def worded(n=3000, seed=5):
    rng = np.random.default_rng(seed)
    return [(i * 3 + 1, " ".join(["the"] * int(rng.integers(1, 4)) + [f"w{int(x)}" for x in rng.zipf(1.3, int(rng.integers(3, 40))) if x < 5000])) for i in range(n)]


def test_blocks_give_the_rows_of_the_plain_search(spark, monkeypatch):
    """Frequent and rare words, words nobody has, no words, ties; and of a stop word few postings are read."""
    from docloom.plans import bm25_blocks as B

    monkeypatch.setattr(B, "BLOCK", 16)
    monkeypatch.setattr(B, "FIRST", 200)
    docs = spark.createDataFrame([*worded(), (2, None), (5, "")], "id long, body string")
    asked = [(1, "the w77 w300"), (2, "the"), (3, "w1 w2 w3 the"), (4, "nobody"), (5, ""), (6, None), (7, "the the W123 w123 w9"), (8, "the w2500")]
    queries = spark.createDataFrame(asked, "query_id long, query string")
    path = new_folder(spark, "blocks")
    B.write_blocks(docs, path, "id", "body")
    read = []
    got = lists(B.search_blocks(queries, path, 10, "id", read=read))
    assert got == lists(R.bm25_topk(queries, docs, 10, "id", "body"))
    assert len(got) == 10 * 6 or {q for q, *_ in got} == {1, 2, 3, 7, 8}
    read.clear()
    B.search_blocks(spark.createDataFrame([(1, "the w77 w300 w40")], "query_id long, query string"), path, 5, "id", read=read).count()
    stop = sum(df.where("term = 'the'").agg(F.sum("n")).first()[0] or 0 for df in read)
    assert 0 < stop < 3000 / 4, stop


def test_blocks_of_nothing(spark):
    from docloom.plans import bm25_blocks as B

    path = new_folder(spark, "blocks")
    B.write_blocks(spark.createDataFrame([], "id long, body string"), path, "id", "body")
    assert B.search_blocks(spark.createDataFrame([(1, "a")], "query_id long, query string"), path, 5, "id").count() == 0


# -- substrings


def test_keywords_by_trigrams(spark):
    """Keywords inside words, across them, in other case, of one or two characters, empty, null, in no text; few candidates are compared."""
    from docloom.plans import substring as G

    rng = np.random.default_rng(8)
    texts = [" ".join("".join(rng.choice(list("abcdeé%_"), 5)) for _ in range(12)) for _ in range(800)] + [None, "", "ab", "Das ÉLAN-Vital", "100%_x"]
    keywords = [texts[5][7:20], texts[9][3:9].upper(), "élan-v", "ab", "%", "", None, "zzz nowhere", "abc", "%_x", "AB", texts[700][:30]]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "id int, body string, gram string")
    asked = spark.createDataFrame(list(enumerate(keywords)), "query_id int, keyword string")
    path = new_folder(spark, "grams")
    G.write_trigrams(docs, path, "id", "body")
    got = sorted((r.query_id, r.id) for r in G.search_substrings(asked, docs, path, "id", "body").collect())
    assert got == sorted((q, i) for q, k in enumerate(keywords) for i, t in enumerate(texts) if k is not None and t is not None and k.lower() in t.lower())
    maybe = G.candidates(asked.where("query_id in (0, 1, 2, 7, 11)"), path, "id")
    assert maybe.count() <= 40 and "PushedFilters: [In(gram" in maybe._jdf.queryExecution().executedPlan().toString()
