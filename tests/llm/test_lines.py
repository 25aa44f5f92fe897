import random

import pytest
from pyspark.sql import functions as F

from docloom.llm import line_dedup as L


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def changed(x, n):
    b = list(x)
    for _ in range(n):
        kind, i = random.random(), random.randrange(len(b))
        if kind < 0.3:
            b.insert(i, random.choice("abc"))
        elif kind < 0.6 and len(b) > 1:
            b.pop(i)
        else:
            b[i] = random.choice("abcé")
    return "".join(b)


def brute(spark, rows, least, edits):
    known = {(i, t) for i, t in rows if t is not None}
    order = spark.createDataFrame(list(known), "i long, t string").select("i", "t", F.xxhash64("t").alias("h")).collect()
    seen, out = [], {}
    for r in sorted(order, key=lambda r: (r.i is not None, r.i or 0, r.h)):
        kept = []
        for line in r.t.split("\n"):
            bare = line.strip(" \t\r\x0b\x0c")
            if len(bare) >= least:
                hit = any(lev(bare, x) <= edits for x in seen if abs(len(x) - len(bare)) <= edits)
                seen.append(bare)
                if hit:
                    continue
            kept.append(line)
        out[(r.i, r.t)] = "\n".join(kept)
    return out


@pytest.mark.parametrize("most", [1, 2, 3])
def test_banded_distance(spark, most):
    random.seed(most)
    pairs = []
    for _ in range(600):
        a = "".join(random.choice("abé") for _ in range(random.randint(0, 14)))
        pairs.append((a, changed(a, random.randint(0, 4)) if a else "ab"))
    for r in spark.createDataFrame(pairs, "a string, b string").select("a", "b", L.edit_distance(F.col("a"), F.col("b"), most).alias("d")).collect():
        assert min(r.d, most + 1) == min(lev(r.a, r.b), most + 1), r


@pytest.mark.parametrize(("hot", "edits"), [(16, 1), (2, 1), (16, 2), (1, 2)])
def test_against_brute_force(spark, monkeypatch, hot, edits):
    monkeypatch.setattr(L, "HOT", hot)
    random.seed(3)
    base = ["".join(random.choice("abc") for _ in range(random.randint(20, 26))) for _ in range(12)]
    rows = []
    for i in range(100):
        lines = [changed(random.choice(base[:3] if random.random() < 0.8 else base), random.choice([0, 1, 1, 2, 3])) if random.random() < 0.9 else "short" for _ in range(random.randint(0, 5))]
        rows.append((i, "\n".join(lines)))
    rows += [rows[5], (5, rows[6][1]), (None, "x" * 30), (None, None), (900, None), (901, ""), (902, "  " + base[0] + "\t\n\n")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"orig": F.col("text"), "n_lines": F.lit("old")})
    want = brute(spark, rows, 12, edits)
    got = L.dedup_lines(df, min_chars=12, max_edits=edits).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.text == (None if r.orig is None else want[(r.doc_id, r.orig)])
        if r.orig is not None:
            assert r.n_lines == r.orig.count("\n") + 1


def test_short_lines_are_compared_for_equality(spark):
    long = "a line of far more than forty characters, which edits count for"
    rows = [(1, f"Les.\n\nx\n{long}"), (2, f" Les.\t\n\nLas.\nx\n{long}!\nend"), (3, "Les.\n  \n\nLos.")]
    got = {r.doc_id: r for r in L.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i].text for i in (1, 2, 3)] == [rows[0][1], "\nLas.\nend", "  \n\nLos."]
    assert [(got[i].n_exact, got[i].n_near) for i in (1, 2, 3)] == [(0, 0), (2, 1), (1, 0)]


def test_ties_and_a_long_line(spark):
    long = "word " * 60000
    rows = [(1, f"{long}x"), (2, f"{long}y\nsame same same same same same same same same 1"), (2, f"{long}y\nsame same same same same same same same same 1"), (3, "same same same same same same same same same 2\nsame same same same same same same same same 1")]
    got = sorted((r.doc_id, r.text, r.kept) for r in L.dedup_lines(spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, kept string")).collect())
    assert got == [(1, f"{long}x", "k"), (2, "same same same same same same same same same 1", "k"), (2, "same same same same same same same same same 1", "k"), (3, "", "k")]


def test_plan_is_native(spark):
    df = spark.createDataFrame([(1, "some words that make a line of more than forty characters")] * 2, "doc_id long, text string")
    assert "Python" not in L.dedup_lines(df)._jdf.queryExecution().executedPlan().toString()


def test_empty_table(spark):
    assert L.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0
