"""The manifest against one built level by level in memory."""

import hashlib
import zlib
from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from docloom.llm import merkle
from docloom.llm.common import Scratch
from docloom.llm.queries import op11_merkle

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row, text):
    fields = (row["doc_id"], row["source"], row["lang"], row["n_chars"], text)
    return digest("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in fields))


def levels_of(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([digest("".join(out[-1][i : i + 8])) for i in range(0, len(out[-1]), 8)])
    return out


def steps_of(levels, i):
    for level in levels[:-1]:
        run = level[i // 8 * 8 :][:8]
        yield i % 8, [x for k, x in enumerate(run) if k != i % 8]
        i //= 8


def expected(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append(r)
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    own = {g: sorted(groups[g], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r, r["text"]))) for g in langs}
    trees = [levels_of([leaf_of(r, r["text"]) for r in own[g]]) for g in langs]
    top, out = levels_of([t[-1][0] for t in trees]), []
    for k, g in enumerate(langs):
        for i, r in enumerate(own[g]):
            steps = [*steps_of(trees[k], i), *steps_of(top, k)]
            leaf = folded = leaf_of(r, r["text"])
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0 and r["text"] is not None:
                folded = leaf_of(r, r["text"].translate(LOWER))
            for slot, others in steps:
                folded = digest("".join([*others[:slot], folded, *others[slot:]]))
            out.append((str(r["doc_id"]), leaf, trees[k][-1][0], top[-1][0], digest("".join(x for _, others in steps for x in others)), folded, folded == top[-1][0]))
    return sorted(out)


def rows_of(df):
    return sorted((str(r[0]), *r[1:]) for r in df.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect())


@contextmanager
def table(spark, tmp_path, rows, parts):
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, path string, row int, size string, Tree int")
    df.repartition(parts).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    yield spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)


def test_query(spark, sf001):
    want = expected([r.asDict() for r in spark.read.parquet(f"{sf001}/documents.parquet").collect()])
    assert rows_of(op11_merkle(spark, sf001)) == want
    assert 0 < sum(x[-1] for x in want) < len(want)


def test_odd_rows(spark, tmp_path):
    """Null fields, ids and groups, repeated rows, equal ids of other texts, lone leaves, empty texts, a very long one, clashing names."""
    row = lambda i, text, lang: (i, text, lang, "s|é" if i and i % 2 else None, None if i == 3 else 5, "p", 1, "x", 2)
    rows = [row(i % 700, f"Text {i}", "aa") for i in range(1300)] + [row(5, "Twice", "aa")] * 3 + [row(None, None, None)] * 2 + [row(None, "", "é")]
    rows += [row(9, "Lone", "b"), row(10, "A" * 300_000, "c"), *(row(i, f"T{i}", "d") for i in range(9)), *(row(i, f"T{i}", f"g{i}") for i in range(80))]
    with table(spark, tmp_path, rows, 7) as (df, folder):
        assert rows_of(op11_merkle(spark, folder)) == expected([r.asDict() for r in df.collect()])


@pytest.mark.parametrize("n", [0, 1, 8, 9, 513])
def test_sizes(spark, tmp_path, n):
    with table(spark, tmp_path, [(i, f"t{i}", "x", None, 1, None, None, None, None) for i in range(n)], 3) as (df, folder):
        assert rows_of(op11_merkle(spark, folder)) == (expected([r.asDict() for r in df.collect()]) if n else [])


def test_nodes_meet_in_rounds(spark):
    """Leaves dealt out one by one: no task completes a parent before the exchange."""
    n = 600
    nodes = spark.range(n).repartition(12).selectExpr("0L AS tree", f"{n}L AS size", "0 AS level", "id AS idx", "unhex(sha2(CAST(id AS STRING), 256)) AS data")
    with Scratch(spark, "test") as scratch:
        links, roots = merkle._grow(nodes, n, scratch, "t")
        levels = levels_of([digest(str(i)) for i in range(n)])
        assert [r["data"].hex() for r in roots.collect()] == levels[-1]
        got = {(r["level"], r["idx"]): r["data"].hex() for r in links.collect()}
        assert got == {(k + 1, i): "".join(level[i * 8 : i * 8 + 8]) for k, level in enumerate(levels[:-1]) for i in range(-(-len(level) // 8))}


def test_proofs_of_other_tables(spark):
    """Any digests under any keys; a changed leaf or a step of another path does not fold to the root."""
    df = spark.range(100).select("id", (F.col("id") % 3).cast("string").alias("grp"), F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("d"))
    with Scratch(spark, "test") as scratch:
        proofs = merkle.Manifest(df, "d", "grp", "id", scratch).proofs()
        rows = proofs.select("*", merkle.fold("d", "path").alias("right"), merkle.fold(F.unhex(F.sha2(F.lit("no"), 256)), "path").alias("wrong")).collect()
    assert len(rows) == 100 and all(r["right"] == r["root"] != r["wrong"] for r in rows) and len({r["path"] for r in rows}) == 100
