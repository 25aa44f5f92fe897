"""Near and semantic duplicates against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.functions import groups
from docloom.plans import similar as S


def test_masks_miss_no_value():
    rng = random.Random(1)
    for within in (1, 2, 3):
        levels = S.hamming_masks(within)
        for _ in range(300):
            x = sum(1 << b for b in rng.sample(range(64), rng.randint(0, within)))  # the bits that differ
            alive = {k for k, (m, _) in enumerate(levels[0]) if not m & x}
            assert alive
            for level in levels[1:]:  # under every mask that shows equal bits, one of its finer ones does
                finer = {k for k, (m, p) in enumerate(level) if p in alive and not m & x}
                assert {level[k][1] for k in finer} == alive
                alive = finer


@pytest.mark.parametrize("paired", [64, 2])
def test_hamming_pairs(spark, monkeypatch, paired):
    """Random values, values close to each other, one hot block, repeated values, nulls; with keys made finer and without."""
    monkeypatch.setattr(S, "PAIRED", paired)
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(30)]
    values = [*base, *(b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(1, 5))) for b in base for _ in range(3))]
    values += [base[0] ^ rng.getrandbits(20) for _ in range(150)] + base[:5] + [0, (1 << 64) - 1, 1 << 63]
    rows = [(i, S._signed(v), "x") for i, v in enumerate(values)] + [(None, 5, "x"), (9999, None, "x")]
    got = {(r.a, r.b, r.distance) for r in S.hamming_pairs(spark.createDataFrame(rows, "i long, v long, mask string"), "i", "v").collect()}
    first = {}
    for i, v in enumerate(values):
        first.setdefault(v, i)
    want = {(min(i, j), max(i, j), bin(u ^ v).count("1")) for u, i in first.items() for v, j in first.items() if i < j and bin(u ^ v).count("1") <= 3}
    assert got == want and len(want) > 50


def test_a_hot_block_makes_no_table_of_its_pairs(spark):
    """Values that agree in half of their bits and are else far apart: few of them meet."""
    rng = random.Random(3)
    rows = [(i, S._signed((0xABCD << 48) | rng.getrandbits(31) << 16 | 0x1234)) for i in range(3000)]
    seen = []
    plain = S.cut
    S.cut = lambda df: (out := plain(df), seen.append((out.columns, out)))[0]
    try:
        S.hamming_pairs(spark.createDataFrame(rows, "i long, v long"), "i", "v").count()
    finally:
        S.cut = plain
    keyed = [df for columns, df in seen if "n" in columns]
    met = sum(df.where(F.col("n") <= S.PAIRED).agg(F.sum("n")).first()[0] or 0 for df in keyed) / 2  # each row brings the number of those it meets
    assert len(keyed) == 2 and met < 3000 * 3000 / 2 / 20


def test_funnel_stages(spark):
    text = "the quick brown fox jumps over the lazy dog while seven wizards brew another kettle of tea near mountains "
    rows = [(1, text * 6), (2, text * 6), (3, text * 6 + "tea"), (4, None), (5, ""), (6, "entirely other words stand here"), (7, None), (8, ""), (None, text)]
    got = {r.id: (r.stage, r.of) for r in S.funnel(spark.createDataFrame(rows, "id long, body string"), "id", "body").collect()}
    assert got == {1: ("unique", None), 2: ("exact", 1), 3: ("similar", 1), 4: ("unique", None), 5: ("unique", None), 6: ("unique", None), 7: ("unique", None), 8: ("exact", 5)}
    assert S.funnel(spark.createDataFrame([], "id long, body string"), "id", "body").count() == 0


def chunks(n=240, docs=5, seed=4):
    rng = np.random.default_rng(seed)
    centres, rows = rng.normal(size=(docs * 3, 16)), []
    for i in range(n):
        doc = int(rng.integers(docs)) if i % 3 else 0  # a third of the rows in one document
        v = centres[doc * 3 + int(rng.integers(3))] + rng.normal(size=16) * rng.choice([0.0, 0.1, 0.3])
        rows.append((i, f"d{doc}", [float(x) for x in v], int(rng.integers(5)) if i % 7 else None, bool(rng.random() < 0.1) if i % 11 else None))
    return [*rows, (n, "d0", None, 5, True), (n + 1, None, rows[0][2], 5, False), (n + 2, "d9", [0.0] * 16, 1, False), (n + 3, "d9", [0.0] * 16, 1, False)]


def greedy(rows, merge, related):
    merged, pairs = {}, set()
    for doc in {r[1] for r in rows}:
        own = [r for r in rows if r[1] == doc]
        if doc is None:
            merged |= {r[0]: None for r in own}
            continue
        unit = {r[0]: np.array(r[2]) / (np.linalg.norm(r[2]) or 1) for r in own if r[2] is not None}
        cos = lambda a, b, u=unit: round(float(u[a] @ u[b]), 6)
        same = {r[0]: tuple(r[2]) for r in own if r[2] is not None}
        kept = []
        for r in sorted(own, key=lambda r: (not r[4], -(r[3] or 0), r[0])):
            near = [k for k in kept if r[2] is not None and k in unit and (same[k] == same[r[0]] or cos(k, r[0]) >= merge)]
            merged[r[0]] = near[0] if near and not r[4] else None
            if merged[r[0]] is None:
                kept.append(r[0])
        pairs |= {(a, b, cos(a, b)) for a in kept for b in kept if a < b and a in unit and b in unit and same[a] != same[b] and related <= cos(a, b) < merge}
    return merged, pairs


@pytest.mark.parametrize("block", [1024, 16])
def test_semantic_duplicates(spark, block):
    """Priorities, chains, repeated vectors, items by hand, nulls; one block a document and several."""
    rows = chunks()
    df = spark.createDataFrame(rows, "id long, doc string, v array<double>, chars long, manual boolean")
    merged, related = S.semantic_duplicates(df, "id", "doc", "v", "chars", "manual", 0.95, 0.88, block)
    want, pairs = greedy(rows, 0.95, 0.88)
    got = {r.id: r.merged_into for r in merged.collect()}
    # Of equal vectors written by hand only the first stands for the others in pairs.
    alike = {}
    for r in sorted((r for r in rows if r[1] is not None and r[2] is not None), key=lambda r: (not r[4], -(r[3] or 0), r[0])):
        alike.setdefault((r[1], tuple(r[2])), r[0])
    heads = set(alike.values())
    assert got == want
    assert {(r.a, r.b, r.similarity) for r in related.collect()} == {p for p in pairs if p[0] in heads and p[1] in heads}
    assert sum(x is not None for x in want.values()) > 50 and len(pairs) > 10


@pytest.mark.parametrize("block", [1024, 16])
def test_figures_within_documents(spark, block):
    rows = [r for r in chunks() if r[1] and r[2]]
    df = spark.createDataFrame(rows, "id long, doc string, v array<double>, chars long, manual boolean")
    got = {r.doc: r for r in S.within_summary(df, "id", "doc", "v", block).collect()}
    for doc in {r[1] for r in rows}:
        m = np.array([r[2] for r in rows if r[1] == doc])
        size = np.linalg.norm(m, axis=1, keepdims=True)
        m = np.divide(m, size, out=np.zeros_like(m), where=size > 0)
        s = np.round((m @ m.T)[np.triu_indices(len(m), 1)], 6)
        r = got[doc]
        assert (r["pairs"], r["min"], r["max"], r["ge_90"], r["ge_70"]) == (len(s), s.min() + 0.0, s.max(), (s >= 0.9).sum(), (s >= 0.7).sum())
        assert np.allclose([r["mean"], r["median"], r["std"]], [s.mean(), np.median(s), s.std()], atol=2e-6)


def test_many_groups_leave_the_driver_alone(spark, monkeypatch):
    """Figures of 10,000 groups: nothing is collected."""
    df = spark.range(30000).select("id", (F.col("id") % 10000).alias("doc"), F.array(F.sin("id"), F.cos("id")).alias("v"))
    monkeypatch.setattr(type(df), "collect", lambda self: pytest.fail("collected"))
    monkeypatch.setattr(type(df), "toArrow", lambda self: pytest.fail("collected"))
    assert S.within_summary(df, "id", "doc", "v").where("pairs = 3").count() == 10000


def test_runs_cross_batches():
    import pyarrow as pa

    rows = [(k, i) for i, k in enumerate("aaabccccdd")]
    batches = [pa.RecordBatch.from_pylist([{"k": k, "i": i} for k, i in rows[a:b]], pa.schema([("k", pa.string()), ("i", pa.int64())])) for a, b in ((0, 2), (2, 2), (2, 5), (5, 9), (9, 10))]
    assert [t.column("i").to_pylist() for t in groups.runs(iter(batches), 1)] == [[0, 1, 2], [3], [4, 5, 6, 7], [8, 9]]
