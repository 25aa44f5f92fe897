import random
import re

import pytest
from pyspark.sql import functions as F

from docloom.llm import near_dedup as N

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(LOWER))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows):
    """Component by row number, with the least id of it."""
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (row_id, _) in enumerate(rows):
        if row_id is not None:
            least[find(i)] = min(least.get(find(i), row_id), row_id)
    return [(row_id, len(sets[i]), least.get(find(i)) if sets[i] else row_id) for i, (row_id, _) in enumerate(rows)]


def corpus(seed=5):
    random.seed(seed)
    word = lambda: "".join(random.choice("abcdefgh") for _ in range(5))
    rows = []
    for _ in range(12):
        base = [word() for _ in range(random.randint(6, 140))]
        for _ in range(random.randint(1, 9)):
            copy = list(base)
            for _ in range(random.choice([0, 0, 1, 1, 2, 3])):
                copy[random.randrange(len(copy))] = word()
            text = random.choice([" ", "\n", " \t"]).join(copy)
            rows.append(text.upper() if random.random() < 0.3 else text)
    rows += ["", None, "  \n", "one two", "ONE TWO", "one  two", "one two three four five", "one two three four", "é É", "é É", "É É", "w " * 3000]
    ids = list(range(len(rows)))
    random.shuffle(ids)
    return [*zip(ids, rows, strict=True), (1003, "null ids and repeated rows also have sets"), (None, "null ids and repeated rows also have sets"), (1003, "null ids and repeated rows also have sets"), (None, "alone with a null id it stays")]


def key(r):
    return tuple(str(x) for x in r)


def test_against_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, component_id string")
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in N.near_duplicates(df).collect()]
    assert sorted(got, key=key) == sorted(brute(rows), key=key)


def test_open_buckets_go_by_rare_shingles(spark, monkeypatch):
    """Heads that are like none of their bucket: all links are found by rare shingles, and no others are compared."""
    rows = boilerplate(40)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    compared = []
    plain = N._rare_pairs
    monkeypatch.setattr(N, "_rare_pairs", lambda *a: compared.append(plain(*a).count()) or plain(*a))
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in N.near_duplicates(df).collect()]
    assert sorted(got, key=key) == sorted(brute(rows), key=key)
    assert len({c for _, _, c in got}) == 40 and compared and compared[0] < 3 * len(rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_rare_shingles_lose_no_pair(spark, seed):
    from docloom.llm.common import Scratch

    rows = [(i, t) for i, (_, t) in enumerate(boilerplate(8) + corpus(seed)) if shingles(t)]
    sets = spark.createDataFrame(rows, "row long, text string")
    with Scratch(spark, "t") as scratch:
        sigs = signed(sets)
        got = {(r.head, r.row) for r in N._rare_pairs(sets.selectExpr("row", "row comp"), sigs, sets, 5, 85, scratch).collect()}
    own = {i: shingles(t) for i, t in rows}
    for i, x in own.items():
        for j, y in own.items():
            if i < j and x != y and 100 * len(x & y) >= 85 * len(x | y):
                assert (i, j) in got


def signed(sets):
    numbered = N._numbered(sets, "row", "text", ()).withColumn("row", F.col("id"))
    return numbered.mapInArrow(N._sets(5), N._sets_like(numbered).schema).select("row", "n", "sig")


def test_common_passages_do_not_make_all_pairs(spark):
    """Texts of 3 of 40 passages: pairs grow no faster than rows, besides those that are alike, and no link is lost."""
    from docloom.llm.common import Scratch

    random.seed(11)
    word = lambda: "".join(random.choice("abcdefgh") for _ in range(5))
    passages = [" ".join(word() for _ in range(60)) for _ in range(40)]
    rows = [(i, " ".join(passages[k] for k in random.sample(range(40), 3))) for i in range(2000)]
    own, made = {i: shingles(t) for i, t in rows}, []
    for n in (500, 1000, 2000):
        sets = spark.createDataFrame(rows[:n], "row long, text string")
        with Scratch(spark, "t") as scratch:
            got = {(r.head, r.row) for r in N._rare_pairs(sets.selectExpr("row", "row comp"), signed(sets), sets, 5, 85, scratch).collect()}
        by_passages, links = {}, set()
        for i, t in rows[:n]:  # only texts of the same three passages are near
            by_passages.setdefault(frozenset(t[k : k + 40] for k in range(0, len(t), 360)), []).append(i)
        for group in by_passages.values():
            links |= {(i, j) for i in group for j in group if i < j and 100 * len(own[i] & own[j]) >= 85 * len(own[i] | own[j])}
        assert links <= {(min(p), max(p)) for p in got}
        made.append((n, len(got), len(links)))
    print(made)
    assert all(pairs <= links + n / 10 for n, pairs, links in made)


def boilerplate(n):
    """Texts that share a long passage; some of them are near copies of each other."""
    random.seed(4)
    word = lambda: "".join(random.choice("abcdefgh") for _ in range(5))
    shared = [word() for _ in range(200)]
    rows = []
    for i in range(n):
        own = shared + [word() for _ in range(random.choice([20, 30, 40]))]
        for copy in range(random.choice([1, 1, 3])):
            text = list(own)
            if copy:
                text[-copy] = word()
            rows.append((5000 + 10 * i + copy, " ".join(text)))
    random.shuffle(rows)
    return rows


def test_a_star_may_be_cut_anywhere():
    import numpy as np
    import pyarrow as pa

    member = [False, True, True, False, True, False, True, True, True]
    batch = pa.RecordBatch.from_pydict({"head": [0, 0, 0, 3, 3, 5, 5, 5, 5], "row": list(range(9)), "member": member, "payload": [b"x"] * 9, "bytes": pa.array([4] * 9, pa.int64())})
    for most in (1, 4, 8, 12, 1000):
        for cut in (1, 3, 4, 7, 9):
            seen = []
            for part, place in N._stars(iter([batch.slice(0, cut), batch.slice(cut)] if cut < 9 else [batch]), most):
                row = part.column(1).to_numpy()
                mine = np.flatnonzero(part.column(2).to_numpy(zero_copy_only=False))
                seen += [(int(row[place[i]]), int(row[i])) for i in mine]
            assert seen == [(0, 1), (0, 2), (3, 4), (5, 6), (5, 7), (5, 8)]


def test_sets_reach_the_threshold_as_fractions_do():
    import numpy as np

    rng = np.random.default_rng(2)
    for _ in range(300):
        x, y = (np.unique(rng.integers(0, 30, rng.integers(0, 40)).astype(np.uint64)) for _ in range(2))
        both, either = len(np.intersect1d(x, y)), len(np.union1d(x, y))
        assert N._reaches(x, y, 60) == (bool(len(x)) and bool(len(y)) and 100 * both >= 60 * either)


def test_one_of_each_group_stays(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, i and i * 2) for i, t in rows], "doc_id long, text string, more long")
    got = N.keep_one(df).collect()
    want = brute(rows)
    components = {(c, shingles(t) and 1) for (_, _, c), (_, t) in zip(want, rows, strict=True) if shingles(t)}
    assert len([r for r in got if shingles(r.text)]) == len(components)
    assert sum(1 for r in got if not shingles(r.text)) == sum(1 for _, t in rows if not shingles(t))
    assert all(r.more == (r.doc_id and r.doc_id * 2) for r in got)


def test_long_texts_ties_and_clashing_names(spark):
    long = " ".join(f"w{i * 7919 % 200003}" for i in range(150000))
    rows = [(7, long), (5, long + " end"), (5, long + " end"), (3, "other " + long[: len(long) // 2]), (9, "a b c d e f g h i j k l m n o p q r s t u v w x y z"), (8, "a b c d e f g h i j k l m n o p q r s t u v w x y z 1")]
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], "doc_id long, text string, row string, rest string, root string")
    got = sorted((r.doc_id, r.component_id, r.kept) for r in N.near_duplicates(df).collect())
    assert got == [(3, 3, True), (5, 5, True), (5, 5, True), (7, 5, False), (8, 8, True), (9, 8, False)]
    kept = N.keep_one(df).collect()
    assert sorted(r.doc_id for r in kept) == [3, 5, 8] and {(r.row, r.rest, r.root) for r in kept} == {("x", "y", "z")}


def test_empty_table(spark):
    assert N.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_thresholds_rise_with_the_matches_seen():
    least = N.least_matches(85)
    assert len(least) == N.BANDS * N.ROWS // N.BATCH and all(a <= b for a, b in zip(least, least[1:], strict=False))
    assert least[-1] < 0.85 * N.BANDS * N.ROWS


@pytest.mark.parametrize("most", [1 << 20, 0])
def test_components(spark, monkeypatch, most):
    from docloom.llm import components
    from docloom.llm.common import Scratch

    monkeypatch.setattr(components, "MOST_EDGES", most)
    edges = [(i, i + 1) for i in range(40)] + [(100, 200), (300, 200), (7, 7), (5, 4), (500, 501)]
    with Scratch(spark, "t") as scratch:
        got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(edges, "a long, b long"), scratch, "c").collect()}
        assert got == {**{i: 0 for i in range(41)}, 100: 100, 200: 100, 300: 100, 500: 500, 501: 500}
        assert components.connected_components(spark.createDataFrame([], "a long, b long"), scratch, "none").count() == 0
