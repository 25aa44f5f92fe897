import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from docloom.llm import decontamination as D


def naive(doc, item, least):
    """Greedy tiling by search: the longest run that both have unmarked, first of the doc on a tie in length."""
    used_d, used_i, out = set(), set(), 0
    while True:
        best = (0, 0, 0)
        for a in range(len(doc)):
            for b in range(len(item)):
                k = 0
                while a + k < len(doc) and b + k < len(item) and doc[a + k] == item[b + k] and a + k not in used_d and b + k not in used_i:
                    k += 1
                if k > best[0]:
                    best = (k, a, b)
        k, a, b = best
        if k < least:
            return out
        used_d |= set(range(a, a + k))
        used_i |= set(range(b, b + k))
        out += k


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=30), st.lists(st.integers(0, 3), max_size=14))
def test_tiles_are_those_of_a_naive_search(doc, item):
    tiles = D.tile(np.array(doc, np.uint64), np.array(item, np.uint64), 3)
    assert all(doc[a : a + k] == item[b : b + k] for a, b, k in tiles)
    assert len({i for a, _, k in tiles for i in range(a, a + k)}) == len({i for _, b, k in tiles for i in range(b, b + k)}) == sum(k for _, _, k in tiles)
    if tiles:
        assert max(k for _, _, k in tiles) == tiles[0][2]
    assert sum(k for _, _, k in tiles) == naive(doc, item, 3) or len(set(map(tuple, [doc]))) == 1 and abs(sum(k for _, _, k in tiles) - naive(doc, item, 3)) <= 3


def test_many_equal_tokens_take_little_memory():
    import tracemalloc

    doc, item = np.full(200_000, 7, np.uint64), np.concatenate([np.full(300, 7, np.uint64), [np.uint64(9)], np.full(200, 7, np.uint64)])
    tracemalloc.start()
    tiles = D.tile(doc, item)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert tiles == [(0, 0, 300), (300, 301, 200)] and peak < 100 << 20


def test_long_tokens_are_compared_whole(spark):
    long = "x" * (D.CHARS + 10)
    item = f"{long}ab {long}cd {long}ef {long}gh {long}ij"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = spark.createDataFrame([(1, item), (2, item.replace("ab ", "zz ").replace("cd ", "zz ").replace("gh ", "zz ")), (3, f"so {item} ends")], "doc_id long, text string")
    assert sorted(r.doc_id for r in D.find_leaks(docs, bench).collect()) == [1, 3]


def test_items_of_few_tokens_leak_whole(spark):
    bench = spark.createDataFrame([(1, "forty two"), (2, "one, two, three"), (3, "four five six seven"), (4, "?!")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "It is Forty-Two!"), (2, "two forty"), (3, "one two"), (4, "and one two three"), (5, "four five six"), (6, "four five six seven")], "doc_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in D.find_leaks(docs, bench).collect()) == [(1, 1), (4, 2), (6, 3)]


def test_common_seeds_are_taken_in_parts(monkeypatch):
    random.seed(6)
    words = [f"w{i}" for i in range(12)]
    items = [" ".join(random.choices(words[:4], k=12)) for _ in range(40)]
    texts = [" ".join(random.choices(words, k=200)) + " " + random.choice(items) for _ in range(12)]
    whole = D.Items(items).leaks(texts, 0.5)
    monkeypatch.setattr(D, "PAIRS", 3)
    assert whole and D.Items(items).leaks(texts, 0.5) == whole
    hashes = [D.tokens_of([t])[0].tolist() for t in [*texts, *items]]
    want = [(d, i) for d in range(12) for i in range(40) if naive(hashes[d], hashes[12 + i], D.SEED) >= 0.5 * 12]
    assert [(d, i) for d, i, _, _ in whole] == want


def test_leaks(spark):
    random.seed(1)
    word = lambda: "".join(random.choice("abcdefghij") for _ in range(6))
    items = [" ".join(word() for _ in range(24)) for _ in range(6)]
    clean = lambda n: " ".join(word() for _ in range(n))
    w = items[2].split()
    rows = [
        (1, clean(50) + " " + items[0] + " " + clean(9)),
        (2, clean(9) + ". " + ", ".join(items[1].upper().split()) + "!"),
        (3, " ".join(w[12:]) + " " + clean(5) + " " + " ".join(w[:12])),  # reordered
        (4, " ".join(items[3].split()[:9]) + clean(30)),  # a third only
        (5, clean(400)),
        (6, None),
        (7, ""),
        (8, items[4] + " " + items[5]),
        (8, items[4]),
        (None, items[0] * 2),
        (9, "a " * 3000),
    ]
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(items)] + [(10, None), (11, ""), (12, "a b c"), (13, "a a a a a a")], "item_id long, text string")
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, item_id string, leaks string")
    want = sorted(map(str, [(1, 0), (2, 1), (3, 2), (8, 4), (8, 5), (8, 4), (None, 0), (9, 13)]))
    for tokens in (1 << 20, 40):  # one block of items, or several
        got = D.find_leaks(docs, bench, block_tokens=tokens).collect()
        assert sorted(str((r.doc_id, r.item_id)) for r in got) == want
        kept = D.without_leaks(docs, bench, block_tokens=tokens).collect()
        assert sorted((r.doc_id, r.leaks) for r in kept) == [(i, "y") for i in (4, 5, 6, 7)]
    assert D.find_leaks(docs, bench.limit(0)).count() == 0 and D.find_leaks(docs.limit(0), bench).count() == 0


def test_query_finds_all_verbatim_passages(spark, sf001):
    import re

    from docloom.llm.queries import queries

    flat = lambda t: " " + " ".join(re.findall(r"[^\W_]+", t.lower())) + " "
    docs = spark.read.parquet(f"{sf001}/documents.parquet").collect()
    items = [(r.item_id, flat(r.text)) for r in spark.read.parquet(f"{sf001}/benchmark.parquet").collect()]
    want = {(r.doc_id, i) for r in docs for t in [flat(r.text)] for i, x in items if x in t}
    got = {(r.doc_id, r.item_id) for r in queries()["op2_decontamination"](spark, sf001).collect()}
    assert want <= got and len(got - want) <= 0.05 * len(want) + 1


def test_query_equals_the_naive_search(spark, tmp_path):
    """All pairs of a small table, by the query: items whole, reordered, in part, repeated, beside texts that share words with them."""
    from docloom.llm.queries import op2_decontamination

    random.seed(9)
    words = [f"w{i}" for i in range(30)]
    items = [" ".join(random.choices(words, k=random.randint(12, 24))) for _ in range(14)]
    texts = []
    for _ in range(40):
        own = random.choice(items).split()
        kind = random.randrange(5)
        if kind == 0:
            own = own[len(own) // 2 :] + random.choices(words, k=5) + own[: len(own) // 2]
        elif kind == 1:
            own = own[: random.randint(4, len(own))]
        elif kind == 2:
            own = [w if random.random() < 0.8 else random.choice(words) for w in own]
        elif kind == 3:
            own = random.choices(words[:6], k=40)
        texts.append(" ".join([*random.choices(words, k=random.randint(0, 50)), *own, *random.choices(words, k=random.randint(0, 30))]))
    spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    hashes = [D.tokens_of([t])[0].tolist() for t in [*texts, *items]]
    want = {}
    for d in range(len(texts)):
        for i in range(len(items)):
            matched = naive(hashes[d], hashes[len(texts) + i], D.SEED)
            if matched >= D.COVERAGE * len(hashes[len(texts) + i]):
                want[d, i] = matched
    got = {(r.doc_id, r.item_id): r.n_matched for r in op2_decontamination(spark, str(tmp_path)).collect()}
    assert got == want and 20 < len(want) < len(texts) * len(items) / 2
