"""Steps that must not grow faster than their input, and rows that odd inputs must give."""

import numpy as np
from pyspark.sql import functions as F

from docloom.operators import sequence
from docloom.plans import dense_index as D
from docloom.plans import ingest as I
from docloom.plans import retrieval as R
from docloom.plans import similar as S
from docloom.plans import substring as G
from docloom.queries import parsing
from docloom.queries import similar as QS
from docloom.sources import model
from docloom.store import batches_of, new_folder


def test_near_copies_are_compared_with_the_first(spark, monkeypatch):
    """60 near copies make 1770 pairs, of which the first of each is enough."""
    rows = [(i, "one two three four five six seven eight nine ten " * 5 + f"w{i}") for i in range(60)]
    docs = spark.createDataFrame(rows, "id long, body string")
    pairs = spark.createDataFrame([(a, b) for b in range(60) for a in range(b)], "a long, b long")
    compared, plain = [], S._cosines
    monkeypatch.setattr(S, "_cosines", lambda p, *more: (compared.append(p.count()), plain(p, *more))[1])
    got = S.first_close(pairs, docs, "id", lambda: F.split("body", " "), 0.9)
    assert {(r.b, r.near) for r in got.collect()} == {(b, 0) for b in range(1, 60)} and sum(compared) == 59


def test_candidates_that_fail_are_passed_over(spark):
    rows = [(i, f"x{i} y{i}") for i in range(40)] + [(50, "x30 y30"), (51, "x7 y7"), (52, "z"), (53, "")]
    pairs = spark.createDataFrame([(a, b) for b in (50, 51, 52, 53) for a in range(40)], "a long, b long")
    got = S.first_close(pairs, spark.createDataFrame(rows, "id long, body string"), "id", lambda: F.filter(F.split("body", " "), lambda w: w != ""), 0.9)
    assert sorted((r.b, r.near) for r in got.collect()) == [(50, 30), (51, 7)]


def test_values_are_made_once(spark, sf001):
    plan = QS.simhash_groups(spark, sf001)._jdf.queryExecution().toString()
    assert "ArrowEvalPython" not in plan


def test_a_pdf_of_no_text_has_its_title(spark, tmp_path):
    rows = [(1, None), (2, ""), (3, "1 2 ?"), (4, " ".join(f"w{'abc'[i % 3]}" for i in range(25)))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r.doc_id, r.seq, r.text) for r in parsing.parse_pdf_elements(spark, f"file://{tmp_path}").collect())
    assert got == [(i, 1, f"Document {i}") for i in (1, 2, 3, 4)] + [(4, 2, " ".join(f"w{'abc'[i % 3]}" for i in range(25)))]


def test_a_pdf_of_a_numeral_is_no_page_number(spark, tmp_path):
    """Words of the letters of Roman numerals, which stand alone at a page's edge in running feet."""
    texts = ["mil", "DI", "là 7", "XIV", "i", "mix mix", "clic " * 30000]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.doc_id, r.seq, r.element_type, r.text) for r in parsing.parse_pdf_elements(spark, f"file://{tmp_path}").collect()}
    words = [t.replace("là 7", "l").strip() for t in texts]
    assert got == {(i, 1, "title", f"Document {i}") for i in range(7)} | {(i, 2, "paragraph", w) for i, w in enumerate(words)}


def test_results_are_not_held_as_objects(spark):
    class Counted(dict):
        live = 0

        def __init__(self):
            Counted.live += 1
            super().__init__(elements=[{"seq": Counted.live}], assets=[], error=None)

        def __del__(self):
            Counted.live -= 1

    registry = model.Registry()
    registry.register(lambda content: Counted(), "x")
    docs = spark.range(1000).coalesce(1).select(F.col("id").alias("doc_id"), F.lit("x").alias("source_type"), F.lit("t").alias("content"))
    most = model.element_rows(model.parse_documents(docs, registry)).agg(F.count("*"), F.max("seq")).first()
    assert most[0] == 1000 and most[1] <= 2 * model.ROWS


def test_links_judged_alone(spark):
    """Of two links of one content both are children if each is judged by the documents alone."""
    docs = spark.createDataFrame([(1, None, "sha256:0", "u", "active")], "doc_id long, root_doc_id long, source_hash string, source_uri string, status string")
    links = spark.createDataFrame([(i, 1, "document_link", f"http://a/{i}.html", bytearray(b"same"), None) for i in (1, 2)], "asset_id long, doc_id long, asset_type string, original_uri string, data binary, fetch_error string")
    outcome = lambda **more: {r.asset_id: r.outcome for r in I.child_documents(links, docs, 1, **more).collect()}
    assert outcome() == {1: "child", 2: "reused"} and outcome(together=False) == {1: "child", 2: "child"}


def test_runs_across_ranges(spark, monkeypatch):
    monkeypatch.setattr(sequence, "SPAN", 8)
    monkeypatch.setattr(sequence, "TASK_ROWS", 20)
    rng = np.random.default_rng(6)
    rows = {("a", int(v)) for v in rng.integers(-60, 60, 90)} | {("b", v) for v in (*range(-30, 31), 40, 47, 48, 56, 63, 64)} | {(None, v) for v in (7, 8, 9, 15)}
    df = spark.createDataFrame([*rows, *list(rows)[:40], ("a", None)], "k string, v long")
    want = []
    for key in ("a", "b", None):
        own = sorted(v for k, v in rows if k == key)
        cuts = [0, *[i for i in range(1, len(own)) if own[i] - own[i - 1] > 1], len(own)]
        want += [(key, own[a], own[b - 1], b - a) for a, b in zip(cuts, cuts[1:], strict=False)]
    got = [tuple(r) for r in sequence.islands(df.where("v is not null"), ["k"], "v").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)




def test_pairs_do_not_leave_the_tasks(spark, monkeypatch):
    """Vectors without structure: all may reach the floor, but of each part of a cell k pass a query on at most."""
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in rng.normal(size=12)]) for i in range(900)]
    items, queries = spark.createDataFrame(rows, "id long, embedding array<double>"), spark.createDataFrame(rows[::30], "query_id long, embedding array<double>")
    index = D.DenseIndex.build(items, new_folder(spark, "dense"), "id", "embedding", 8)
    passed, plain = [], D.DenseIndex._scored
    monkeypatch.setattr(D.DenseIndex, "_scored", lambda self, asked, pairs: (passed.append(pairs.count()), plain(self, asked, pairs))[1])
    got = sorted((r.query_id, r["rank"], r.id, r.score) for r in index.search(queries, 5).collect())
    assert got == sorted((r.query_id, r["rank"], r.id, r.score) for r in R.vector_topk(queries, items, 5, "id").collect())
    assert sum(passed) <= 30 * 5 * D.SHORTLIST


def test_trigram_lists(spark, monkeypatch):
    """Lists of few texts each, ids that come twice, characters beyond the first plane."""
    monkeypatch.setattr(G, "TEXTS", 2)
    docs = spark.createDataFrame([(1, "abcd abc"), (2, "xabcy"), (2, "other"), (3, "😀😁😂 z"), (4, "ab"), (None, "abc"), (5, None), (6, "aBCd")], "id long, body string")
    path = new_folder(spark, "grams")
    G.write_trigrams(docs, path, "id", "body")
    asked = spark.createDataFrame([(1, "abc"), (2, "😁😂 "), (3, "bcd"), (4, "zzz")], "query_id long, keyword string")
    assert sorted(tuple(r) for r in G.search_substrings(asked, docs, path, "id", "body").collect()) == [(1, 1), (1, 2), (1, 6), (2, 3), (3, 1), (3, 6)]
    assert max(r.n for r in spark.read.parquet(f"{path}/postings").select(F.size("ids").alias("n")).collect()) >= 2


def cuts(monkeypatch, spark):
    """(columns, plan, rows that go to Python at once) of what is cut from now on."""
    seen, plain = [], S.cut

    def cut(df):
        seen.append((df.columns, df._jdf.queryExecution().executedPlan().toString(), spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")))
        return plain(df)

    monkeypatch.setattr(S, "cut", cut)
    return seen


def test_keys_are_not_broadcast(spark, monkeypatch):
    """A value has 20 keys, yet Spark takes its rows with keys for as few bytes as the value's table."""
    seen = cuts(monkeypatch, spark)
    rows = spark.range(3000).select("id", F.when(F.col("id") < 2000, F.xxhash64("id")).otherwise(F.col("id") * 64).alias("v"))
    pairs = S.hamming_pairs(rows, "id", "v")
    plans = [plan for _, plan, _ in seen] + [pairs._jdf.queryExecution().executedPlan().toString()]
    assert sum("SortMergeJoin" in plan for plan in plans) >= 2 and not any("Broadcast" in plan for plan in plans)
    assert pairs.count() > 1000


def test_pairs_make_values_once(spark, sf001, monkeypatch):
    seen = cuts(monkeypatch, spark)
    QS.simhash_pairs(spark, sf001)
    assert sum(plan.count("ArrowEvalPython") for _, plan, _ in seen) == 1


def test_texts_go_to_python_few_at_a_time(spark, monkeypatch):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was, seen = spark.conf.get(key), cuts(monkeypatch, spark)
    text = "the quick brown fox jumps over the lazy dog while seven wizards brew another kettle of tea near mountains "
    S.funnel(spark.createDataFrame([(1, text * 6), (2, text * 6 + "tea")], "id long, body string"), "id", "body").collect()
    assert {int(n) for _, plan, n in seen if "ArrowEvalPython" in plan} == {S.ROWS} and sum("ArrowEvalPython" in plan for _, plan, _ in seen) >= 2
    with batches_of(spark, 10**6):
        assert spark.conf.get(key) == was
    assert spark.conf.get(key) == was


def test_words_are_kept_once_with_counts(spark):
    docs = spark.createDataFrame([(1, "x y x x"), (1, "y z"), (2, "x"), (3, "q"), (4, "")], "id long, body string")
    pairs = spark.createDataFrame([(1, 2), (1, 4)], "a long, b long")
    lists = S._word_lists(pairs, docs, "id", lambda: F.filter(F.split("body", " "), lambda w: w != ""))
    assert {r.id: dict(zip(r.w.terms, r.w.counts, strict=True)) for r in lists.collect()} == {1: {"x": 3, "y": 2, "z": 1}, 2: {"x": 1}}
