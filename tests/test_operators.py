import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docloom import schema, seams
from docloom.functions import scalar as S
from docloom.operators import catalog, dedup, mutations, sequence
from docloom.plans import evaluation, retrieval


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("url", "kind"),
    [("http://x/a.PNG", "image"), ("https://x/v.mp4?t=1", "video"), ("https://youtu.be/q", "video"), ("http://x/s.mp3/", "audio"), ("http://x/d.pdf#p", "document"), ("http://x/", "url"), ("http://x.png", "url"), ("a.webp", "image")],
)
def test_classify_link(spark, url, kind):
    assert value(spark, S.classify_link(F.lit(url))) == kind


@pytest.mark.parametrize(("path", "want"), [("a/b.Tar.GZ?x", ".gz"), ("/.hidden", ""), ("..a.b", ".b"), ("name.", ""), ("", ""), ("x/y.md/", ".md"), ("a.b c", ".b c")])
def test_suffix_is_that_of_a_pure_path(spark, path, want):
    from pathlib import PurePosixPath

    assert PurePosixPath(path.split("?", 1)[0]).suffix.lower() == want
    assert value(spark, S.suffix(F.lit(path))) == want


def test_text_functions(spark):
    assert value(spark, S.normalize_text(F.lit(" a&nbsp;&amp;　 b\n"))) == "a & b"
    assert value(spark, S.derive_title(F.lit("  一句？ 二。三"))) == "一句"
    assert value(spark, S.derive_title(F.lit("x" * 50))) == "x" * 40 + "..."
    assert value(spark, S.token_estimate(F.lit(0))) == 1
    assert value(spark, S.strip_placeholders(F.lit(" a {{image:1}} b{{web:12}} {{no:1}}"))) == "a  b {{no:1}}"
    assert value(spark, S.json_in_text(F.lit('x ```json\n{"a":1}\n``` y'))) == '{"a":1}'
    assert value(spark, S.json_in_text(F.lit('x {"a":{"b":1}} y'))) == '{"a":{"b":1}}'
    assert value(spark, S.has_keys(F.lit('{"a":1,"b":2}'), ("a", "b"))) and not value(spark, S.has_keys(F.lit('{"a":1}'), ("a", "b")))
    assert [value(spark, S.a1_column(F.lit(n))) for n in (1, 26, 27, 52, 702, 703)] == ["A", "Z", "AA", "AZ", "ZZ", "AAA"]
    assert value(spark, S.resolve_file_uri(F.lit("file:///a%20b+c"), "/r")) == "/a b+c" and value(spark, S.resolve_file_uri(F.lit("x/y"), "/r/")) == "/r/x/y"
    assert value(spark, S.stem(F.lit("/a/b.c.md"))) == "b.c" and value(spark, S.source_type(F.lit("n.DOCX"))) == "docx"
    assert value(spark, S.is_page_number(F.lit(" 第 3 页"))) and value(spark, S.is_page_number(F.lit("iv"))) and not value(spark, S.is_page_number(F.lit("page")))
    assert value(spark, S.code_language(F.lit("x language-py"))) == "py" and value(spark, S.count_label(F.lit(12345))) == "1.2 万"


@settings(max_examples=30, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 4), st.text("ab", min_size=1, max_size=2)), max_size=8))
def test_section_path_is_the_stack_of_headings(spark, headings):
    path = []
    for level, title in headings:
        while len(path) >= level:
            path.pop()
        path.append(title)
    levels, titles = (F.array(*[F.lit(h[i]) for h in headings]) if headings else F.array().cast(f"array<{t}>") for i, t in ((0, "int"), (1, "string")))
    assert value(spark, S.section_path(levels, titles)) == path


def packed(chars, limit, share):
    """The packing rule as a loop over texts of so many characters."""
    tokens = lambda texts: max(1, int(len(" ".join("x" * c for c in texts if c)) / 1.2))
    keep, window, used, out = max(1, int(len(chars) * share)), [], 0, []
    for i, c in enumerate(chars):
        if used + tokens([c]) > limit and window:
            out.append((window[0], window[-1]))
            window = [*window[-keep:], i]
            used = tokens([chars[j] for j in window[:keep]]) + tokens([c])
        else:
            window.append(i)
            used += tokens([c])
    return [*out, (window[0], window[-1])]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 60), min_size=1, max_size=15), st.integers(10, 80))
def test_packing_follows_the_loop(spark, chars, limit):
    got = value(spark, sequence.pack_budget(F.array(*map(F.lit, chars)), limit))
    assert [(w["first"], w["last"]) for w in got] == packed(chars, limit, 0.2)


def ranked(spark, rows, name="id"):
    return spark.createDataFrame([(1, x, s, i + 1) for i, (x, s) in enumerate(rows)], f"query_id int, {name} string, score double, rank int")


def test_rrf(spark):
    v, t = ranked(spark, [("a", 0.9), ("b", 0.8), ("c", 0.7)]), ranked(spark, [("b", 5.0), ("c", 3.0), ("a", 1.0)])
    got = {r.id: r.rrf for r in retrieval.rrf(v, t, "id").collect()}
    assert got == {"a": round(1 / 61 + 1 / 63, 9), "b": round(1 / 62 + 1 / 61, 9), "c": round(1 / 63 + 1 / 62, 9)}
    assert retrieval.rrf(v.limit(0), t.limit(0), "id").count() == 0
    assert {r.id for r in retrieval.rrf(v.where("id = 'a'"), t.where("id = 'b'"), "id").collect()} == {"a", "b"}
    order = [r.id for r in retrieval.fused_topk(retrieval.rrf(v, t, "id"), 3, "id").orderBy("fused_rank").collect()]
    assert order == ["b", "a", "c"]


def test_metrics(spark):
    m = evaluation.metrics(F.array(*map(F.lit, "xayb")), F.array(*map(F.lit, "abc")), 5)
    assert {k: round(value(spark, c), 6) for k, c in m.items()} == {"precision": 0.4, "recall": round(2 / 3, 6), "mrr": 0.5, "hit": 1.0}
    none = evaluation.metrics(F.array(F.lit("x")), F.array().cast("array<string>"), 5)
    assert all(value(spark, c) is None for c in none.values())


def test_dense_edge_cases(spark):
    items = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0, 1.0]), (4, [-1.0, 0.0]), (5, [2.0, 0.0])], "vec_id long, embedding array<float>")
    queries = spark.createDataFrame([(7, [1.0, 0.0]), (8, [0.0, 0.0])], "query_id long, embedding array<float>")
    got = [(r.query_id, r.vec_id, r.score) for r in retrieval.vector_topk(queries, items, 3, "vec_id").orderBy("rank").collect()]
    assert got == [(7, 1, 1.0), (7, 5, 1.0), (7, 3, 0.707107)]  # a zero query finds nothing
    assert retrieval.vector_topk(queries.limit(0), items, 3, "vec_id").count() == 0


def test_seams(spark):
    embed = seams.hashing_embedding(16)
    rows = [r.e for r in spark.createDataFrame([("a b",), ("b a",), ("",), ("{{image:1}} a b",)], "t string").select(embed(F.col("t")).alias("e")).collect()]
    assert rows[0] == rows[1] == rows[3] and sum(x * x for x in rows[0]) == pytest.approx(1, abs=1e-6) and set(rows[2]) == {0.0}
    assert value(spark, seams.cjk_tokens(F.lit("中文字 Abc"))) == ["中", "文", "字", "中文", "文字", "abc"]
    assert value(spark, seams.overlap_score(F.lit("a b"), F.lit("B c"))) == 0.5 and value(spark, seams.clamp(F.lit(3.0))) == 1.0


def test_insert_refuses_a_known_key(spark):
    t = spark.createDataFrame([(1, "a")], "id int, v string")
    assert mutations.insert(t, spark.createDataFrame([(2, "b")], t.schema), "id").count() == 2
    with pytest.raises(Exception, match="duplicate id"):
        mutations.insert(t, spark.createDataFrame([(1, "b")], t.schema), "id").collect()


def test_patch_and_missing(spark):
    t = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id int, v string, w string")
    p = spark.createDataFrame([(1, None, "z"), (3, "q", "q")], t.schema)
    assert sorted(tuple(r) for r in mutations.patch(t, p, "id").collect()) == [(1, "a", "z"), (2, "b", "y")]
    assert [r.id for r in mutations.missing(t, p, "id").collect()] == [3]


def test_version_chain_stops_at_gaps_and_cycles(spark):
    rows = [(1, None), (2, 1), (3, 2), (4, 3), (5, 99), (6, 7), (7, 6)]
    got = {}
    docs = spark.createDataFrame(rows, "doc_id long, previous_doc_id long")
    for r in catalog.version_chain(docs, docs.select("doc_id")).collect():
        got.setdefault(r.doc_id, set()).add((r.ancestor, r.depth))
    assert got[4] == {(4, 0), (3, 1), (2, 2), (1, 3)} and got[5] == {(5, 0)} and got[6] == {(6, 0), (7, 1)}


def test_long_version_chains_end_at_their_first_version(spark):
    docs = spark.createDataFrame([(i, i - 1 if i % 130 else None) for i in range(390)], "doc_id long, previous_doc_id long")
    got = catalog.version_chain(docs)
    assert got.count() == 390 and {r.doc_id for r in got.select("doc_id").distinct().collect()} == {129, 259, 389}
    assert got.where("depth = doc_id - ancestor").count() == 390 and got.agg({"depth": "max"}).first()[0] == 129


def test_heading_paths_are_those_of_a_walk(spark):
    import random

    random.seed(3)
    rows = [(d, i, random.choice(["title", "paragraph"]), f"t{i}", random.choice([1, 2, 3, 4, None])) for d in range(4) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, seq long, element_type string, text string, heading_level int")
    got = {(r.doc_id, r.seq): r.section_path for r in sequence.heading_paths(df).collect()}
    paths = {}
    for d, i, kind, text, level in rows:
        path = paths.setdefault(d, [])
        if kind == "title" and level:
            while len(path) >= level:
                path.pop()
            path.append(text)
        assert got[d, i] == path


def test_cells_that_no_run_holds_together(spark):
    cells = spark.createDataFrame([("s", r, c) for r, c in [(1, 1), (2, 2), (4, 1), (9, 9)]] + [(None, 5, 5)], "sheet string, row int, col int")
    got = {(r.sheet, r.r0, r.r1, r.c0, r.c1) for r in sequence.regions(cells, ["sheet"]).collect()}
    assert got == {("s", 1, 2, 1, 2), ("s", 4, 4, 1, 2), ("s", 9, 9, 9, 9), (None, 5, 5, 5, 5)}


def test_probes(spark):
    rows = catalog.probe(spark, {"a": lambda: 1, "b": lambda: 1 / 0})
    assert [(r.service, r.status, r.error) for r in rows.collect()] == [("a", "ok", None), ("b", "error", "ZeroDivisionError: division by zero")]
    assert catalog.health(rows).first().status == "degraded" and catalog.health(rows.where("service = 'a'")).first().status == "ok"


def test_stored_rows(spark):
    from docloom.functions import codecs

    rows = spark.createDataFrame([("c", None, "{bad", None, '{"a": "1"}', None), ("d", "relational", '[{"asset_id": "x"}, null]', "[]", "[1]", "deleted")], "chunk_id string, knowledge_type string, asset_refs string, source_refs string, metadata string, status string")
    one, two = codecs.from_row(rows, "chunks").orderBy("chunk_id").collect()
    assert (one.knowledge_type, one.asset_refs, one.source_refs, one.metadata, one.status) == ("declarative", [], [], {"a": "1"}, "active")
    assert (two.knowledge_type, [a.asset_id for a in two.asset_refs], two.source_refs, two.metadata, two.status) == ("relational", ["x"], [], {}, "deleted")


def test_upload_of_equal_files(spark):
    docs = spark.createDataFrame([(10, "h1", "active"), (11, "h2", "deleted")], "doc_id long, source_hash string, status string")
    new = spark.createDataFrame([(1, "h1"), (2, "h2"), (3, "h2"), (4, "h3")], "doc_id long, source_hash string")
    got = {r.doc_id: (r.outcome, r.existing_id) for r in dedup.upload_outcomes(new, docs, "doc_id").collect()}
    assert got == {1: ("duplicate", 10), 2: ("success", None), 3: ("duplicate", 2), 4: ("success", None)}


def test_schemas_parse():
    for name in schema.DDL:
        assert schema.schema(name).fields


def test_pages(spark):
    rows = spark.createDataFrame([(i, None if i == 3 else i % 4) for i in range(10)], "doc_id long, updated_at long")
    order = catalog.ordering(rows, "nonsense", "up", "doc_id")
    assert [r.doc_id for r in catalog.page(rows, order, 1, 3).collect()] == [3, 7, 2]
    with pytest.raises(ValueError, match="1 to 200"):
        catalog.page(rows, order, 1, 500)


def test_merged_cells(spark):
    cells = spark.createDataFrame([("s", 1, 1, "top"), ("s", 1, 2, None), ("s", 2, 1, None), ("s", 3, 1, "x"), ("t", 1, 1, "y")], "sheet string, row int, col int, value string")
    merges = spark.createDataFrame([("s", 1, 1, 2, 2)], "sheet string, r0 int, c0 int, r1 int, c1 int")
    got = {(r.sheet, r.row, r.col): r.value for r in sequence.fill_merged(cells, merges, ["sheet"]).collect()}
    assert got == {("s", 1, 1): "top", ("s", 1, 2): "top", ("s", 2, 1): "top", ("s", 3, 1): "x", ("t", 1, 1): "y"}
    rows = spark.createDataFrame([("t", 1, 1, "a", False), ("t", 2, 1, "", True), ("t", 3, 1, "b", False), ("t", 1, 2, "c", False), ("t", 2, 2, "", True)], "tbl string, row int, col int, value string, continued boolean")
    got = {(r.row, r.col): r.value for r in sequence.carry_down(rows, ["tbl"]).collect()}
    assert got == {(1, 1): "a", (2, 1): "a", (3, 1): "b", (1, 2): "c", (2, 2): "c"}


def test_stores(spark):
    schema.create_stores(spark, "stores_test", ("jobs", "eval_items"))
    assert spark.table("stores_test.jobs").columns[0] == "job_id" and spark.table("stores_test.eval_items").count() == 0
    schema.drop_stores(spark, "stores_test", ("jobs", "eval_items"))
    assert not spark.catalog.tableExists("stores_test.jobs")


def test_lifecycle_of_the_index(spark):
    index = spark.createDataFrame([("a", "active", "c", "declarative"), ("b", "active", "c", "declarative"), ("z", "active", "c", "declarative")], "chunk_id string, status string, category string, knowledge_type string")
    chunks = spark.createDataFrame([("a", "deleted", "c", "declarative"), ("b", "active", "d", "procedural")], index.schema)
    assert sorted(tuple(r) for r in mutations.sync_index(index, chunks).collect()) == [("b", "active", "d", "procedural"), ("z", "active", "c", "declarative")]


def test_packing_of_random_documents_is_that_of_a_walk(spark):
    """As the query token_packing, over random lengths, against a plain walk along the elements."""
    import random

    tokens = lambda n: max(1, int(n / 1.2))

    def walk(chars, limit):
        back, first, used, out = max(1, int(len(chars) * 0.2)), 0, 0, []
        for i, n in enumerate(chars):
            if used + tokens(n) > limit and i > first:
                out.append((first, i - 1))
                first = max(first, i - back)
                again = [x for x in chars[first : first + min(back, i - first + 1)] if x > 0]
                used = tokens(max(sum(again) + len(again) - 1, 0))
            used += tokens(n)
        return [*out, (first, len(chars) - 1)] if chars else None

    random.seed(11)
    docs = [(i, [random.choice([0, 1, 5, 30, 200, 900]) for _ in range(random.randint(0, 40))]) for i in range(60)]
    df = spark.createDataFrame(docs, "id long, chars array<int>")
    for limit in (50, 300):
        got = {r.id: r.w and [(x["first"], x["last"]) for x in r.w] for r in df.select("id", sequence.pack_budget(F.col("chars"), limit).alias("w")).collect()}
        assert all(got[i] == walk(chars, limit) for i, chars in docs)
