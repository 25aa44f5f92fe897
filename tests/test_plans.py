from pyspark.sql import functions as F

from docloom.plans import extraction as X
from docloom.plans import ingest as I
from docloom.plans import retrieval as R
from docloom.sources import pdf
from docloom.sources.files import default_registry


def row(text, level=0, vector=None):
    return {"title": level > 0, "level": level or None, "text": text, "extra": None, "vector": vector}


def test_ranges_follow_headings_then_likeness_then_budget():
    body = [row("x" * 60)] * 2
    doc = [row("A", 1), *body, row("B", 1), row("C", 2), *body, row("D", 2), *body]
    assert X.Ranges(doc, 1000, 1000).all() == [(0, 10)]
    assert X.Ranges(doc, 120, 100).all() == [(0, 3), (3, 4), (4, 7), (7, 10)]
    deep = [row("t", 3), *body, row("u", 3), *body]
    assert X.Ranges(deep, 120, 100).all() == [(0, 3), (3, 6)]
    plain = [row("y" * 50, vector=v) for v in ([1, 0], [1, 0.1], [0, 1], [0, 1], [0.1, 1])]
    assert X.Ranges(plain, 150, 100).all() == [(0, 1), (1, 2), (2, 4), (4, 5)]
    hard = [row("z" * 60)] * 6
    assert X.Ranges(hard, 100, 110).all() == [(0, 2), (1, 3), (2, 4), (3, 5), (4, 6)]
    assert X.Ranges([], 10, 10).all() == []


def sections(spark):
    rows = [("d", 0, 1, "e1", "one", ["a1"]), ("d", 0, 2, "e2", "two", ["a1", "a2"]), ("d", 1, 3, "e3", "three", None), ("d", 2, 4, "e4", "  ", None)]
    return spark.createDataFrame(rows, "doc_id string, section int, seq long, element_id string, text string, asset_ids array<string>")


def test_answers_and_fallback(spark):
    assets = spark.createDataFrame([("d", "a1", "image", "u1", ""), ("d", "a2", "web_link", "u2", "site")], "doc_id string, asset_id string, asset_type string, original_uri string, display_text string")
    answer = '```json\n{"chunks": [{"content": "c1", "knowledge_type": "odd", "source_refs": [{"element_id": "e2"}, {"element_id": "no"}, {"element_id": "e2"}], "asset_refs": [{"asset_id": "a2"}, {"asset_id": "zz"}, {"asset_id": "a1", "caption": "cap"}]}, {"content": ""}, {"title": "T", "content": "c2", "knowledge_type": "procedural"}]}\n```'
    answers = spark.createDataFrame([("d", 0, answer), ("d", 1, "not json")], "doc_id string, section int, answer string")
    got = {(r.section, r.n): r for r in X.chunks_of_answers(answers, sections(spark), assets).collect()}
    assert set(got) == {(0, 0), (0, 2), (1, 0)}
    one, two, rest = got[0, 0], got[0, 2], got[1, 0]
    assert one.source_refs == ["e2"] and one.knowledge_type == "declarative" and [tuple(a) for a in one.asset_refs] == [("a2", "site"), ("a1", "cap")]
    assert two.source_refs == ["e1", "e2"] and two.title == "T" and two.knowledge_type == "procedural" and two.asset_refs == []
    assert (rest.content, rest.source_refs, rest.title) == ("three", ["e3"], "three")
    plain = X.fallback(sections(spark), assets).where("section = 0").first()
    assert plain.content == "one\ntwo" and [a.asset_id for a in plain.asset_refs] == ["a1", "a2"] and plain.asset_refs[0].caption == "image: u1"


def test_uploads_and_ingestion(spark):
    files = spark.createDataFrame([(1, "a.md", b"# T\n\nx"), (2, "b.md", b"# T\n\nx"), (3, "c.exe", b"q"), (4, "d.html", b" "), (5, "e.txt", b"y" * 50)], "upload_id long, file_name string, content binary")
    docs = spark.createDataFrame([], "doc_id string, source_hash string, status string")
    up = I.upload(files, docs, max_bytes=40)
    got = {r.upload_id: (r.outcome, r.error_message) for r in up.collect()}
    assert got == {1: ("success", None), 2: ("duplicate", None), 3: ("failed", "unsupported format"), 4: ("success", None), 5: ("failed", "too large")}
    new = up.where("outcome = 'success'")
    first = I.ingest(new, default_registry(), {})
    again = I.ingest(new, default_registry(), first)
    assert first["elements"].count() == again["elements"].count() == 2
    assert sorted(r.status for r in first["outcomes"].collect()) == ["active", "failed"]


def test_assets_by_content(spark):
    png = bytes.fromhex("89504E470D0A1A0A") + b"x" * 9
    rows = [("a", "image", png), ("b", "image", png), ("c", "image", b"  <html>"), ("d", "image", b"nothing"), ("e", "video", b"nothing"), ("f", "web_link", None)]
    got = {r.asset_id: r for r in I.process_assets(spark.createDataFrame(rows, "asset_id string, asset_type string, data binary")).collect()}
    assert [got[x].status for x in "abcdef"] == ["ready", "ready", "failed", "failed", "ready", "ready"]
    assert got["b"].reused_from == "a" and got["b"].storage_uri == got["a"].storage_uri and got["a"].storage_uri.endswith(".png") and got["e"].mime == "video/mp4"


def test_layout(spark):
    rows = []
    for page in range(1, 5):
        rows += [("d", page, 0, 0, 0, 10.0, 20.0, 90.0, 30.0, "Running head", 8.0, False), ("d", page, 9, 0, 0, 10.0, 780.0, 20.0, 790.0, str(page), 8.0, False)]
        rows += [("d", page, 1, 0, 0, 10.0, 200.0, 90.0, 220.0, f"Heading {page}", 18.0, True), ("d", page, 2, 0, 0, 10.0, 240.0, 90.0, 250.0, "body", 11.0, False), ("d", page, 3, 0, 0, 10.0, 255.0, 90.0, 265.0, "goes on", 11.0, False), ("d", page, 4, 0, 0, 10.0, 400.0, 90.0, 410.0, "in a table", 11.0, False)]
    spans = spark.createDataFrame(rows, "doc_id string, page int, block int, line int, span int, x0 double, y0 double, x1 double, y1 double, text string, size double, bold boolean").withColumn("page_height", F.lit(800.0))
    tables = spark.createDataFrame([("d", p, 390.0, 420.0) for p in range(1, 5)], "doc_id string, page int, y0 double, y1 double")
    got = [(r.element_type, r.text, r.heading_level) for r in pdf.layout_elements(spans, tables).orderBy("seq").collect()]
    assert got == [x for p in range(1, 5) for x in (("title", f"Heading {p}", 1), ("paragraph", "body goes on", None))]
    links = spark.createDataFrame([("d", 1, 7, 12.0, 202.0, 80.0, 219.0)], "doc_id string, page int, link int, x0 double, y0 double, x1 double, y1 double")
    assert pdf.links_of(links, spans).first().place == 1000000


def test_pairs_of_queries_with_all_rows(spark):
    rows = spark.range(100).select(F.col("id").alias("vec_id"), (F.col("id") % 2).cast("int").alias("label"), F.array(F.col("id").cast("float"), F.lit(1.0).cast("float")).alias("embedding"))
    queries = rows.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    got = R.pair_summary(queries, rows, "vec_id", "label").collect()
    assert [(r.label, r.pairs) for r in got] == [(0, 5 * 45 + 10)]
    assert R.nearest_of_others(queries, rows, "vec_id", "label").select("query_id").distinct().count() == 5


def test_model_answers_are_asked_for_again(spark):
    from docloom import seams

    def model(prompts, attempt):
        return [None if p == "down" else "no" if attempt < int(p) else '```json\n{"a": 1, "n": %d}\n```' % attempt for p in prompts]

    rows = spark.createDataFrame([("1",), ("3",), ("9",), ("down",), (None,)], "p string")
    got = {r.p: r.a for r in rows.select("p", seams.asked_json(model, F.col("p"), ("a",)).alias("a")).collect()}
    assert [(got[p].attempts, got[p].json, got[p].error and got[p].error[:9]) for p in ("1", "3", "9", "down", None)] == [(1, '{"a": 1, "n": 1}', None), (3, '{"a": 1, "n": 3}', None), (4, None, "no JSON: "), (1, None, "no answer"), (0, None, "no prompt")]
    lacking = spark.createDataFrame([("1",)], "p string").select(seams.asked_json(model, F.col("p"), ("a", "z")).alias("a")).first().a
    assert lacking.error == "lacks z" and lacking.attempts == 4


def test_cells_give_most_of_the_exact_results(spark):
    from docloom.plans import ann
    from docloom.queries import service

    d = "/root/testdata/sf0.01"
    items = spark.read.parquet(f"{d}/embeddings.parquet")
    queries = items.where("vec_id % 20 = 0").select(items.vec_id.alias("query_id"), "embedding")
    exact = R.vector_topk(queries, items, 30, "vec_id").cache()
    found = service.vector_topk_cells(spark, d)
    figures = ann.recall(found, exact, "vec_id").agg({"recall": "avg"}).first()[0]
    assert figures >= 0.9
    both = found.join(exact.withColumnRenamed("score", "s"), ["query_id", "vec_id"])
    assert both.where("score <> s").count() == 0
    centres = ann.fit_cells(items, "vec_id", "embedding", 8)
    index = ann.build_index(items, "vec_id", "embedding", centres)
    assert index.count() == 2 * items.where("embedding is not null").count() and index.select("vec_id").distinct().count() * 2 == index.count()
    whole = ann.search_index(queries, index, centres, 30, "vec_id", 8)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, exact.collect()))


def test_queries_in_blocks(spark, monkeypatch):
    items = spark.createDataFrame([(i, [float(i % 7), float(i % 5), 1.0]) for i in range(200)], "vec_id long, embedding array<double>")
    queries = items.where("vec_id % 20 = 0").select(items.vec_id.alias("query_id"), "embedding")
    whole = sorted(map(tuple, R.vector_topk(queries, items, 4, "vec_id").collect()))
    monkeypatch.setattr(R, "QUERY_BLOCK", 3)
    monkeypatch.setattr(R, "TILE", 16)
    assert sorted(map(tuple, R.vector_topk(queries, items, 4, "vec_id").collect())) == whole


def test_parts_and_records_of_uploads(spark):
    files = spark.createDataFrame([("a", bytearray(b"x" * 25)), ("b", bytearray())], "doc_id string, content binary")
    got = {(r.doc_id, r.part): bytes(r.data) for r in I.parts_of(files, size=10).collect()}
    assert got == {("a", 0): b"x" * 10, ("a", 1): b"x" * 10, ("a", 2): b"x" * 5, ("b", 0): b""}
    judged = spark.createDataFrame([("a", "r.v.pdf", 25, "success"), ("b", "s", 0, "success"), ("c", "t", 1, "failed")], "doc_id string, file_name string, size long, outcome string")
    done, gone = I.store_records(judged, spark.createDataFrame([("a", "s/a"), ("b", None)], "doc_id string, source_uri string"))
    assert [(r.source_uri, r.title) for r in done.collect()] == [("s/a", "r.v")] and [r.doc_id for r in gone.collect()] == ["b"]


def test_pictures_of_a_layout(spark):
    text = "a ![one](images/1.png) b ![x](gone.png)c ![](images/2.png)"
    images = F.array(F.struct(F.lit("images/1.png").alias("path"), F.lit("s/1").alias("uri")), F.struct(F.lit("images/2.png").alias("path"), F.lit("s/2").alias("uri")))
    assert spark.range(1).select(X.with_images(F.lit(text), images)).first()[0] == "a ![one](s/1) b c ![](s/2)"
