"""Parsing queries: whole texts and pages to elements and assets."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions.scalar import content_hash
from docloom.queries import tables as T
from docloom.sources import model
from docloom.sources.files import default_registry, share_page_json

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _pages(spark, d):
    pages = T.table(spark, d, "pages").select(F.col("page_id").alias("doc_id"), F.lit("html").alias("source_type"), F.col("html").alias("content"))
    return model.parse_documents(pages, default_registry())


@query("parse_html_elements")
def parse_html_elements(spark, d):
    rows = model.element_rows(_pages(spark, d))
    return rows.select("doc_id", "seq", "element_type", "text", "heading_level", F.array_join("section_path", " > ").alias("section_path"), "parent_seq", F.size("refs").alias("refs"))


@query("parse_html_assets", "SELECT page_id AS doc_id, 1 AS asset, 'document_link' AS asset_type, 'http://files.example.org/' || page_id || '.pdf' AS original_uri, '' AS display_text FROM pages WHERE contains(html, '</article>') UNION ALL SELECT page_id, 2, CASE page_id % 3 WHEN 1 THEN 'image_link' ELSE 'web_link' END, 'http://files.example.org/' || page_id || '.png', CASE page_id % 3 WHEN 1 THEN 'pic.png' ELSE 'pic' END FROM pages WHERE contains(html, '</article>') AND page_id % 3 <> 0")
def parse_html_assets(spark, d):
    """A link and a picture at the end of each page's article; pages of every third id have no picture. A picture's type goes by the suffix of its text."""
    place = F.concat(F.lit("http://files.example.org/"), F.col("page_id").cast("string"))
    picture = F.when(F.col("page_id") % 3 != 0, F.concat(F.lit(' and <img src="'), place, F.when(F.col("page_id") % 3 == 1, '.png" alt="pic.png">').otherwise('.png" alt="pic">'))).otherwise("")
    more = F.concat(F.lit('<p>see <a href="'), place, F.lit('.pdf">paper</a>'), picture, F.lit("</p></article>"))
    pages = T.table(spark, d, "pages").select(F.col("page_id").alias("doc_id"), F.lit("html").alias("source_type"), F.replace("html", F.lit("</article>"), more).alias("content"))
    rows = model.asset_rows(model.parse_documents(pages, default_registry()))
    return rows.select("doc_id", "asset", "asset_type", "original_uri", "display_text")


@query("source_hashes", "SELECT page_id AS doc_id, 'sha256:' || sha256(html) AS source_hash FROM pages")
def source_hashes(spark, d):
    return T.table(spark, d, "pages").select(F.col("page_id").alias("doc_id"), content_hash(F.col("html")).alias("source_hash"))


@query("parse_markdown_elements")
def parse_markdown_elements(spark, d):
    docs = T.table(spark, d, "documents").select("doc_id", F.lit("md").alias("source_type"), F.col("text").alias("content"))
    rows = model.element_rows(model.parse_documents(docs, default_registry()))
    return rows.select("doc_id", "seq", "element_type", "text", "heading_level")


@query("parse_conversations")
def parse_conversations(spark, d):
    turns = T.table(spark, d, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda x: F.concat(F.lit("## "), x["role"], F.lit("\n\n"), F.coalesce(x["text"], F.lit("")))), "\n\n").alias("content"))
    docs = turns.select(F.col("conv_id").alias("doc_id"), F.lit("markdown").alias("source_type"), "content")
    return model.element_rows(model.parse_documents(docs, default_registry())).groupBy("doc_id", "element_type").agg(F.count("*").alias("elements"), F.sum(F.length("text")).alias("chars"))


@query("share_page_json", "SELECT page_id, CASE WHEN page_id % 4 <> 0 THEN '{\"url\": \"' || replace(url, '/', CASE WHEN page_id % 4 = 1 THEN '\\u002F' ELSE '/' END) || '\", \"id\": ' || page_id || ', \"ok\": true, \"t\": [1,2]}' END AS json FROM pages")
def share_page(spark, d):
    """Pages with their address in a script, some with its slashes escaped, some without the script's variable."""
    i, k = F.col("page_id").cast("string"), F.col("page_id") % 4
    url = F.when(k == 1, F.replace("url", F.lit("/"), F.lit("\\x2F"))).otherwise(F.col("url"))
    name = F.when(k == 0, "window.other").otherwise("window.data")
    html = F.concat(F.lit("<p>{x}</p><script>"), name, F.lit(' = {"url": "'), url, F.lit('", "id": Number('), i, F.lit('), "ok": Boolean(true), "t": [1,2,],};</script><p>}</p>'))
    return T.table(spark, d, "pages").select("page_id", share_page_json(html, r"window\.data").alias("json"))


@query("parse_pdf_elements", "WITH t AS (SELECT doc_id, regexp_extract_all(text, '[A-Za-z]+') AS w FROM documents) SELECT doc_id, 1 AS seq, 'title' AS element_type, 'Document ' || doc_id AS text, 1 AS page FROM documents UNION ALL SELECT doc_id, 2, 'paragraph', array_to_string(w, ' '), 1 FROM t WHERE len(w) > 0")
def parse_pdf_elements(spark, d):
    """The documents' words as PDF files of one page, a line of ten words each, and read again. All stands below the page's upper edge,
    where a text of one word like "mil" would be taken for a page number."""
    words = F.array_join(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[A-Za-z]+"), F.lit(0)), " ")
    rows = T.table(spark, d, "documents").select("doc_id", words.alias("w"))
    # Each tenth space ends a line, in one pass; a slice for each line would copy the whole array each time.
    lines = F.concat(F.lit("("), F.regexp_replace("w", r"((?:[A-Za-z]+ ){9}[A-Za-z]+) ", "$1) Tj T*\n("), F.lit(") Tj T*"))
    head = F.concat(F.lit("BT /F 20 Tf 12 TL 50 48100 Td (Document "), F.col("doc_id").cast("string"), F.lit(") Tj ET BT /F 10 Tf 12 TL 50 48000 Td\n"))
    page = F.concat(head, lines, F.lit(" ET"))
    objects = F.concat(F.lit("%PDF-1.4\n1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj\n2 0 obj << /Type /Pages /Kids [3 0 R] /Count 1 >> endobj\n3 0 obj << /Type /Page /Parent 2 0 R /MediaBox [0 0 900 60000] /Contents 4 0 R /Resources << /Font << /F 5 0 R >> >> >> endobj\n5 0 obj << /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >> endobj\n4 0 obj << /Length "), F.octet_length(page).cast("string"), F.lit(" >>\nstream\n"), page, F.lit("\nendstream endobj\ntrailer << /Root 1 0 R >>"))
    docs = rows.select("doc_id", F.lit("pdf").alias("source_type"), objects.cast("binary").alias("content"))
    return model.element_rows(model.parse_documents(docs, default_registry())).select("doc_id", "seq", "element_type", "text", "page")
