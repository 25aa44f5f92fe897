"""PDF files to elements: as a parser of one file, and as operators over a table of text spans.

spans: doc_id, page, block, line, span, x0, y0, x1, y1, text, size, bold, page_height, as
``decoded_spans`` makes them from files. Both ways follow the same rules.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.scalar import PAGE_NUMBER, PLACEHOLDER, is_page_number, normalize_text
from docloom.operators.layout import best_overlap, heading_level, outside_ranges
from docloom.sources.model import Builder
from docloom.sources.office import link_kind, table_json, table_text
from docloom.sources.pdf_bytes import Page, PdfFile, Span

EDGE, SMALL, SHORT, PAGES = 0.15, 10.0, 100, 3


def blocks_of(spans: DataFrame) -> DataFrame:
    """A row per block: its box, mean font size, whether any of it is bold, and its text."""
    keys = ["doc_id", "page", "block"]
    one = F.struct("line", "span", "text")
    rows = spans.groupBy(*keys).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.avg("size").alias("size"), F.bool_or("bold").alias("bold"), F.max("page_height").alias("page_height"), F.array_sort(F.collect_list(one)).alias("parts"))
    return rows.withColumn("text", normalize_text(F.array_join(F.transform("parts", lambda p: p["text"]), " "))).drop("parts").where("text <> ''")


def without_margins(blocks: DataFrame) -> DataFrame:
    """Blocks that are no running heads or feet: small short texts at a page's edge that stand at one height on three pages or are page numbers."""
    edge = (F.col("y1") <= F.col("page_height") * EDGE) | (F.col("y0") >= F.col("page_height") * (1 - EDGE))
    at_edge = edge & (F.col("size") <= SMALL) & (F.length("text") <= SHORT)
    bucket = F.floor(F.col("y0") / 10).cast("bigint")
    repeated = blocks.where(edge).groupBy("doc_id", bucket.alias("bucket"), "text").agg(F.countDistinct("page").alias("pages")).where(F.col("pages") >= PAGES).drop("pages").withColumn("repeated", F.lit(True))
    rows = blocks.withColumn("bucket", bucket).join(repeated, ["doc_id", "bucket", "text"], "left")
    return rows.where(~((edge & F.coalesce("repeated", F.lit(False))) | (at_edge & is_page_number(F.col("text"))))).drop("bucket", "repeated")


def merged(blocks: DataFrame) -> DataFrame:
    """Blocks of a page in reading order, neighbours joined: a block joins the one before if its font is within 0.5 of
    that of the first block joined, equally bold, and the gap to the last one at most max(1.5 of that font, 2).

    A fold over each page's blocks, as a block is compared with what was joined so far.
    """
    one = F.struct("y0", "x0", "block", "x1", "y1", "size", "bold", "text")
    pages = blocks.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(one)).alias("parts"))  # the blocks of one page
    kind = "array<struct<x0:double,y0:double,x1:double,y1:double,size:double,bold:boolean,text:string>>"

    def joined(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        gap = F.greatest(F.when(last["size"] > 0, last["size"] * 1.5).otherwise(12.0), F.lit(2.0))
        fits = (F.size(acc) > 0) & (F.abs(last["size"] - x["size"]) < 0.5) & (last["bold"] == x["bold"]) & (x["y0"] - last["y1"] <= gap)
        own = F.struct(x["x0"].cast("double").alias("x0"), x["y0"].cast("double").alias("y0"), x["x1"].cast("double").alias("x1"), x["y1"].cast("double").alias("y1"), x["size"].cast("double").alias("size"), x["bold"].alias("bold"), x["text"].alias("text"))
        both = F.struct(F.least(last["x0"], own["x0"]).alias("x0"), last["y0"].alias("y0"), F.greatest(last["x1"], own["x1"]).alias("x1"), own["y1"].alias("y1"), last["size"].alias("size"), last["bold"].alias("bold"), F.concat(last["text"], F.lit(" "), own["text"]).alias("text"))
        return F.when(F.coalesce(fits, F.lit(False)), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(both))).otherwise(F.concat(acc, F.array(own)))

    folded = F.aggregate("parts", F.array().cast(kind), joined)
    return pages.select("doc_id", "page", F.posexplode(folded).alias("n", "b")).select("doc_id", "page", (F.col("n") + 1).cast("bigint").alias("block"), "b.*")


def layout_elements(spans: DataFrame, tables: DataFrame | None = None) -> DataFrame:
    """(doc_id, seq, page, element_type, text, heading_level): blocks in reading order, without margins and what tables (page, y0, y1) cover."""
    rows = without_margins(blocks_of(spans))
    if tables is not None:
        rows = outside_ranges(rows, tables, ["doc_id", "page"])
    rows = merged(rows).withColumn("heading_level", heading_level())
    title = F.col("heading_level") > 0
    seq = F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "y0", "x0", "block"))
    return rows.select("doc_id", seq.cast("bigint").alias("seq"), "page", F.when(title, "title").otherwise("paragraph").alias("element_type"), "text", F.when(title, F.col("heading_level")).alias("heading_level"), "x0", "y0", "x1", "y1")


def links_of(links: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc_id, page, link, span, share): for each link's rectangle the span of which it covers most, at least a tenth."""
    numbered = spans.withColumn("place", F.col("block") * 1000000 + F.col("line") * 1000 + F.col("span"))
    return best_overlap(links, numbered, ["doc_id", "page"], "link", "place")


# -- files

SPANS = "doc_id string, page int, block int, line int, span int, x0 double, y0 double, x1 double, y1 double, text string, size double, bold boolean, page_height double"


def decoded_spans(docs: DataFrame) -> DataFrame:
    """SPANS of PDF files (doc_id, content): what the operators above take. A file that can't be read has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                try:
                    pages = PdfFile(batch.column(1)[i].as_py() or b"").pages()
                except Exception:  # its failure is a row of parse_pdf
                    continue
                rows = [[batch.column(0)[i].as_py(), p.number, b, n, k, s.x0, s.y0, s.x1, s.y1, s.text, s.size, s.bold, p.height] for p in pages for b, block in enumerate(_blocks(p.spans)) for n, line in enumerate(block) for k, s in enumerate(line)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.string(), *[pa.int32()] * 4, *[pa.float64()] * 4, pa.string(), pa.float64(), pa.bool_(), pa.float64()], strict=True)], [x.split()[0] for x in SPANS.split(", ")])

    return docs.select(F.col("doc_id").cast("string"), F.col("content").cast("binary")).mapInArrow(run, SPANS)


def _blocks(spans: list[Span]) -> list[list[list[Span]]]:
    """Spans as lines (of one height, left to right) and lines as blocks (no gap of over 0.6 of the font between them)."""
    lines: list[list[Span]] = []
    for s in sorted(spans, key=lambda s: (s.y1, s.x0)):
        if lines and abs(lines[-1][0].y1 - s.y1) <= 0.3 * max(s.size, 1) and s.x0 - max(x.x1 for x in lines[-1]) <= 4 * max(s.size, 1):
            lines[-1].append(s)
        else:
            lines.append([s])
    blocks: list[list[list[Span]]] = []
    for line in lines:
        line.sort(key=lambda s: s.x0)
        top, size = min(s.y0 for s in line), max(s.size for s in line)
        if blocks:
            before = blocks[-1][-1]
            beside = min(line[-1].x1, before[-1].x1) > max(line[0].x0, before[0].x0)
            if beside and -0.5 * size <= top - max(s.y1 for s in before) <= 0.6 * size and abs(before[0].size - line[0].size) < 0.5 and before[0].bold == line[0].bold:
                blocks[-1].append(line)
                continue
        blocks.append([line])
    return blocks


@dataclass
class _Block:
    page: int
    x0: float
    y0: float
    x1: float
    y1: float
    size: float
    bold: bool
    spans: list[Span]

    @cached_property
    def text(self) -> str:
        return " ".join("".join(s.text for s in line) for line in _lines_of(self.spans)).strip()


def _lines_of(spans: list[Span]) -> list[list[Span]]:
    out: list[list[Span]] = []
    for s in spans:
        if out and abs(out[-1][0].y1 - s.y1) <= 0.3 * max(s.size, 1):
            out[-1].append(s)
        else:
            out.append([s])
    return out


def _page_blocks(page: Page) -> list[_Block]:
    out = []
    for block in _blocks(page.spans):
        flat = [s for line in block for s in line]
        out.append(_Block(page.number, min(s.x0 for s in flat), min(s.y0 for s in flat), max(s.x1 for s in flat), max(s.y1 for s in flat), sum(s.size for s in flat) / len(flat), any(s.bold for s in flat), flat))
    return [b for b in sorted(out, key=lambda b: (b.y0, b.x0)) if b.text]


def _margins(pages: list[Page], blocks: list[_Block]) -> list[_Block]:
    """Blocks without running heads and feet: edge texts at one height on PAGES pages, and small page numbers."""
    height = {p.number: p.height for p in pages}
    at_edge = lambda b: b.y1 <= height[b.page] * EDGE or b.y0 >= height[b.page] * (1 - EDGE)
    seen: dict[tuple, set[int]] = {}
    for b in blocks:
        if at_edge(b):
            seen.setdefault((int(b.y0 // 10), b.text), set()).add(b.page)
    number = lambda b: b.size <= SMALL and len(b.text) <= SHORT and re.match(PAGE_NUMBER, b.text)
    return [b for b in blocks if not (at_edge(b) and (len(seen[int(b.y0 // 10), b.text]) >= PAGES or number(b)))]


def _joined(blocks: list[_Block]) -> list[_Block]:
    """As merged: a fold along the page."""
    out: list[_Block] = []
    for b in blocks:
        a = out[-1] if out else None
        if a and abs(a.size - b.size) < 0.5 and a.bold == b.bold and b.y0 - a.y1 <= max(a.size * 1.5 if a.size > 0 else 12.0, 2.0):
            out[-1] = _Block(a.page, min(a.x0, b.x0), a.y0, max(a.x1, b.x1), b.y1, a.size, a.bold, a.spans + b.spans)
        else:
            out.append(b)
    return out


def _level(b: _Block) -> int:
    """Heading level by font: large short texts, and bold ones of 12 to 13 points; 0 for a paragraph."""
    if len(b.text) > 80:
        return 0
    if b.size >= 14:
        return 1 if b.size >= 18 else 2 if b.size >= 16 else 3
    return 3 if 12 <= b.size <= 13 and b.bold else 0


def _tables(page: Page) -> list[tuple[tuple, list[list[str]]]]:
    """(box, rows of cell texts) of grids of ruled lines with two rows and two columns at least."""
    flat = [(min(a, c), b, max(a, c)) for a, b, c, d in page.lines if abs(b - d) < 1 and abs(a - c) > 8]
    tall = [(a, min(b, d), max(b, d)) for a, b, c, d in page.lines if abs(a - c) < 1 and abs(b - d) > 4]
    groups: list[list] = []
    for x0, y, x1 in sorted(set(flat), key=lambda r: r[1]):  # horizontal rules that verticals tie together
        for g in groups:
            if any(x0 - 2 <= x <= x1 + 2 and top - 2 <= g[-1][1] and y <= end + 2 for x, top, end in tall):
                g.append((x0, y, x1))
                break
        else:
            groups.append([(x0, y, x1)])
    out = []
    for g in groups:
        ys = _apart([y for _, y, _ in g])
        left, right = min(r[0] for r in g), max(r[2] for r in g)
        xs = _apart([x for x, top, end in tall if left - 2 <= x <= right + 2 and top < ys[-1] and end > ys[0]])
        if len(xs) < 3 or len(ys) < 3:
            continue
        inside = lambda s, a, b, c, d: a <= (s.x0 + s.x1) / 2 < c and b <= (s.y0 + s.y1) / 2 < d
        rows = [[" ".join(s.text.strip() for s in sorted(page.spans, key=lambda s: (s.y1, s.x0)) if inside(s, a, b, c, d)) for a, c in zip(xs, xs[1:], strict=False)] for b, d in zip(ys, ys[1:], strict=False)]
        if any(any(r) for r in rows):
            out.append(((xs[0], ys[0], xs[-1], ys[-1]), rows))
    return out


def _apart(values: list[float]) -> list[float]:
    out: list[float] = []
    for v in sorted(values):
        if not out or v - out[-1] > 3:
            out.append(v)
    return out


def _shared(a: tuple, b: Span) -> float:
    """Share of a span that a rectangle covers."""
    width, height = min(a[2], b.x1) - max(a[0], b.x0), min(a[3], b.y1) - max(a[1], b.y0)
    area = (b.x1 - b.x0) * (b.y1 - b.y0)
    return width * height / area if width > 0 and height > 0 and area > 0 else 0.0


def parse_pdf(content: bytes) -> dict:
    """Elements and assets of a PDF file: outline titles, headings by font, paragraphs, tables, pictures (each once),
    links at the span they cover most. Empty, encrypted and unreadable files, and those without text, are errors."""
    if not content:
        raise ValueError("the file is empty")
    file = PdfFile(content)
    pages = file.pages()
    if not pages:
        raise ValueError("the file has no pages")
    out, told = Builder(), {}
    for level, title, number in file.outline():
        told.setdefault(number, []).append((level, title))
    blocks: dict[int, list[_Block]] = {}
    for b in _margins(pages, [b for p in pages for b in _page_blocks(p)]):
        blocks.setdefault(b.page, []).append(b)
    for page in pages:
        _page_elements(out, page, blocks.get(page.number, []), sorted(told.get(page.number, []), key=lambda x: x[0]))
    if not any(e["element_type"] != "unknown" and not re.fullmatch(PLACEHOLDER, e["text"]) for e in out.elements):
        raise ValueError("no text layer: a scanned file" if any(p.images for p in pages) else "no text")
    return out.result()


def _page_elements(out: Builder, page: Page, blocks: list[_Block], titles: list[tuple[int, str]]) -> None:
    tables = _tables(page)
    free = [b for b in blocks if not any(b.y0 <= box[3] and b.y1 >= box[1] for box, _ in tables)]
    for level, title in titles:
        out.title(title, level, page=page.number)
    named = {re.sub(r"\s+", " ", t) for _, t in titles}
    links: dict[int, list[str]] = {}
    for uri, box in page.links:
        if not re.match(r"https?://", uri):
            continue
        share, i = max(((_shared(box, s), -k) for k, s in enumerate(page.spans)), default=(0.0, 0))
        if share >= 0.1:
            links.setdefault(id(page.spans[-i]), []).append(uri)
    pieces = [(b.y0, b.x0, "text", b) for b in _joined(free)] + [(box[1], box[0], "table", rows) for box, rows in tables] + [(box[1], box[0], "image", data) for data, box in page.images]
    for _, _, kind, x in sorted(pieces, key=lambda p: p[:2]):
        if kind == "table":
            out.add("table", table_text(x), structured_data=table_json("", x[0], x[1:]), page=page.number)
        elif kind == "image":
            number = out.asset("image", hashlib.sha256(x).hexdigest(), data=x)
            if out.assets[number - 1]["element_seq"] is None:
                mark = out.placeholder("image")
                out.add("paragraph", mark, [(mark, number)], page=page.number)
        elif re.sub(r"\s+", " ", x.text) not in named:
            refs = []
            for s in x.spans:
                for uri in links.get(id(s), []):
                    kind_of = link_kind(uri)
                    refs.append((out.placeholder(kind_of), out.asset(kind_of, uri, s.text.strip())))
            text = " ".join([x.text, *[mark for mark, _ in refs]])
            if level := _level(x):
                out.title(text, level, refs=refs, page=page.number)
            else:
                out.add("paragraph", text, refs, page=page.number)
