"""PDF files made here, byte by byte, and what is read of them."""

import zlib

import pytest

from docloom.sources import model, pdf
from docloom.sources.files import default_registry
from docloom.sources.pdf_bytes import PdfFile, Reader, glyph_text, unfiltered

PNG_ROW = bytes(range(12))


def pdf_file(pages, more=(), catalog="", packed=False, trailer=b""):
    """pages: (content, extra page entries, extra resources); more: further objects from number 20 on."""
    objects = {1: f"<< /Type /Catalog /Pages 2 0 R {catalog} >>".encode(), 5: b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding /FirstChar 32 /LastChar 126 /Widths [" + b" ".join([b"500"] * 95) + b"] >>", 6: b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica-Bold /Encoding /WinAnsiEncoding >>"}
    kids = []
    for i, (content, entries, resources) in enumerate(pages):
        n = 100 + 2 * i
        kids.append(f"{n} 0 R")
        data = zlib.compress(content.encode("latin-1"))
        objects[n] = f"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 600 800] /Contents {n + 1} 0 R /Resources << /Font << /F 5 0 R /B 6 0 R >> {resources} >> {entries} >>".encode()
        objects[n + 1] = b"<< /Length %d /Filter /FlateDecode >>\nstream\n" % len(data) + data + b"\nendstream"
    objects[2] = f"<< /Type /Pages /Kids [{' '.join(kids)}] /Count {len(kids)} >>".encode()
    for i, x in enumerate(more, 20):
        objects[i] = x
    out = b"%PDF-1.5\n"
    if packed:
        plain = {n: x for n, x in objects.items() if b"stream" not in x}
        head, body = b"", b""
        for n, x in plain.items():
            head += b"%d %d " % (n, len(body))
            body += x + b" "
        data = zlib.compress(head + body)
        out += b"9 0 obj\n<< /Type /ObjStm /N %d /First %d /Filter /FlateDecode /Length %d >>\nstream\n" % (len(plain), len(head), len(data)) + data + b"\nendstream\nendobj\n"
        objects = {n: x for n, x in objects.items() if n not in plain}
    for n, x in objects.items():
        out += b"%d 0 obj\n" % n + x + b"\nendobj\n"
    return out + b"trailer\n<< /Root 1 0 R " + trailer + b" >>\n%%EOF"


def at(x, y, text, size=10, font="F"):
    return f"BT /{font} {size} Tf 1 0 0 1 {x} {y} Tm ({text}) Tj ET\n"


def shown(result):
    return [(e["element_type"], e["text"], e.get("heading_level"), e["page"]) for e in result["elements"]]


def test_headings_paragraphs_and_margins():
    body = lambda i: at(50, 780, "Annual report", 9) + at(50, 20, str(i), 9) + at(50, 700, f"Chapter {i}", 20) + at(50, 650, "First line of", 10) + at(50, 638, "one paragraph", 10) + at(50, 500, "Another one", 10) + at(50, 470, "Bold part", 12, "B")
    got = shown(pdf.parse_pdf(pdf_file([(body(i), "", "") for i in (1, 2, 3)])))
    assert got == [x for i in (1, 2, 3) for x in [("title", f"Chapter {i}", 1, i), ("paragraph", "First line of one paragraph", None, i), ("paragraph", "Another one", None, i), ("title", "Bold part", 3, i)]]
    assert shown(pdf.parse_pdf(pdf_file([(body(i), "", "") for i in (1, 2, 3)], packed=True))) == got


def test_blocks_are_compared_with_the_first_font_that_was_joined(spark):
    rows = [("d", 1, b, 0, 0, 50.0, y, 90.0, y + 10, t, s, False, 800.0) for b, (y, s, t) in enumerate([(100.0, 10.0, "a"), (112.0, 10.4, "b"), (124.0, 10.8, "c"), (300.0, 10.8, "d")])]
    spans = spark.createDataFrame(rows, pdf.SPANS)
    assert sorted((r.y0, r.text, r.size) for r in pdf.merged(pdf.blocks_of(spans)).collect()) == [(100.0, "a b", 10.0), (124.0, "c", 10.8), (300.0, "d", 10.8)]
    page = pdf_file([(at(50, 700, "a", 10) + at(50, 682, "b", 10.4) + at(50, 664, "c", 10.8), "", "")])
    assert [t for _, t, *_ in shown(pdf.parse_pdf(page))] == ["a b", "c"]


def test_tables_pictures_links_and_outline():
    rules = "".join(f"{x} 300 m {x} 400 l S\n" for x in (100, 200, 300)) + "".join(f"100 {y} m 300 {y} l S\n" for y in (300, 350, 400))
    cells = at(110, 370, "name") + at(210, 370, "n") + at(110, 320, "x") + at(210, 320, "7")
    picture = b"<< /Type /XObject /Subtype /Image /Width 2 /Height 2 /BitsPerComponent 8 /ColorSpace /DeviceRGB /Length 12 >>\nstream\n" + PNG_ROW + b"\nendstream"
    more = [picture, b"<< /Type /Annot /Subtype /Link /Rect [50 598 110 612] /A << /S /URI /URI (https://a.org/f.pdf) >> >>", b"<< /First 23 0 R >>", b"<< /Title (Opening) /Dest [100 0 R /Fit] /Next 24 0 R >>", b"<< /Title <FEFF00C900740065> /Dest [102 0 R /Fit] >>"]
    content = at(50, 700, "Opening", 24) + at(50, 600, "read this") + rules + cells + "q 80 0 0 80 100 150 cm /I Do Q\nq 80 0 0 80 300 150 cm /I Do Q\n"
    got = pdf.parse_pdf(pdf_file([(content, "/Annots [21 0 R]", "/XObject << /I 20 0 R >>"), (at(50, 600, "second page"), "", "")], more, "/Outlines 22 0 R"))
    assert shown(got) == [("title", "Opening", 1, 1), ("paragraph", "read this {{doc:1}}", None, 1), ("table", "name | n\nx | 7", None, 1), ("paragraph", "{{image:1}}", None, 1), ("title", "Éte", 1, 2), ("paragraph", "second page", None, 2)]
    assert [(a["asset_type"], a["display_text"]) for a in got["assets"]] == [("document_link", "read this"), ("image", "")]
    assert got["assets"][0]["original_uri"] == "https://a.org/f.pdf" and got["assets"][1]["data"].startswith(b"\x89PNG") and got["assets"][1]["element_seq"] == 4


def test_fonts_of_two_bytes_and_named_glyphs():
    cmap = b"1 beginbfchar <0001> <0041> endbfchar 1 beginbfrange <0002> <0003> <4E2D> endbfrange"
    more = [b"<< /Type /Font /Subtype /Type0 /BaseFont /X /Encoding /Identity-H /DescendantFonts [21 0 R] /ToUnicode 22 0 R >>", b"<< /Type /Font /DW 1000 /W [1 [500 600] 3 3 700] >>", b"<< /Length %d >>\nstream\n" % len(cmap) + cmap + b"\nendstream", b"<< /Type /Font /Subtype /Type1 /BaseFont /Y /Encoding << /Differences [65 /eacute /uni20AC /fi] >> >>"]
    content = "BT /W 10 Tf 50 600 Td <000100020003> Tj ET BT /D 10 Tf 50 300 Td [(AB) -400 (C\\101)] TJ T* ET"
    got = pdf.parse_pdf(pdf_file([(content, "", "/Font << /W 20 0 R /D 23 0 R >>")], more))
    assert [t for _, t, *_ in shown(got)] == ["A中丮", "é€ fié"]
    assert glyph_text("Odieresis") == "Ö" and glyph_text("nosuch") == ""


def test_values_and_filters():
    assert Reader(b"<< /A#20B [1 -.5 (a\\(b\\)\\n\\061(c)) <4a4> true null 3 0 R] /C << >> % note\n>>").value() == {"A B": [1, -0.5, b"a(b)\n1(c)", b"J@", True, None, Reader(b"3 0 R").value()], "C": {}}
    rows = b"\x01\x05\x01\x02\x02\x01\x01\x01\x04\x01\x01\x01"
    assert unfiltered(zlib.compress(rows), ["FlateDecode"], [{"Predictor": 15, "Columns": 3}])[0] == b"\x05\x06\x08\x06\x07\x09\x07\x08\x0a"
    assert unfiltered(b"87cURDZ~>", ["ASCII85Decode"], [None])[0] == b"Hello" and unfiltered(b"\x02abc\xfed\x80", ["RunLengthDecode"], [None])[0] == b"abcddd"
    assert unfiltered(bytes.fromhex("800B6050220C0C8501"), ["LZWDecode"], [None])[0] == b"-----A---B"
    data = bytes(i * i % 251 for i in range(9000))
    assert unfiltered(packed(data), ["LZW"], [None])[0] == data


def packed(data):
    """LZW as PDF files have it."""
    out, bits, width = 0, 0, 9
    table = {bytes([i]): i for i in range(256)}

    def put(code):
        nonlocal out, bits
        out, bits = out << width | code, bits + width

    put(256)
    run, last = b"", 258
    for i in range(len(data)):
        c = data[i : i + 1]
        if run + c in table:
            run += c
            continue
        put(table[run])
        if last < 4096:
            table[run + c] = last
            last += 1
            # The reader's table is one entry behind.
            width = min(12, max(9, (last - 1 + 1).bit_length()))
        run = c
    put(table[run])
    width = min(12, max(9, (last + 1).bit_length()))
    put(257)
    pad = -bits % 8
    return (out << pad).to_bytes((bits + pad) // 8, "big")


@pytest.mark.parametrize(("data", "error"), [(b"", "empty"), (b"GIF89a", "not a PDF"), (pdf_file([]), "no pages"), (pdf_file([("", "", "")]), "no text"), (pdf_file([(at(1, 1, "x"), "", "")], trailer=b"/Encrypt 3 0 R"), "encrypted"), (pdf_file([("/I Do", "", "/XObject << /I 20 0 R >>")], [b"<< /Subtype /Image /Filter /DCTDecode /Length 3 >>\nstream\nabc\nendstream"]), "scanned")])
def test_errors(data, error):
    with pytest.raises(ValueError, match=error):
        pdf.parse_pdf(data)


def test_damaged_files_still_give_their_text():
    good = pdf_file([(at(50, 700, "still here"), "", "")])
    assert shown(pdf.parse_pdf(good.replace(b"/Length", b"/Lost99").replace(b"trailer", b"tail")))[0][1] == "still here"
    assert PdfFile(good + b"\n100 0 obj\n<< /Type /Page /MediaBox [0 0 9 9] >>\nendobj").pages()[0].height == 9


def test_table_functions(spark):
    files = [("a", "pdf", pdf_file([(at(50, 700, "Title", 20) + at(50, 600, "text") + at(50, 580, "more", 10.1), "", "")])), ("b", "pdf", b"x"), ("c", "pdf", None)]
    docs = spark.createDataFrame(files, "doc_id string, source_type string, content binary")
    parsed = model.parse_documents(docs, default_registry())
    assert sorted((r.doc_id, r.text) for r in model.element_rows(parsed).collect()) == [("a", "Title"), ("a", "text more")]
    assert {r.doc_id for r in model.failures(parsed).collect()} == {"b", "c"}
    rows = pdf.layout_elements(pdf.decoded_spans(docs)).orderBy("seq").collect()
    assert [(r.element_type, r.text, r.heading_level) for r in rows] == [("title", "Title", 1), ("paragraph", "text more", None)]
