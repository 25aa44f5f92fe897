import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from docloom.sources import files, model
from docloom.sources.html import parse_html
from docloom.sources.markdown import parse_markdown
from docloom.sources.office import parse_docx, parse_pptx, parse_xlsx

W = 'xmlns:w="http://w" xmlns:r="http://r" xmlns:a="http://a"'


def package(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def shown(result):
    return [(e["element_type"], e["text"]) for e in result["elements"]]


def test_markdown():
    text = "# One *two*\n\nfirst\nline `x`\n\nsecond [手册.pdf](http://a) ![](b.png)\n\n- a\n  - b\n- c\n\n| h | i |\n|---|---|\n| 1 | [t.png](q) |\n\n```\ncode\n```\n## Two\n<video src='m.mp4'></video>\n> quoted\n\nlast\n===\nend snake_case\\*"
    got = parse_markdown(text.encode())
    assert shown(got) == [
        ("title", "One two"),
        ("paragraph", "first line x\nsecond {{doc:1}} {{image:1}}"),
        ("list", "- a\n- b\n- c"),
        ("table", "h | i\n1 | {{image:2}}"),
        ("title", "Two"),
        ("paragraph", "{{video:1}}\nquoted"),
        ("title", "last"),
        ("paragraph", "end snake_case*"),
    ]
    assert [(a["asset_type"], a["original_uri"], a["element_seq"]) for a in got["assets"]] == [("document_link", "http://a", 2), ("image", "b.png", 2), ("image_link", "q", 4), ("video_link", "m.mp4", 6)]
    assert got["elements"][4]["section_path"] == ["One two", "Two"] and got["elements"][6]["section_path"] == ["last"]


@pytest.mark.parametrize("text", ["", "\n\n", "```\nopen fence", "- ", "[x](", "**", "| a |\n|--|", "# ", "\t code", "> > #x", "1. a\n\n\n2. b", "`" * 50, "[" * 200])
def test_odd_markdown_is_read(text):
    assert parse_markdown(text.encode())["error"] is None


def test_html():
    text = '<html><head><base href="http://h/x/"><script>no</script></head><body><nav><ul><li>n</li></ul></nav><main><h1>T</h1><p>see <a href="f.pdf">doc</a> &amp; more</p><ol><li>a<ul><li>b</li></ul></li></ol><pre class="lang-py">x\ny</pre><table><thead><tr><th>A</th></tr></thead><tr><td rowspan="2">1<table><tr><td>n</td></tr></table></td></tr></table><h3>S</h3><video src="v.webm"></video></main></body></html>'
    got = parse_html(text.encode())
    assert shown(got) == [("title", "T"), ("paragraph", "see doc & more"), ("list", ""), ("paragraph", "a"), ("list", ""), ("paragraph", "b"), ("code", "x\ny"), ("table", "A\n1"), ("table", "n"), ("title", "S"), ("paragraph", "{{video:1}}")]
    assert got["assets"][0]["original_uri"] == "http://h/x/f.pdf" and got["elements"][3]["parent_seq"] == 3 and got["elements"][6]["language"] == "py"
    assert json.loads(got["elements"][7]["structured_data"])["table"]["rows"][0]["cells"][0]["metadata"]["rowspan"] == 2
    for empty in (b"", b"  ", b"<p></p>"):
        with pytest.raises(ValueError):
            parse_html(empty)


def test_docx():
    p = lambda text, props="": f"<w:p>{f'<w:pPr>{props}</w:pPr>' if props else ''}<w:r><w:t>{text}</w:t></w:r></w:p>"
    cell = lambda text, props="": f"<w:tc><w:tcPr>{props}</w:tcPr>{p(text)}</w:tc>"
    body = p("Top", '<w:pStyle w:val="Heading1"/>') + p("plain") + p("one", "<w:numPr/>") + p("goes on") + p("Sub", '<w:outlineLvl w:val="1"/>')
    body += '<w:p><w:hyperlink r:id="r1"><w:r><w:t>site</w:t></w:r></w:hyperlink></w:p>'
    body += f"<w:tbl><w:tr>{cell('h', '<w:gridSpan w:val=&quot;2&quot;/>'.replace('&quot;', chr(34)))}</w:tr><w:tr>{cell('a', '<w:vMerge w:val=' + chr(34) + 'restart' + chr(34) + '/>')}{cell('b')}</w:tr><w:tr>{cell('', '<w:vMerge/>')}{cell('c')}</w:tr></w:tbl><w:tbl><w:tr>{cell('single')}</w:tr></w:tbl>"
    parts = {"word/document.xml": f"<w:document {W}><w:body>{body}</w:body></w:document>", "word/_rels/document.xml.rels": '<R><Relationship Id="r1" Target="http://x/y" TargetMode="External"/></R>'}
    got = parse_docx(package(**parts))
    assert shown(got) == [("title", "Top"), ("paragraph", "plain"), ("list", "- one\n- goes on"), ("title", "Sub"), ("paragraph", "{{web:1}}"), ("table", "h | h\na | b\na | c")]
    with pytest.raises(ValueError):
        parse_docx(b"not a zip")


def test_xlsx():
    cells = "".join(f'<row r="{r}">' + "".join(f'<c r="{c}{r}" t="inlineStr"><is><t>{c}{r}</t></is></c>' for c in "AB") + "</row>" for r in range(1, 9))
    cells += '<row r="10"><c r="D10" t="s"><v>0</v></c></row><row r="12"><c r="D12"><f>SUM(A1)</f></c></row>'
    sheet = f'<worksheet {W}><sheetData>{cells}</sheetData><hyperlinks><hyperlink ref="D10" r:id="l1"/></hyperlinks></worksheet>'
    parts = {
        "xl/workbook.xml": f'<workbook {W}><sheets><sheet name="Hid" state="hidden" r:id="s1"/><sheet name="Data" r:id="s2"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<R><Relationship Id="s1" Target="worksheets/sheet1.xml"/><Relationship Id="s2" Target="worksheets/sheet2.xml"/></R>',
        "xl/worksheets/sheet1.xml": sheet,
        "xl/worksheets/sheet2.xml": sheet,
        "xl/worksheets/_rels/sheet2.xml.rels": '<R><Relationship Id="l1" Target="http://x/a.pdf" TargetMode="External"/></R>',
        "xl/sharedStrings.xml": "<sst><si><t>linked</t></si></sst>",
    }
    got = parse_xlsx(package(**parts))
    assert [e["element_type"] for e in got["elements"]] == ["title", "table", "table", "paragraph", "paragraph"]
    ranges = [json.loads(e["structured_data"])["table"]["metadata"]["range"] for e in got["elements"][1:3]]
    assert ranges == ["A1:B6", "A7:B8"] and got["elements"][2]["text"].startswith("A1 | B1\nA7 | B7")
    assert [e["text"] for e in got["elements"][3:]] == ["{{doc:1}}", "=SUM(A1)"] and got["elements"][0]["page"] == 2


def test_pptx():
    def shape(text, y, kind="", lines=()):
        ph = f'<p:nvPr><p:ph type="{kind}"/></p:nvPr>' if kind else ""
        body = "".join(f'<a:p><a:pPr lvl="{n}"/><a:r><a:t>{t}</a:t></a:r></a:p>' for n, t in (lines or [(0, text)]))
        return f'<p:sp><p:nvSpPr>{ph}</p:nvSpPr><p:spPr><a:xfrm><a:off x="0" y="{y}"/></a:xfrm></p:spPr><p:txBody>{body}</p:txBody></p:sp>'

    table = '<p:graphicFrame><p:xfrm><a:off x="0" y="50"/></p:xfrm><a:tbl><a:tr><a:tc><a:p><a:r><a:t>h</a:t></a:r></a:p></a:tc></a:tr><a:tr><a:tc><a:p><a:r><a:t>v</a:t></a:r></a:p></a:tc></a:tr></a:tbl></p:graphicFrame>'
    slide = f'<p:sld xmlns:p="http://p" {W}><p:cSld><p:spTree>{shape("low", 90)}{shape("Title", 10, "title")}{table}{shape("", 30, "body", [(0, "a"), (1, "b")])}</p:spTree></p:cSld></p:sld>'
    parts = {
        "ppt/presentation.xml": f'<p:presentation xmlns:p="http://p" {W}><p:sldIdLst><p:sldId id="256" r:id="s1"/></p:sldIdLst></p:presentation>',
        "ppt/_rels/presentation.xml.rels": '<R><Relationship Id="s1" Target="slides/slide1.xml"/></R>',
        "ppt/slides/slide1.xml": slide,
    }
    assert shown(parse_pptx(package(**parts))) == [("title", "Title"), ("list", "- a\n  - b"), ("table", "h\nv"), ("paragraph", "low")]


def test_registry():
    r = model.Registry()
    r.register(lambda c: {"n": 1}, "A", priority=2)
    r.register(lambda c: {"n": 2}, "a", priority=1)
    assert r.get("a")(b"") == {"n": 1}
    r.register(lambda c: {"n": 3}, "a", priority=2)
    assert r.get("A")(b"") == {"n": 3} and r.supported_types() == ["a"]
    r.unregister("a", "b")
    with pytest.raises(ValueError, match="unsupported"):
        r.get("a")


def test_folder_to_rows(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / ".git").mkdir()
    for name, text in {"a.md": "# T\n\nx", "sub/b.HTML": "<p>y</p>", "c.bin": "z", ".git/d.md": "n", "e.txt": " ", "f.html": " "}.items():
        (tmp_path / name).write_text(text)
    rows = files.read_folder(spark, str(tmp_path))
    assert {r.file_name: r.source_type for r in rows.collect()} == {"a.md": "markdown", "b.HTML": "html", "e.txt": "txt", "f.html": "html"}
    parsed = model.parse_documents(rows, files.default_registry())
    assert {(r.element_type, r.text) for r in model.element_rows(parsed).collect()} == {("title", "T"), ("paragraph", "x"), ("paragraph", "y")}
    assert [r.error_message for r in model.failures(parsed).collect()] == ["ValueError: the page is empty"]


def test_uris(spark):
    rows = spark.createDataFrame([("file:///a",), ("ftp://x",), ("http://y",), ("minio://b/k",)], "uri string")
    got = {r.uri: (r.content, r.error) for r in files.read_uris(rows, "uri", {"file": lambda u: F.encode(u, "utf-8")}).collect()}
    assert got["file:///a"][1] is None and bytes(got["file:///a"][0]) == b"file:///a"
    assert got["ftp://x"][1].startswith("unknown scheme") and got["http://y"][1] == "no fetcher: http"


def test_eval_files(spark, tmp_path):
    items = [{"query": "q", "expected_chunk_ids": ["c"], "source_doc_id": "d"}, {"query": " ", "expected_chunk_ids": ["c"]}, {"query": "r"}, {"query": "s", "expected_content_contains": ["k"], "doc_id": "e"}]
    (tmp_path / "x.json").write_text(json.dumps({"items": items}))
    got = {r.query: r.doc_id for r in files.read_eval_items(spark, str(tmp_path / "x.json")).collect()}
    assert got == {"q": "d", "s": "e"}


def test_docx_fields_and_objects():
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    run = lambda x: f"<w:r>{x}</w:r>"
    mark = lambda k: run(f'<w:fldChar w:fldCharType="{k}"/>')
    instr = lambda t: run(f"<w:instrText>{t}</w:instrText>")
    text = lambda t: run(f"<w:t>{t}</w:t>")
    one = text("see ") + mark("begin") + instr('HYPERLINK "https://a.org/f.pdf?x=1"') + mark("separate") + text("the file") + mark("end") + text(" now")
    two = mark("begin") + instr(r"WD \\tdfu https://d.org/1 \\tdfn clip.mov") + mark("end")
    three = mark("begin") + instr("PAGE") + mark("separate") + text("7") + mark("end") + run("<w:object><o:OLEObject xmlns:o='o'/></w:object>")
    body = "".join(f"<w:p>{p}</w:p>" for p in (one, two, three))
    got = parse_docx(package(**{"word/document.xml": f'<w:document xmlns:w="{w}"><w:body>{body}</w:body></w:document>'}))
    assert shown(got) == [("paragraph", "see {{doc:1}} now"), ("paragraph", "{{video:1}}"), ("paragraph", "7"), ("unknown", "")]
    assert [(a["asset_type"], a["original_uri"], a["display_text"]) for a in got["assets"]] == [("document_link", "https://a.org/f.pdf?x=1", "the file"), ("video_link", "https://d.org/1", "clip.mov")]
