"""Word, Excel and PowerPoint packages to elements and assets, from their XML."""

from __future__ import annotations

import io
import json
import posixpath
import re
import zipfile
from xml.etree import ElementTree as ET

from docloom.sources.model import Builder
from docloom.sources.names import HTTP, is_attachment, is_video, suffix, text_type

# Heading names of Word styles in the languages that are recognised.
HEADING_WORDS = ("heading", "标题", "見出し", "überschrift", "titre", "título", "заголовок")
ROWS_PER_TABLE = 5


def local(tag: str) -> str:
    return tag.rpartition("}")[2]


def attr(node: ET.Element, name: str) -> str | None:
    """An attribute by its local name."""
    return next((v for k, v in node.attrib.items() if local(k) == name), None)


def child(node: ET.Element | None, *names: str) -> ET.Element | None:
    for name in names:
        node = next((c for c in node if local(c.tag) == name), None) if node is not None else None
    return node


def all_of(node: ET.Element, *names: str) -> list[ET.Element]:
    return [c for c in node.iter() if local(c.tag) in names]


class Package:
    def __init__(self, content: bytes):
        try:
            self.zip = zipfile.ZipFile(io.BytesIO(content))
        except zipfile.BadZipFile as e:
            raise ValueError("not an office package") from e
        self.names = set(self.zip.namelist())

    def xml(self, name: str) -> ET.Element | None:
        return ET.fromstring(self.zip.read(name)) if name in self.names else None

    def links(self, name: str) -> dict[str, tuple[str, bool]]:
        """Relationships of a part: id -> (target, external)."""
        folder, file = posixpath.split(name)
        root = self.xml(f"{folder}/_rels/{file}.rels")
        out = {}
        for r in root if root is not None else ():
            outside, target = r.get("TargetMode") == "External", r.get("Target", "")
            out[r.get("Id")] = (target if outside else posixpath.normpath(posixpath.join("/" + folder, target)).lstrip("/"), outside)
        return out


def link_kind(url: str) -> str:
    return "video_link" if is_video(url) else "image_link" if text_type(url) == "image_link" else "document_link" if is_attachment(url) else "web_link"


def table_json(caption: str, headers: list[str], rows: list[list[str]], **meta) -> str:
    return json.dumps({"table": {"caption": caption, "headers": [{"text": h} for h in headers], "rows": [{"cells": [{"text": c} for c in r]} for r in rows], "metadata": meta}}, ensure_ascii=False)


def table_text(rows: list[list[str]]) -> str:
    return "\n".join(" | ".join(r) for r in rows)


# -- Word

def field_link(instruction: str) -> tuple[str, str]:
    """(URL, file name) of a field's instruction: a drive's file with its name, else the first link in it and its last part."""
    place, name = re.search(r"\\tdfu\s+(\S+)", instruction), re.search(r"\\tdfn\s+(\S+)", instruction)
    if place and name:
        return place[1], name[1]
    quoted = re.search(r'(?i)(?:HYPERLINK|INCLUDEPICTURE)\s+"(https?://[^"]+)"', instruction)
    found = quoted[1] if quoted else m[0] if (m := re.search(r"https?://\S+", instruction)) else ""
    return (found, found.partition("?")[0].rpartition("/")[2] or "file") if found else ("", "")


class _Word:
    def __init__(self, content: bytes):
        self.package, self.out = Package(content), Builder()
        self.body = child(self.package.xml("word/document.xml"), "body")
        if self.body is None:
            raise ValueError("the package has no document")
        self.links = self.package.links("word/document.xml")
        styles = self.package.xml("word/styles.xml")
        self.styles = {attr(s, "styleId"): (attr(n, "val") or "") if (n := child(s, "name")) is not None else "" for s in styles if local(s.tag) == "style"} if styles is not None else {}
        self.items: list[str] = []
        self.item_refs: list[tuple[str, int]] = []
        self.embedded = 0

    def read(self) -> dict:
        for node in self.body:
            if local(node.tag) == "p":
                self.paragraph(node)
            elif local(node.tag) == "tbl":
                self.close_list()
                self.table(node)
            if self.embedded:
                self.close_list()
                self.objects()
        self.close_list()
        self.out.own_last()
        return self.out.result()

    def level(self, node: ET.Element) -> int:
        props = child(node, "pPr")
        style = child(props, "pStyle")
        names = [attr(style, "val") or "", self.styles.get(attr(style, "val"), "")] if style is not None else []
        for name in names:
            if any(w in name.lower() for w in HEADING_WORDS) and (m := re.search(r"([1-9])\s*$", name)):
                return int(m[1])
        outline = child(props, "outlineLvl")
        n = int(attr(outline, "val") or 9) if outline is not None else 9
        return n + 1 if n < 9 else 0

    def paragraph(self, node: ET.Element) -> None:
        text, refs = self.content(node)
        text = text.strip()
        if level := self.level(node):
            self.close_list()
            if text:
                self.out.title(text, level, refs=refs)
        elif child(node, "pPr", "numPr") is not None or self.items:
            if text:
                self.items.append(text)
                self.item_refs += refs
        elif text or refs:
            self.out.add("paragraph", text, refs)

    def close_list(self) -> None:
        if self.items:
            self.out.add("list", "\n".join(f"- {x}" for x in self.items), self.item_refs)
        self.items, self.item_refs = [], []

    def content(self, node: ET.Element) -> tuple[str, list[tuple[str, int]]]:
        """Text of a paragraph, links and pictures in it as placeholders."""
        parts: list[str] = []
        refs: list[tuple[str, int]] = []

        def refer(kind: str, uri: str, label: str = "", data: bytes | None = None) -> None:
            mark = self.out.placeholder(kind)
            refs.append((mark, self.out.asset(kind, uri, label, data)))
            parts.append(mark)

        fields: list[dict] = []  # open ones, outermost first

        def close(f: dict) -> None:
            url, label = field_link(f["instr"])
            told = "".join(f["told"])
            if url:
                refer(link_kind(label) if suffix(label) else link_kind(url), url, told.strip() or label)
            else:
                put(told)

        def put(text: str) -> None:
            if not fields:
                parts.append(text)
            elif fields[-1]["result"]:
                fields[-1]["told"].append(text)

        def walk(n: ET.Element) -> None:
            name = local(n.tag)
            if name == "t":
                put(n.text or "")
            elif name in ("tab", "br", "cr"):
                put("\t" if name == "tab" else "\n")
            elif name == "fldChar":
                kind = attr(n, "fldCharType")
                if kind == "begin":
                    fields.append({"instr": "", "told": [], "result": False})
                elif kind == "separate" and fields:
                    fields[-1]["result"] = True
                elif kind == "end" and fields:
                    close(fields.pop())
            elif name == "instrText":
                if fields:
                    fields[-1]["instr"] += n.text or ""
                else:
                    close({"instr": n.text or "", "told": []})
            elif name == "hyperlink" and attr(n, "id") in self.links:
                label, url = "".join(t.text or "" for t in all_of(n, "t")), self.links[attr(n, "id")][0]
                refer(text_type(label) if text_type(label) != "web_link" else link_kind(url), url, label)
            elif name == "blip" and attr(n, "embed") in self.links:
                place, outside = self.links[attr(n, "embed")]
                refer("image_link" if outside else "image", place, data=None if outside or place not in self.package.names else self.package.zip.read(place))
            elif name == "OLEObject":
                self.embedded += 1
            elif name != "pPr":
                for c in n:
                    walk(c)

        for c in node:
            walk(c)
        while fields:  # a field that the paragraph does not end
            close(fields.pop())
        return "".join(parts), refs

    def objects(self) -> None:
        """An unknown element for each embedded object since the last call."""
        for _ in range(self.embedded):
            self.out.add("unknown", "")
        self.embedded = 0

    def table(self, node: ET.Element) -> None:
        rows: list[list[str]] = []
        refs: list[tuple[str, int]] = []
        for tr in (c for c in node if local(c.tag) == "tr"):
            row: list[str] = []
            for tc in (c for c in tr if local(c.tag) == "tc"):
                props = child(tc, "tcPr")
                texts = []
                for p in (c for c in tc if local(c.tag) == "p"):
                    text, own = self.content(p)
                    texts.append(text)
                    refs += own
                text = "\n".join(texts).strip()
                merge = child(props, "vMerge")
                if merge is not None and attr(merge, "val") != "restart" and rows and len(row) < len(rows[-1]):
                    text = rows[-1][len(row)]  # goes on from the cell above
                wide = child(props, "gridSpan")
                row += [text] * (int(attr(wide, "val") or 1) if wide is not None else 1)
            rows.append(row)
        if len(rows) > 1:
            self.out.add("table", table_text(rows), refs, structured_data=table_json("", rows[0], rows[1:]))


def parse_docx(content: bytes) -> dict:
    return _Word(content).read()


# -- Excel

def cell_place(ref: str) -> tuple[int, int]:
    letters, digits = re.match(r"\$?([A-Z]+)\$?(\d+)", ref).groups()
    col = 0
    for c in letters:
        col = col * 26 + ord(c) - 64
    return int(digits), col


def cell_name(row: int, col: int) -> str:
    letters = ""
    while col:
        col, rest = divmod(col - 1, 26)
        letters = chr(65 + rest) + letters
    return f"{letters}{row}"


def runs(numbers: set[int]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for n in sorted(numbers):
        if out and out[-1][1] == n - 1:
            out[-1] = (out[-1][0], n)
        else:
            out.append((n, n))
    return out


def parse_xlsx(content: bytes) -> dict:
    """Visible sheets: a title, then each region of cells, a table from 2 x 2 on and else a paragraph for each cell."""
    package, out = Package(content), Builder()
    book = package.xml("xl/workbook.xml")
    if book is None:
        raise ValueError("the package has no workbook")
    links = package.links("xl/workbook.xml")
    shared = package.xml("xl/sharedStrings.xml")
    strings = ["".join(t.text or "" for t in all_of(si, "t")) for si in shared] if shared is not None else []
    for number, sheet in enumerate(child(book, "sheets"), 1):
        if sheet.get("state", "visible") != "visible":
            continue
        part = links.get(attr(sheet, "id"), ("", True))[0]
        root = package.xml(part)
        if root is not None:
            _sheet(out, sheet.get("name", ""), number, root, package.links(part), strings)
    out.own_orphans()
    return out.result()


def _value(cell: ET.Element, strings: list[str]) -> str:
    raw, kind = child(cell, "v"), cell.get("t", "n")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in all_of(cell, "t"))
    text = raw.text or "" if raw is not None else ""
    if kind == "s" and text:
        return strings[int(text)]
    if kind == "b":
        return "TRUE" if text == "1" else "FALSE"
    formula = child(cell, "f")
    if not text and formula is not None and formula.text:
        return "=" + formula.text
    return text


def _sheet(out: Builder, name: str, number: int, root: ET.Element, links: dict, strings: list[str]) -> None:
    out.path = []
    out.title(name, 1, page=number)
    cells = {cell_place(c.get("r")): text for c in all_of(root, "c") if (text := _value(c, strings).strip())}
    urls = {}
    for h in all_of(root, "hyperlink"):
        target = links.get(attr(h, "id"), (None, True))[0]
        if target and target.startswith("http"):
            urls[cell_place(h.get("ref").split(":")[0])] = target
    for m in all_of(root, "mergeCell"):
        (r0, c0), (r1, c1) = (cell_place(x) for x in m.get("ref").split(":"))
        if (r0, c0) in cells:
            cells |= {(r, c): cells[r0, c0] for r in range(r0, r1 + 1) for c in range(c0, c1 + 1)}
    refs = {}
    for place, url in urls.items():
        kind = link_kind(url)
        refs[place] = (out.placeholder(kind), out.asset(kind, url, cells.get(place, "")))
        cells[place] = refs[place][0]
    for r0, r1 in runs({r for r, _ in cells}):
        for c0, c1 in runs({c for _, c in cells}):
            inside = {p: t for p, t in cells.items() if r0 <= p[0] <= r1 and c0 <= p[1] <= c1}
            if not inside:
                continue
            if r1 > r0 and c1 > c0:
                grid = [[inside.get((r, c), "") for c in range(c0, c1 + 1)] for r in range(r0, r1 + 1)]
                for i in range(1, len(grid), ROWS_PER_TABLE):
                    body = grid[i : i + ROWS_PER_TABLE]
                    first = r0 if i == 1 else r0 + i
                    own = [refs[p] for p in sorted(inside) if p in refs and (p[0] == r0 or r0 + i <= p[0] < r0 + i + len(body))]
                    where = f"{cell_name(first, c0)}:{cell_name(r0 + i + len(body) - 1, c1)}"
                    out.add("table", table_text([grid[0], *body]), own, structured_data=table_json("", grid[0], body, range=where), page=number)
            else:
                for p in sorted(inside):
                    out.add("paragraph", inside[p], [refs[p]] if p in refs else [], page=number)


# -- PowerPoint

def parse_pptx(content: bytes) -> dict:
    package, out = Package(content), Builder()
    deck = package.xml("ppt/presentation.xml")
    if deck is None:
        raise ValueError("the package has no presentation")
    links = package.links("ppt/presentation.xml")
    ids = child(deck, "sldIdLst")
    for number, slide in enumerate(ids if ids is not None else (), 1):
        # The relationship's id, not the slide's own.
        rel = next((v for k, v in slide.attrib.items() if k.endswith("}id")), None)
        part = links.get(rel, ("", True))[0]
        root = package.xml(part)
        if root is not None:
            _slide(out, number, root, package, package.links(part))
    return out.result()


def _shapes(node: ET.Element) -> list[ET.Element]:
    out = []
    for s in node:
        if local(s.tag) == "grpSp":
            out += _shapes(s)
        elif local(s.tag) in ("sp", "pic", "graphicFrame"):
            out.append(s)
    return out


def _place(shape: ET.Element) -> tuple[int, int]:
    off = next(iter(all_of(shape, "off")), None)
    return (int(off.get("y", 0)), int(off.get("x", 0))) if off is not None else (0, 0)


def _lines(shape: ET.Element, out: Builder, links: dict) -> tuple[list[tuple[int, str]], list[tuple[str, int]]]:
    """(indent, text) of the paragraphs of a shape, linked runs as placeholders."""
    lines, refs = [], []
    for p in all_of(shape, "p"):
        parts = []
        for r in p:
            text = "".join(t.text or "" for t in all_of(r, "t"))
            click = next(iter(all_of(r, "hlinkClick")), None)
            url = links.get(attr(click, "id"), ("", True))[0] if click is not None else ""
            if url.startswith("http"):
                kind = link_kind(url)
                refs.append((out.placeholder(kind), out.asset(kind, url, text)))
                text = refs[-1][0]
            parts.append("\n" if local(r.tag) == "br" else text)
        text = re.sub(r"[ \t\r\f\v]+", " ", "".join(parts)).strip()
        if text:
            props = child(p, "pPr")
            lines.append((int(props.get("lvl", 0)) if props is not None else 0, text))
    return lines, refs


def _slide(out: Builder, number: int, root: ET.Element, package: Package, links: dict) -> None:
    shapes = [s for _, _, s in sorted(((_place(s), i, s) for i, s in enumerate(_shapes(child(root, "cSld", "spTree")))), key=lambda x: x[:2])]
    kind_of = lambda s: attr(next(iter(all_of(s, "ph")), ET.Element("x")), "type") or ("body" if all_of(s, "ph") else "")
    read = {id(s): _lines(s, out, links) for s in shapes if local(s.tag) == "sp"}
    told = [s for s in shapes if read.get(id(s), ([],))[0]]
    titled = next((s for s in told if kind_of(s) in ("title", "ctrTitle")), told[0] if told else None)
    out.path = []
    if titled is not None:
        lines, refs = read[id(titled)]
        out.title(" ".join(t for _, t in lines), 1, refs=refs, page=number)
    else:
        out.title(f"Slide {number}", 1, page=number)
    for s in shapes:
        if s is titled:
            continue
        if tables := all_of(s, "tbl"):
            rows = [["\n".join(t for _, t in _lines(tc, out, links)[0]) for tc in tr if local(tc.tag) == "tc"] for tr in tables[0] if local(tr.tag) == "tr"]
            if rows:
                out.add("table", table_text(rows), structured_data=table_json("", rows[0], rows[1:]), page=number)
        elif local(s.tag) == "pic":
            video = next(iter(all_of(s, "videoFile")), None)
            blip = next(iter(all_of(s, "blip")), None)
            node, key = (video, "link") if video is not None else (blip, "embed")
            place, outside = links.get(attr(node, key), ("", True)) if node is not None else ("", True)
            if place:
                kind = ("video" if video is not None else "image") + ("_link" if outside else "")
                data = package.zip.read(place) if not outside and place in package.names else None
                mark = out.placeholder(kind)
                out.add("paragraph", mark, [(mark, out.asset(kind, place, data=data))], page=number)
        elif local(s.tag) == "sp":
            lines, refs = read[id(s)]
            if len(lines) > 1 and (any(n for n, _ in lines) or kind_of(s) == "body"):
                out.add("list", "\n".join(f"{'  ' * n}- {t}" for n, t in lines), refs, page=number)
            elif lines:
                out.add("paragraph", "\n".join(t for _, t in lines), refs, page=number)
        elif charts := all_of(s, "chart"):
            part = links.get(attr(charts[0], "id"), ("", True))[0]
            if (chart := package.xml(part)) is not None:
                _chart(out, chart, number)
        else:
            out.add("unknown", "", page=number)


def _chart(out: Builder, chart: ET.Element, number: int) -> None:
    """A chart as a table: categories, and a column for each series."""
    series = all_of(chart, "ser")
    points = lambda n: {int(p.get("idx")): "".join(v.text or "" for v in all_of(p, "v")) for p in all_of(n, "pt")} if n is not None else {}
    names = ["".join(points(child(s, "tx")).values()) or f"Series {i}" for i, s in enumerate(series, 1)]
    cats = points(child(series[0], "cat")) if series else {}
    values = [points(child(s, "val")) for s in series]
    rows = [[cats.get(i, str(i + 1)), *(v.get(i, "") for v in values)] for i in sorted({*cats, *(i for v in values for i in v)})]
    if rows:
        headers = ["", *names]
        out.add("table", table_text([headers, *rows]), structured_data=table_json("", headers, rows), page=number)


def known_suffix(name: str) -> bool:
    return suffix(name) in (".docx", ".xlsx", ".pptx")
