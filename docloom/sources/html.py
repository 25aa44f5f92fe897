"""HTML to elements and assets, with the standard library's tokeniser."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser

from docloom.sources.model import Builder
from docloom.sources.names import HTTP, absolute, is_attachment, is_video, text_type

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
SKIPPED = frozenset("script style noscript template meta link".split())
BLOCKS = frozenset("article aside blockquote body dd div dl dt figcaption figure footer form header li main nav ol p pre section table ul".split())
RESOURCES = frozenset("img video source iframe embed object a".split())
HEADINGS = {f"h{i}": i for i in range(1, 7)}


class Node:
    __slots__ = ("name", "attrs", "kids")

    def __init__(self, name: str, attrs: dict[str, str]):
        self.name, self.attrs, self.kids = name, attrs, []

    def below(self) -> Iterator[Node]:
        stack = list(reversed([k for k in self.kids if isinstance(k, Node)]))
        while stack:
            node = stack.pop()
            yield node
            stack += reversed([k for k in node.kids if isinstance(k, Node)])

    def find(self, *names: str) -> Node | None:
        return next((n for n in self.below() if n.name in names), None)

    def own(self, *names: str) -> list[Node]:
        return [k for k in self.kids if isinstance(k, Node) and k.name in names]

    def strings(self, without: frozenset[str] = frozenset()) -> Iterator[str]:
        stack: list = list(reversed(self.kids))
        while stack:
            node = stack.pop()
            if isinstance(node, str):
                yield node
            elif node.name not in without:
                stack += reversed(node.kids)


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("", {})
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].kids.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.open[-1].kids.append(Node(tag, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].name == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        self.open[-1].kids.append(data)


def tree(text: str) -> Node:
    parser = _Tree()
    parser.feed(text)
    parser.close()
    stack = [parser.root]
    while stack:  # what is never read goes first
        node = stack.pop()
        node.kids = [k for k in node.kids if isinstance(k, str) or k.name not in SKIPPED]
        stack += [k for k in node.kids if isinstance(k, Node)]
    return parser.root


def flat(strings: Iterator[str]) -> str:
    return re.sub(r"\s+", " ", unescape(" ".join(x.strip() for x in strings if x.strip()))).strip()


def inner_text(node: Node) -> str:
    """Text of a tag without that of blocks in it."""
    return flat(node.strings(BLOCKS - {node.name}))


class _Reader:
    def __init__(self, base: str):
        self.out, self.base = Builder(), base

    def walk(self, node: Node) -> None:
        for kid in node.kids:
            if isinstance(kid, Node):
                self.block(kid)

    def block(self, node: Node) -> None:
        name = node.name
        if name in HEADINGS:
            if text := inner_text(node):
                self.out.title(text, HEADINGS[name])
            self.walk(node)
        elif name in ("p", "blockquote"):
            text, refs = inner_text(node), self.linked(node)
            if text or refs:
                self.out.add("paragraph", text, refs)
        elif name in ("ul", "ol"):
            self.list(node)
        elif name in ("pre", "code"):
            text = "\n".join(node.strings()).strip("\n")
            if text:
                self.out.add("code", text, language=language_of(node) or language_of(node.find("code")))
        elif name == "table":
            self.table(node)
        elif name in RESOURCES:
            if refs := self.resource(node):
                self.out.add("paragraph", flat(node.strings()) or refs[0][0], refs)
        else:
            self.walk(node)

    def list(self, node: Node) -> None:
        """A list and its items in reading order, each item before the lists inside it."""
        work: list[tuple[Node, int | None]] = [(node, None)]
        while work:
            node, parent = work.pop()
            if parent is None:
                items = node.own("li")
                if items:
                    parent = self.out.add("list", "", structured_data=json.dumps({"ordered": node.name == "ol"}))
                    work += [(item, parent) for item in reversed(items)]
                continue
            inner = node.own("ul", "ol")
            node.kids = [k for k in node.kids if k not in inner]
            text, refs = inner_text(node), self.linked(node)
            if text or refs:
                self.out.add("paragraph", text, refs, parent_seq=parent)
            work += [(n, None) for n in reversed(inner)]

    def table(self, node: Node) -> None:
        inner = [n for n in node.below() if n.name == "table"]
        _detach(node, inner)
        lines = [n for n in node.below() if n.name == "tr"]
        grid = [cells for cells in (line.own("th", "td") for line in lines) if cells]
        if grid:
            caption = " ".join(flat(c.strings()) for c in node.own("caption")[:1])
            self.out.add("table", **_table_parts(caption, grid, _header_place(node, lines, len(grid))), refs=_once(ref for row in grid for cell in row for ref in self.linked(cell)))
        for n in inner:
            self.table(n)

    def linked(self, node: Node) -> list[tuple[str, int]]:
        """References of the resources in a tag and of video URLs in its text, each asset once."""
        refs = [r for n in node.below() for r in self.resource(n)]
        return _once([*refs, *(("", self.out.asset("video_link", url)) for url in HTTP.findall(flat(node.strings())) if is_video(url))])

    def resource(self, node: Node) -> list[tuple[str, int]]:
        """The reference of a tag that stands for something elsewhere; none for other tags and links to pages."""
        place = node.attrs.get(ADDRESS.get(node.name, ""), "").strip()
        if not place:
            return []
        url = absolute(place, self.base)
        label = node.attrs.get("alt", "") if node.name == "img" else ""
        kind = asset_kind(node.name, url, label)
        return [(self.out.placeholder(kind), self.out.asset(kind, url, label))] if kind else []


#: The attribute that holds the address of what a tag stands for.
ADDRESS = dict.fromkeys(("img", "video", "source", "iframe", "embed"), "src") | {"a": "href", "object": "data"}


def asset_kind(tag: str, url: str, label: str) -> str | None:
    """Type of asset: a picture's by its text, films by their tag or frame, frames and attachments as documents."""
    if tag == "img":
        return text_type(label) if label else "image_link"
    film = {"video": True, "source": True, "iframe": is_video(url)}.get(tag, False)
    framed = tag in ("iframe", "embed", "object")
    return "video_link" if film else "document_link" if framed or is_attachment(url) else None


def _once(refs) -> list[tuple[str, int]]:
    """References without repeated assets; the first of each counts."""
    out: dict[int, tuple[str, int]] = {}
    for mark, asset in refs:
        out.setdefault(asset, (mark, asset))
    return [*out.values()]


def _header_place(node: Node, lines: list[Node], rows: int) -> int:
    """Which row holds the headers: the first line of a head, if it has one, else the first."""
    head = node.find("thead")
    first = head.find("tr") if head else None
    return min(next((i for i, line in enumerate(lines) if line is first), 0), rows - 1)


def _table_parts(caption: str, grid: list[list[Node]], at: int) -> dict:
    """Text and data of a table whose headers are in row ``at``."""
    texts = [[inner_text(cell) for cell in row] for row in grid]
    cells = [[{"text": t, "metadata": {"tag": cell.name, "rowspan": span_of(cell, "rowspan"), "colspan": span_of(cell, "colspan")}} for t, cell in zip(own, row, strict=True)] for own, row in zip(texts, grid, strict=True)]
    rest = [i for i in range(len(grid)) if i != at]
    data = {"caption": caption, "headers": [{"text": t} for t in texts[at]], "rows": [{"cells": cells[i]} for i in rest], "metadata": {"row_count": len(grid), "header_row_index": at}}
    shown = [caption, *(" | ".join(texts[i]) for i in (at, *rest))]
    return {"text": "\n".join(line for line in shown if line.strip()), "structured_data": json.dumps({"table": data}, ensure_ascii=False)}


def _detach(node: Node, gone: list[Node]) -> None:
    marks = set(map(id, gone))
    for n in [node, *node.below()]:
        n.kids = [k for k in n.kids if id(k) not in marks]


def language_of(node: Node | None) -> str | None:
    found = re.search(r"(?:^|\s)lang(?:uage)?-(\S*)", node.attrs.get("class", "")) if node else None
    return found[1] if found else None


def span_of(node: Node, name: str) -> int:
    digits = re.fullmatch(r"\s*\+?(\d+)\s*", node.attrs.get(name, ""))
    return max(1, int(digits[1])) if digits else 1


def parse_html(content: bytes, base: str = "") -> dict:
    """The main part of a page (main, body, a single article, or all) as elements; an empty page is an error."""
    text = content.decode("utf-8")
    if not text.strip():
        raise ValueError("the page is empty")
    root = tree(text)
    anchor = next((n for n in root.below() if n.name == "base" and n.attrs.get("href")), None)
    articles = root.own("article")
    top = root.find("main") or root.find("body") or (articles[0] if len(articles) == 1 else root)
    reader = _Reader(anchor.attrs["href"] if anchor else base)
    reader.walk(top)
    if not reader.out.elements:
        raise ValueError("the page has no content")
    return reader.out.result()
