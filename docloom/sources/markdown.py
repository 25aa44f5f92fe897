"""Markdown and plain text to elements and assets.

Blocks: headings, paragraphs, lists, tables; quotes are read as what they hold, fenced and
indented code and rules are left out, HTML is text. Neighbouring paragraphs are one element.
"""

from __future__ import annotations

import json
import re

from docloom.sources.model import Builder
from docloom.sources.names import is_video, text_type

_ATX = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})(.*)$")
_RULE = re.compile(r" {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
_ITEM = re.compile(r"( {0,3})([-+*]|\d{1,9}[.)])(?:([ \t]+)(.*)|[ \t]*)$")
_TABLE_RULE = re.compile(r" {0,3}\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
# Fixed value: the tag that is replaced before anything else is read.
_VIDEO_TAG = re.compile(r"<video[^>]+src=[\"']([^\"']+)[\"'][^>]*>.*?</video>", re.IGNORECASE | re.DOTALL)
_INLINE = re.compile(
    r"(?P<esc>\\[!-/:-@\[-`{-~])|(?P<code>(?P<tick>`+)(?P<inner>.+?)(?<!`)(?P=tick)(?!`))"
    r"|(?P<bang>!?)\[(?P<label>(?:[^\[\]\\]|\\.|\[[^\[\]]*\])*)\]\((?P<dest><[^<>\n]*>|[^\s()]*(?:\([^\s()]*\)[^\s()]*)*)(?:\s+(?:\"[^\"]*\"|'[^']*'|\([^()]*\)))?\s*\)"
    r"|<(?P<auto>[a-zA-Z][a-zA-Z0-9+.-]{1,31}:[^\s<>]*)>|(?P<mark>\*{1,3}|_{1,3})|(?P<brk>(?: {2,}|\\)\n)|(?P<soft>\n)",
    re.DOTALL,
)


class _Reader:
    def __init__(self):
        self.out = Builder()
        self.pending: list[str] = []
        self.refs: list[tuple[str, int]] = []
        self.videos: dict[str, str] = {}

    # -- inline

    def inline(self, text: str) -> str:
        spans: list[str] = []
        open_marks: list[tuple[str, int]] = []
        at = 0
        for m in _INLINE.finditer(text):
            spans.append(text[at : m.start()])
            at = m.end()
            if m["esc"]:
                spans.append(m["esc"][1])
            elif m["code"]:
                inner = m["inner"].replace("\n", " ")
                spans.append(inner[1:-1] if len(inner) > 2 and inner[0] == inner[-1] == " " and inner.strip() else inner)
            elif m["label"] is not None:
                spans.append(self.link(m["label"], m["dest"].strip("<>"), bool(m["bang"])))
            elif m["auto"]:
                spans.append(self.reference("web_link" if text_type(m["auto"]) == "web_link" else text_type(m["auto"]), m["auto"], m["auto"]))
            elif m["brk"]:
                spans.append("\n")
            elif m["soft"]:
                spans.append(" ")
            else:
                spans.append(self.emphasis(m, text, spans, open_marks))
        return "".join([*spans, text[at:]])

    def emphasis(self, m: re.Match, text: str, spans: list[str], open_marks: list) -> str:
        """Removes pairs of emphasis marks; a mark without its pair is text."""
        before, after, mark = text[m.start() - 1 : m.start()], text[m.end() : m.end() + 1], m["mark"]
        inside_word = mark[0] == "_" and before.isalnum() and after.isalnum()
        if inside_word:
            return mark
        for i in range(len(open_marks) - 1, -1, -1):
            if open_marks[i][0] == mark and before.strip():
                spans[open_marks[i][1]] = ""
                del open_marks[i:]
                return ""
        if after.strip():
            open_marks.append((mark, len(spans)))
        return mark

    def link(self, label: str, dest: str, embedded: bool) -> str:
        if embedded:
            kind = "video" if "video" in label.lower() or is_video(dest) else "image"
            return self.reference(kind, dest, "")
        shown = _Plain().inline(label)
        return self.reference(text_type(shown), dest, shown)

    def reference(self, kind: str, uri: str, label: str) -> str:
        mark = self.out.placeholder(kind)
        self.refs.append((mark, self.out.asset(kind, uri, label, once=False)))
        return mark

    def taken(self) -> list[tuple[str, int]]:
        refs, self.refs = self.refs, []
        return refs

    def emit(self, kind: str, text: str, refs: list[tuple[str, int]], **more) -> None:
        found = [mark for mark in self.videos if mark in text]
        refs = refs + [(mark, self.out.asset("video_link", self.videos.pop(mark), once=False)) for mark in found]
        if kind == "title":
            self.out.title(text, refs=refs, level=more["level"])
        else:
            self.out.add(kind, text, refs, **more)

    # -- blocks

    def flush(self) -> None:
        text, self.pending = "".join(self.pending).strip(), []
        if text:
            self.emit("paragraph", text, self.taken())

    def blocks(self, lines: list[str]) -> None:
        i = 0
        while i < len(lines):
            line = lines[i]
            if not line.strip():
                i += 1
            elif m := _FENCE.match(line):
                i = _after_fence(lines, i, m[1])
            elif m := _ATX.match(line):
                self.heading(m[2] or "", len(m[1]))
                i += 1
            elif _RULE.match(line):
                i += 1
            elif re.match(r" {0,3}>", line):
                j = i
                while j < len(lines) and lines[j].strip() and (re.match(r" {0,3}>", lines[j]) or not _starts_block(lines[j])):
                    j += 1
                self.blocks([re.sub(r"^ {0,3}> ?", "", x) for x in lines[i:j]])
                i = j
            elif _ITEM.match(line):
                i = self.list(lines, i)
            elif i + 1 < len(lines) and "|" in line and _TABLE_RULE.match(lines[i + 1]) and len(_cells(line)) == len(_cells(lines[i + 1])):
                i = self.table(lines, i)
            elif line.startswith(("    ", "\t")):
                while i < len(lines) and (lines[i].startswith(("    ", "\t")) or not lines[i].strip()):
                    i += 1
            else:
                i = self.paragraph(lines, i)

    def heading(self, raw: str, level: int) -> None:
        self.flush()
        if text := self.inline(raw.strip()).strip():
            self.emit("title", text, self.taken(), level=level)

    def paragraph(self, lines: list[str], i: int) -> int:
        j = i + 1
        while j < len(lines) and lines[j].strip():
            if m := re.match(r" {0,3}(=+|-+)[ \t]*$", lines[j]):
                self.heading("\n".join(x.strip() for x in lines[i:j]), 1 if m[1][0] == "=" else 2)
                return j + 1
            if _starts_block(lines[j], inside=True):
                break
            j += 1
        text = "\n".join(x.lstrip() if k else x.strip(" \t") + ("  " if x.endswith("  ") and j - i > 1 else "") for k, x in enumerate(lines[i:j]))
        self.pending += [self.inline(text), "\n"]
        return j

    def list(self, lines: list[str], i: int) -> int:
        self.flush()
        items, j = _items(lines, i)
        texts = [self.inline("\n".join(x)).strip() for x in items]
        merged = "\n".join(f"- {t}" for t in texts if t)
        if merged:
            self.emit("list", merged, self.taken())
        return j

    def table(self, lines: list[str], i: int) -> int:
        self.flush()
        headers = [self.inline(c) for c in _cells(lines[i])]
        self.taken()  # as rows alone count for a table's references
        rows, j = [], i + 2
        while j < len(lines) and lines[j].strip() and not _starts_block(lines[j], inside=True):
            rows.append([self.inline(c) for c in (_cells(lines[j]) + [""] * len(headers))[: len(headers)]])
            j += 1
        refs = self.taken()
        if rows:
            table = {"table": {"caption": "", "headers": [{"text": h} for h in headers], "rows": [{"cells": [{"text": c} for c in r]} for r in rows]}}
            self.emit("table", "\n".join(" | ".join(r) for r in [headers, *rows]), refs, structured_data=json.dumps(table, ensure_ascii=False))
        return j


class _Plain(_Reader):
    """Renders a link's text without making references of its own."""

    def reference(self, kind: str, uri: str, label: str) -> str:
        return label


def _starts_block(line: str, inside: bool = False) -> bool:
    item = _ITEM.match(line)
    if item and inside:  # only a list that begins at 1 and is not empty ends a paragraph
        item = item[4] and (not item[2][0].isdigit() or int(item[2][:-1]) == 1)
    return bool(_ATX.match(line) or _FENCE.match(line) or _RULE.match(line) or item or re.match(r" {0,3}>", line))


def _after_fence(lines: list[str], i: int, mark: str) -> int:
    i += 1
    while i < len(lines):
        closing = _FENCE.match(lines[i])
        i += 1
        if closing and closing[1][0] == mark[0] and len(closing[1]) >= len(mark) and not closing[2].strip():
            break
    return i


def _items(lines: list[str], i: int) -> tuple[list[list[str]], int]:
    """The texts of a list's items, those of lists in it among them, and the line after it."""
    items: list[list[str]] = []
    blank = False
    while i < len(lines):
        line = lines[i]
        bare = line.lstrip(" \t")
        m = _ITEM.match(bare)
        if not bare:
            blank = True
        elif m and not _RULE.match(line):
            items.append([m[4] or ""])
            blank = False
        elif f := _FENCE.match(bare):
            if blank and line == bare:
                break
            i = _after_fence([x.lstrip() for x in lines], i, f[1])
            continue
        elif line == bare and (blank or _starts_block(line)):
            break
        else:
            items[-1].append(bare)
            blank = False
        i += 1
    return items, i


def _cells(line: str) -> list[str]:
    text = line.strip()
    text = text[1:] if text.startswith("|") else text
    text = text[:-1] if text.endswith("|") and not text.endswith("\\|") else text
    return [c.replace("\\|", "|").strip() for c in re.split(r"(?<!\\)\|", text)]


def parse_markdown(content: bytes) -> dict:
    text = content.decode("utf-8").replace("\r\n", "\n").replace("\r", "\n")
    reader = _Reader()

    def video(m: re.Match) -> str:
        mark = reader.out.placeholder("video_link")
        reader.videos[mark] = m[1]
        return mark

    text = re.sub(r"\n{3,}", "\n\n", _VIDEO_TAG.sub(video, text))
    reader.blocks(text.split("\n"))
    reader.flush()
    return reader.out.result()
