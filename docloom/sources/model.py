"""What parsers give: ordered elements and linked assets, and the table functions that call them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.scalar import content_hash, sha256_id

ELEMENT = "struct<seq: int, element_type: string, text: string, heading_level: int, section_path: array<string>, parent_seq: int, language: string, structured_data: string, refs: array<struct<placeholder: string, asset: int>>, page: int>"
ASSET = "struct<asset: int, asset_type: string, original_uri: string, display_text: string, element_seq: int, data: binary>"
RESULT = f"struct<elements: array<{ELEMENT}>, assets: array<{ASSET}>, error: string>"

_ELEMENT = pa.struct([("seq", pa.int32()), ("element_type", pa.string()), ("text", pa.string()), ("heading_level", pa.int32()), ("section_path", pa.list_(pa.string())), ("parent_seq", pa.int32()), ("language", pa.string()), ("structured_data", pa.string()), ("refs", pa.list_(pa.struct([("placeholder", pa.string()), ("asset", pa.int32())]))), ("page", pa.int32())])
_ASSET = pa.struct([("asset", pa.int32()), ("asset_type", pa.string()), ("original_uri", pa.string()), ("display_text", pa.string()), ("element_seq", pa.int32()), ("data", pa.binary())])
_RESULT = pa.struct([("elements", pa.list_(_ELEMENT)), ("assets", pa.list_(_ASSET)), ("error", pa.string())])

#: Documents whose results a task holds as Python objects.
ROWS = 64

#: Placeholder names by asset type; anything else is res.
PREFIX = {"image": "image", "video": "video", "image_link": "image", "video_link": "video", "document_link": "doc", "web_link": "web"}


@dataclass
class Builder:
    """Collects a document's elements and assets in order."""

    elements: list[dict] = field(default_factory=list)
    assets: list[dict] = field(default_factory=list)
    path: list[str] = field(default_factory=list)
    counts: dict[str, int] = field(default_factory=dict)
    by_key: dict[tuple, int] = field(default_factory=dict)

    def placeholder(self, asset_type: str) -> str:
        prefix = PREFIX.get(asset_type, "res")
        self.counts[prefix] = self.counts.get(prefix, 0) + 1
        return f"{{{{{prefix}:{self.counts[prefix]}}}}}"

    def asset(self, asset_type: str, uri: str, label: str = "", data: bytes | None = None, once: bool = True) -> int:
        """The number of the asset; the same place and type is one asset."""
        key = (uri, asset_type, data)
        if once and key in self.by_key:
            return self.by_key[key]
        self.assets.append({"asset": len(self.assets) + 1, "asset_type": asset_type, "original_uri": uri, "display_text": label, "element_seq": None, "data": data})
        self.by_key[key] = len(self.assets)
        return len(self.assets)

    def title(self, text: str, level: int, **more) -> int:
        del self.path[max(level - 1, 0) :]
        self.path.append(text)
        return self.add("title", text, heading_level=level, **more)

    def add(self, element_type: str, text: str, refs: list[tuple[str, int]] = (), **more) -> int:
        seq = len(self.elements) + 1
        self.elements.append({"seq": seq, "element_type": element_type, "text": text, "section_path": list(self.path), "refs": [{"placeholder": p, "asset": n} for p, n in refs]} | more)
        for _, n in refs:
            if self.assets[n - 1]["element_seq"] is None:
                self.assets[n - 1]["element_seq"] = seq
        return seq

    def own_last(self) -> None:
        """Assets belong to the last element that refers to them, as Word documents have it, instead of the first."""
        for e in self.elements:
            for ref in e["refs"]:
                self.assets[ref["asset"] - 1]["element_seq"] = e["seq"]

    def own_orphans(self) -> None:
        """Assets that no element refers to belong to the first element, as in workbooks."""
        for a in self.assets:
            if a["element_seq"] is None and self.elements:
                a["element_seq"] = self.elements[0]["seq"]

    def result(self) -> dict:
        return {"elements": self.elements, "assets": self.assets, "error": None}


class Registry:
    """Parsers by source type, any case; the higher priority wins, of equal ones the later."""

    def __init__(self):
        self._parsers: dict[str, tuple[int, Callable[[bytes], dict]]] = {}

    def register(self, parser: Callable[[bytes], dict], *types: str, priority: int = 0) -> None:
        for t in types:
            if t.lower() not in self._parsers or self._parsers[t.lower()][0] <= priority:
                self._parsers[t.lower()] = (priority, parser)

    def unregister(self, *types: str) -> None:
        for t in types:
            self._parsers.pop(t.lower(), None)

    def get(self, source_type: str) -> Callable[[bytes], dict]:
        if source_type.lower() not in self._parsers:
            raise ValueError(f"unsupported format: {source_type}")
        return self._parsers[source_type.lower()][1]

    def supported_types(self) -> list[str]:
        return sorted(self._parsers)


def parse_column(content: Column, source_type: Column, registry: Registry) -> Column:
    """RESULT of binary contents; a document that fails has no elements and an error of up to 2000 characters."""
    parsers = {t: registry.get(t) for t in registry.supported_types()}

    @F.arrow_udf(RESULT)
    def run(content: pa.Array, source_type: pa.Array) -> pa.Array:
        done, out = [], []
        for i in range(len(content)):
            kind = (source_type[i].as_py() or "").lower()
            try:
                if kind not in parsers:
                    raise ValueError(f"unsupported format: {kind}")
                out.append(parsers[kind](content[i].as_py() or b""))
            except Exception as e:  # a document's failure is a value
                out.append({"elements": [], "assets": [], "error": f"{type(e).__name__}: {e}"[:2000]})
            if len(out) == ROWS:  # as dicts, results take many times as much
                done.append(pa.array(out, _RESULT))
                out = []
        return pa.concat_arrays([*done, pa.array(out, _RESULT)])

    return run(content.cast("binary"), source_type)


def parse_documents(docs: DataFrame, registry: Registry, content: str = "content", source_type: str = "source_type") -> DataFrame:
    """docs (without their content) with source_hash and parsed, a RESULT."""
    return docs.withColumns({"source_hash": content_hash(F.col(content)), "parsed": parse_column(F.col(content), F.col(source_type), registry)}).drop(content)


def element_rows(parsed: DataFrame) -> DataFrame:
    rows = parsed.select("doc_id", F.inline("parsed.elements"))
    return rows.withColumn("element_id", sha256_id("el", F.col("doc_id").cast("string"), F.col("seq").cast("string")))


def asset_rows(parsed: DataFrame) -> DataFrame:
    rows = parsed.select("doc_id", F.inline("parsed.assets"))
    key = lambda p, c: sha256_id(p, F.col("doc_id").cast("string"), F.col(c).cast("string"))
    return rows.withColumns({"asset_id": key("as", "asset"), "element_id": F.when(F.col("element_seq").isNotNull(), key("el", "element_seq"))})


def failures(parsed: DataFrame) -> DataFrame:
    return parsed.where("parsed.error is not null").select("doc_id", F.col("parsed.error").alias("error_message"))
