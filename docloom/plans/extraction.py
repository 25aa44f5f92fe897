"""From elements to knowledge chunks: cutting documents into sections, and answers into chunks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.scalar import content_hash, derive_title, json_in_text
from docloom.schema import DEFAULT_CATEGORY, KNOWLEDGE_TYPES

DEEPEST, STEPS, SHARE, OVERLAP = 6, 3, 0.3, 0.2
ROW = "struct<title: boolean, level: int, text: string, extra: string, vector: array<double>>"

ANSWER = "chunks ARRAY<STRUCT<title: STRING, content: STRING, knowledge_type: STRING, source_refs: ARRAY<STRUCT<element_id: STRING>>, asset_refs: ARRAY<STRUCT<asset_id: STRING, caption: STRING>>>>"


class Ranges:
    """Cuts the rows of a document into ranges [first, last) of a limited number of tokens."""

    def __init__(self, rows: list[dict], limit: int, window: int):
        self.rows, self.limit, self.window = rows, limit, window
        parts = [[x for x in (r["text"], r["extra"]) if x] for r in rows]
        self.chars = np.concatenate([[0], np.cumsum([sum(len(x) + 1 for x in p) for p in parts], dtype=np.int64)]).astype(np.int64)

    def tokens(self, a: int, b: int) -> int:
        """Tokens of the texts of a range, joined by spaces."""
        return max(1, int(max(int(self.chars[b] - self.chars[a]) - 1, 0) / 1.2))

    def titles(self, a: int, b: int, level: int) -> list[tuple[int, int]]:
        """The range cut before each of its titles of a level."""
        cuts = [i for i in range(a + 1, b) if self.rows[i]["title"] and self.rows[i]["level"] == level]
        return list(zip([a, *cuts], [*cuts, b], strict=True))

    def similar(self, a: int, b: int) -> list[tuple[int, int]]:
        """The range cut after rows that are least like the next row with a vector."""
        known = [i for i in range(a, b) if (self.rows[i]["text"] or "").strip() and self.rows[i]["vector"]]
        if len(known) < 2:
            return [(a, b)]
        m = np.array([self.rows[i]["vector"] for i in known], np.float64)
        size = np.sqrt((m * m).sum(1))
        both = size[1:] * size[:-1]
        sims = np.divide((m[1:] * m[:-1]).sum(1), both, out=np.zeros(len(both)), where=both > 0)
        edge = np.sort(sims)[int(len(sims) * SHARE)]
        cuts = [i + 1 for i, s in zip(known, sims, strict=False) if s <= edge and a < i + 1 < b]
        return list(zip([a, *cuts], [*cuts, b], strict=True))

    def packed(self, a: int, b: int) -> list[tuple[int, int]]:
        """Windows of the token budget, a fifth of the range's rows shared by neighbours."""
        keep, first, used, out = max(1, int((b - a) * OVERLAP)), a, 0, []
        for i in range(a, b):
            own = self.tokens(i, i + 1)
            if used + own > self.window and i > first:
                out.append((first, i))
                first = max(first, i - keep)
                used = self.tokens(first, min(first + keep, i + 1)) + own
            else:
                used += own
        return [*out, (first, b)]

    def all(self) -> list[tuple[int, int]]:
        n = len(self.rows)
        if not n:
            return []
        return [(0, n)] if self.tokens(0, n) <= self.limit else self.cut(0, n, 1)

    def cut(self, a: int, b: int, level: int) -> list[tuple[int, int]]:
        if self.tokens(a, b) < self.limit:
            return [(a, b)]
        found = self.titles(a, b, level)
        if len(found) > 1:
            return [x for s in found for x in self.cut(*s, level + 1)]
        for deeper in range(level + 1, min(level + STEPS, DEEPEST) + 1):
            found = self.titles(a, b, deeper)
            if len(found) > 1:
                return [x for s in found for x in self.cut(*s, deeper)]
        found = self.similar(a, b)
        if len(found) > 1:
            return [x for s in found for x in ([s] if self.tokens(*s) < self.limit else self.packed(*s))]
        return self.packed(a, b)


def section_ranges(rows: Column, limit: int, window: int) -> Column:
    """array<struct<first, last>> (from 0, both inside) of an array of ROW in document order."""

    @F.arrow_udf("array<struct<first: int, last: int>>")
    def run(rows: pa.Array) -> pa.Array:
        out = [[{"first": a, "last": b - 1} for a, b in Ranges(r.as_py() or [], limit, window).all()] for r in rows]
        return pa.array(out, pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())])))

    return run(rows)


def cut_documents(elements: DataFrame, limit: int, window: int, vector: str | None = None) -> DataFrame:
    """elements with section: those in the overlap of two windows are in both."""
    one = F.struct("seq", (F.col("element_type") == "title").alias("title"), F.col("heading_level").cast("int").alias("level"), "text", (F.col("structured_data") if "structured_data" in elements.columns else F.lit(None).cast("string")).alias("extra"), (F.col(vector).cast("array<double>") if vector else F.lit(None).cast("array<double>")).alias("vector"))
    docs = elements.groupBy("doc_id").agg(F.array_sort(F.collect_list(one)).alias("rows"))
    ranges = docs.select("doc_id", F.transform("rows", lambda r: r["seq"]).alias("seqs"), section_ranges(F.transform("rows", lambda r: r.dropFields("seq")), limit, window).alias("ranges"))
    placed = ranges.select("doc_id", "seqs", F.posexplode("ranges").alias("section", "r")).select("doc_id", "section", F.explode(F.slice("seqs", F.col("r.first") + 1, F.col("r.last") - F.col("r.first") + 1)).alias("seq"))
    return placed.join(elements, ["doc_id", "seq"])


def fallback(sections: DataFrame, assets: DataFrame, category: str = DEFAULT_CATEGORY) -> DataFrame:
    """A chunk of the texts of each section; blank sections give none. sections: doc_id, section, seq, element_id, text, asset_ids."""
    rows = sections.groupBy("doc_id", "section").agg(F.array_sort(F.collect_list(F.struct("seq", "element_id", "text", "asset_ids"))).alias("rows"))
    texts = F.filter(F.transform("rows", lambda r: r["text"]), lambda t: F.coalesce(t.rlike(r"\S"), F.lit(False)))
    rows = rows.select("doc_id", "section", F.array_join(texts, "\n").alias("content"), F.transform("rows", lambda r: r["element_id"]).alias("source_refs"), F.array_distinct(F.flatten(F.transform("rows", lambda r: F.coalesce(r["asset_ids"], F.array().cast("array<string>"))))).alias("ids")).where("content <> ''")
    return _finished(rows.withColumns({"title": derive_title(F.col("content")), "knowledge_type": F.lit("declarative"), "n": F.lit(0)}), assets, category, F.transform("ids", lambda i: F.struct(i.alias("asset_id"), F.lit(None).cast("string").alias("caption"))))


def chunks_of_answers(answers: DataFrame, sections: DataFrame, assets: DataFrame, category: str = DEFAULT_CATEGORY) -> DataFrame:
    """Chunks of a model's answers (doc_id, section, answer); sections whose answer gives none get the fallback.

    Chunks without content go; references to unknown elements or assets go, repeated ones
    stay once; without any source reference a chunk refers to the whole section; types that
    are not known are declarative.
    """
    parsed = answers.select("doc_id", "section", F.from_json(json_in_text(F.col("answer")), ANSWER).alias("a"))
    rows = parsed.select("doc_id", "section", F.posexplode("a.chunks").alias("n", "c")).select("doc_id", "section", "n", "c.*").where(F.coalesce(F.btrim("content"), F.lit("")) != "")
    known = sections.groupBy("doc_id", "section").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "element_id"))), lambda x: x["element_id"]).alias("own"))
    rows = rows.join(known, ["doc_id", "section"], "left")
    cited = F.array_intersect(F.array_distinct(F.transform(F.coalesce("source_refs", F.array().cast("array<struct<element_id:string>>")), lambda r: r["element_id"])), F.col("own"))
    kind = F.when(F.col("knowledge_type").isin(*KNOWLEDGE_TYPES), F.col("knowledge_type")).otherwise("declarative")
    rows = rows.withColumns({"source_refs": F.when(F.size(cited) > 0, cited).otherwise(F.col("own")), "title": F.coalesce(F.nullif(F.col("title"), F.lit("")), derive_title(F.col("content"))), "knowledge_type": kind})
    made = _finished(rows, assets, category, F.coalesce("asset_refs", F.array().cast("array<struct<asset_id:string,caption:string>>")))
    return made.unionByName(fallback(sections.join(made.select("doc_id", "section").distinct(), ["doc_id", "section"], "left_anti"), assets, category))


def _finished(rows: DataFrame, assets: DataFrame, category: str, wanted: Column) -> DataFrame:
    """rows as chunks; of the wanted assets those that exist, once each, with a caption."""
    label = F.coalesce(F.nullif(F.col("display_text"), F.lit("")), F.concat_ws(": ", "asset_type", "original_uri"))
    listed = rows.select("doc_id", "section", "n", F.posexplode(wanted).alias("at", "w")).select("doc_id", "section", "n", "at", F.col("w.asset_id").alias("asset_id"), F.col("w.caption").alias("caption"))
    first = listed.groupBy("doc_id", "section", "n", "asset_id").agg(F.min(F.struct("at", "caption")).alias("f"))
    found = first.join(assets.select("doc_id", "asset_id", label.alias("label")), ["doc_id", "asset_id"])
    refs = found.groupBy("doc_id", "section", "n").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col("f.at").alias("at"), "asset_id", F.coalesce(F.nullif(F.col("f.caption"), F.lit("")), F.col("label")).alias("caption")))), lambda x: x.dropFields("at")).alias("asset_refs"))
    out = rows.drop("asset_refs").join(refs, ["doc_id", "section", "n"], "left")
    none = F.array().cast("array<struct<asset_id:string,caption:string>>")
    return out.select("doc_id", "section", "n", "title", "content", content_hash(F.col("content")).alias("content_hash"), "knowledge_type", F.lit(category).alias("category"), F.lit("active").alias("status"), "source_refs", F.coalesce("asset_refs", none).alias("asset_refs"))


def section_title_path(sections: DataFrame) -> DataFrame:
    """(doc_id, section, path): the first heading path of each section that is not empty."""
    first = F.min(F.when(F.size("section_path") > 0, F.struct("seq", "section_path")))
    return sections.groupBy("doc_id", "section").agg(first.alias("f")).select("doc_id", "section", F.array_join("f.section_path", " > ").alias("path"))


def model_input(elements: DataFrame, assets: DataFrame | None = None) -> DataFrame:
    """(doc_id, input): a document's elements in order as JSON: element_id, type, text, and where they have one the heading
    level, language and the descriptions of their assets (assets: element_id, placeholder, description)."""
    rows = elements
    if assets is not None:
        told = assets.where("description is not null").groupBy("element_id").agg(F.array_sort(F.collect_list(F.struct("placeholder", "description"))).alias("assets"))
        rows = rows.join(told, "element_id", "left")
    more = [c for c in ("language", "assets") if c in rows.columns]
    one = F.struct("seq", "element_id", F.col("element_type").alias("type"), "text", "heading_level", *more)
    lists = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(one)).alias("rows"))  # the elements of one document
    return lists.select("doc_id", F.to_json(F.transform("rows", lambda r: r.dropFields("seq"))).alias("input"))


def with_links(text: Column, links: Column) -> Column:
    """Markdown text with links (array<struct<anchor, uri>>) set in, one after another: an anchor that is linked
    already stays, else its first place becomes a link, else the link is put on a line at the end. Links without
    an anchor, and places other than http(s), are passed over."""

    def one(text: Column, link: Column) -> Column:
        anchor, made = F.btrim(link["anchor"]), F.concat(F.lit("["), F.btrim(link["anchor"]), F.lit("]("), link["uri"], F.lit(")"))
        at = F.position(anchor, text)
        set_in = F.concat(F.substring(text, F.lit(1), at - 1), made, F.substring(text, at + F.length(anchor), F.length(text)))
        none = (F.coalesce(anchor, F.lit("")) == "") | ~F.coalesce(link["uri"].rlike("^https?://"), F.lit(False)) | F.contains(text, F.concat(F.lit("["), anchor, F.lit("]")))
        return F.when(F.coalesce(none, F.lit(True)), text).when(at > 0, set_in).otherwise(F.concat(text, F.lit("\n"), made))

    return F.aggregate(links, text, one)


def with_images(text: Column, images: Column) -> Column:
    """Markdown text whose pictures (![alt](place)) are shown by what is stored: images is array<struct<path, uri>>; one
    whose path is not stored is removed."""
    cut_up = F.split(text, r"(?=!\[[^\]]*\]\([^)]*\))")

    def one(part: Column) -> Column:
        path = F.regexp_extract(part, r"^!\[[^\]]*\]\(([^)]*)\)", 1)
        uri = F.get(F.filter(images, lambda i: i["path"] == path), 0)["uri"]
        alt, rest = F.regexp_extract(part, r"^!\[([^\]]*)\]", 1), F.regexp_replace(part, r"^!\[[^\]]*\]\([^)]*\)", "")
        shown = F.concat(F.lit("!["), alt, F.lit("]("), uri, F.lit(")"), rest)
        return F.when(part.startswith("![") & (path != ""), F.coalesce(shown, rest)).otherwise(part)

    return F.array_join(F.transform(cut_up, one), "")
