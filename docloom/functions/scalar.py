"""Scalar functions on text, links, bytes, numbers and JSON, as Column expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Suffixes and types that results must agree on.
MIME_BY_SUFFIX = {
    ".png": "image/png", ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".gif": "image/gif", ".webp": "image/webp", ".bmp": "image/bmp", ".svg": "image/svg+xml", ".tiff": "image/tiff", ".tif": "image/tiff",
    ".mp4": "video/mp4", ".webm": "video/webm", ".mov": "video/quicktime", ".m4v": "video/mp4",
    ".mp3": "audio/mpeg", ".wav": "audio/wav", ".m4a": "audio/mp4", ".aac": "audio/aac", ".ogg": "audio/ogg", ".flac": "audio/flac",
    ".pdf": "application/pdf", ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", ".xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", ".pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation", ".zip": "application/zip",
}
ATTACHMENT_SUFFIXES = (".pdf", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx", ".zip", ".rar", ".7z", ".csv", ".txt", ".md")
TEXT_IMAGE_SUFFIXES = (".png", ".jpg", ".jpeg", ".gif", ".webp", ".bmp", ".svg", ".tiff", ".tif")
TEXT_VIDEO_SUFFIXES = (".mov", ".mp4", ".webm", ".m4v")
LINK_IMAGE_SUFFIXES = (".png", ".jpg", ".jpeg", ".gif", ".bmp", ".webp", ".svg", ".ico", ".tiff", ".tif")
LINK_VIDEO_SUFFIXES = (".mp4", ".avi", ".mov", ".wmv", ".flv", ".mkv", ".webm")
LINK_VIDEO_DOMAINS = ("youtube.com", "youtu.be", "bilibili.com", "vimeo.com")
LINK_AUDIO_SUFFIXES = (".mp3", ".wav", ".m4a", ".aac", ".ogg", ".flac")
LINK_DOCUMENT_SUFFIXES = (".pdf", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx", ".txt", ".md", ".csv")
SOURCE_TYPE_BY_SUFFIX = {".md": "markdown", ".markdown": "markdown", ".txt": "txt", ".docx": "docx", ".xlsx": "xlsx", ".html": "html", ".htm": "html", ".pdf": "pdf", ".pptx": "pptx"}
VIDEO_URL = r"(?i)https?://[^\s\])<\"']*(?:youtube\.com|youtu\.be|vimeo\.com|\.mp4|\.webm|\.mov|\.m4v)[^\s\])<\"']*"
HTTP_URL = r"(?i)https?://[^\s\])<\"']+"
PAGE_NUMBER = r"^(?:\d+|[ivxlcdmIVXLCDM]+|\d+\s*/\s*\d+|-\s*\d+\s*-|第\s*\d+\s*页?)$"
PLACEHOLDER = r"\{\{(?:image|doc|video|web|res):\d+\}\}"


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[key]


def strip(text: Column) -> Column:
    """Without white space at either end, of any Unicode kind."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def suffix(path: Column) -> Column:
    """The last suffix of a URL's or path's last component, lower case, with its dot; empty without one.

    A leading dot begins a name, a dot at the end begins nothing.
    """
    name = F.regexp_extract(F.regexp_replace(F.split_part(path, F.lit("?"), F.lit(1)), "/+$", ""), r"[^/]*$", 0)
    return F.lower(F.regexp_extract(name, r"^\.*[^.].*?(\.[^.]+)$", 1))


def normalize_text(text: Column) -> Column:
    """HTML entities decoded (named basic ones and numeric ones), white space runs as one space, trimmed; null is empty."""
    out = F.coalesce(text, F.lit(""))
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(char))
    return strip(F.regexp_replace(out, r"(?U)\s+", " "))


def normalize_lines(text: Column) -> Column:
    """Runs of blanks as one space; line ends stay."""
    return F.btrim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[ \t\r\f\x0B]+", " "))


def guess_mime(url: Column, asset_type: Column) -> Column:
    known = _lookup(MIME_BY_SUFFIX, suffix(url))
    return F.coalesce(known, F.when(asset_type.isin("image", "image_link"), "image/*").when(asset_type == "video_link", "video/*").otherwise("application/octet-stream"))


def is_video_url(url: Column) -> Column:
    return F.coalesce(url.rlike(VIDEO_URL), F.lit(False))


def extract_urls(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(HTTP_URL), F.lit(0))


def is_attachment_url(url: Column) -> Column:
    return suffix(url).isin(*ATTACHMENT_SUFFIXES)


def classify_link_text(text: Column) -> Column:
    s = suffix(text)
    return F.when(s.isin(*TEXT_IMAGE_SUFFIXES), "image_link").when(s.isin(*TEXT_VIDEO_SUFFIXES), "video_link").when(s.isin(*ATTACHMENT_SUFFIXES), "document_link").otherwise("web_link")


def _ends(text: Column, ends: Iterable[str]) -> Column:
    return text.rlike("(" + "|".join(x.replace(".", r"\.") for x in ends) + ")$")


def classify_link(url: Column) -> Column:
    """image, video (by suffix, then by domain), audio, document or url."""
    low = F.regexp_replace(F.lower(url), "/+$", "")
    path = F.regexp_replace(F.regexp_replace(F.regexp_replace(low, r"[?#].*$", ""), r"^[a-z][a-z0-9+.-]*:", ""), r"^//[^/]*", "")
    domain = low.rlike("|".join(x.replace(".", r"\.") for x in LINK_VIDEO_DOMAINS))
    return F.when(_ends(path, LINK_IMAGE_SUFFIXES), "image").when(_ends(path, LINK_VIDEO_SUFFIXES) | domain, "video").when(_ends(path, LINK_AUDIO_SUFFIXES), "audio").when(_ends(path, LINK_DOCUMENT_SUFFIXES), "document").otherwise("url")


def link_asset_type(url: Column) -> Column:
    """The asset type of a link: audio counts as video, anything unknown as web."""
    kind = classify_link(url)
    return F.when(kind == "image", "image_link").when(kind.isin("video", "audio"), "video_link").when(kind == "document", "document_link").otherwise("web_link")


def source_type(name: Column, default: str | None = "unknown") -> Column:
    return F.coalesce(_lookup(SOURCE_TYPE_BY_SUFFIX, suffix(name)), F.lit(default))


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/]*$", 0)


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]+$", "")


def derive_title(text: Column, size: int = 40) -> Column:
    """The first sentence (up to 。 and then up to ？), cut to ``size`` characters and an ellipsis."""
    first = strip(F.substring_index(F.substring_index(text, "。", 1), "？", 1))
    return truncate(first, size)


def truncate(text: Column, size: int, mark: str = "...") -> Column:
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size), F.lit(mark))).otherwise(text)


def token_estimate(chars: Column) -> Column:
    """Tokens of a text of so many characters, at least 1."""
    return F.greatest(F.lit(1), F.floor(chars / 1.2)).cast("bigint")


def strip_placeholders(text: Column) -> Column:
    return strip(F.regexp_replace(text, PLACEHOLDER, ""))


def code_language(css_class: Column) -> Column:
    return F.nullif(F.regexp_extract(css_class, r"(?:^|\s)lang(?:uage)?-([^\s]+)", 1), F.lit(""))


def is_page_number(text: Column) -> Column:
    return strip(text).rlike(PAGE_NUMBER)


def sha256_id(prefix: str, *parts: Column) -> Column:
    """A stable id: prefix and the first 16 hex digits of the hash of its natural key."""
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha2(F.concat_ws("\u0001", *parts).cast("binary"), 256), 1, 16))


def content_hash(data: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(data.cast("binary"), 256))


def sniff_image(data: Column) -> Column:
    head = F.hex(F.substring(data, 1, 12))
    return F.when(head.startswith("89504E470D0A1A0A"), "image/png").when(head.startswith("FFD8FF"), "image/jpeg").when(head.startswith("474946383761") | head.startswith("474946383961"), "image/gif").when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), "image/webp").when(head.startswith("424D"), "image/bmp")


def sniff_video(data: Column) -> Column:
    head = F.hex(F.substring(data, 1, 12))
    full = F.length(head) == 24
    return F.when(full & (F.substring(head, 9, 8) == "66747970"), F.when(F.substring(head, 17, 8) == "71742020", "video/quicktime").otherwise("video/mp4")).when(head.startswith("1A45DFA3"), "video/webm").when(full & head.startswith("52494646") & (F.substring(head, 17, 8) == "41564920"), "video/avi")


def looks_like_html(data: Column) -> Column:
    """Whether the first 200 bytes begin, after white space, with <."""
    return F.coalesce(F.hex(F.substring(data, 1, 200)).rlike("^(?:20|09|0A|0B|0C|0D)*3C"), F.lit(False))


def blob_key(hash_hex: Column, mime: Column) -> Column:
    """Place of a content-addressed blob: first two digits, then the hash with the suffix of its type."""
    by_mime = {m: s for s, m in reversed(MIME_BY_SUFFIX.items())}
    return F.concat(F.substring(hash_hex, 1, 2), F.lit("/"), hash_hex, F.coalesce(_lookup(by_mime, mime), F.lit("")))


def document_key(doc_id: Column, name: Column, asset: bool = False) -> Column:
    return F.concat(F.substring(doc_id, 1, 2), F.lit("/"), doc_id, F.lit("/asset/" if asset else "/"), name)


def parse_store_uri(uri: Column, scheme: str = "minio") -> Column:
    """struct<bucket, key, valid> of scheme://bucket/key."""
    pattern = rf"^{scheme}://([^/]+)/(.+)$"
    valid = F.coalesce(uri.rlike(pattern), F.lit(False))
    return F.struct(F.when(valid, F.regexp_extract(uri, pattern, 1)).alias("bucket"), F.when(valid, F.regexp_extract(uri, pattern, 2)).alias("key"), valid.alias("valid"))


def resolve_file_uri(uri: Column, root: str) -> Column:
    """The path of a file URI or path, percent-decoded; relative ones below root."""
    path = F.url_decode(F.replace(F.regexp_replace(uri, r"^file://(?:localhost)?", ""), F.lit("+"), F.lit("%2B")))
    return F.when(path.startswith("/"), path).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), path))


def overlap_area(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Area that two rectangles (x0, y0, x1, y1) share."""
    width = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    return width * F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))


def scale_coordinate(value: Column, size: Column, to: float = 1000.0) -> Column:
    return value * F.lit(to) / size


def total_pages(total: Column, size: int) -> Column:
    return F.ceil(total / size).cast("bigint")


def a1_column(index: Column) -> Column:
    """Spreadsheet letters of a column number from 1 (up to three letters)."""
    letter = lambda x: F.char(F.lit(65) + x)
    n = index.cast("int") - 1
    one, two = n % 26, F.floor(n / 26) - 1
    three = F.floor(two / 26) - 1
    return F.concat(F.when(three >= 0, letter(three)).otherwise(""), F.when(two >= 0, letter(two % 26)).otherwise(""), letter(one))


def a1_range(first_row: Column, first_col: Column, last_row: Column, last_col: Column) -> Column:
    return F.concat(a1_column(first_col), first_row.cast("string"), F.lit(":"), a1_column(last_col), last_row.cast("string"))


def iso_time(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ssXXX")


def json_or_empty(value: Column) -> Column:
    return F.coalesce(F.to_json(value), F.lit("[]"))


def json_in_text(text: Column) -> Column:
    """The JSON of an answer: a fenced block, else from the first { to the last }, else all of it."""
    fenced, braces = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1), F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.when(fenced != "", strip(fenced)).when(braces != "", braces).otherwise(strip(text))


def has_keys(json: Column, keys: tuple[str, ...]) -> Column:
    found = F.json_object_keys(json)
    return F.coalesce(F.size(F.array_except(F.array(*map(F.lit, keys)), found)) == 0, F.lit(False))


def byte_size(n: Column) -> Column:
    kb, mb = F.format_number(n / 1024, 1), F.format_number(n / 1048576, 1)
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1048576, F.concat(kb, F.lit(" KB"))).otherwise(F.concat(mb, F.lit(" MB")))


def count_label(n: Column) -> Column:
    return F.when(n >= 10000, F.concat(F.format_number(n / 10000, 1), F.lit(" 万"))).otherwise(n.cast("string"))


def section_path(levels: Column, titles: Column) -> Column:
    """Heading path after a list of headings: each cuts the path to fewer than its level and is appended."""
    pairs = F.arrays_zip(levels.alias("level"), titles.alias("title"))
    return F.aggregate(pairs, F.array().cast("array<string>"), lambda acc, x: F.concat(F.slice(acc, 1, F.least(F.size(acc), F.greatest(x["level"] - 1, F.lit(0)))), F.array(x["title"])))
