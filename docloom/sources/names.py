"""Suffixes and links, in Python, for parsers; the Column forms are in functions.scalar."""

from __future__ import annotations

import re
from pathlib import PurePosixPath
from urllib.parse import urljoin, urlsplit

from docloom.functions.scalar import ATTACHMENT_SUFFIXES, HTTP_URL, TEXT_IMAGE_SUFFIXES, TEXT_VIDEO_SUFFIXES, VIDEO_URL

HTTP, VIDEO = re.compile(HTTP_URL), re.compile(VIDEO_URL)


def suffix(path: str) -> str:
    return PurePosixPath(path.split("?", 1)[0]).suffix.lower()


def text_type(text: str) -> str:
    """The asset type that a link's text names."""
    s = suffix(text)
    return "image_link" if s in TEXT_IMAGE_SUFFIXES else "video_link" if s in TEXT_VIDEO_SUFFIXES else "document_link" if s in ATTACHMENT_SUFFIXES else "web_link"


def is_video(url: str) -> bool:
    return bool(VIDEO.search(url)) or suffix(url) in TEXT_VIDEO_SUFFIXES


def is_attachment(url: str) -> bool:
    return suffix(urlsplit(url).path or url) in ATTACHMENT_SUFFIXES


def absolute(url: str, base: str) -> str:
    if not url or urlsplit(url).scheme:
        return url
    return urljoin(base, url) if urlsplit(base).scheme in ("http", "https") else url
