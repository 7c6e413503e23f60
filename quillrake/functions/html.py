"""Metadata of HTML pages and resolution of their URLs: vectorised Python, as Spark has no HTML parser."""

from __future__ import annotations

import html
import re
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import META

_TITLE_END = re.compile(r"</title\s*>?", re.IGNORECASE)


class _Reader(HTMLParser):
    """First meta element of each kind that matters, and the text of the first title element."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: dict[str, str] = {}
        self.title_at: int | None = None

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "meta":
            a = dict(reversed(attrs))  # of a repeated attribute the first counts
            for key, name in (("property", "og:title"), ("property", "og:description"), ("property", "og:image"), ("name", "description")):
                if a.get(key) == name and name not in self.found:
                    self.found[name] = (a.get("content") or "").strip()
        elif tag == "title" and "title" not in self.found:
            self.found["title"] = ""
            line, column = self.getpos()
            self.title_at = self.offsets[line - 1] + column + len(self.get_starttag_text() or "")

    def read(self, text: str) -> dict[str, str]:
        self.offsets = [0, *(m.end() for m in re.finditer("\n", text))]
        self.feed(text)
        if self.title_at is not None:  # a title holds text only, whatever it looks like
            end = _TITLE_END.search(text, self.title_at)
            self.found["title"] = html.unescape(text[self.title_at : end.start() if end else len(text)]).strip()
        return self.found


def metadata(text: str | None) -> tuple[str, str, str]:
    """(title, description, image): Open Graph first, then the title element and the plain description; '' if absent."""
    if not text:
        return "", "", ""
    got = _Reader().read(text)
    return got.get("og:title") or got.get("title", ""), got.get("og:description") or got.get("description", ""), got.get("og:image", "")


def resolved(raw: str | None, base: str | None) -> str:
    """A URL against its page's; '' if blank, itself if absolute or if one of the two can't be read."""
    if not raw:
        return ""
    try:
        return raw if urlsplit(raw).scheme else urljoin(base or "", raw)
    except ValueError:
        return raw


@F.pandas_udf(META)
def parse_meta(pages: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([metadata(p) for p in pages], columns=["title", "description", "image_url"])


@F.pandas_udf(T.StringType())
def resolve_url(raw: pd.Series, base: pd.Series) -> pd.Series:
    return pd.Series([resolved(r, b) for r, b in zip(raw, base, strict=True)])
