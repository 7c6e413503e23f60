"""Sitemap feeds as a Python data source: one partition per provider.

    spark.dataSource.register(SitemapFeeds)
    spark.read.format("sitemap_feeds").option("providers", json.dumps([{"id": ..., "source_url": ..., "headers": {}}])).load()
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .sitemaps import TIMEOUT_S, http_get, parse_sitemap


#: Type of the providers whose feeds these are, compared in small letters.
PROVIDER_TYPE = "google_news_sitemap"


class FeedError(RuntimeError):
    """A provider's feed can't be read as a whole."""


def read_feed(url: str, get: Callable[[str], tuple[int | None, bytes | str | None, str | None]]) -> Iterator[dict]:
    """Entries of a feed, nested documents in the order of their index; each document is read once.

    A failed or malformed document, or a feed without entries, raises.
    """
    seen: set[str] = set()
    found = 0

    waiting = [url]
    while waiting:
        at = waiting.pop()
        if at in seen:
            continue
        seen.add(at)
        status, body, error = get(at)
        if error or status != 200:
            raise FeedError(error or f"status {status}")
        doc = parse_sitemap(body)
        if doc["error"]:
            raise FeedError(doc["error"])
        for entry in doc["entries"]:
            found += bool((entry["loc"] or "").strip())
            yield entry
        if not doc["entries"]:
            waiting.extend(reversed(doc["nested"]))
    if not found:
        raise FeedError("sitemap returned no records")


class _Feed(InputPartition):
    def __init__(self, provider: dict):
        super().__init__(provider["id"])
        self.provider = provider


class SitemapFeeds(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sitemap_feeds"

    def schema(self) -> str:
        return "provider_id string, feed_pos int, loc string, news struct<publication_date:string,keywords:string,title:string>, image array<struct<loc:string,title:string>>"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(json.loads(self.options.get("providers", "[]")), float(self.options.get("timeout", TIMEOUT_S)))


class _Reader(DataSourceReader):
    def __init__(self, providers: list[dict], timeout: float):
        self.providers, self.timeout = providers, timeout

    def partitions(self) -> list[InputPartition]:
        return [_Feed(p) for p in self.providers]

    def read(self, partition: _Feed) -> Iterator[tuple]:
        p = partition.provider
        kind = (p.get("type") or PROVIDER_TYPE).strip()
        if kind.lower() != PROVIDER_TYPE:
            raise FeedError(f"provider {p['id']} of type {kind} isn't a sitemap feed")
        get = lambda url: http_get(url, p.get("headers"), self.timeout)
        for k, e in enumerate(read_feed(p["source_url"], get)):
            news = e["news"] and (e["news"]["publication_date"], e["news"]["keywords"], e["news"]["title"])
            yield p["id"], k, e["loc"], news, [(i["loc"], i["title"]) for i in e["image"]]
