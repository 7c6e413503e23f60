"""Pages of fresh articles, fetched politely: a provider's requests share one pace and a few threads."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.articles import PAGE_BYTES
from ..operators.registry import request_headers, sanitize_providers
from ..session import workdir, written
from .sitemaps import TIMEOUT_S, http_get

#: Most threads that fetch pages of one provider at a time.
PAGE_WORKERS = 10

PAGES = "provider_id string, url string, status int, body binary, error string"


class Pace:
    """The n-th call of ``wait`` for a key returns no earlier than n times its delay after the first call was made."""

    def __init__(self, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.clock, self.sleep, self.next = clock, sleep, {}

    def wait(self, key: str, delay_s: float) -> None:
        now = self.clock()
        at = self.next.setdefault(key, now) + delay_s
        self.next[key] = max(at, now)
        if at > now:
            self.sleep(at - now)


def fetch_pages(articles: DataFrame, providers: DataFrame, get: Callable | None = None, most: int = PAGE_WORKERS, pace: Callable[[], Pace] = Pace, page_bytes: int = PAGE_BYTES) -> DataFrame:
    """(provider_id, url, status, body, error) of the distinct pages of articles.

    All pages of a provider are in one partition, so that its delay holds, and no other provider is in it. A failed
    request is a row with an error. ``get(url, headers)`` gives (status, body, error); bodies beyond ``page_bytes`` are
    cut, and only some ``4 * most`` of them are in memory at a time.
    """
    get = get or (lambda url, headers: http_get(url, headers, TIMEOUT_S, limit=page_bytes))
    p = sanitize_providers(providers).select(F.col("id").alias("provider_id"), "request_delay_ms", request_headers().alias("headers"))
    rows = articles.select("provider_id", "url").distinct().join(p, "provider_id", "left")
    rows = written(rows, f"{workdir(rows.sparkSession, 'pages')}/requests")
    names = [r.provider_id for r in rows.select("provider_id").distinct().orderBy("provider_id").collect()]  # some of the registry's
    number = F.create_map(*[F.lit(x) for k, name in enumerate(names) if name is not None for x in (name, k)]) if any(x is not None for x in names) else F.create_map(F.lit(""), F.lit(0))
    own = F.coalesce(F.try_element_at(number, F.col("provider_id")), F.lit(0))
    rows = rows.repartitionById(max(1, len(names)), own.cast("int")).sortWithinPartitions("provider_id", "url")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        slots = pace()
        with ThreadPoolExecutor(most) as pool:
            for whole in batches:
                for at in range(0, len(whole), 4 * most):
                    b = whole.iloc[at : at + 4 * most]
                    jobs = []
                    for provider, url, delay, headers in zip(b["provider_id"], b["url"], b["request_delay_ms"], b["headers"], strict=True):
                        slots.wait(provider, (500 if pd.isna(delay) else int(delay)) / 1000)
                        jobs.append(pool.submit(get, url, dict(headers or {})))
                    got = [j.result() for j in jobs]
                    bodies = [x[1] if x[1] is None else x[1][:page_bytes] for x in got]
                    yield pd.DataFrame({"provider_id": b["provider_id"], "url": b["url"], "status": pd.array([x[0] for x in got], dtype="Int32"), "body": bodies, "error": [x[2] for x in got]})

    return rows.mapInPandas(run, PAGES)
