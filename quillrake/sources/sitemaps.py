"""News sitemaps: fetching, parsing with exact namespaces, and traversal of nested indexes."""

from __future__ import annotations

import itertools
import urllib.error
import urllib.request
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import feed_snippet
from ..operators.registry import request_headers, resolve_fetchers, sanitize_providers
from ..schemas import ENTRY, RESPONSE
from ..session import workdir, written

#: Namespaces of the news and image extensions.
NEWS_NS, IMAGE_NS = "http://www.google.com/schemas/sitemap-news/0.9", "http://www.google.com/schemas/sitemap-image/1.1"

TIMEOUT_S = 15

#: Most feed documents that are fetched at a time.
FEED_WORKERS = 10
DOCUMENT = T.StructType([T.StructField("entries", T.ArrayType(ENTRY)), T.StructField("nested", T.ArrayType(T.StringType())), T.StructField("error", T.StringType())])

Fetch = Callable[[DataFrame], DataFrame]


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _all_text(e: ET.Element | None) -> str | None:
    """Character data directly in an element."""
    return None if e is None else (e.text or "") + "".join(c.tail or "" for c in e)


def parse_sitemap(body: bytes | str | None) -> dict:
    """Entries of a document and the documents that it points to; a malformed one has an error.

    Elements ``url``, ``sitemap`` and ``loc`` count in any namespace; those of news and images in their own only.
    """
    try:
        root = ET.fromstring(body if body is not None else b"")
    except (ET.ParseError, ValueError, LookupError) as e:
        return {"entries": None, "nested": None, "error": f"decode sitemap: {e}"}
    entries, nested = [], []
    for child in root:
        kind = _local(child.tag)
        if kind not in ("url", "sitemap"):
            continue
        loc = next((_all_text(x) for x in child if _local(x.tag) == "loc" and x.tag.rpartition("}")[0] not in (f"{{{NEWS_NS}", f"{{{IMAGE_NS}")), None)
        if kind == "sitemap":
            if (loc or "").strip():
                nested.append(loc.strip())
            continue
        news = child.find(f"{{{NEWS_NS}}}news")
        part = lambda n, news=news: None if news is None else _all_text(news.find(f"{{{NEWS_NS}}}{n}"))
        images = [{"loc": _all_text(i.find(f"{{{IMAGE_NS}}}loc")), "title": _all_text(i.find(f"{{{IMAGE_NS}}}title"))} for i in child.findall(f"{{{IMAGE_NS}}}image")]
        entries.append({"loc": loc, "news": None if news is None else {"publication_date": part("publication_date"), "keywords": part("keywords"), "title": part("title")}, "image": images})
    return {"entries": entries, "nested": nested, "error": None}


@F.pandas_udf(DOCUMENT)
def parse_documents(bodies: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([parse_sitemap(b) for b in bodies], columns=["entries", "nested", "error"])


def from_table(responses: DataFrame) -> Fetch:
    """Fetch of requests from a table (url, status, body): the offline transport. A URL that it lacks is an error."""
    r = responses.select(F.col("url").alias("qf_url"), F.col("status").cast("int").alias("status"), F.col("body").cast("binary").alias("body"))

    def fetch(requests: DataFrame) -> DataFrame:
        j = requests.join(r, requests["url"] == r["qf_url"], "left")
        return j.select(*[requests[c] for c in requests.columns], "status", "body", F.when(F.col("qf_url").isNull(), F.lit("connection failed")).alias("error"))

    return fetch


def over_http(timeout: float = TIMEOUT_S, opener: Callable | None = None, workers: int = FEED_WORKERS) -> Fetch:
    """Fetch by HTTP GET from the executors, with the request's ``headers`` map; transport errors become error texts.

    As many documents as ``workers`` are fetched at a time, each in a task of its own.
    """

    def fetch(requests: DataFrame) -> DataFrame:
        schema = T.StructType([*requests.schema.fields, *[f for f in RESPONSE.fields if f.name != "url"]])
        names = requests.columns

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for k in range(len(b)):  # one body in memory at a time
                    one = b.iloc[k : k + 1]
                    status, body, error = http_get(one["url"].iloc[0], one["headers"].iloc[0] if "headers" in names else None, timeout, opener)
                    yield one.assign(status=pd.array([status], dtype="Int32"), body=[body], error=[error])

        n = max(1, min(workers, requests.count()))  # the frontier of a level is a written table
        return requests.repartition(n).mapInPandas(run, schema)

    return fetch


def http_get(url: str, headers: dict | None, timeout: float = TIMEOUT_S, opener: Callable | None = None, limit: int | None = None) -> tuple[int | None, bytes | None, str | None]:
    """(status, body, error) of a GET; of a body larger than ``limit`` only so many bytes are read."""
    read = (lambda r: r.read()) if limit is None else (lambda r: r.read(limit))
    try:
        with (opener or urllib.request.urlopen)(urllib.request.Request(url, headers=dict(headers or {})), timeout=timeout) as r:
            return r.status, read(r), None
    except urllib.error.HTTPError as e:
        return e.code, read(e), None
    except Exception as e:  # noqa: BLE001  any failure of the transport is a result
        return None, None, f"{type(e).__name__}: {e}"


def traverse(providers: DataFrame, fetch: Fetch) -> tuple[DataFrame, DataFrame]:
    """Entries of all providers' sitemaps, whose indexes may be nested, and the providers' errors.

    Returns entries (provider_id, feed_path, feed_pos, loc, news, image) in bag semantics and errors (provider_id,
    error). A document with entries is a leaf, whatever else it holds. A document is read once per provider, so cycles
    end. Any failed or malformed document, and a feed without entries, makes its provider an error without entries.
    Level by level: the driver runs one job per level of nesting, however many there are.
    """
    spark, root = providers.sparkSession, workdir(providers.sparkSession, "feeds")
    p = sanitize_providers(providers)
    start = p.select(F.col("id").alias("provider_id"), F.col("source_url").alias("url"), F.lit("").alias("path"), request_headers().alias("headers"))
    bad = start.filter("url = ''").select("provider_id", F.concat(F.lit("source_url of provider "), "provider_id", F.lit(" is empty")).alias("error"))
    frontier, visited, leaves, errors = start.filter("url <> ''"), None, [], [bad]
    for level in itertools.count():
        got = fetch(frontier)
        wrong = F.when(F.col("error").isNotNull(), F.col("error")).when(F.col("status") != 200, F.concat(F.lit("status "), F.col("status"), F.lit(": "), feed_snippet(F.make_valid_utf8(F.col("body").cast("string")))))
        got = got.select("provider_id", "url", "path", "headers", wrong.alias("failed"), F.when(wrong.isNull(), F.col("body")).alias("body"))
        # An absent body is no document of its own: its parse result is ignored.
        got = written(got.select("provider_id", "url", "path", "headers", "failed", parse_documents("body").alias("d")), f"{root}/level-{level}")
        errors.append(got.filter("failed IS NOT NULL OR d.error IS NOT NULL").select("provider_id", F.coalesce("failed", "d.error").alias("error")))
        good = got.filter("failed IS NULL AND d.error IS NULL")
        leaves.append(good.select("provider_id", F.col("path").alias("feed_path"), F.posexplode("d.entries").alias("feed_pos", "e")).select("provider_id", "feed_path", "feed_pos", "e.loc", "e.news", "e.image"))
        here = got.select("provider_id", "url")
        visited = here if visited is None else visited.unionByName(here)
        links = good.filter(F.size("d.entries") == 0).select("provider_id", "headers", "path", F.posexplode("d.nested").alias("k", "url"))
        links = links.select("provider_id", "headers", "url", F.concat("path", F.lit("/"), F.lpad(F.col("k").cast("string"), 6, "0")).alias("path"))
        links = links.groupBy("provider_id", "url").agg(F.min("path").alias("path"), F.first("headers").alias("headers"))
        frontier = written(links.join(visited, ["provider_id", "url"], "left_anti").select("provider_id", "url", "path", "headers"), f"{root}/frontier-{level}")
        if frontier.isEmpty():
            break
    entries = leaves[0]
    for x in leaves[1:]:
        entries = entries.unionByName(x)
    failed = errors[0]
    for x in errors[1:]:
        failed = failed.unionByName(x)
    failed = failed.groupBy("provider_id").agg(F.array_join(F.array_sort(F.collect_set("error")), "\n").alias("error"))
    entries = entries.join(failed.select("provider_id"), "provider_id", "left_anti")
    some = entries.filter("trim(loc) <> ''").select("provider_id").distinct()
    empty = start.select("provider_id").join(failed, "provider_id", "left_anti").join(some, "provider_id", "left_anti")
    empty = empty.select("provider_id", F.concat("provider_id", F.lit(" sitemap returned no records")).alias("error"))
    return entries, failed.unionByName(empty)


#: Fetcher of each type of provider: from cleaned providers to (entries, errors).
FETCHERS: dict[str, Callable[[DataFrame, Fetch], tuple[DataFrame, DataFrame]]] = {"google_news_sitemap": traverse}


def harvest(providers: DataFrame, fetch: Fetch, by_id: dict[str, Callable] | None = None, by_type: dict[str, Callable] | None = None) -> tuple[DataFrame, DataFrame]:
    """Entries and errors of all providers, each by its fetcher: one registered for the id comes before one for the type.

    ``by_type`` is ``FETCHERS`` by default. A provider without a fetcher is an error.
    """
    spark = providers.sparkSession
    by_id, by_type = by_id or {}, FETCHERS if by_type is None else by_type
    table = {f"{kind}:{key}": (kind, key, f) for kind, of in (("id", by_id), ("type", by_type)) for key, f in of.items()}
    rows = [(kind, key, name) for name, (kind, key, _) in table.items()]
    found = written(resolve_fetchers(providers, spark.createDataFrame(rows, "key_kind string, key string, fetcher string")), f"{workdir(spark, 'providers')}/resolved")
    errors = found.filter("fetcher IS NULL").select(F.trim("id").alias("provider_id"), F.col("fetcher_error").alias("error"))
    entries = None
    for r in found.filter("fetcher IS NOT NULL").select("fetcher").distinct().collect():  # as many as fetchers
        own = found.filter(F.col("fetcher") == r.fetcher).drop("fetcher", "fetcher_error")
        e, wrong = table[r.fetcher][2](own, fetch)
        entries, errors = e if entries is None else entries.unionByName(e), errors.unionByName(wrong)
    if entries is None:
        entries = spark.createDataFrame([], T.StructType([T.StructField("provider_id", T.StringType()), T.StructField("feed_path", T.StringType()), T.StructField("feed_pos", T.IntegerType()), *ENTRY.fields]))
    return entries, errors


def xml_text(c: Column) -> Column:
    """Text with the characters escaped that XML would change or read as markup."""
    out = c
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("\r", "&#13;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def sitemap_documents(entries: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One sitemap document (body string) per value of the key columns, its entries in the order of a column."""
    tag = lambda name, c: F.coalesce(F.concat(F.lit(f"<{name}>"), xml_text(c), F.lit(f"</{name}>")), F.lit(""))
    news = F.when(F.col("news").isNull(), "").otherwise(F.concat(F.lit("<n:news>"), tag("n:publication_date", F.col("news.publication_date")), tag("n:keywords", F.col("news.keywords")), tag("n:title", F.col("news.title")), F.lit("</n:news>")))
    images = F.array_join(F.transform(F.coalesce("image", F.array().cast("array<struct<loc:string,title:string>>")), lambda i: F.concat(F.lit("<i:image>"), tag("i:loc", i["loc"]), tag("i:title", i["title"]), F.lit("</i:image>"))), "")
    url = F.concat(F.lit("<url>"), tag("loc", F.col("loc")), news, images, F.lit("</url>"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), url.alias("x")))), lambda s: s["x"]), "\n")
    head = f'<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9" xmlns:n="{NEWS_NS}" xmlns:i="{IMAGE_NS}">'
    return entries.groupBy(*keys).agg(F.concat(F.lit(head), listed, F.lit("</urlset>")).alias("body"))


def spark_rows(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """Entries of documents (body and others, which stay), with their position."""
    own = [c for c in documents.columns if c != "body"]
    return documents.select(*own, parse_documents("body").alias("d")).select(*own, F.posexplode("d.entries").alias("feed_pos", "e")).select(*own, "feed_pos", "e.loc", "e.news", "e.image")
