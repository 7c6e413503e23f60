"""Article rows from sitemap entries, and what page metadata adds to them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.html import parse_meta, resolve_url
from ..functions.text import article_id, cut_bytes, first_image, first_non_empty, keyword_list, rfc3339, utrim

#: Bytes of a page that are read for its metadata.
PAGE_BYTES = 1 << 20


def build_articles(entries: DataFrame) -> DataFrame:
    """Articles of entries (provider_id, loc, news, image and any others, which stay): entries with a blank ``loc`` are dropped.

    Absent texts are ''; absent keywords and dates NULL. An entry that is listed twice gives two rows.
    """
    loc = utrim(F.col("loc"))
    other = [c for c in entries.columns if c not in ("provider_id", "loc", "news", "image")]
    return entries.filter(loc != "").select(
        *[F.col(f"`{c}`") for c in other],
        "provider_id",
        article_id(F.col("loc")).alias("id"),
        first_non_empty(F.col("news.title")).alias("title"),
        loc.alias("url"),
        F.lit("").alias("description"),
        first_image(F.col("image")).alias("image_url"),
        keyword_list(F.col("news.keywords")).alias("keywords"),
        rfc3339(F.col("news.publication_date")).alias("published_at"),
    )


def page_metadata(pages: DataFrame) -> DataFrame:
    """(url, title, description, image_url, error) of fetched pages (url, status, body binary or string, error).

    Pages of any status but 200 and failed requests have an error and no metadata.
    """
    body = F.col("body").cast("string") if dict(pages.dtypes)["body"] == "string" else F.make_valid_utf8(F.col("body").cast("string"))
    ok = F.coalesce((F.col("status") == 200) & F.col("error").isNull(), F.lit(False))
    error = F.when(F.col("error").isNotNull(), F.col("error")).when(~ok, F.concat(F.lit("status "), F.coalesce(F.col("status").cast("string"), F.lit("none"))))
    read = pages.select("url", ok.alias("ok"), error.alias("error"), F.when(ok, cut_bytes(body, PAGE_BYTES)).alias("html"))
    read = read.select("url", "error", parse_meta("html").alias("m"))
    return read.select("url", "m.title", "m.description", "m.image_url", "error")


def enrich(articles: DataFrame, metadata: DataFrame) -> DataFrame:
    """Articles with title, description and image of their page where it has them (``metadata``: one row per url).

    Every article comes out once; one whose page is missing or failed stays as it is. Images are resolved against the
    article's URL.
    """
    m = metadata.select(F.col("url").alias("qm_url"), *[F.coalesce(F.col(c), F.lit("")).alias(f"qm_{c}") for c in ("title", "description", "image_url")])
    j = articles.join(m, articles["url"] == m["qm_url"], "left")
    image = F.when(F.coalesce(F.col("qm_image_url"), F.lit("")) != "", resolve_url("qm_image_url", "url"))
    over = {c: F.when(F.coalesce(F.col(f"qm_{c}"), F.lit("")) != "", F.col(f"qm_{c}")).otherwise(F.col(c)) for c in ("title", "description")}
    over["image_url"] = F.coalesce(image, F.col("image_url"))
    return j.select(*[over[c].alias(c) if c in over else F.col(f"`{c}`") for c in articles.columns])
