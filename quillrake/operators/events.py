"""Events around articles, and their JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import utrim


def events(articles: DataFrame, providers: DataFrame, collected_at: Column) -> DataFrame:
    """Articles wrapped with their provider's name and the time of collection; other columns of articles stay.

    A provider that isn't known has the name ''.
    """
    fields = ("provider_id", "id", "title", "url", "description", "image_url", "keywords", "published_at")
    names = providers.select(F.col("id").alias("qe_id"), utrim(F.col("name")).alias("qe_name"))
    j = articles.join(names, articles["provider_id"] == names["qe_id"], "left")
    other = [F.col(f"`{c}`") for c in articles.columns if c not in fields]
    return j.select(*other, "provider_id", F.coalesce("qe_name", F.lit("")).alias("provider_name"), F.struct(*fields).alias("article"), collected_at.alias("collected_at"))


def utc_text(t: Column) -> Column:
    """RFC 3339 in UTC, the fraction without its trailing zeros; NULL is the zero time of year 1."""
    second = F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss")
    fraction = F.regexp_replace(F.date_format(t, ".SSSSSS"), r"\.?0+$", "")
    return F.coalesce(F.concat(second, fraction, F.lit("Z")), F.lit("0001-01-01T00:00:00Z"))


def event_json(event_columns: str | None = None) -> Column:
    """JSON of an event row: every key is there, absent texts are '', absent keywords null, absent times the zero time."""
    at = lambda n: F.col(f"{event_columns}.{n}" if event_columns else n)
    a = lambda n: F.coalesce(at(f"article.{n}"), F.lit("")).alias(n)
    article = F.struct(a("provider_id"), a("id"), a("title"), a("url"), a("description"), a("image_url"), at("article.keywords").alias("keywords"), utc_text(at("article.published_at")).alias("published_at"))
    whole = F.struct(F.coalesce(at("provider_id"), F.lit("")).alias("provider_id"), F.coalesce(at("provider_name"), F.lit("")).alias("provider_name"), article.alias("article"), utc_text(at("collected_at")).alias("collected_at"))
    return F.to_json(whole, {"ignoreNullFields": "false"})
