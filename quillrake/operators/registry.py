"""Provider and sink registries: cleaning, validation, uniqueness, look-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import utrim
from ..session import small

DEFAULT_DELAY_MS, DEFAULT_TIMEOUT_S, DEFAULT_METHOD = 500, 5, "POST"

#: Keys of a provider's config and the request headers that they set.
HEADER_KEYS = {"user_agent": "User-Agent", "accept": "Accept", "accept_language": "Accept-Language", "cache_control": "Cache-Control"}

#: Required fields of each queue's configuration, in the order of their check.
QUEUE_FIELDS = {
    "aws-sqs": ("aws", "sqs", ("queue_url", "region", "access_key_id", "secret_access_key")),
    "aws-sns": ("sns", "sns", ("topic_arn", "region", "access_key_id", "secret_access_key")),
    "gcp": ("gcp", "gcp", ("project_id", "topic")),
}


def _clean(name: str) -> Column:
    return F.coalesce(utrim(F.col(name)), F.lit(""))


def config_string(key: str, fallback: str = "", config: str = "config") -> Column:
    """Trimmed value of a config key, the fallback where it is absent or blank."""
    return F.coalesce(F.nullif(utrim(F.try_element_at(F.col(config), F.lit(key))), F.lit("")), F.lit(fallback))


def request_headers(config: str = "config") -> Column:
    """Map of the request headers that a config sets; blank ones are left out."""
    pairs = [x for key, header in HEADER_KEYS.items() for x in (F.lit(header), config_string(key, "", config))]
    return F.map_filter(F.create_map(*pairs), lambda k, v: v != "")


def sanitize_providers(providers: DataFrame) -> DataFrame:
    """Trimmed fields, type in small letters, a config map, a positive delay."""
    empty = F.create_map().cast("map<string,string>")
    return providers.select(
        _clean("id").alias("id"), _clean("name").alias("name"), F.lower(_clean("type")).alias("type"), _clean("source_url").alias("source_url"), _clean("response_format").alias("response_format"),
        F.when(F.col("request_delay_ms") > 0, F.col("request_delay_ms")).otherwise(DEFAULT_DELAY_MS).cast("int").alias("request_delay_ms"),
        F.coalesce(F.col("config"), empty).alias("config"),
    )


def provider_error() -> Column:
    """What is wrong with a cleaned provider; NULL if nothing is."""
    out = F.when(F.col("id") == "", F.lit("id is required"))
    for f in ("name", "type", "source_url", "response_format"):
        out = out.when(F.col(f) == "", F.concat(F.lit(f"{f} is required for provider "), F.col("id")))
    return out


def repeated_ids(rows: DataFrame) -> DataFrame:
    """Ids that more than one row has: (id, rows)."""
    return rows.groupBy("id").agg(F.count("*").alias("rows")).filter("rows > 1")


def by_id(rows: DataFrame, key: str | None) -> dict | None:
    """The row of a cleaned registry with an id, which is trimmed first; None if there is none."""
    got = rows.filter(F.col("id") == utrim(F.lit(key))).limit(1).collect()
    return got[0].asDict(recursive=True) if got else None


def sanitize_sinks(sinks: DataFrame) -> DataFrame:
    """Trimmed fields, defaults for enabled, method and timeout; headers without blank names or values, NULL if none is left."""

    def fields(path: str, names: tuple[str, ...]) -> Column:
        return F.when(F.col(path).isNotNull(), F.struct(*[F.coalesce(utrim(F.col(f"{path}.{n}")), F.lit("")).alias(n) for n in names]))

    q = F.struct(
        F.lower(F.coalesce(utrim(F.col("queue.provider")), F.lit(""))).alias("provider"),
        fields("queue.aws", ("queue_url", "region", "access_key_id", "secret_access_key")).alias("aws"),
        fields("queue.sns", ("topic_arn", "region", "access_key_id", "secret_access_key")).alias("sns"),
        fields("queue.azure", ("connection_string", "queue_name")).alias("azure"),
        fields("queue.gcp", ("project_id", "topic", "credentials_file")).alias("gcp"),
    )
    pairs = F.filter(F.transform(F.map_entries(F.col("http.headers")), lambda e: F.struct(utrim(e["key"]).alias("k"), utrim(e["value"]).alias("v"))), lambda e: (e["k"] != "") & (e["v"] != ""))
    # Of names that are equal once trimmed the last one counts.
    last = F.filter(pairs, lambda e, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda later: later["k"] == e["k"]))
    h = F.struct(
        F.coalesce(utrim(F.col("http.url")), F.lit("")).alias("url"),
        F.coalesce(F.nullif(F.upper(utrim(F.col("http.method"))), F.lit("")), F.lit(DEFAULT_METHOD)).alias("method"),
        F.when(F.size(last) > 0, F.map_from_entries(last)).alias("headers"),
        F.when(F.col("http.timeout_seconds") > 0, F.col("http.timeout_seconds")).otherwise(DEFAULT_TIMEOUT_S).cast("int").alias("timeout_seconds"),
    )
    return sinks.select(
        _clean("id").alias("id"), F.lower(_clean("type")).alias("type"), F.coalesce("enabled", F.lit(True)).alias("enabled"),
        F.when(F.col("queue").isNotNull(), q).alias("queue"), F.when(F.col("http").isNotNull(), h).alias("http"),
    )


def sink_error() -> Column:
    """What is wrong with a cleaned sink, enabled or not; NULL if nothing is."""
    name = lambda text: F.concat(F.lit(f"{text} for sink "), F.col("id"))
    out = F.when(F.col("id") == "", F.lit("id is required")).when(F.col("type") == "", name("type is required"))
    queue, kind = F.col("type") == "queue", F.col("queue.provider")
    out = out.when(queue & F.col("queue").isNull(), name("queue config required"))
    for provider, (field, label, required) in QUEUE_FIELDS.items():
        out = out.when(queue & (kind == provider) & F.col(f"queue.{field}").isNull(), name(f"{label} config required"))
        for f in required:
            out = out.when(queue & (kind == provider) & (F.col(f"queue.{field}.{f}") == ""), name(f"{label}.{f} is required"))
    out = out.when(queue & (kind == "azure"), name("queue provider azure not implemented"))
    out = out.when(queue & ~kind.isin(*QUEUE_FIELDS, "azure"), F.concat(F.lit("queue provider "), kind, name(" not supported")))
    http = F.col("type") == "http"
    out = out.when(http & F.col("http").isNull(), name("http config required")).when(http & (F.col("http.url") == ""), name("http.url is required"))
    return out.when(~F.col("type").isin("queue", "http"), F.concat(F.lit("type "), F.col("type"), name(" not supported")))


def enabled_sinks(sinks: DataFrame) -> DataFrame:
    return sinks.filter(F.coalesce("enabled", F.lit(True)))


def resolve_fetchers(providers: DataFrame, fetchers: DataFrame) -> DataFrame:
    """Providers with ``fetcher`` and ``fetcher_error``: one registered for the id comes before one for the type.

    ``fetchers``: (key_kind 'id' or 'type', key, fetcher), at most one per kind and key; keys are compared in small
    letters and trimmed, blank ones ignored.
    """
    key = F.lower(utrim(F.col("key")))
    keys = fetchers.select(F.col("key_kind"), key.alias("k"), "fetcher").filter("k <> ''")
    by_id = small(keys).filter("key_kind = 'id'").select(F.col("k").alias("qi"), F.col("fetcher").alias("by_id"))
    by_type = small(keys).filter("key_kind = 'type'").select(F.col("k").alias("qt"), F.col("fetcher").alias("by_type"))
    a = providers.withColumns({"ki": F.lower(_clean("id")), "kt": F.lower(_clean("type"))})
    j = a.join(by_id, a["ki"] == F.col("qi"), "left").join(by_type, a["kt"] == F.col("qt"), "left")
    blank = F.col("ki") == ""
    chosen = F.when(~blank, F.coalesce("by_id", "by_type"))
    error = F.when(blank, "provider id is empty").when(chosen.isNull(), F.concat(F.lit("no fetcher for provider "), utrim(F.col("id"))))
    return j.select(*[F.col(f"`{c}`") for c in providers.columns], chosen.alias("fetcher"), error.alias("fetcher_error"))
