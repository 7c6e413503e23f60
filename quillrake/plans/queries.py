"""Catalogue of the core's queries and their SQL."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.html import parse_meta, resolve_url
from ..functions.text import article_id, cut_bytes, feed_snippet, first_image, keyword_list, page_snippet, rfc3339, sink_snippet, utrim
from ..operators import articles as A
from ..operators import delivery as D
from ..operators import message_store, moments, multivalue, pacing
from ..operators import registry as R
from ..operators import seen as S
from ..operators.events import event_json, events
from ..schemas import PROVIDER, SINK
from ..session import is_directory, small, workdir
from ..sources import registries
from ..sources import sitemaps as X
from ..streaming import harvest
from . import moments_sql, multivalue_sql
from .cycle import run_cycle

#: The moment at which queries read the seen table: 2025-07-01 00:00 UTC.
AS_OF, TTL = 1_751_328_000, 432_000

#: DuckDB's form of the trim that knows all white space.
_T = r"regexp_replace({0}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"
T = _T.format
#: Microseconds of an RFC 3339 text, NULL for any other.
US = lambda c: rf"CASE WHEN regexp_full_match({T(c)}, '\d{{4}}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d{{1,9}})?(Z|[+-]\d\d:\d\d)') THEN epoch_us(TRY_CAST(regexp_replace({T(c)}, '(\.\d{{6}})\d+', '\1') AS TIMESTAMPTZ)) END"


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "sitemap_entries").select(F.col("entry_id").alias("row_id"), "provider_id", "loc", "news", "image")


def article_identity(spark, sf_dir):
    e = _entries(spark, sf_dir)
    return e.filter(utrim(F.col("loc")) != "").select("row_id", utrim(F.col("loc")).alias("url"), article_id(F.col("loc")).alias("id"))


def blank_loc_filter(spark, sf_dir):
    e = _entries(spark, sf_dir)
    return e.groupBy("provider_id").agg(F.count_if(F.coalesce(utrim(F.col("loc")), F.lit("")) == "").alias("blank"), F.count_if(utrim(F.col("loc")) != "").alias("kept"))


def build_articles(spark, sf_dir):
    a = A.build_articles(_entries(spark, sf_dir))
    return a.select("row_id", "provider_id", "id", "title", "url", "description", "image_url", F.array_join("keywords", "|").alias("keywords"), F.unix_micros("published_at").alias("published_us"))


def keywords_parse(spark, sf_dir):
    k = keyword_list(F.col("news.keywords"))
    return _entries(spark, sf_dir).select("row_id", F.coalesce(F.size(k), F.lit(0)).cast("bigint").alias("n"), F.array_join(k, "|").alias("joined"))


def first_image_of_entry(spark, sf_dir):
    return _entries(spark, sf_dir).select("row_id", first_image(F.col("image")).alias("image_url"))


def pubdate_parse(spark, sf_dir):
    return _read(spark, sf_dir, "articles").select("row_id", F.unix_micros(rfc3339(F.col("published_at"))).alias("us"))


def sitemap_roundtrip(spark, sf_dir):
    """Entries written as sitemap documents of bounded length and read back from them."""
    e = _entries(spark, sf_dir).withColumn("chunk", F.floor(F.col("row_id") / 500))
    rows = X.spark_rows(spark, X.sitemap_documents(e, ["provider_id", "chunk"], "row_id"))
    return A.build_articles(rows.drop("chunk")).select("provider_id", "id", "title", "url", "image_url", F.array_join("keywords", "|").alias("keywords"), F.unix_micros("published_at").alias("published_us"))


def index_traversal(spark, sf_dir):
    """Regions and nations as a tree of sitemap indexes that also points back to its root."""
    base = "https://feeds.example"
    region, nation = _read(spark, sf_dir, "region"), _read(spark, sf_dir, "nation")
    page = lambda body, tag: F.concat(F.lit(f'<{tag} xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'), body, F.lit(f"</{tag}>"))
    link = lambda kind, c: F.concat(F.lit(f"<sitemap><loc>{base}/{kind}/"), c.cast("string"), F.lit("</loc></sitemap>"))
    root = region.agg(page(F.array_join(F.collect_list(link("region", F.col("r_regionkey"))), ""), "sitemapindex").alias("body")).select(F.lit(f"{base}/root").alias("url"), "body")
    back = F.lit(f"<sitemap><loc> </loc></sitemap><sitemap><loc>{base}/root</loc></sitemap>")
    mid = nation.groupBy("n_regionkey").agg(page(F.concat(F.array_join(F.collect_list(link("nation", F.col("n_nationkey"))), ""), back), "sitemapindex").alias("body"))
    mid = mid.select(F.concat(F.lit(f"{base}/region/"), F.col("n_regionkey").cast("string")).alias("url"), "body")
    leaf = nation.select(F.concat(F.lit(f"{base}/nation/"), F.col("n_nationkey").cast("string")).alias("url"), page(F.concat(F.lit(f"<url><loc>{base}/story/"), F.replace("n_name", F.lit(" "), F.lit("-")), F.lit("</loc></url>")), "urlset").alias("body"))
    responses = root.unionByName(mid).unionByName(leaf).select("url", F.lit(200).alias("status"), "body")
    provider = spark.createDataFrame([("tree", "Tree", "google_news_sitemap", f"{base}/root", "xml", 0, {})], PROVIDER)
    return X.traverse(provider, X.from_table(responses))[0].select("provider_id", "loc")


def _html(spark, sf_dir):
    """Pages made of documents: which metadata they have depends on the document's number."""
    d = _read(spark, sf_dir, "documents")
    esc = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    text, k = F.coalesce("text", F.lit("")), F.col("doc_id") % 4
    meta = lambda key, name, c: F.concat(F.lit(f'<meta {key}="{name}" content="'), c, F.lit('">'))
    head = F.concat(
        F.when(k == 0, meta("property", "og:title", F.concat(F.lit(" open "), F.col("source")))).when(k == 1, meta("property", "og:title", F.lit("  "))).otherwise(""),
        F.lit("<title> page &amp; "), F.col("source"), F.lit("</title>"),
        F.when(k <= 1, meta("property", "og:description", esc(text))).otherwise(""),
        F.when(k <= 2, meta("name", "description", F.concat(F.lit("of "), F.col("source")))).otherwise(""),
        F.when(k == 0, meta("property", "og:image", F.lit("/pic.jpg"))).otherwise(""),
    )
    return d.select("doc_id", "article_id", F.concat(F.lit("<html><head>"), head, F.lit("</head><body>"), esc(text), F.lit("</body></html>")).alias("html"))


def meta_precedence(spark, sf_dir):
    return _html(spark, sf_dir).select("doc_id", parse_meta("html").alias("m")).select("doc_id", "m.title", "m.description", "m.image_url")


def url_resolve(spark, sf_dir):
    a = _read(spark, sf_dir, "articles").filter(utrim(F.col("url")) != "")
    k = F.col("row_id") % 5
    raw = F.when(k == 0, "/img/a.jpg").when(k == 1, "").when(k == 2, "https://cdn.example/x.png").when(k == 3, "//cdn.example/y.png").otherwise("b.jpg?w=1")
    return a.select("row_id", utrim(F.col("url")).alias("base"), raw.alias("raw")).select("row_id", resolve_url("raw", "base").alias("resolved"))


def body_truncate(spark, sf_dir):
    d = _read(spark, sf_dir, "documents").filter("text IS NOT NULL")
    return d.select("doc_id", cut_bytes(F.col("text"), 1000).alias("head"))


def snippets(spark, sf_dir):
    d = _read(spark, sf_dir, "documents").filter("text IS NOT NULL")
    return d.select("doc_id", feed_snippet(F.col("text")).alias("feed"), page_snippet(F.col("text")).alias("page"), sink_snippet(F.col("text")).alias("sink"))


def enrich_override(spark, sf_dir):
    """Articles with the metadata of the first of their documents' pages."""
    pages = _html(spark, sf_dir).filter("article_id IS NOT NULL").groupBy("article_id").agg(F.min_by("html", "doc_id").alias("body"))
    a = _read(spark, sf_dir, "articles").select("row_id", "id", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("description", F.lit("")).alias("description"), F.coalesce("image_url", F.lit("")).alias("image_url"))
    # The article's key stands for its URL; its image is resolved against it.
    metadata = A.page_metadata(pages.select(F.concat(F.lit("https://a.example/"), "article_id").alias("url"), F.lit(200).alias("status"), "body", F.lit(None).cast("string").alias("error")))
    return A.enrich(a.withColumn("url", F.concat(F.lit("https://a.example/"), F.col("id"))), metadata).select("row_id", "title", "description", "image_url")


def dedupe_fresh(spark, sf_dir):
    a = _read(spark, sf_dir, "articles").select("row_id", "id")
    return S.fresh(a, _read(spark, sf_dir, "seen_articles"), AS_OF)


def dedupe_keeps_batch_dups(spark, sf_dir):
    a = A.build_articles(_entries(spark, sf_dir)).select("id")
    return S.fresh(a, _read(spark, sf_dir, "seen_articles"), AS_OF).groupBy("id").agg(F.count("*").alias("rows"))


def seen_upsert(spark, sf_dir):
    return _read(spark, sf_dir, "seen_articles").groupBy("article_id").agg(F.max("expires_at").alias("expires_at"))


def seen_sweep(spark, sf_dir):
    return S.alive(_read(spark, sf_dir, "seen_articles"), AS_OF)


def provider_sanitize(spark, sf_dir):
    return R.sanitize_providers(_read(spark, sf_dir, "providers")).drop("config")


def _broken_providers(spark, sf_dir):
    p = R.sanitize_providers(_read(spark, sf_dir, "providers"))
    k = F.length("id") % 4
    return p.withColumns({"name": F.when(k == 1, "").otherwise(F.col("name")), "source_url": F.when(k == 2, "").otherwise(F.col("source_url")), "response_format": F.when(k == 3, "").otherwise(F.col("response_format"))})


def provider_validate(spark, sf_dir):
    p = _broken_providers(spark, sf_dir)
    return p.select("id", R.provider_error().alias("error"))


def headers_build(spark, sf_dir):
    return _read(spark, sf_dir, "providers").select("id", F.explode(R.request_headers()).alias("header", "value"))


def config_strings(spark, sf_dir):
    return _read(spark, sf_dir, "providers").select("id", R.config_string("timezone", "UTC").alias("timezone"), R.config_string("user_agent", "none").alias("user_agent"))


def fetcher_resolve(spark, sf_dir):
    f = spark.createDataFrame([("type", " Google_News_Sitemap ", "sitemap"), ("id", "KOTAL-post", "special"), ("id", " ", "never")], "key_kind string, key string, fetcher string")
    return R.resolve_fetchers(_read(spark, sf_dir, "providers"), f).select("id", "fetcher", "fetcher_error")


def _sinks(spark) -> DataFrame:
    sqs = {"queue_url": " https://queue.example/1 ", "region": "r1", "access_key_id": "k", "secret_access_key": "s"}
    rows = [
        (" hook ", "HTTP", True, None, {"url": " https://hook.example/in ", "method": "", "headers": {" X-A ": " 1 ", "X-B": " "}, "timeout_seconds": 0}),
        ("jobs", "queue", None, {"provider": " AWS-SQS", "aws": sqs}, None),
        ("topic", "queue", True, {"provider": "aws-sns", "sns": {"topic_arn": "arn:1", "region": "r1", "access_key_id": "k", "secret_access_key": "s"}}, None),
        ("off", "http", False, None, {"url": "https://off.example", "method": "put", "headers": {}, "timeout_seconds": 9}),
        ("nohttp", "http", True, None, None),
        ("nourl", "http", False, None, {"url": " ", "method": None, "headers": None, "timeout_seconds": None}),
        ("azure", "queue", True, {"provider": "azure"}, None),
        ("other", "queue", True, {"provider": "rabbit"}, None),
        ("nosecret", "queue", True, {"provider": "aws-sqs", "aws": {**sqs, "secret_access_key": " "}}, None),
        ("nogcp", "queue", True, {"provider": "gcp"}, None),
        ("odd", "ftp", True, None, None),
        (" ", "http", True, None, {"url": "https://x.example", "method": None, "headers": None, "timeout_seconds": None}),
    ]
    return spark.createDataFrame(rows, SINK)


def sink_validate(spark, sf_dir):
    return R.sanitize_sinks(_sinks(spark)).select("id", "type", "enabled", F.col("http.method").alias("method"), F.col("http.timeout_seconds").alias("timeout_seconds"), F.to_json("http.headers").alias("headers"), R.sink_error().alias("error"))


def sink_enabled(spark, sf_dir):
    return R.enabled_sinks(R.sanitize_sinks(_sinks(spark))).select("id", "type")


def _good_sinks(spark) -> list[dict]:
    good = R.sanitize_sinks(_sinks(spark)).filter(R.sink_error().isNull())
    return D.sink_rows(good)


def _fail():
    """Hook and topic refuse some articles by the first letter of their id, jobs none that hook takes."""
    first = F.substring("article_id", 1, 1)
    return (
        F.when((F.col("sink_id") == "hook") & first.isin("0", "1", "2", "3"), F.concat(F.lit("refused "), first))
        .when((F.col("sink_id") == "jobs") & first.isin("0", "8"), "queue full")
        .when((F.col("sink_id") == "topic") & first.isin("0", "1", "8", "9", "a"), "no topic")
    )


def _events(spark, sf_dir):
    h = _read(spark, sf_dir, "harvest_events")
    a = h.select(F.col("delivery_id").alias("row_id"), F.col("article").alias("x"), rfc3339(F.col("collected_at")).alias("c"))
    a = a.select("row_id", "c", "x.provider_id", "x.id", "x.title", "x.url", "x.description", "x.image_url", "x.keywords", rfc3339(F.col("x.published_at")).alias("published_at"))
    return events(a, _read(spark, sf_dir, "providers"), F.col("c")).drop("c")


def fanout_pairs(spark, sf_dir):
    return D.fan_out(_events(spark, sf_dir).select("row_id"), _good_sinks(spark)).select("row_id", F.col("sink_pos").cast("bigint").alias("sink_pos"), "sink_id", "sink_type")


def delivery_outcome(spark, sf_dir):
    return D.outcomes(D.by_rule(_events(spark, sf_dir), _good_sinks(spark), _fail())).select("row_id", "article_id", "successes", "errors")


def delivery_marks(spark, sf_dir):
    return S.marks(D.by_rule(_events(spark, sf_dir), _good_sinks(spark), _fail()), AS_OF, TTL)


def event_rows_json(spark, sf_dir):
    return _events(spark, sf_dir).select("row_id", event_json().alias("body"))


def crawl_summary(spark, sf_dir):
    """One cycle over all entries: what each provider fetched, found fresh and published."""
    e, p = _entries(spark, sf_dir), _read(spark, sf_dir, "providers")
    done = run_cycle(e, p, _read(spark, sf_dir, "seen_articles"), _good_sinks(spark), lambda ev, sinks: D.by_rule(ev, sinks, _fail()), AS_OF, TTL)
    return done.summary


def error_rollup(spark, sf_dir):
    """Distinct errors of each provider's deliveries with their numbers."""
    d = D.by_rule(_events(spark, sf_dir), _good_sinks(spark), _fail())
    return d.filter("NOT ok").groupBy("provider_id", "sink_id", "error").agg(F.count("*").alias("failures"))


def rate_slots(spark, sf_dir):
    e = _entries(spark, sf_dir).filter(utrim(F.col("loc")) != "")
    p = R.sanitize_providers(_read(spark, sf_dir, "providers")).select(F.col("id").alias("provider_id"), "request_delay_ms")
    s = pacing.slots(e.select("row_id", "provider_id").join(small(p), "provider_id"), "provider_id", "row_id", F.col("request_delay_ms"))
    return s.select("row_id", "provider_id", "not_before_ms")


def worker_cap(spark, sf_dir):
    return pacing.workers(_entries(spark, sf_dir).filter(utrim(F.col("loc")) != ""), "provider_id")


def stream_cycle(spark, sf_dir):
    """All entries as a stream of one batch; the marks that it leaves in the seen table."""
    root = workdir(spark, "stream")
    store = S.open_seen(spark, "parquet", f"{root}/seen")
    store.write(_read(spark, sf_dir, "seen_articles"), 0)
    table = _read(spark, sf_dir, "sitemap_entries")
    path, reader = f"{sf_dir}/sitemap_entries.parquet", spark.readStream.schema(table.schema)
    rows = reader.parquet(path) if is_directory(spark, path) else reader.option("pathGlobFilter", "sitemap_entries.parquet").parquet(sf_dir)
    rows = rows.select(F.col("entry_id").alias("row_id"), "provider_id", "loc", "news", "image")
    found: list[DataFrame] = []
    query = harvest.start(rows, _read(spark, sf_dir, "providers"), store, _good_sinks(spark), lambda ev, sinks: D.by_rule(ev, sinks, _fail()), f"{root}/checkpoint", lambda: AS_OF, TTL, None, lambda done, n: found.append(done.events))
    query.awaitTermination()
    out = None
    for e in found:
        out = e if out is None else out.unionByName(e)
    if out is None:
        return spark.createDataFrame([], "id string, published bigint")
    return out.groupBy(F.col("article.id").alias("id")).agg(F.count("*").alias("published"))


def registry_load(spark, sf_dir):
    """The providers written as a registry document and loaded from it."""
    rows = [r.asDict(recursive=True) for r in _read(spark, sf_dir, "providers").collect()]  # a registry is read by the driver
    return registries.read_providers(spark, json.dumps({"providers": rows}, ensure_ascii=False)).drop("config")


def sink_registry(spark, sf_dir):
    """Nations as sinks of a registry with variables: webhooks, of which every third is off and others say nothing of it."""
    rows = []
    for r in _read(spark, sf_dir, "nation").collect():
        k = r.n_nationkey
        http = {"url": f" https://${{HOOK_HOST}}/{k} ", "method": ["", "put", None][k % 3], "timeout_seconds": k - 5, "headers": {" X-Key ": f"$HOOK_KEY{k % 2} ", "X-None": " $NO_SUCH "}}
        rows.append({"id": f" {r.n_name} ", "type": "HTTP", "http": http} | ({"enabled": False} if k % 3 == 0 else {}))
    s = registries.read_sinks(spark, json.dumps(rows), ".json", {"HOOK_HOST": "hook.example", "HOOK_KEY1": "one"})
    h = F.col("http")
    return s.select("id", "type", "enabled", h["url"].alias("url"), h["method"].alias("method"), h["timeout_seconds"].cast("bigint").alias("timeout_seconds"), F.to_json(h["headers"]).alias("headers"))


def _supplier_sinks(spark, sf_dir) -> DataFrame:
    """Suppliers as sinks that lack one thing or another, by their key."""
    k, name = F.col("s_suppkey") % 9, F.col("s_name")
    url = F.when(k == 1, " ").otherwise(F.concat(F.lit("https://"), F.lower(F.replace(name, F.lit("#"), F.lit("-")))))
    http = F.struct(url.alias("url"), F.lit("post").alias("method"), F.lit(None).cast("map<string,string>").alias("headers"), F.lit(None).cast("int").alias("timeout_seconds"))
    keys = lambda *names: F.struct(*[F.when((k == 4) & (F.lit(n) == "region"), " ").otherwise("v").alias(n) for n in names])
    none = lambda t: F.lit(None).cast(t)
    t = {f.name: f.dataType for f in SINK["queue"].dataType.fields}
    kind = F.when(k == 3, " AWS-SQS").when(k == 4, "aws-sns").when(k == 5, "azure").when(k == 6, "rabbit").otherwise("gcp")
    queue = F.struct(kind.alias("provider"), F.when(k == 3, keys("queue_url", "region", "access_key_id", "secret_access_key")).alias("aws"), F.when(k == 4, keys("topic_arn", "region", "access_key_id", "secret_access_key")).alias("sns"), none(t["azure"]).alias("azure"), none(t["gcp"]).alias("gcp"))
    s = _read(spark, sf_dir, "supplier").select(
        F.when(k == 8, " ").otherwise(name).alias("id"), F.when(k <= 2, " Http").when(k <= 7, "queue").otherwise("ftp").alias("type"), F.when(F.col("s_nationkey") % 3 == 0, False).when(F.col("s_nationkey") % 3 == 1, True).alias("enabled"),
        F.when(k >= 3, queue).alias("queue"), F.when(k <= 1, http).alias("http"),
    )
    return R.sanitize_sinks(s)


def sink_table_validate(spark, sf_dir):
    return _supplier_sinks(spark, sf_dir).select("id", "type", "enabled", R.sink_error().alias("error"))


def sink_table_enabled(spark, sf_dir):
    return R.enabled_sinks(_supplier_sinks(spark, sf_dir)).groupBy("type").agg(F.count("*").alias("sinks"))


def repeated_ids(spark, sf_dir):
    return R.repeated_ids(_read(spark, sf_dir, "articles").select("id").filter("id IS NOT NULL"))


def seen_store(spark, sf_dir):
    """Marks written in two batches, one of them twice, swept and read again."""
    store, rows = S.open_seen(spark, "parquet", workdir(spark, "seen-store"), 1), _read(spark, sf_dir, "seen_articles")
    odd = F.pmod("expires_at", F.lit(2)) == 1
    for batch, part in ((0, odd), (1, F.lit(True)), (1, ~odd)):  # a batch that is run again takes the place of its first run
        store.write(rows.filter(part), batch)
    store.swept_at = 0
    store.sweep(AS_OF)
    return store.read()


def deliver_transport(spark, sf_dir):
    """Every event handed to a transport for every sink, with its outcome or error."""
    refusals = {"hook": ("0123", "refused "), "jobs": ("08", "queue full"), "topic": ("0189a", "no topic")}

    def send(body: str, provider: str, sink: dict) -> str | None:
        first = json.loads(body)["article"]["id"][:1]
        letters, text = refusals[sink["id"]]
        if first not in letters:
            return None
        if sink["id"] == "topic":
            raise RuntimeError(text)  # an exception is an error of its attempt
        return text + first if sink["id"] == "hook" else text

    done = D.deliver(_events(spark, sf_dir), _good_sinks(spark), send)
    return done.select("row_id", "article_id", "sink_id", "ok", "error")


def p2_check(spark, sf_dir):
    """What must hold of the store: every delivery is kept or dropped, once."""
    store = message_store.replay(spark, sf_dir)
    kept, lost = store.messages(), store.dropped()
    both = (kept.select("delivery_id") if kept is not None else lost.select("delivery_id").limit(0)).unionByName(lost.select("delivery_id"))
    return both.agg(F.count("*").alias("deliveries"), F.count_distinct("delivery_id").alias("ids"))


def p6_check(spark, sf_dir):
    """Of the texts of each table: how many, how many hold no value, and characters of values that aren't in their text."""
    texts = multivalue.packed_texts(spark, sf_dir)
    done = multivalue.Splitter(texts).split(texts, "text")
    lost = F.size(F.filter("vals", lambda v: ~F.contains(F.col("text"), v) & ~v.contains('"')))
    return done.groupBy("tab").agg(F.count("*").alias("texts"), F.count_if((F.size("vals") == 0) & (utrim(F.col("text")) != "") & F.col("text").rlike(r"[\p{L}\p{N}]")).alias("lost_texts"), F.coalesce(F.sum(lost), F.lit(0)).alias("strange_values"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p2_found": message_store.p2_found,
    "p2_messages": message_store.p2_messages,
    "p5_found": moments.p5_found,
    "p5_status": moments.p5_status,
    "p6_found": multivalue.p6_found,
    "article_identity": article_identity,
    "blank_loc_filter": blank_loc_filter,
    "build_articles": build_articles,
    "keywords_parse": keywords_parse,
    "first_image": first_image_of_entry,
    "pubdate_parse": pubdate_parse,
    "sitemap_roundtrip": sitemap_roundtrip,
    "index_traversal": index_traversal,
    "meta_precedence": meta_precedence,
    "url_resolve": url_resolve,
    "body_truncate": body_truncate,
    "snippets": snippets,
    "enrich_override": enrich_override,
    "dedupe_fresh": dedupe_fresh,
    "dedupe_keeps_batch_dups": dedupe_keeps_batch_dups,
    "seen_upsert": seen_upsert,
    "seen_sweep": seen_sweep,
    "provider_sanitize": provider_sanitize,
    "provider_validate": provider_validate,
    "headers_build": headers_build,
    "config_strings": config_strings,
    "fetcher_resolve": fetcher_resolve,
    "sink_enabled": sink_enabled,
    "sink_validate": sink_validate,
    "fanout_pairs": fanout_pairs,
    "delivery_outcome": delivery_outcome,
    "delivery_marks": delivery_marks,
    "event_json": event_rows_json,
    "crawl_summary": crawl_summary,
    "error_rollup": error_rollup,
    "rate_slots": rate_slots,
    "worker_cap": worker_cap,
    "stream_cycle": stream_cycle,
    "registry_load": registry_load,
    "sink_registry": sink_registry,
    "sink_table_validate": sink_table_validate,
    "sink_table_enabled": sink_table_enabled,
    "repeated_ids": repeated_ids,
    "seen_store": seen_store,
    "deliver_transport": deliver_transport,
    "p2_check": p2_check,
    "p6_check": p6_check,
}

_KW = lambda c: f"list_filter(list_transform(string_split({c}, ','), lambda x: {T('x')}), lambda x: x <> '')"
_IMG = f"coalesce(list_filter(list_transform(image, lambda x: {T('x.loc')}), lambda x: x <> '')[1], '')"
_SEEN = f"(SELECT article_id FROM seen_articles WHERE expires_at > {AS_OF})"
_ARTICLES = f"""SELECT entry_id AS row_id, provider_id, sha1({T("loc")}) AS id, coalesce({T("news.title")}, '') AS title, {T("loc")} AS url,
  '' AS description, {_IMG} AS image_url, nullif(list_aggregate({_KW("news.keywords")}, 'string_agg', '|'), '') AS keywords, {US("news.publication_date")} AS published_us
  FROM sitemap_entries WHERE {T("loc")} <> ''"""
_PAGE = f"""SELECT doc_id, article_id, CASE WHEN doc_id % 4 = 0 THEN 'open ' || source ELSE 'page & ' || source END AS title,
  CASE WHEN doc_id % 4 <= 1 AND {T("coalesce(text, '')")} <> '' THEN {T("text")} WHEN doc_id % 4 <= 2 THEN 'of ' || source ELSE '' END AS description,
  CASE WHEN doc_id % 4 = 0 THEN '/pic.jpg' ELSE '' END AS image_url FROM documents"""
_EVENTS = "SELECT delivery_id AS row_id, provider_id, article.id AS article_id, substr(article.id, 1, 1) AS f FROM harvest_events"
_GOOD = "(VALUES (0, 'hook', 'http'), (1, 'jobs', 'queue'), (2, 'topic', 'queue')) s(sink_pos, sink_id, sink_type)"
_TRIED = f"""SELECT e.*, s.*, CASE WHEN sink_id = 'hook' AND f IN ('0','1','2','3') THEN 'refused ' || f
  WHEN sink_id = 'jobs' AND f IN ('0','8') THEN 'queue full' WHEN sink_id = 'topic' AND f IN ('0','1','8','9','a') THEN 'no topic' END AS error FROM ({{0}}) e, {_GOOD}"""
_DELIVERED = _TRIED.format(_EVENTS)
_CLEAN = f"SELECT coalesce({T('id')}, '') AS id, coalesce({T('name')}, '') AS name, lower(coalesce({T('type')}, '')) AS type, coalesce({T('source_url')}, '') AS source_url, coalesce({T('response_format')}, '') AS response_format, CASE WHEN request_delay_ms > 0 THEN request_delay_ms ELSE 500 END::INT AS request_delay_ms FROM providers"
_TEXT = lambda us: f"CASE WHEN {us} IS NULL THEN '0001-01-01T00:00:00Z' ELSE strftime(make_timestamp({us}), '%Y-%m-%dT%H:%M:%S') || regexp_replace(strftime(make_timestamp({us}), '.%f'), '\\.?0+$', '') || 'Z' END"
_SINK_ROWS = """(VALUES ('hook','http',true,'POST',5,'{"X-A":"1"}',NULL), ('jobs','queue',true,NULL,NULL,NULL,NULL), ('topic','queue',true,NULL,NULL,NULL,NULL), ('off','http',false,'PUT',9,NULL,NULL),
  ('nohttp','http',true,NULL,NULL,NULL,'http config required for sink nohttp'), ('nourl','http',false,'POST',5,NULL,'http.url is required for sink nourl'),
  ('azure','queue',true,NULL,NULL,NULL,'queue provider azure not implemented for sink azure'), ('other','queue',true,NULL,NULL,NULL,'queue provider rabbit not supported for sink other'),
  ('nosecret','queue',true,NULL,NULL,NULL,'sqs.secret_access_key is required for sink nosecret'), ('nogcp','queue',true,NULL,NULL,NULL,'gcp config required for sink nogcp'),
  ('odd','ftp',true,NULL,NULL,NULL,'type ftp not supported for sink odd'), ('','http',true,'POST',5,NULL,'id is required')) t(id, type, enabled, method, timeout_seconds, headers, error)"""

_HEAD = lambda x, n: f"CASE WHEN strlen({x}) <= {n} THEN {x} ELSE substring({x}, 1, list_max(list_filter(range({n} + 1), lambda k: strlen(substring({x}, 1, k)) <= {n}))) END"
_SUPPLIERS = """SELECT CASE WHEN k = 8 THEN '' ELSE s_name END AS id, CASE WHEN k <= 2 THEN 'http' WHEN k <= 7 THEN 'queue' ELSE 'ftp' END AS type, s_nationkey % 3 <> 0 AS enabled,
  CASE k WHEN 1 THEN 'http.url is required for sink ' || s_name WHEN 2 THEN 'http config required for sink ' || s_name WHEN 4 THEN 'sns.region is required for sink ' || s_name WHEN 5 THEN 'queue provider azure not implemented for sink ' || s_name
  WHEN 6 THEN 'queue provider rabbit not supported for sink ' || s_name WHEN 7 THEN 'gcp config required for sink ' || s_name WHEN 8 THEN 'id is required' END AS error FROM (SELECT *, s_suppkey % 9 AS k FROM supplier)"""

ORACLES: dict[str, str] = moments_sql.oracles() | {
    "p6_found": multivalue_sql.oracle(),
    "body_truncate": f"SELECT doc_id, {_HEAD('text', 1000)} AS head FROM documents WHERE text IS NOT NULL",
    "snippets": f"SELECT doc_id, CASE WHEN t = '' THEN '<empty>' WHEN strlen(t) <= 512 THEN t ELSE {_HEAD('t', 512)} || '...' END AS feed, {_HEAD('t', 1024)} AS page, {T(_HEAD('text', 512))} AS sink FROM (SELECT doc_id, text, {T('text')} AS t FROM documents WHERE text IS NOT NULL)",
    "registry_load": _CLEAN,
    "sink_registry": """SELECT n_name AS id, 'http' AS type, n_nationkey % 3 <> 0 AS enabled, 'https://hook.example/' || n_nationkey AS url, CASE WHEN n_nationkey % 3 = 1 THEN 'PUT' ELSE 'POST' END AS method,
      CASE WHEN n_nationkey > 5 THEN n_nationkey - 5 ELSE 5 END::BIGINT AS timeout_seconds, CASE WHEN n_nationkey % 2 = 1 THEN '{"X-Key":"one"}' END AS headers FROM nation""",
    "sink_table_validate": _SUPPLIERS,
    "sink_table_enabled": f"SELECT type, count(*) AS sinks FROM ({_SUPPLIERS}) WHERE enabled GROUP BY 1",
    "repeated_ids": "SELECT id, count(*) AS rows FROM articles WHERE id IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
    "seen_store": f"SELECT article_id, max(expires_at) AS expires_at FROM seen_articles GROUP BY 1 HAVING max(expires_at) > {AS_OF}",
    "deliver_transport": f"SELECT row_id, article_id, sink_id, error IS NULL AS ok, error FROM ({_DELIVERED})",
    "p2_check": "SELECT count(*) AS deliveries, count(DISTINCT delivery_id) AS ids FROM harvest_events",
    "p6_check": "SELECT tab, count(*) AS texts, 0::BIGINT AS lost_texts, 0::BIGINT AS strange_values FROM (SELECT 'sitemap_entries' AS tab, news.keywords AS text FROM sitemap_entries UNION ALL SELECT 'articles', array_to_string(keywords, ', ') FROM articles) WHERE text IS NOT NULL GROUP BY 1",
    "article_identity": f"SELECT entry_id AS row_id, {T('loc')} AS url, sha1({T('loc')}) AS id FROM sitemap_entries WHERE {T('loc')} <> ''",
    "blank_loc_filter": f"SELECT provider_id, count(*) FILTER (coalesce({T('loc')}, '') = '') AS blank, count(*) FILTER ({T('loc')} <> '') AS kept FROM sitemap_entries GROUP BY 1",
    "build_articles": _ARTICLES,
    "keywords_parse": f"SELECT entry_id AS row_id, coalesce(len({_KW('news.keywords')}), 0)::BIGINT AS n, nullif(list_aggregate({_KW('news.keywords')}, 'string_agg', '|'), '') AS joined FROM sitemap_entries",
    "first_image": f"SELECT entry_id AS row_id, {_IMG} AS image_url FROM sitemap_entries",
    "pubdate_parse": f"SELECT row_id, {US('published_at')} AS us FROM articles",
    "sitemap_roundtrip": f"SELECT provider_id, id, title, url, image_url, keywords, published_us FROM ({_ARTICLES})",
    "index_traversal": "SELECT 'tree' AS provider_id, 'https://feeds.example/story/' || replace(n_name, ' ', '-') AS loc FROM nation JOIN region ON n_regionkey = r_regionkey",
    "meta_precedence": f"SELECT doc_id, title, description, image_url FROM ({_PAGE})",
    "url_resolve": rf"""SELECT row_id, CASE row_id % 5 WHEN 0 THEN regexp_extract({T("url")}, '^(https?://[^/]+)', 1) || '/img/a.jpg' WHEN 1 THEN '' WHEN 2 THEN 'https://cdn.example/x.png'
      WHEN 3 THEN regexp_extract({T("url")}, '^(https?):', 1) || '://cdn.example/y.png' ELSE regexp_extract({T("url")}, '^([^?#]*/)', 1) || 'b.jpg?w=1' END AS resolved FROM articles WHERE {T("url")} <> ''""",
    "enrich_override": f"""WITH p AS (SELECT article_id, min(doc_id) AS doc_id FROM documents WHERE article_id IS NOT NULL GROUP BY 1), m AS (SELECT q.* FROM ({_PAGE}) q JOIN p USING (article_id, doc_id))
      SELECT row_id, CASE WHEN m.title <> '' THEN m.title ELSE coalesce(a.title, '') END AS title, CASE WHEN m.description <> '' THEN m.description ELSE coalesce(a.description, '') END AS description,
      CASE WHEN m.image_url <> '' THEN 'https://a.example/pic.jpg' ELSE coalesce(a.image_url, '') END AS image_url FROM articles a LEFT JOIN m ON a.id = m.article_id""",
    "dedupe_fresh": f"SELECT row_id, id FROM articles a WHERE NOT EXISTS (SELECT 1 FROM seen_articles s WHERE s.article_id = a.id AND s.expires_at > {AS_OF})",
    "dedupe_keeps_batch_dups": f"SELECT id, count(*) AS rows FROM ({_ARTICLES}) WHERE id NOT IN {_SEEN} GROUP BY 1",
    "seen_upsert": "SELECT article_id, max(expires_at) AS expires_at FROM seen_articles GROUP BY 1",
    "seen_sweep": f"SELECT article_id, max(expires_at) AS expires_at FROM seen_articles GROUP BY 1 HAVING max(expires_at) > {AS_OF}",
    "provider_sanitize": _CLEAN,
    "provider_validate": f"SELECT id, CASE length(id) % 4 WHEN 1 THEN 'name is required for provider ' || id WHEN 2 THEN 'source_url is required for provider ' || id WHEN 3 THEN 'response_format is required for provider ' || id END AS error FROM ({_CLEAN})",
    "headers_build": "SELECT id, header, value FROM (" + " UNION ALL ".join(f"SELECT id, '{h}' AS header, {T(f'''config['{k}']''')} AS value FROM providers" for k, h in R.HEADER_KEYS.items()) + ") WHERE value <> ''",
    "config_strings": f"""SELECT id, coalesce(nullif({T("config['timezone']")}, ''), 'UTC') AS timezone, coalesce(nullif({T("config['user_agent']")}, ''), 'none') AS user_agent FROM providers""",
    "fetcher_resolve": f"SELECT id, CASE WHEN lower({T('id')}) = 'kotal-post' THEN 'special' WHEN lower({T('type')}) = 'google_news_sitemap' THEN 'sitemap' END AS fetcher, CASE WHEN lower({T('id')}) <> 'kotal-post' AND lower({T('type')}) <> 'google_news_sitemap' THEN 'no fetcher for provider ' || {T('id')} END AS fetcher_error FROM providers",
    "sink_enabled": f"SELECT id, type FROM {_SINK_ROWS} WHERE enabled",
    "sink_validate": f"SELECT * FROM {_SINK_ROWS}",
    "fanout_pairs": f"SELECT delivery_id AS row_id, sink_pos::BIGINT AS sink_pos, sink_id, sink_type FROM harvest_events, {_GOOD}",
    "delivery_outcome": f"SELECT row_id, article_id, count(*) FILTER (error IS NULL) AS successes, coalesce(string_agg(sink_type || ' sink ' || sink_id || ': ' || error, chr(10) ORDER BY sink_pos) FILTER (error IS NOT NULL), '') AS errors FROM ({_DELIVERED}) GROUP BY 1, 2",
    "delivery_marks": f"SELECT DISTINCT article_id, {AS_OF + TTL}::BIGINT AS expires_at FROM ({_DELIVERED}) WHERE error IS NULL",
    "event_json": f"""SELECT h.delivery_id AS row_id, to_json(struct_pack(provider_id := coalesce(h.article.provider_id, ''), provider_name := coalesce({T("p.name")}, ''),
      article := struct_pack(provider_id := coalesce(h.article.provider_id, ''), id := coalesce(h.article.id, ''), title := coalesce(h.article.title, ''), url := coalesce(h.article.url, ''), description := coalesce(h.article.description, ''),
      image_url := coalesce(h.article.image_url, ''), keywords := h.article.keywords, published_at := {_TEXT("pu")}), collected_at := {_TEXT("cu")}))::VARCHAR AS body
      FROM (SELECT *, {US("article.published_at")} AS pu, {US("collected_at")} AS cu FROM harvest_events) h LEFT JOIN providers p ON p.id = h.article.provider_id""",
    "crawl_summary": f"""WITH a AS ({_ARTICLES}), n AS (SELECT row_id, provider_id, id AS article_id, substr(id, 1, 1) AS f FROM a WHERE id NOT IN {_SEEN}), d AS ({_TRIED.format("SELECT * FROM n")}),
      o AS (SELECT row_id, provider_id, count(*) FILTER (error IS NULL) AS ok, count(error) AS bad FROM d GROUP BY 1, 2)
      SELECT provider_id, fetched, coalesce(fresh, 0) AS fresh, coalesce(published, 0) AS published, coalesce(with_errors, 0) AS with_errors FROM (SELECT provider_id, count(*) AS fetched FROM a GROUP BY 1)
      LEFT JOIN (SELECT provider_id, count(*) AS fresh, count(*) FILTER (ok > 0) AS published, count(*) FILTER (bad > 0) AS with_errors FROM o GROUP BY 1) USING (provider_id)""",
    "error_rollup": f"SELECT provider_id, sink_id, error, count(*) AS failures FROM ({_DELIVERED}) WHERE error IS NOT NULL GROUP BY 1, 2, 3",
    "rate_slots": f"SELECT entry_id AS row_id, provider_id, row_number() OVER (PARTITION BY provider_id ORDER BY entry_id) * p.request_delay_ms::BIGINT AS not_before_ms FROM sitemap_entries e JOIN ({_CLEAN}) p ON p.id = e.provider_id WHERE {T('loc')} <> ''",
    "worker_cap": f"SELECT provider_id, count(*) AS jobs, least(count(*), 10) AS workers FROM sitemap_entries WHERE {T('loc')} <> '' GROUP BY 1",
    "stream_cycle": f"SELECT id, count(*) AS published FROM ({_ARTICLES}) WHERE id NOT IN {_SEEN} GROUP BY 1",
}
