import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from quillrake.functions import html as H
from quillrake.functions import text as T
from quillrake.operators import articles as A
from quillrake.operators import delivery as D
from quillrake.operators import pacing
from quillrake.operators import registry as R
from quillrake.operators import seen as S
from quillrake.operators.events import event_json, events
from quillrake.plans.cycle import run_cycle
from quillrake.schemas import ARTICLE, ENTRY, HTTP, PROVIDER, QUEUE, SINK
from quillrake.session import workdir
from quillrake.sources import registries as C
from quillrake.sources import sitemaps as X
from quillrake.streaming import harvest

NEWS = (
    '<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9" xmlns:q="http://www.google.com/schemas/sitemap-news/0.9" xmlns:image="http://www.google.com/schemas/sitemap-image/1.1">'
    "<url><loc> https://a.example/1 </loc><news>no</news><q:news><q:publication_date>2025-01-02T03:04:05+01:00</q:publication_date><q:keywords>a, , b</q:keywords><q:title> One &amp; two </q:title></q:news>"
    "<image:image><image:loc> </image:loc></image:image><image:image><image:loc>https://a.example/i.jpg</image:loc></image:image></url>"
    "<url><loc>  </loc></url><url><loc>https://a.example/2</loc><news><title>unbound</title></news></url></urlset>"
)
INDEX = '<sitemapindex xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">{}</sitemapindex>'


def index(*locs):
    return INDEX.format("".join(f"<sitemap><loc>{x}</loc></sitemap>" for x in locs))


def provider(spark, *rows):
    return spark.createDataFrame([(i, i.upper(), "google_news_sitemap", u, "xml", 0, {"user_agent": " me "}) for i, u in rows], PROVIDER)


def test_text_functions(spark):
    df = spark.createDataFrame([("  a,b ,, c\t", "2025-01-02T03:04:05.123456789+02:00", "é" * 300), ("  ", "2025-01-02", ""), (None, "garbage", None)], "k string, d string, b string")
    rows = df.select(T.keyword_list(F.col("k")).alias("k"), F.unix_micros(T.rfc3339(F.col("d"))).alias("d"), T.feed_snippet(F.col("b")).alias("f"), T.cut_bytes(F.col("b"), 5).alias("c"), T.first_non_empty(F.col("k"), F.lit(" z ")).alias("n")).collect()
    assert [r.k for r in rows] == [["a", "b", "c"], None, None]
    assert [r.d for r in rows] == [1735779845123456, None, None]
    assert [r.f for r in rows] == ["é" * 256 + "...", "<empty>", None]
    assert [r.c for r in rows] == ["éé", "", None]
    assert [r.n for r in rows] == ["a,b ,, c", "z", "z"]


def test_sitemap_namespaces():
    got = X.parse_sitemap(NEWS)
    assert got["error"] is None and len(got["entries"]) == 3
    one, blank, two = got["entries"]
    assert one["news"] == {"publication_date": "2025-01-02T03:04:05+01:00", "keywords": "a, , b", "title": " One & two "} and len(one["image"]) == 2
    assert blank["loc"].strip() == "" and two["news"] is None
    assert X.parse_sitemap("<urlset><url>")["error"] and X.parse_sitemap(None)["error"]
    assert X.parse_sitemap(index("https://a.example/x ", " "))["nested"] == ["https://a.example/x"]


def test_traversal(spark):
    pages = {
        "https://a.example/root": index("https://a.example/n1", "https://a.example/n2", "https://a.example/root"),
        "https://a.example/n1": NEWS, "https://a.example/n2": index("https://a.example/n1", "https://a.example/n3"), "https://a.example/n3": NEWS,
        "https://b.example/root": index("https://b.example/gone"), "https://c.example/root": "<urlset></urlset>", "https://d.example/root": "<oops",
    }
    responses = spark.createDataFrame([(u, 200, b) for u, b in pages.items()], "url string, status int, body string")
    p = provider(spark, *[(k, f"https://{k}.example/root") for k in "abcd"], ("e", " "))
    entries, errors = X.traverse(p, X.from_table(responses))
    assert [(r.provider_id, r.n) for r in entries.groupBy("provider_id").agg(F.count("*").alias("n")).collect()] == [("a", 6)]
    assert {r.provider_id: r.error for r in errors.collect()}.keys() == set("bcde")
    built = A.build_articles(entries.withColumn("row_id", F.lit(1))).orderBy("url").collect()
    assert len(built) == 4 and built[0].title == "One & two" and built[0].keywords == ["a", "b"] and built[0].image_url == "https://a.example/i.jpg"


def test_html_metadata():
    page = '<html><head><script>"<title>no</title>"</script><title> a &amp; <b>b</b> </title><meta property="og:title" content=" "><meta property="og:title" content="second"><meta name="description" content="d"><meta property="og:image" content="/i.png"></head>'
    assert H.metadata(page) == ("a & <b>b</b>", "d", "/i.png")
    assert H.metadata('<meta property="og:title" content="T"><title>x') == ("T", "", "")
    assert H.metadata(None) == ("", "", "") and H.metadata("<title>open") == ("open", "", "")
    base = "https://a.example/x/y.html?q=1"
    assert [H.resolved(r, base) for r in ("/i", "", "//c.example/z", "../k", "https://q.example/", "data:a")] == ["https://a.example/i", "", "https://c.example/z", "https://a.example/k", "https://q.example/", "data:a"]


def test_enrich_keeps_rows_and_overrides_only_with_text(spark):
    a = spark.createDataFrame([("p", "1", "t", "https://a.example/1", "d", "", None, None), ("p", "2", "t", "https://a.example/2", "d", "i", None, None), ("p", "3", "t", "https://a.example/3", "d", "i", None, None)], ARTICLE)
    pages = spark.createDataFrame([("https://a.example/1", 200, '<meta property="og:title" content="new"><meta property="og:image" content="/p.png">', None), ("https://a.example/2", 500, "<title>no</title>", None), ("https://a.example/9", 200, "", None)], "url string, status int, body string, error string")
    big = spark.createDataFrame([("https://a.example/3", 200, "x" * (A.PAGE_BYTES + 5) + "<title>late</title>", None)], "url string, status int, body string, error string")
    got = A.enrich(a, A.page_metadata(pages.unionByName(big))).orderBy("id").collect()
    assert [(r.title, r.description, r.image_url) for r in got] == [("new", "d", "https://a.example/p.png"), ("t", "d", "i"), ("t", "d", "i")]


def test_seen_rules(spark):
    seen = spark.createDataFrame([("old", 99), ("now", 100), ("alive", 101), ("again", 50), ("again", 200)], "article_id string, expires_at long")
    a = spark.createDataFrame([(x,) for x in ("old", "now", "alive", "again", "new", "new", None)], "id string")
    assert sorted(str(r.id) for r in S.fresh(a, seen, 100).collect()) == ["None", "new", "new", "now", "old"]
    assert {(r.article_id, r.expires_at) for r in S.alive(seen, 100).collect()} == {("alive", 101), ("again", 200)}


def test_seen_table_replays_sweeps_and_fails_open(spark, tmp_path):
    t = S.open_seen(spark, "parquet", str(tmp_path / "seen"), cleanup_interval=10)
    t.swept_at = 100
    mark = lambda *rows: spark.createDataFrame(rows, "article_id string, expires_at long")
    assert t.read().count() == 0
    t.write(mark(("a", 105), ("b", 300)), 0)
    t.write(mark(("a", 120)), 1)
    t.write(mark(("a", 120)), 1)  # a batch that is run again
    assert t.read().count() == 3 and not t.sweep(105) and t.sweep(119)
    assert {(r.article_id, r.expires_at) for r in t.read().collect()} == {("a", 120), ("b", 300)}
    t.write(mark(("c", 500)), 2)
    assert t.read().count() == 3
    broken = S.SeenTable(spark, "nosuchscheme://x/y")
    assert broken.read().count() == 0
    assert S.open_seen(spark, " None ").read().count() == 0
    for bad in (("parquet", " "), ("bolt", "x")):
        with pytest.raises(ValueError):
            S.open_seen(spark, *bad)


def test_registry_files(spark, tmp_path):
    f = tmp_path / "p.yaml"
    f.write_text("providers:\n- {id: ' a ', name: A, type: ' Google_News_Sitemap', source_url: 'https://a.example', response_format: xml, request_delay_ms: -1, config: {accept: x, n: 3}}\n")
    r = C.load_providers(spark, str(f)).first()
    assert (r.id, r.type, r.request_delay_ms, r.config) == ("a", "google_news_sitemap", 500, {"accept": "x"})
    f.write_text(json.dumps([{"id": "a", "name": "A", "type": "t", "source_url": "u", "response_format": "x"}] * 2))
    with pytest.raises(C.RegistryError, match="duplicate"):
        C.load_providers(spark, str(f))
    for text in ("[]", "providers: []", "{", "- {id: a}"):
        f.write_text(text)
        with pytest.raises(C.RegistryError):
            C.load_providers(spark, str(f))
    odd = tmp_path / "p.toml"
    odd.write_text("x")
    with pytest.raises(C.RegistryError):
        C.load_providers(spark, str(odd))
    s = tmp_path / "s.json"
    s.write_text(json.dumps({"publishers": [{"id": "h", "type": "HTTP", "http": {"url": "https://${HOST}/in$NONE", "headers": {" A ": " 1 ", "B": " "}}}, {"id": "q", "type": "queue", "enabled": False, "queue": {"provider": "AWS-SQS", "aws": {"uri": "u", "region": "r", "access_key_id": "k", "secret_access_key": "$KEY"}}}]}))
    rows = {r.id: r for r in C.load_sinks(spark, str(s), {"HOST": "h.example", "KEY": "x"}).collect()}
    assert rows["h"].http.url == "https://h.example/in" and rows["h"].http.method == "POST" and rows["h"].http.headers == {"A": "1"} and rows["h"].http.timeout_seconds == 5
    assert rows["q"].queue.aws.queue_url == "u" and rows["q"].enabled is False
    with pytest.raises(C.RegistryError, match="secret_access_key"):  # a disabled sink is checked too
        C.load_sinks(spark, str(s), {"HOST": "h"})


def test_settings(tmp_path):
    env = tmp_path / ".env"
    env.write_text("# x\nCRAWL_INTERVAL=60\nSTORAGE_TTL='7'\n")
    s = C.Settings.load({"STORAGE_TTL": "9"}, str(env))
    assert (s.crawl_interval, s.storage_ttl, s.storage_cleanup_interval) == (60, 9, 43_200)
    for bad in ({"CRAWL_INTERVAL": "0"}, {"STORAGE_TTL": "x"}):
        with pytest.raises(C.RegistryError):
            C.Settings.load(bad, str(tmp_path / "none"))


def test_fetcher_priority(spark):
    p = provider(spark, ("A", "u"), ("b", "u"), (" ", "u")).unionByName(provider(spark, ("c", "u")).withColumn("type", F.lit("rss")))
    f = spark.createDataFrame([("id", " a ", "one"), ("type", "GOOGLE_news_sitemap", "two"), ("type", " ", "x")], "key_kind string, key string, fetcher string")
    got = {r.id: (r.fetcher, r.fetcher_error) for r in R.resolve_fetchers(p, f).collect()}
    assert got == {"A": ("one", None), "b": ("two", None), " ": (None, "provider id is empty"), "c": (None, "no fetcher for provider c")}


def sinks(spark, *rows):
    return D.sink_rows(R.sanitize_sinks(spark.createDataFrame(rows, SINK)))


def make_events(spark, n=3):
    a = spark.createDataFrame([(i, "p", f"{i}", f"t <{i}>", f"https://a.example/{i}", "", "", None, None) for i in range(n)], "row_id long, " + ARTICLE.simpleString()[7:-1].replace(":", " "))
    return events(a, spark.createDataFrame([("p", " P ")], "id string, name string"), F.timestamp_seconds(F.lit(100)))


def test_event_json_has_every_key(spark):
    body = json.loads(make_events(spark, 1).select(event_json().alias("b")).first().b)
    assert body == {"provider_id": "p", "provider_name": "P", "article": {"provider_id": "p", "id": "0", "title": "t <0>", "url": "https://a.example/0", "description": "", "image_url": "", "keywords": None, "published_at": "0001-01-01T00:00:00Z"}, "collected_at": "1970-01-01T00:01:40Z"}


def test_partial_success_marks(spark):
    def transport(body, prov, sink):
        k = json.loads(body)["article"]["id"]
        if k == "1" or (k == "0" and sink["id"] == "s2"):
            raise RuntimeError("down")
        return None

    out = D.deliver(make_events(spark), sinks(spark, ("s1", "http", None, None, {"url": "u"}), ("s2", "http", True, None, {"url": "u"}), ("s3", "http", False, None, {"url": "u"})), transport).cache()
    got = {r.article_id: (r.successes, r.errors) for r in D.outcomes(out).collect()}
    assert got == {"0": (1, "http sink s2: down"), "1": (0, "http sink s1: down\nhttp sink s2: down"), "2": (2, "")}
    assert {(r.article_id, r.expires_at) for r in S.marks(out, 100, 5).collect()} == {("0", 105), ("2", 105)}
    assert D.fan_out(make_events(spark), []).count() == 0


def test_http_and_queue_transports(spark):
    got = []

    class Handler(BaseHTTPRequestHandler):
        def do_PUT(self):  # noqa: N802
            got.append((self.path, self.headers["X-A"], self.headers["Content-Type"], json.loads(self.rfile.read(int(self.headers["Content-Length"])))["article"]["id"]))
            self.send_response(400 if self.path == "/bad" else 204)
            self.end_headers()
            self.path == "/bad" and self.wfile.write(b" nope ")

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        base = f"http://127.0.0.1:{server.server_port}"
        http = D.http_transport()
        body = make_events(spark, 1).select(event_json().alias("b")).first().b
        assert http(body, "p", {"http": {"url": base + "/ok", "method": "PUT", "headers": {"X-A": "1", "Content-Type": "text/plain"}}}) is None
        assert http(body, "p", {"http": {"url": base + "/bad", "method": "PUT"}}) == "http response status 400: nope"
        assert got[0] == ("/ok", "1", "application/json", "0")
        assert "http request" in http(body, "p", {"http": {"url": "http://127.0.0.1:1/", "timeout_seconds": 1}})
    finally:
        server.shutdown()
    sent = []
    queue = D.queue_transport({"aws-sqs": lambda conf, b, attrs: sent.append((conf["queue_url"], attrs)), "gcp": lambda *a: 1 / 0})
    assert queue("{}", "p", {"queue": {"provider": "aws-sqs", "aws": {"queue_url": "q"}}}) is None and sent == [("q", {"provider_id": "p"})]
    assert queue("{}", "p", {"queue": {"provider": "gcp", "gcp": {}}}) == "queue gcp: division by zero"
    assert "not supported" in queue("{}", "p", {"queue": {"provider": "azure"}})
    assert "no transport" in D.routed({"HTTP": http})("{}", "p", {"type": "queue"})
    assert QUEUE and HTTP


def test_numbered_splits_groups(spark):
    df = spark.createDataFrame([("hot" if i % 3 else f"g{i % 7}", i) for i in range(1, 500)] + [(None, 3), (None, 900)], "g string, o long")
    got = {(r.g, r.o): r.n for r in pacing.numbered(df, "g", "o", width=50).collect()}
    want = {}
    for g in {x.g for x in df.collect()}:
        for n, o in enumerate(sorted(x.o for x in df.collect() if x.g == g), 1):
            want[g, o] = n
    assert got == want


def entries(spark, *locs):
    return spark.createDataFrame([(i, "p", (loc, None, None)) for i, loc in enumerate(locs)], f"row_id long, provider_id string, e {ENTRY.simpleString()}").select("row_id", "provider_id", "e.loc", "e.news", "e.image")


def test_cycle_and_stream(spark, tmp_path):
    p = spark.createDataFrame([("p", "P")], "id string, name string")
    one = sinks(spark, ("s", "http", True, None, {"url": "u"}))
    send = lambda ev, s: D.by_rule(ev, s, F.lit(None).cast("string"))
    e = entries(spark, "https://a.example/1", "https://a.example/1", " ", "https://a.example/2")
    done = run_cycle(e, p, spark.createDataFrame([], "article_id string, expires_at long"), one, send, 100, 10)
    assert [tuple(r) for r in done.summary.collect()] == [("p", 3, 3, 3, 0)]  # a feed's repeats are all published
    store = S.open_seen(spark, "parquet", str(tmp_path / "seen"))
    e.write.parquet(str(tmp_path / "in"))
    clock, seen = [100], []

    def run():
        q = harvest.start(spark.readStream.schema(e.schema).parquet(str(tmp_path / "in")), p, store, one, send, str(tmp_path / "cp"), lambda: clock[0], 10, None, lambda c, n: seen.append((n, c.events.count())))
        q.awaitTermination()

    run()
    e.write.mode("append").parquet(str(tmp_path / "in"))
    clock[0] = 105  # still marked
    run()
    e.write.mode("append").parquet(str(tmp_path / "in"))
    clock[0] = 110  # expired at 110
    run()
    assert seen == [(0, 3), (1, 0), (2, 3)]


def test_the_stream_enriches(spark, tmp_path):
    p, got = spark.createDataFrame([("p", "P")], "id string, name string"), []
    e = entries(spark, "https://a.example/1", "https://a.example/2")
    e.write.parquet(str(tmp_path / "in"))
    pages = lambda fresh: A.page_metadata(fresh.select("url", F.lit(200).alias("status"), F.concat(F.lit("<title>of "), "url", F.lit("</title>")).alias("body"), F.lit(None).cast("string").alias("error")))
    q = harvest.start(spark.readStream.schema(e.schema).parquet(str(tmp_path / "in")), p, S.NoSeenTable(spark), sinks(spark, ("s", "http", True, None, {"url": "u"})), lambda ev, s: D.by_rule(ev, s, F.lit(None).cast("string")), str(tmp_path / "cp"), interval_s=None, on_cycle=lambda c, n: got.extend(r.t for r in c.events.select("article.title").toDF("t").collect()), metadata=pages)
    q.awaitTermination()
    assert sorted(got) == ["of https://a.example/1", "of https://a.example/2"]


def test_a_failing_cycle_ends_the_stream_where_asked_to(spark, tmp_path):
    e = entries(spark, "https://a.example/1")
    e.write.parquet(str(tmp_path / "in"))
    took = []

    def bad(ev, s):
        took.append(ev.count())
        raise RuntimeError("down")

    for _ in range(2):  # the batch that failed comes again
        q = harvest.start(spark.readStream.schema(e.schema).parquet(str(tmp_path / "in")), spark.createDataFrame([("p", "P")], "id string, name string"), S.NoSeenTable(spark), [], bad, str(tmp_path / "cp"), interval_s=None, fail=True)
        with pytest.raises(Exception, match="down"):
            q.awaitTermination()
    assert took == [1, 1]


def test_a_failing_cycle_doesnt_stop_the_stream(spark, tmp_path):
    e = entries(spark, "https://a.example/1")
    e.write.parquet(str(tmp_path / "in"))

    def bad(ev, s):
        raise RuntimeError("down")

    q = harvest.start(spark.readStream.schema(e.schema).parquet(str(tmp_path / "in")), spark.createDataFrame([("p", "P")], "id string, name string"), S.NoSeenTable(spark), [], bad, str(tmp_path / "cp"), interval_s=None)
    q.awaitTermination()
    assert q.exception() is None
    assert workdir(spark, "x") != workdir(spark, "x")
