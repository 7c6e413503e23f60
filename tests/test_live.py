import io
import json
import logging
import os
import signal
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillrake import app, logs
from quillrake.operators.registry import by_id, sanitize_providers
from quillrake.operators.seen import SeenTable
from quillrake.schemas import IMAGE, NEWS
from quillrake.session import discarding, is_directory, small, workdir
from quillrake.sources import datasource as DS
from quillrake.sources import sitemaps as X
from quillrake.sources.pages import Pace, fetch_pages
from quillrake.sources.registries import Settings
from quillrake.streaming.periodic import every

LEAF = '<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">{}</urlset>'


@pytest.fixture(scope="module")
def site():
    got, pages = [], {}

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            body = pages.get(self.path)
            self.send_response(200 if body is not None else 404)
            self.end_headers()
            self.wfile.write((body or "gone").encode())

        def do_POST(self):  # noqa: N802
            got.append(json.loads(self.rfile.read(int(self.headers["Content-Length"]))))
            self.send_response(200)
            self.end_headers()

        def log_message(self, *a):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    pages["/index"] = f"<sitemapindex><sitemap><loc>{base}/leaf</loc></sitemap><sitemap><loc>{base}/index</loc></sitemap></sitemapindex>"
    pages["/leaf"] = LEAF.format("".join(f"<url><loc>{base}/a{i}</loc></url>" for i in range(3)))
    pages["/a0"] = '<title>zero</title><meta property="og:image" content="/i.png">'
    yield base, got
    server.shutdown()


def test_a_whole_live_cycle(spark, site, tmp_path):
    base, got = site
    (tmp_path / "p.json").write_text(json.dumps({"providers": [{"id": "x", "name": "X", "type": "google_news_sitemap", "source_url": f"{base}/index", "response_format": "xml", "request_delay_ms": 1}, {"id": "y", "name": "Y", "type": "t2", "source_url": f"{base}/none", "response_format": "xml"}]}))
    (tmp_path / "s.json").write_text(json.dumps({"publishers": [{"id": "h", "type": "http", "http": {"url": f"{base}/in"}}]}))
    settings = Settings(str(tmp_path / "p.json"), str(tmp_path / "s.json"), storage_path=str(tmp_path / "seen"), log_level="error")
    cycle = app.build(spark, settings, clock=lambda: 1000)
    assert [tuple(r) for r in cycle(0).summary.collect()] == [("x", 3, 3, 3, 0)]
    assert sorted((e["article"]["title"], e["article"]["image_url"]) for e in got) == [("", ""), ("", ""), ("zero", f"{base}/i.png")]
    assert [tuple(r) for r in cycle(1).summary.collect()] == [("x", 3, 0, 0, 0)] and len(got) == 3
    (tmp_path / "s.json").write_text(json.dumps([{"id": "h", "type": "http", "enabled": False, "http": {"url": base}}]))
    with pytest.raises(ValueError, match="no sink"):
        app.build(spark, settings)


def test_data_source(spark, site):
    base, _ = site
    spark.dataSource.register(DS.SitemapFeeds)
    rows = spark.read.format("sitemap_feeds").option("providers", json.dumps([{"id": "x", "source_url": f"{base}/index"}])).load().collect()
    assert [(r.provider_id, r.feed_pos, r.loc, r.news) for r in rows] == [("x", i, f"{base}/a{i}", None) for i in range(3)]


def test_the_data_source_takes_its_type_only(spark, site):
    base, _ = site
    spark.dataSource.register(DS.SitemapFeeds)
    load = lambda kind: spark.read.format("sitemap_feeds").option("providers", json.dumps([{"id": "x", "type": kind, "source_url": f"{base}/index"}])).load()
    assert load(" Google_News_Sitemap ").count() == 3
    with pytest.raises(Exception, match="isn't a sitemap feed"):
        load("rss").count()


def test_feed_errors():
    docs = {"root": "<sitemapindex><sitemap><loc>bad</loc></sitemap></sitemapindex>", "empty": "<urlset/>", "broken": "<x"}
    get = lambda u: (200, docs[u], None) if u in docs else (500, b"", None)
    for url in ("root", "empty", "broken", "gone"):
        with pytest.raises(DS.FeedError):
            list(DS.read_feed(url, get))


def test_pace():
    now, slept = [0.0], []

    def sleep(s):
        slept.append(round(s, 3))
        now[0] += s

    p = Pace(lambda: now[0], sleep)
    for _ in range(3):
        p.wait("a", 0.5)
    p.wait("b", 0.1)
    assert slept == [0.5, 0.5, 0.5, 0.1]


def test_pages_keep_failures(spark):
    a = spark.createDataFrame([("x", "u1"), ("x", "u2"), ("x", "u2"), ("y", "u3")], "provider_id string, url string")
    p = spark.createDataFrame([("x", "X", "t", "s", "xml", 1, {"accept": "q"})], "id string, name string, type string, source_url string, response_format string, request_delay_ms int, config map<string,string>")
    get = lambda url, headers: (None, None, "down") if url == "u1" else (200, json.dumps(headers).encode(), None)
    got = {r.url: (r.status, r.body and bytes(r.body).decode(), r.error) for r in fetch_pages(a, p, get).collect()}
    assert got == {"u1": (None, None, "down"), "u2": (200, '{"Accept": "q"}', None), "u3": (200, "{}", None)}


def test_periodic_survives_failures(spark, tmp_path):
    ran = []

    def cycle(n):
        ran.append(n)
        if n == 0:
            raise RuntimeError("down")

    q = every(spark, cycle, 1, str(tmp_path / "cp"))
    end = time.time() + 40
    while len(ran) < 3 and time.time() < end:
        time.sleep(0.2)
    q.stop()
    assert ran[:3] == [0, 1, 2]


def test_logs():
    out = io.StringIO()
    log = logs.init("warning", out)
    log.info("no")
    log.error("yes", extra={"key": "k", "obj": {"n": 1}})
    assert json.loads(out.getvalue())["k"] == {"n": 1} and logs.level_of("?") == logging.INFO
    assert not logs.silent().propagate


def test_deeply_nested_feeds_are_read_to_their_end():
    index = '<sitemapindex xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><sitemap><loc>{}</loc></sitemap></sitemapindex>'
    leaf = LEAF.format("<url><loc>http://x/a</loc></url>")
    get = lambda url: (200, leaf if url == "2000" else index.format(int(url) + 1), None)
    assert [e["loc"] for e in DS.read_feed("0", get)] == ["http://x/a"]


PROVIDER = "id string, name string, type string, source_url string, response_format string, request_delay_ms int, config map<string,string>"


def test_feeds_are_fetched_side_by_side(spark):
    requests = spark.createDataFrame([(f"http://x/{i}", None) for i in range(4)], "url string, headers map<string,string>")

    class Slow:
        status = 200

        def __init__(self, *a, **k):
            time.sleep(1.5)

        def __enter__(self):
            return self

        def __exit__(self, *a):
            return False

        def read(self, *a):
            return b"x"

    over = X.over_http(opener=Slow, workers=4)
    over(requests).count()  # workers start
    began = time.time()
    assert {r.status for r in over(requests).collect()} == {200}
    assert time.time() - began < 5.5  # one after the other would take 6


def test_bodies_are_bounded(spark, site):
    base, _ = site
    assert X.http_get(f"{base}/index", None, limit=10)[1] == b"<sitemapin"
    a = spark.createDataFrame([("x", "u")], "provider_id string, url string")
    p = spark.createDataFrame([("x", "X", "t", "s", "xml", 1, {})], PROVIDER)
    got = fetch_pages(a, p, lambda url, headers: (200, b"y" * 5000, None), page_bytes=100).collect()
    assert [len(r.body) for r in got] == [100]


def test_each_provider_has_a_partition_of_its_own(spark):
    a = spark.createDataFrame([(f"p{k}", f"u{k}{i}") for k in range(9) for i in range(3)], "provider_id string, url string")
    p = spark.createDataFrame([(f"p{k}", "X", "t", "s", "xml", 1, {}) for k in range(9)], PROVIDER)
    rows = fetch_pages(a, p, lambda url, headers: (200, b"", None)).select("provider_id", F.spark_partition_id().alias("part")).distinct().collect()
    assert len(rows) == 9 and len({r.part for r in rows}) == 9


def test_providers_go_by_their_fetcher(spark):
    p = spark.createDataFrame([("a", "A", "google_news_sitemap", "s", "xml", 1, {}), ("b", "B", "rss", "s", "xml", 1, {}), ("C", "C", "rss", "s", "xml", 1, {})], PROVIDER)
    row = lambda own, fetch: (own.select(F.col("id").alias("provider_id"), F.lit("").alias("feed_path"), F.lit(0).alias("feed_pos"), F.lit("l").alias("loc"), F.lit(None).cast(NEWS).alias("news"), F.array().cast(T.ArrayType(IMAGE)).alias("image")), own.limit(0).select(F.col("id").alias("provider_id"), F.lit("").alias("error")))
    entries, errors = X.harvest(p, None, {"c": row}, {"google_news_sitemap": row})
    assert {r.provider_id for r in entries.collect()} == {"a", "C"} and [(r.provider_id, r.error) for r in errors.collect()] == [("b", "no fetcher for provider b")]
    entries, errors = X.harvest(p.filter("id = 'b'"), None)
    assert entries.count() == 0 and errors.count() == 1


def settings_of(tmp_path, sinks):
    (tmp_path / "p.json").write_text(json.dumps([{"id": "x", "name": "X", "type": "t", "source_url": "s", "response_format": "xml"}]))
    (tmp_path / "s.json").write_text(json.dumps(sinks))
    return Settings(str(tmp_path / "p.json"), str(tmp_path / "s.json"), log_level="error")


def test_sinks_that_cannot_be_built_are_told_at_once(spark, tmp_path):
    sqs = {"queue_url": "q", "region": "r", "access_key_id": "k", "secret_access_key": "s"}
    settings = settings_of(tmp_path, [{"id": "j", "type": "queue", "queue": {"provider": "aws-sqs", "aws": sqs}}])
    with pytest.raises(ValueError, match="no client"):
        app.build(spark, settings, clients={})
    assert app.build(spark, settings)  # the client that comes with the library


def test_signals_stop_the_query(spark, tmp_path):
    q = every(spark, lambda n: None, 1, str(tmp_path / "cp"))
    before = signal.getsignal(signal.SIGTERM)
    app.stop_on_signals(q, (signal.SIGTERM,))
    os.kill(os.getpid(), signal.SIGTERM)
    assert q.awaitTermination(30)
    signal.signal(signal.SIGTERM, before)


def test_registry_look_up(spark):
    p = sanitize_providers(spark.createDataFrame([(" a ", "A", "T", "s", "xml", 0, None)], PROVIDER))
    assert by_id(p, " a")["type"] == "t" and by_id(p, "b") is None and by_id(p, None) is None


def test_a_seen_table_that_cannot_be_read(spark, tmp_path):
    (tmp_path / "seen" / "batch=1").mkdir(parents=True)
    for name in ("_SUCCESS", "x.parquet"):
        (tmp_path / "seen" / "batch=1" / name).write_text("no table")
    assert SeenTable(spark, str(tmp_path / "none"), strict=True).read().count() == 0
    broken = SeenTable(spark, str(tmp_path / "seen"))
    broken._paths = lambda: (_ for _ in ()).throw(OSError("down"))
    assert broken.read().count() == 0
    broken.strict = True
    with pytest.raises(OSError, match="down"):
        broken.read()


def test_work_folders_go(spark):
    with discarding(spark):
        path = workdir(spark, "t")
        spark.range(3).write.parquet(f"{path}/x")
        assert is_directory(spark, path)
    assert not is_directory(spark, path)


def test_size_is_summed_before_a_broadcast(spark):
    df = spark.createDataFrame([("x" * 1000,)] * 10, "t string")
    plan = lambda d: d._jdf.queryExecution().analyzed().toString()
    assert "broadcast" in plan(small(df, 20_000)).lower() and "broadcast" not in plan(small(df, 5_000)).lower()
