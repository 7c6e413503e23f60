"""The harvester as a process: settings, registries, stores and transports wired to cycles by the clock."""

from __future__ import annotations

import signal
import sys
import threading
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from . import logs
from .operators import articles as A
from .operators import delivery as D
from .operators.queues import CLIENTS
from .operators.seen import open_seen
from .plans.cycle import Cycle, run_cycle
from .session import build_session, discarding, ship, workdir, written
from .sources import sitemaps as X
from .sources.pages import fetch_pages
from .sources.registries import RegistryError, Settings, load_providers, load_sinks
from .streaming.periodic import every


def build(spark: SparkSession, settings: Settings, clients: dict[str, Callable] | None = None, fetch: X.Fetch | None = None, get: Callable | None = None, clock: Callable[[], int] = lambda: int(time.time()), fetchers: dict[str, Callable] | None = None) -> Callable[[int], Cycle]:
    """A function that runs one cycle.

    No enabled sink, and one that can't be built, are errors. Transports, clients of queues and fetchers by type of
    provider can be injected. The function has the seen table as its attribute ``store``.
    """
    log = logs.init(settings.log_level)
    providers, registry = load_providers(spark, settings.providers_file), load_sinks(spark, settings.sinks_file)
    sinks, clients = D.sink_rows(registry), CLIENTS if clients is None else clients
    log.info("registries loaded", extra={"key": "registries", "obj": {"providers": providers.count(), "sinks": registry.count(), "enabled": len(sinks)}})
    if not sinks:
        raise RegistryError("no sink is enabled")
    transports = {"http": D.http_transport(), "queue": D.queue_transport(clients)}
    if wrong := D.unsupported(sinks, transports, clients):
        raise RegistryError(wrong)
    store = open_seen(spark, settings.storage_type if settings.storage_path else "none", settings.storage_path, settings.storage_cleanup_interval)
    send = D.routed(transports)
    log.info("sinks built", extra={"key": "sinks", "obj": {"sinks": len(sinks)}})

    def pages(fresh: DataFrame) -> DataFrame:
        return A.page_metadata(fetch_pages(fresh, providers, get).select("url", "status", "body", "error").dropDuplicates(["url"]))

    def cycle(number: int) -> Cycle:
        began, as_of = time.monotonic(), clock()
        elapsed = lambda: int((time.monotonic() - began) * 1000)
        entries, errors = X.harvest(providers, fetch or X.over_http(), by_type=fetchers)
        # Numbers follow the feeds' order; repeats within a cycle stay apart by them.
        rows = entries.orderBy("provider_id", "feed_path", "feed_pos").withColumn("row_id", F.monotonically_increasing_id())
        rows = written(rows, f"{workdir(spark, 'entries')}/rows")
        done = run_cycle(rows, providers, store.read(), sinks, lambda ev, s: D.deliver(ev, s, send), as_of, settings.storage_ttl, pages)
        store.write(done.marks, as_of)
        store.sweep(as_of)
        for r in errors.collect():  # one row per provider at most
            log.error("provider failed", extra={"key": "provider", "obj": r.asDict()})
        for r in done.summary.collect():
            said = {"key": "provider", "obj": r.asDict() | {"elapsed_ms": elapsed()}}
            if r.with_errors:  # what went wrong takes the place of the summary
                log.error("publishing failed", extra=said)
            else:
                log.info("provider done", extra=said)
        log.info("cycle done", extra={"key": "cycle", "obj": {"number": number, "elapsed_ms": elapsed()}})
        return done

    cycle.store = store
    return cycle


def stop_on_signals(query: StreamingQuery, signals: tuple[int, ...] = (signal.SIGINT, signal.SIGTERM)) -> None:
    """Stop a query when the process is told to end; the cycle under way is cut off and marks nothing more."""
    for s in signals:
        signal.signal(s, lambda *_: threading.Thread(target=query.stop, daemon=True).start())


def main() -> int:
    settings = Settings.load()
    spark = build_session(name="quillrake-harvester")
    ship(spark)
    cycle = build(spark, settings)

    def once(number: int) -> None:
        with discarding(spark):
            cycle(number)

    query = every(spark, once, settings.crawl_interval, workdir(spark, "ticks"))
    stop_on_signals(query)
    try:
        query.awaitTermination()
    finally:
        cycle.store.close()
        spark.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main())
