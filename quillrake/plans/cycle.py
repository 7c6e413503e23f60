"""One harvest cycle: entries to fresh, enriched, delivered and marked articles."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import articles as A
from ..operators import delivery as D
from ..operators import seen as S
from ..operators.events import events as wrap
from ..session import workdir, written


@dataclass
class Cycle:
    """What a cycle did: ``events``, ``deliveries``, ``outcomes`` and ``marks`` are tables that were written already."""

    events: DataFrame
    deliveries: DataFrame
    outcomes: DataFrame
    marks: DataFrame
    summary: DataFrame


def run_cycle(entries: DataFrame, providers: DataFrame, seen: DataFrame, sinks: list[dict], send: Callable[[DataFrame, list[dict]], DataFrame], as_of: int, ttl: int = 432_000, metadata: Callable[[DataFrame], DataFrame] | None = None) -> Cycle:
    """Take entries (row_id, provider_id, loc, news, image) through the cycle at ``as_of`` (Unix seconds).

    Seen articles go before pages are fetched (``metadata``: from fresh articles to ``page_metadata`` rows). ``send``
    makes deliveries of events; an article is marked if a sink took it. Repeated entries of a cycle are all published.
    """
    spark = entries.sparkSession
    root = workdir(spark, "cycle")
    built = A.build_articles(entries.select("row_id", "provider_id", "loc", "news", "image"))
    new = S.fresh(built, seen, as_of)
    if metadata is not None:
        new = written(new, f"{root}/fresh")
        new = A.enrich(new, metadata(new.select("provider_id", "url").distinct()))
    # In the order of their rows, which is that of the feed, so that sinks get them in it as far as tasks go.
    evts = written(wrap(new, providers, F.timestamp_seconds(F.lit(int(as_of)))).sortWithinPartitions("row_id"), f"{root}/events")
    deliveries = written(send(evts, sinks), f"{root}/deliveries")
    done = D.outcomes(deliveries)
    fetched = built.groupBy("provider_id").agg(F.count("*").alias("fetched"))
    kept = evts.groupBy("provider_id").agg(F.count("*").alias("fresh"))
    sent = done.groupBy("provider_id").agg(F.count_if(F.col("successes") > 0).alias("published"), F.count_if(F.col("errors") != "").alias("with_errors"))
    summary = fetched.join(kept, "provider_id", "left").join(sent, "provider_id", "left").select("provider_id", "fetched", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("fresh", "published", "with_errors")])
    return Cycle(evts, deliveries, done, S.marks(deliveries, as_of, ttl), summary)
