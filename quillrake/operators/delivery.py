"""Delivery of events to sinks: every event to every sink, outcomes per attempt, counts per event and provider.

Transports are injected: a function from the events' JSON and a sink to an error text or None. They run once per
attempt inside of ``mapInPandas``; the outcomes are written before anything is derived from them, so that nothing is
sent again when they are read twice. A task that is retried sends again: delivery is at least once.
"""

from __future__ import annotations

import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import DELIVERY, SINK
from .events import event_json
from .registry import DEFAULT_METHOD, DEFAULT_TIMEOUT_S, enabled_sinks

#: Most sinks of a registry: each event is repeated for each.
SINK_LIMIT = 10_000

Transport = Callable[[str, str, dict], str | None]


def sink_rows(sinks: DataFrame) -> list[dict]:
    """Enabled sinks in the order of their rows, as plain dictionaries."""
    rows = enabled_sinks(sinks).select(*SINK.fieldNames()).limit(SINK_LIMIT + 1).collect()
    if len(rows) > SINK_LIMIT:
        raise ValueError("too many sinks")
    return [r.asDict(recursive=True) for r in rows]


def fan_out(events: DataFrame, sinks: list[dict]) -> DataFrame:
    """Each event once per sink, with (sink_pos, sink_id, sink_type): no join, as the sinks are a short list."""
    if not sinks:
        return events.limit(0).select("*", F.lit(0).alias("sink_pos"), F.lit("").alias("sink_id"), F.lit("").alias("sink_type"))
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("sink_pos"), F.lit(s["id"]).alias("sink_id"), F.lit(s["type"]).alias("sink_type")) for k, s in enumerate(sinks)]))
    return events.select("*", each.alias("qs")).select(*[F.col(f"`{c}`") for c in events.columns], "qs.sink_pos", "qs.sink_id", "qs.sink_type")


def deliver(events: DataFrame, sinks: list[dict], transport: Transport) -> DataFrame:
    """One outcome per event (with ``row_id``) and sink. An exception of the transport is that attempt's error."""
    by_pos = dict(enumerate(sinks))
    rows = fan_out(events.select("row_id", F.col("article.id").alias("article_id"), "provider_id", event_json().alias("body")), sinks)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            errors = []
            for body, provider, pos in zip(b["body"], b["provider_id"], b["sink_pos"], strict=True):
                try:
                    errors.append(transport(body, provider, by_pos[pos]))
                except Exception as e:  # noqa: BLE001  one attempt's failure is its outcome
                    errors.append(str(e) or type(e).__name__)
            out = b[["row_id", "article_id", "provider_id", "sink_pos", "sink_id", "sink_type"]].assign(error=errors)
            out["ok"] = out["error"].isna()
            yield out[DELIVERY.fieldNames()]

    return rows.select("row_id", "article_id", "provider_id", F.col("sink_pos").cast("int").alias("sink_pos"), "sink_id", "sink_type", "body").mapInPandas(run, DELIVERY)


def by_rule(events: DataFrame, sinks: list[dict], error: Column) -> DataFrame:
    """Outcomes by an expression over the fanned-out events instead of a transport: NULL means delivered."""
    rows = fan_out(events.select("row_id", F.col("article.id").alias("article_id"), "provider_id"), sinks)
    return rows.select("row_id", "article_id", "provider_id", F.col("sink_pos").cast("int").alias("sink_pos"), "sink_id", "sink_type", error.isNull().alias("ok"), error.cast("string").alias("error"))


def outcomes(deliveries: DataFrame) -> DataFrame:
    """Per event: sinks that took it, and the others' errors in the order of the sinks, one per line."""
    text = F.concat("sink_type", F.lit(" sink "), "sink_id", F.lit(": "), "error")
    listed = F.array_sort(F.collect_list(F.when(~F.col("ok"), F.struct("sink_pos", text.alias("e")))))
    return deliveries.groupBy("row_id", "article_id", "provider_id").agg(F.sum(F.col("ok").cast("int")).cast("bigint").alias("successes"), F.array_join(F.transform(listed, lambda x: x["e"]), "\n").alias("errors"))


def http_transport(opener: Callable | None = None) -> Transport:
    """POST (or the sink's method) of the JSON to the sink's URL; a status of 400 or more is an error."""

    def send(body: str, provider: str, sink: dict) -> str | None:
        h = sink["http"]
        headers = {**(h.get("headers") or {}), "Content-Type": "application/json"}
        request = urllib.request.Request(h["url"], data=body.encode(), headers=headers, method=h.get("method") or DEFAULT_METHOD)
        try:
            with (opener or urllib.request.urlopen)(request, timeout=h.get("timeout_seconds") or DEFAULT_TIMEOUT_S):
                return None
        except urllib.error.HTTPError as e:
            text = e.read()[:512].decode("utf-8", "ignore").strip()
            return None if e.code < 400 else f"http response status {e.code}: {text}"
        except Exception as e:  # noqa: BLE001
            return f"http request: {e}"

    return send


def queue_transport(clients: dict[str, Callable[[dict, str, dict], None]]) -> Transport:
    """Message of JSON with the attribute provider_id through the client of the queue's provider.

    A client is called with the sink's settings of its provider, the body and the attributes, waits for the
    acknowledgement, and raises on failure.
    """
    parts = {"aws-sqs": "aws", "aws-sns": "sns", "gcp": "gcp"}

    def send(body: str, provider: str, sink: dict) -> str | None:
        kind = sink["queue"]["provider"]
        if kind not in clients or kind not in parts:
            return f"queue provider {kind} not supported"
        try:
            clients[kind](sink["queue"][parts[kind]], body, {"provider_id": provider})
        except Exception as e:  # noqa: BLE001
            return f"queue {kind}: {e}"
        return None

    return send


def unsupported(sinks: list[dict], transports: dict[str, Transport], clients: dict[str, Callable]) -> str | None:
    """What keeps the first such sink from being built: its type has no transport, or its queue no client."""
    for s in sinks:
        kind = (s["type"] or "").strip().lower()
        if kind not in transports:
            return f"no transport for type {s['type']} of sink {s['id']}"
        if kind == "queue" and s["queue"]["provider"] not in clients:
            return f"no client for queue provider {s['queue']['provider']} of sink {s['id']}"
    return None


def routed(transports: dict[str, Transport]) -> Transport:
    """Transport by the sink's type, compared in small letters."""
    table = {k.strip().lower(): v for k, v in transports.items()}

    def send(body: str, provider: str, sink: dict) -> str | None:
        t = table.get((sink["type"] or "").strip().lower())
        return f"no transport for type {sink['type']}" if t is None else t(body, provider, sink)

    return send
