"""The harvest as a stream: each micro-batch is a cycle that commits its marks at its end."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.seen import NoSeenTable, SeenTable
from ..plans.cycle import Cycle, run_cycle

log = logging.getLogger("quillrake")


def start(entries: DataFrame, providers: DataFrame, seen: SeenTable | NoSeenTable, sinks: list[dict], send: Callable, checkpoint: str, clock: Callable[[], int] = lambda: int(time.time()), ttl: int = 432_000, interval_s: int | None = 900, on_cycle: Callable[[Cycle, int], None] | None = None, metadata: Callable[[DataFrame], DataFrame] | None = None, fail: bool = False) -> StreamingQuery:
    """Start a query over a streaming frame of entries; ``interval_s`` None takes what is there and ends.

    Fresh articles are enriched by ``metadata``, as in ``run_cycle``. A cycle that fails is logged and the stream goes
    on; its entries aren't marked, so they count as fresh when the feed lists them again. Where nothing lists them again,
    as in a stream of a table, ``fail`` ends the query instead: started again, it takes the same batch. A batch that is
    run again overwrites its own marks.
    """

    def cycle(batch: DataFrame, batch_id: int) -> None:
        try:
            as_of = clock()
            done = run_cycle(batch, providers, seen.read(), sinks, send, as_of, ttl, metadata)
            seen.write(done.marks, batch_id)
            seen.sweep(as_of)
            if on_cycle:
                on_cycle(done, batch_id)
        except Exception:
            log.exception("cycle %s failed", batch_id)
            if fail:
                raise

    w = entries.writeStream.foreachBatch(cycle).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if interval_s is None else w.trigger(processingTime=f"{interval_s} seconds")
    return w.start()
