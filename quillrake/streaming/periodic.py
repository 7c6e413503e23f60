"""Cycles by the clock: the first at once, then one per interval, never two at a time."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

log = logging.getLogger("quillrake")


def every(spark: SparkSession, cycle: Callable[[int], None], interval_s: int, checkpoint: str) -> StreamingQuery:
    """Run ``cycle(batch number)`` on the ticks of a stream; a failing cycle is logged and the next one comes.

    Ticks that come due while a cycle runs collapse into one. ``query.stop()`` ends it.
    """

    def tick(_, number: int) -> None:
        try:
            cycle(number)
        except Exception:
            log.exception("cycle %s failed", number)

    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load().limit(1)
    return ticks.writeStream.foreachBatch(tick).option("checkpointLocation", checkpoint).trigger(processingTime=f"{interval_s} seconds").start()
