"""Articles published before: a table of marks with expiry, read by an anti join and written by appends."""

from __future__ import annotations

import json
import logging
import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import SEEN
from ..session import delete_path, small

log = logging.getLogger("quillrake")


def alive(seen: DataFrame, as_of: int) -> DataFrame:
    """Keys (article_id) whose last mark expires after ``as_of`` (Unix seconds); the later expiry of a key holds."""
    return seen.groupBy("article_id").agg(F.max("expires_at").alias("expires_at")).filter(F.col("expires_at") > as_of)


def fresh(articles: DataFrame, seen: DataFrame, as_of: int) -> DataFrame:
    """Articles whose ``id`` has no mark alive at ``as_of``; rows of one id stay as many as they are.

    The keys are broadcast if their summed size allows it; else the join shuffles both sides, and adaptive execution
    splits hot ids. Keys that are marked several times do no harm, so the table isn't made distinct before.
    """
    keys = small(seen.filter(F.col("expires_at") > as_of).select(F.col("article_id").alias("id")))
    return articles.join(keys, "id", "left_anti").select(*[F.col(f"`{c}`") for c in articles.columns])


def marks(deliveries: DataFrame, as_of: int, ttl: int) -> DataFrame:
    """Marks for the articles that at least one sink took: (article_id, expires_at)."""
    return deliveries.filter("ok").select("article_id").distinct().withColumn("expires_at", F.lit(int(as_of) + int(ttl)).cast("bigint"))


@dataclass
class SeenTable:
    """Marks below ``root``, one folder per batch, so that a batch that is run again overwrites its own marks only.

    ``strict``: a table that can't be read fails the cycle. Otherwise that is logged and every article counts as fresh.
    """

    spark: SparkSession
    root: str
    cleanup_interval: int = 43_200
    strict: bool = False
    swept_at: int = field(default_factory=lambda: int(time.time()))

    def _paths(self) -> list[str]:
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.root)
        fs = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return []
        found = [s.getPath() for s in fs.listStatus(root) if s.isDirectory() and s.getPath().getName().startswith("batch=")]
        return sorted(str(p) for p in found if fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def read(self) -> DataFrame:
        """All marks; where they can't be read an empty table and a log line, or the error if ``strict``."""
        try:
            paths = self._paths()
            if paths:
                return self.spark.read.schema(SEEN).parquet(*paths)
        except Exception:
            if self.strict:
                raise
            log.exception("seen table can't be read")
        return self.spark.createDataFrame([], SEEN)

    def write(self, new: DataFrame, batch: int) -> None:
        new.select("article_id", "expires_at").write.mode("overwrite").parquet(f"{self.root}/batch={batch:012d}")

    def sweep(self, as_of: int) -> bool:
        """Rewrite the marks without expired ones, at most once per interval; tells whether it did."""
        if as_of - self.swept_at < self.cleanup_interval:
            return False
        old = self._paths()
        if old:
            target = f"{self.root}/batch={int(old[-1].rpartition("=")[2].partition("-")[0]):012d}-swept-{as_of}"
            alive(self.spark.read.schema(SEEN).parquet(*old), as_of).write.mode("overwrite").parquet(target)
            for p in old:
                delete_path(self.spark, p)
        self.swept_at = as_of
        return True


    def close(self) -> None:
        """Nothing is held open."""


class NoSeenTable:
    """Remembers nothing."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def read(self) -> DataFrame:
        return self.spark.createDataFrame([], SEEN)

    def write(self, new: DataFrame, batch: int) -> None:
        """Nothing is kept."""

    def sweep(self, as_of: int) -> bool:
        return False

    def close(self) -> None:
        """Nothing is held open."""


def open_seen(spark: SparkSession, kind: str, path: str = "", cleanup_interval: int = 43_200) -> SeenTable | NoSeenTable:
    """Store of a kind: '', 'none' and 'disabled' remember nothing; 'parquet' needs a path."""
    kind = (kind or "").strip().lower()
    if kind in ("", "none", "disabled"):
        return NoSeenTable(spark)
    if kind == "parquet":
        if not (path or "").strip():
            raise ValueError("the seen table needs a path")
        return SeenTable(spark, path.strip().rstrip("/"), cleanup_interval)
    raise ValueError(f"unknown kind of seen table {json.dumps(kind)}")
