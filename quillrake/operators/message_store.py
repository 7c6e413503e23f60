"""Exactly one copy of each message that was delivered at least once.

``MessageStore`` keeps the winners in partitions by a column of the messages (the period of receipt, say), beside an
index from message identifiers to partitions. A batch looks up the partitions that hold its identifiers, combines
their rows with its own, recomputes one winner per message and overwrites only those partitions: each new version is
written to a folder of its own, and replacing the manifest file puts all of them into force at once.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import BROADCAST_LIMIT_BYTES, delete_path, exclusive, hadoop_path, read_json, replace_json, workdir, written
from .moments import with_instants


@dataclass
class MessageStore:
    """A store below ``root`` (a path on the shared file system), with one writer at a time and any number of readers.

    ``key``: the columns that identify a message; a row with NULL in one of them equals no other and is kept.
    ``order``: a column without repeats; of equal messages the one with the smallest value wins, whenever it comes.
    ``part``: the string column that says in which partition a message lies; NULL is a partition of its own.
    ``buckets``: parts of the index, by hash; some million identifiers each. A batch opens those of its identifiers.
    ``index_files``: batches whose index entries lie side by side; more are merged into one.
    ``keep``: batches for which replaced files stay, for readers that opened an older manifest.
    """

    spark: SparkSession
    root: str
    key: tuple[str, ...]
    order: str
    part: str
    buckets: int = 16
    index_files: int = 8
    keep: int = 2
    state: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        empty = {"batch": 0, "buckets": self.buckets, "parts": {}, "index": {}, "dropped": [], "retired": []}
        self.state = read_json(self.spark, f"{self.root}/manifest.json") or empty

    def _key_hash(self) -> Column:
        return F.xxhash64(*[F.col(k).cast("string") for k in self.key])

    def _bucket(self) -> Column:
        return F.pmod("key_hash", F.lit(self.state["buckets"])).cast("int")

    def messages(self) -> DataFrame | None:
        """The winners; None while the store is empty."""
        paths = sorted({p for versions in self.state["parts"].values() for p in versions})
        return self._read(paths)

    def _read(self, paths: list[str]) -> DataFrame | None:
        # Files have the columns of their batch; the schema is that of the latest one and saves a look into each.
        return self.spark.read.schema(T.StructType.fromJson(self.state["schema"])).parquet(*paths) if paths else None

    def dropped(self) -> DataFrame:
        """The copies that lost: (order column, partition column, batch that dropped them)."""
        paths = self.state["dropped"]
        if paths:
            return self.spark.read.parquet(*paths)
        return self.spark.createDataFrame([], f"{self.order} bigint, batch bigint")

    def _written_by(self, rows: DataFrame, column: str, path: str) -> dict[str, str]:
        """Write rows to one folder per value of a column; the folders by value, NULL as '' and others after '='.

        Small values share a task and large ones are split, so a folder has few files however its rows are spread.
        """
        rows.hint("rebalance", column).write.mode("overwrite").partitionBy(column).parquet(path)
        at, fs = hadoop_path(self.spark, path)
        names = [s.getPath().getName() for s in fs.listStatus(at)]
        found = {n: n.removeprefix(f"{column}=") for n in names if n.startswith(f"{column}=")}
        return {"" if v == "__HIVE_DEFAULT_PARTITION__" else f"={v}": f"{path}/{n}" for n, v in found.items()}

    def _affected(self, own: dict[str, str]) -> list[str]:
        """Partitions that may hold a message of a batch, whose own index lies in the folders ``own`` by bucket.

        Only these buckets are opened, and the index isn't shuffled while the batch's identifiers can be broadcast.
        """
        paths = self.index_paths(own)
        if not paths:
            return []
        schema = f"key_hash bigint, `{self.part}` string"
        ids = self.spark.read.schema(schema).parquet(*own.values()).select("key_hash")
        ids = F.broadcast(ids) if ids.count() * 64 <= BROADCAST_LIMIT_BYTES else ids  # a hash table's entry takes some 50 bytes
        hits = self.spark.read.schema(schema).parquet(*paths).join(ids, "key_hash", "left_semi").select(self.part).distinct()
        return sorted("" if r[0] is None else f"={r[0]}" for r in hits.collect())  # partitions: a bounded number

    def index_paths(self, buckets: Iterable[str]) -> list[str]:
        """Folders of the index that hold earlier identifiers of some buckets."""
        return sorted(p for b in buckets for p in self.state["index"].get(b, []))

    def _merged_index(self, state: dict, n: int) -> None:
        """Merge the index's folders where too many lie side by side."""
        if max((len(p) for p in state["index"].values()), default=0) <= self.index_files:
            return
        old = [p for paths in state["index"].values() for p in paths]
        rows = self.spark.read.schema(f"key_hash bigint, `{self.part}` string").parquet(*old).distinct()
        found = self._written_by(rows.withColumn("qr_bucket", self._bucket()), "qr_bucket", f"{self.root}/index/merged-{n}")
        state["index"] = {b: [p] for b, p in found.items()}
        state["retired"] += [[n, p] for p in old]

    def ingest(self, batch: DataFrame) -> list[str]:
        """Take a batch in; returns the partitions that had versions before and were rewritten.

        Keys are shuffled, and the rows that are written are gathered by partition. The messages themselves are
        filtered by the ids of the losers, which are broadcast while their counted size allows it and joined by a
        shuffle beyond that. Fails if another writer is at work. A batch that fails leaves the store as it was.
        """
        with exclusive(self.spark, f"{self.root}/writer.lock"):
            return self._ingest(batch)

    def _ingest(self, batch: DataFrame) -> list[str]:
        n = self.state["batch"] + 1
        landed = f"{self.root}/incoming/batch-{n}"
        batch = written(batch, landed)  # read several times below
        keyed = F.lit(True)
        for k in self.key:
            keyed = keyed & F.col(k).isNotNull()
        index_rows = batch.filter(keyed).select(self._key_hash().alias("key_hash"), self.part).distinct()
        own = self._written_by(index_rows.withColumn("qr_bucket", self._bucket()), "qr_bucket", f"{self.root}/index/batch-{n}")
        affected = self._affected(own)
        old_paths = sorted({p for a in affected for p in self.state["parts"].get(a, [])})
        old = self._read(old_paths)
        rows = batch if old is None else batch.unionByName(old, allowMissingColumns=True)
        keys = rows.filter(keyed).select(*self.key, self.order)
        # A hot message collapses in the map-side half of this aggregate.
        winners = keys.groupBy(*self.key).agg(F.min(self.order).alias(self.order))
        losers = keys.select(self.order).join(winners.select(self.order), self.order, "left_anti")
        lost_path = f"{self.root}/dropped/batch-{n}"
        losers.withColumn("batch", F.lit(n).cast("bigint")).write.mode("overwrite").parquet(lost_path)
        lost = self.spark.read.parquet(lost_path).select(self.order)
        lost = F.broadcast(lost) if lost.count() * 64 <= BROADCAST_LIMIT_BYTES else lost
        # Rows of the affected partitions that lie in them go to new versions; every other partition is only added to.
        kept = rows.join(lost, self.order, "left_anti").withColumn("qr_part", F.col(self.part))
        state = json.loads(json.dumps(self.state))
        state["retired"] += [[n, p] for a in affected for p in state["parts"].pop(a, [])]
        for label, path in self._written_by(kept, "qr_part", f"{self.root}/data/batch-{n}").items():
            state["parts"].setdefault(label, []).append(path)
        for label, path in own.items():
            state["index"].setdefault(label, []).append(path)
        self._merged_index(state, n)
        state |= {"batch": n, "schema": rows.schema.jsonValue(), "dropped": [*state["dropped"], lost_path]}
        gone = [p for at, p in state["retired"] if at <= n - self.keep]
        state["retired"] = [[at, p] for at, p in state["retired"] if at > n - self.keep]
        replace_json(self.spark, f"{self.root}/manifest.json", state)
        self.state = state
        for path in [*gone, landed]:
            delete_path(self.spark, path)
        return [a for a in affected if a.removeprefix("=")]


def deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of ``harvest_events`` with the message's identifier: provider, article id and instant of collection."""
    e = spark.read.parquet(f"{sf_dir}/harvest_events.parquet")
    e = e.withColumn("article_id", F.col("article.id")).withColumn("receipt_period", F.date_format(F.date_trunc("day", "received_at"), "yyyy-MM-dd"))
    read = with_instants(e, "collected_at", spark.read.parquet(f"{sf_dir}/providers.parquet"))
    return read.withColumnRenamed("utc_ms", "collected_ms").drop("moment_status")


def replay(spark: SparkSession, sf_dir: str, batches: int = 4, columns: tuple[str, ...] = ()) -> MessageStore:
    """Take all of ``harvest_events`` into a fresh store, as ``batches`` batches of receipt cycles of equal number.

    Rows without a cycle come with the last batch. ``columns``: what is stored of a message beside its identifier, order and period.
    """
    store = MessageStore(spark, workdir(spark, "messages"), ("provider_id", "article_id", "collected_ms"), "delivery_id", "receipt_period")
    rows = deliveries(spark, sf_dir)
    lo, hi = spark.read.parquet(f"{sf_dir}/harvest_events.parquet").agg(F.min("batch_no"), F.max("batch_no")).first()
    names = [*store.key, store.order, store.part, *columns]
    edges = [] if lo is None else [lo + (hi + 1 - lo) * i // batches for i in range(1, batches)]
    cycle = F.col("batch_no")
    number = sum([(cycle >= x).cast("int") for x in edges], F.lit(0))
    number = F.when(cycle.isNull(), len(edges)).otherwise(number)
    for k in range(len(edges) + 1):
        store.ingest(rows.filter(number == k).select(*dict.fromkeys(names)))
    return store


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deliveries of messages that an earlier delivery already brought: the copies that the store dropped."""
    return replay(spark, sf_dir).dropped().select("delivery_id")


def p2_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exactly one delivery of each message, with the fields of its article."""
    kept = replay(spark, sf_dir, columns=("provider_name", "article", "collected_at", "received_at")).messages()
    if kept is None:
        return spark.createDataFrame([], "delivery_id bigint, provider_id string, article_id string, collected_ms bigint, title string, url string")
    return kept.select("delivery_id", "provider_id", "article_id", "collected_ms", F.col("article.title").alias("title"), F.col("article.url").alias("url"))
