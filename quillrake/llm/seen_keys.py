"""Has this key been seen before? Filter, then verify.

``KeyStore`` keeps the full keys of earlier records on disk, in hash buckets, and beside them a blocked Bloom filter
of a fixed number of bits a key, however many keys there are. The filter is broadcast in parts of bounded size, one at
a time. Records that it refuses are new for certain and go no further. The others are shuffled to the buckets' full
keys and looked up exactly; the keys on disk stay where they are. Every positive that the lookup disproves is logged.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import utrim
from ..session import delete_path, read_json, replace_json, workdir, written

#: Bits of the filter for each key (four of them are set); most bytes of it that are broadcast at a time.
BITS_PER_KEY, PART_BYTES = 16, 32 << 20

#: Keys of one bucket on disk, about, in a new store.
BUCKET_KEYS = 4_000_000


@dataclass
class Answers:
    """``found``: (row_id) of records seen before; ``errors``: (row_id, key, reason) of disproved positives;
    ``counts``: records, positives, found, and disproved by reason, as numbers."""

    found: DataFrame
    errors: DataFrame
    counts: dict[str, int]

    @property
    def error_rate(self) -> float:
        """Share of wrong answers that the filter gave for records whose key neither occurred before nor comes again."""
        c = self.counts
        negatives = c["records"] - c["found"] - c["first_of_several"]
        return c["hash_collision"] / negatives if negatives else 0.0


def _high(h: Column) -> Column:
    """The upper 32 bits of a hash: they pick the word of a filter, whatever its size."""
    return F.shiftrightunsigned(h, 32)


def _mask(h: Column) -> Column:
    """Four bits of a word, by the lower bits of a hash."""
    bit = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(h, 6 * k).bitwiseAND(F.lit(63).cast("long")).cast("int"))
    return bit(0).bitwiseOR(bit(1)).bitwiseOR(bit(2)).bitwiseOR(bit(3))


def _word(high: Column, words: int) -> Column:
    return F.shiftright(high * F.lit(words).cast("long"), 32)


@dataclass
class Filter:
    """(word, mask) rows of a written Bloom filter of ``words`` 64-bit words, those without bits left out."""

    path: str
    words: int

    @classmethod
    def of(cls, hashes: DataFrame, keys: int, path: str) -> Filter:
        """Write a filter of a column ``h``."""
        words = max(1, -(-keys * BITS_PER_KEY // 64))
        rows = hashes.select(_word(_high(F.col("h")), words).alias("word"), _mask(F.col("h")).alias("mask"))
        rows.groupBy("word").agg(F.bit_or("mask").alias("mask")).sortWithinPartitions("word").write.mode("overwrite").parquet(path)
        return cls(path, words)

    def part(self, spark: SparkSession, k: int, parts: int) -> tuple[int, np.ndarray]:
        """First word and words of the k-th part: a ``parts``-th of the filter, which the caller keeps small."""
        lo, hi = (((1 << 32) * k // parts) * self.words) >> 32, ((((1 << 32) * (k + 1) // parts) - 1) * self.words) >> 32
        got = spark.read.schema("word bigint, mask bigint").parquet(self.path).filter(F.col("word").between(lo, hi)).toPandas()
        out = np.zeros(hi - lo + 1, dtype=np.int64)
        out[got["word"].to_numpy(dtype=np.int64) - lo] = got["mask"].to_numpy(dtype=np.int64)
        return lo, out


@dataclass
class KeyStore:
    """Earlier keys below ``root`` (on the shared file system), which opens again with what it held.

    ``buckets``: hash buckets of the keys on disk, fixed when the store is made. ``part_bytes``: most bytes of filters
    that are broadcast at a time; it bounds memory and changes no answer.
    """

    spark: SparkSession
    root: str
    buckets: int = 16
    part_bytes: int = PART_BYTES
    state: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.state = read_json(self.spark, f"{self.root}/state.json") or {"runs": 0, "buckets": self.buckets, "keys": 0, "filters": []}

    def _table(self) -> str:
        """Name of the table of keys in this session's catalogue, which knows how its files are bucketed."""
        name = f"quillrake_keys_{hashlib.md5(self.root.encode()).hexdigest()}"
        if not self.spark.catalog.tableExists(name):
            self.spark.sql(f"CREATE TABLE {name} (key STRING) USING parquet CLUSTERED BY (key) SORTED BY (key) INTO {self.state['buckets']} BUCKETS LOCATION '{self.root}/keys'")
        return name

    def keys(self) -> DataFrame:
        """All keys that were added, repeats too."""
        return self.spark.read.table(self._table())

    def add(self, keys: DataFrame) -> None:
        """Add a column ``key``; NULL is none. Each key is shuffled once in its life: here, to its bucket.

        The filter of what is added lies beside the earlier ones; more than eight are made into one. What a failed add
        leaves behind are keys without a filter; adding them again puts that right, as repeats do no harm.
        """
        run = self.state["runs"] + 1
        new = keys.select("key").filter("key IS NOT NULL")
        rows = new.repartition(self.state["buckets"], "key")
        rows.write.mode("append").bucketBy(self.state["buckets"], "key").sortBy("key").format("parquet").saveAsTable(self._table())
        filters = [Filter(*f) for f in self.state["filters"]]
        if len(filters) < 8:
            filters.append(self._filter(new, run))
        else:
            old, filters = filters, [self._filter(self.keys(), run)]
            for f in old:
                delete_path(self.spark, f.path)
        self.state |= {"runs": run, "filters": [[f.path, f.words] for f in filters]}
        replace_json(self.spark, f"{self.root}/state.json", self.state)

    def _filter(self, keys: DataFrame, run: int) -> Filter:
        hashes = written(keys.select(F.xxhash64("key").alias("h")), f"{self.root}/hashes-{run}")
        made = Filter.of(hashes, hashes.count(), f"{self.root}/filter-{run}")
        delete_path(self.spark, f"{self.root}/hashes-{run}")
        return made

    def look_up(self, incoming: DataFrame) -> Answers:
        """For each record of ``incoming`` (row_id bigint without repeats, key string): did its key occur before?

        Before means: in the store, whose keys may repeat, or in a record with a smaller row_id. A NULL key is never
        seen; other columns are ignored. Empty tables give no findings. The store stays as it is.

        Which keys come several times among the incoming records themselves is told from their 64-bit hashes, the only
        thing of refused records that is shuffled (copies collapse on the map side); those hashes make one more filter.
        """
        spark, root = self.spark, workdir(self.spark, "seen")
        rows = incoming.select("row_id", "key", F.xxhash64("key").alias("h")).filter("key IS NOT NULL")
        rows = written(rows, f"{root}/incoming")
        again = written(rows.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h"), f"{root}/again")
        n = again.count()
        filters = [Filter(*f) for f in self.state["filters"]] + ([Filter.of(again, n, f"{root}/again-filter")] if n else [])
        parts = max(1, -(-sum(f.words for f in filters) * 8 // self.part_bytes))
        high = _high(F.col("h"))
        if parts > 1:  # the records of a part of the filter lie in a folder of their own; nothing is shuffled for that
            rows.withColumn("part", F.shiftright(high * F.lit(parts).cast("long"), 32)).write.partitionBy("part").parquet(f"{root}/parts")
            rows = spark.read.schema("row_id bigint, key string, h bigint, part bigint").parquet(f"{root}/parts")
        for k in range(parts if filters else 0):
            own = rows.filter(F.col("part") == k) if parts > 1 else rows
            held = spark.sparkContext.broadcast([f.part(spark, k, parts) for f in filters])
            hit = F.pandas_udf(_probe(held), T.BooleanType())(_mask(F.col("h")), *[_word(high, f.words) for f in filters])
            own.filter(hit).select("row_id", "key").write.mode("overwrite").parquet(f"{root}/positives/run={k}")
            held.destroy()
        if not filters:
            rows.limit(0).select("row_id", "key").write.parquet(f"{root}/positives/run=0")
        positives = spark.read.schema("row_id bigint, key string").parquet(*[f"{root}/positives/run={k}" for k in range(parts if filters else 1)])
        # All records of a repeated key are positives, so the smallest row_id among them is the key's first. Hot keys
        # collapse in the map-side half of this aggregate, and the joins below are on values without repeats.
        firsts = positives.groupBy("key").agg(F.min("row_id").alias("row_id"), F.count("*").alias("n"))
        disproved = verified(firsts, self.keys()) if self.state["runs"] else firsts
        reason = F.when(F.col("n") > 1, "first_of_several").otherwise("hash_collision").alias("reason")
        errors = written(disproved.select("row_id", "key", reason), f"{root}/errors")
        found = written(positives.join(errors.select("row_id"), "row_id", "left_anti").select("row_id"), f"{root}/found")
        reasons = {r.reason: r["count"] for r in errors.groupBy("reason").count().collect()}
        counts = {"records": incoming.count(), "positives": positives.count(), "found": found.count()}
        return Answers(found, errors, counts | {k: reasons.get(k, 0) for k in ("first_of_several", "hash_collision")})


def _probe(held):
    """Whether the mask of each record is in a filter, given its word in each of the broadcast parts of filters."""

    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        tables = held.value
        for m, *words in batches:
            mask, hit = m.to_numpy(), np.zeros(len(m), dtype=bool)
            for (lo, table), w in zip(tables, words, strict=True):
                hit |= (table[w.to_numpy() - lo] & mask) == mask
            yield pd.Series(hit)

    return run


def verified(firsts: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows of ``firsts`` whose key isn't among the bucketed ``keys``, which are read bucket by bucket as they lie."""
    return firsts.join(keys.hint("shuffle_merge"), "key", "left_anti")


def seen_before(incoming: DataFrame, earlier: DataFrame, part_bytes: int = PART_BYTES) -> Answers:
    """``KeyStore.look_up`` of ``incoming`` (row_id, key) in a fresh store of the keys of ``earlier`` (key string)."""
    spark = incoming.sparkSession
    earlier = earlier.select("key")
    buckets = 1 << max(4, (earlier.count() // BUCKET_KEYS).bit_length())
    store = KeyStore(spark, workdir(spark, "keys"), buckets, part_bytes)
    store.add(earlier)
    return store.look_up(incoming)


def article_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = spark.read.parquet(f"{sf_dir}/articles.parquet")
    blank = F.col("id").isNull() | (utrim(F.col("id")) == "")
    return a.select("row_id", F.when(blank, F.sha1(utrim(F.col("url")))).otherwise(F.col("id")).alias("key"))


def _answers(spark: SparkSession, sf_dir: str) -> Answers:
    seen = spark.read.parquet(f"{sf_dir}/seen_articles.parquet").select(F.col("article_id").alias("key"))
    return seen_before(article_keys(spark, sf_dir), seen)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Article rows whose key was published earlier or belongs to an earlier row."""
    return _answers(spark, sf_dir).found.select("row_id")


def p4_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the filter said wrongly before the lookup put it right: records, and the rate among true negatives."""
    a = _answers(spark, sf_dir)
    c = a.counts
    of_all = lambda k: c[k] / c["records"] if c["records"] else 0.0
    rows = [(k, c[k], of_all(k)) for k in ("records", "positives", "found", "first_of_several")]
    return spark.createDataFrame([*rows, ("hash_collision", c["hash_collision"], a.error_rate)], "what string, records bigint, rate double")


def p4_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of all records: those found, the first ones of keys that come again, and those whose key comes once and is new."""
    c = _answers(spark, sf_dir).counts
    once = c["records"] - c["found"] - c["first_of_several"]
    return spark.createDataFrame([("found", c["found"]), ("first_of_several", c["first_of_several"]), ("once", once)], "what string, records bigint")


P4_SQL = r"""
WITH k AS (SELECT row_id, CASE WHEN id IS NULL OR regexp_replace(id, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') = '' THEN sha1(regexp_replace(url, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')) ELSE id END AS key FROM articles),
f AS (SELECT key, min(row_id) AS first_id FROM k WHERE key IS NOT NULL GROUP BY key)
SELECT k.row_id FROM k JOIN f ON k.key = f.key WHERE k.row_id > f.first_id OR k.key IN (SELECT article_id FROM seen_articles)
"""

P4_COUNTS_SQL = (
    P4_SQL.strip().rpartition("SELECT k.row_id")[0]
    + """, g AS (SELECT k.row_id, k.key, k.row_id > f.first_id OR k.key IN (SELECT article_id FROM seen_articles) AS found, count(*) OVER (PARTITION BY k.key) AS n FROM k LEFT JOIN f ON k.key = f.key)
SELECT CASE WHEN found THEN 'found' WHEN n > 1 AND key IS NOT NULL THEN 'first_of_several' ELSE 'once' END AS what, count(*) AS records FROM g GROUP BY 1
"""
)
