"""Items of varying length packed into containers of fixed capacity: first-fit decreasing in randomised groups."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import workdir, written
from .tokens import TOKENIZER, told_apart, token_count

#: A group holds about this many tokens and at most about this many items, so that one task packs it in little memory.
GROUP_TOKENS, GROUP_ITEMS = 4_000_000, 40_000


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """Container of each item (sizes of at most ``capacity``): largest items first, each into the first that has room.

    A tournament tree over the containers holds the largest room below each node, so the leftmost fit is found by one
    descent. Equal sizes keep their order.
    """
    if not sizes:
        return []
    # Containers are at least half full but for one, as two that aren't would have been one.
    width = 1 << max(0, (min(len(sizes), 2 * math.ceil(sum(sizes) / capacity) + 1) - 1).bit_length())
    room = [capacity] * (2 * width)
    out = [0] * len(sizes)
    for k in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        size, node = sizes[k], 1
        while node < width:
            node *= 2
            if room[node] < size:
                node += 1
        out[k] = node - width
        room[node] -= size
        node //= 2
        while node:
            left, right = room[2 * node], room[2 * node + 1]
            most = left if left >= right else right
            if room[node] == most:
                break
            room[node] = most
            node //= 2
    return out


def pack_group(ids: list, sizes: list[int], capacity: int) -> list[tuple]:
    """(id, piece, token_from, token_to, container) of a group; an item beyond the capacity is split into full pieces and a rest."""
    pieces, full = [], []
    for i, n in zip(ids, sizes, strict=True):
        whole = n // capacity if n > capacity else 0
        full += [(i, p, p * capacity, (p + 1) * capacity) for p in range(whole)]
        if n > whole * capacity or n == 0:
            pieces.append((i, whole, whole * capacity, n))
    at = first_fit_decreasing([b - a for _, _, a, b in pieces], capacity)
    used = max(at, default=-1) + 1
    return [(*p, c) for p, c in zip(pieces, at, strict=True)] + [(*p, used + k) for k, p in enumerate(full)]


def pack(items: DataFrame, specs: list[tuple[str, int]], seed: int = 17, group_tokens: int = GROUP_TOKENS, group_items: int = GROUP_ITEMS) -> DataFrame:
    """Assign items (doc_id bigint, n_tokens bigint) to containers of each spec (name, capacity).

    One row per piece: (spec, grp, container, doc_id, piece, token_from, token_to); a container is (spec, grp,
    container). Only an item larger than the capacity has several pieces. Items without tokens, NULL sizes among them,
    take no room and come out too. Repeated ids are items of their own. No items or specs, no rows. Capacities must be
    positive. The seed fixes the result, whatever the files and the number of tasks.
    """
    spark = items.sparkSession
    if any(c is None or c <= 0 for _, c in specs):
        raise ValueError("capacities must be positive")
    schema = "spec string, grp int, container bigint, doc_id bigint, piece int, token_from bigint, token_to bigint"
    if not specs:
        return spark.createDataFrame([], schema)
    items = items.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("n_tokens"), F.lit(0)).cast("bigint").alias("n_tokens"))
    items = written(told_apart(items), workdir(spark, "sizes"))
    total, n = items.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)), F.count("*")).first()
    groups = max(1, math.ceil(total / group_tokens), math.ceil(n / group_items))
    grp = F.pmod(F.xxhash64("doc_id", "copy", F.lit(seed)), F.lit(groups)).cast("int")
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("spec"), F.lit(int(c)).cast("bigint").alias("capacity")) for s, c in specs]))
    rows = items.select("doc_id", "n_tokens", grp.alias("grp"), each.alias("s")).select("doc_id", "n_tokens", "grp", "s.spec", "s.capacity")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "n_tokens"], kind="stable")
        ids = [None if pd.isna(x) else int(x) for x in pdf["doc_id"]]
        out = pd.DataFrame(pack_group(ids, pdf["n_tokens"].astype(int).tolist(), int(pdf["capacity"].iloc[0])), columns=["doc_id", "piece", "token_from", "token_to", "container"])
        out["doc_id"] = out["doc_id"].astype("Int64")
        return out.assign(spec=pdf["spec"].iloc[0], grp=int(pdf["grp"].iloc[0]))[["spec", "grp", "container", "doc_id", "piece", "token_from", "token_to"]]

    return rows.groupBy("spec", "capacity", "grp").applyInPandas(run, schema)


def _specs(spark: SparkSession, sf_dir: str) -> list[tuple[str, int]]:
    rows = spark.read.parquet(f"{sf_dir}/container_sizes.parquet").select("spec", "capacity_tokens").limit(1001).collect()
    if len(rows) > 1000:
        raise ValueError("more than 1000 kinds of containers")
    return [(r.spec, r.capacity_tokens) for r in rows]


def p8_assignments(spark: SparkSession, sf_dir: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """Every document, measured in tokens, in containers of each capacity."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", token_count(F.col("text"), tokenizer).alias("n_tokens"))
    return pack(docs, _specs(spark, sf_dir))


def p8_fill(spark: SparkSession, sf_dir: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """Of each capacity: containers used, the fewest that could do, tokens and the share of room that is used."""
    sizes = spark.createDataFrame(_specs(spark, sf_dir), "spec string, capacity bigint")
    rows = p8_assignments(spark, sf_dir, tokenizer).groupBy("spec", "grp", "container").agg(F.sum(F.col("token_to") - F.col("token_from")).alias("used"))
    out = rows.groupBy("spec").agg(F.count("*").alias("containers"), F.sum("used").alias("tokens")).join(sizes, "spec")
    return out.select("spec", "capacity", "containers", "tokens", F.ceil(F.col("tokens") / F.col("capacity")).alias("fewest"), (F.col("tokens") / (F.col("containers") * F.col("capacity"))).alias("fill"))
