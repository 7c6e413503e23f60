"""Sources mixed to target weights by Sainte-Laguë apportionment of equal-token blocks."""

from __future__ import annotations

import heapq
import math
import random

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import workdir, written
from .tokens import TOKENIZER, told_apart, token_count

#: Tokens of a block; and of a shard, which one task orders and selects from.
BLOCK_TOKENS, SHARD_TOKENS = 256, 4_000_000


def sainte_lague(weights: list[float], caps: list[int], seats: int) -> list[int]:
    """Seats for each weight by highest quotients weight / (2 s + 1), none beyond its cap; ties go to the earlier one.

    Gives out ``min(seats, sum of the caps of positive weights)``. A divisor below the final one is found by bisection,
    so the time doesn't grow with the seats; the rest is given out quotient by quotient.
    """
    caps = [c if w > 0 else 0 for w, c in zip(weights, caps, strict=True)]
    seats = min(seats, sum(caps))
    if seats <= 0:
        return [0] * len(weights)
    held = lambda d: [min(c, int(w / d + 0.5)) for w, c in zip(weights, caps, strict=True)]
    lo, hi = 0.0, 4 * max(weights) + 1e-300  # at hi nobody has a seat
    for _ in range(200):
        mid = (lo + hi) / 2
        if mid <= 0 or sum(held(mid)) > seats - len(weights):
            lo = mid
        else:
            hi = mid
    out = held(hi)
    heap = [(-w / (2 * s + 1), i) for i, (w, s, c) in enumerate(zip(weights, out, caps, strict=True)) if s < c]
    heapq.heapify(heap)
    for _ in range(seats - sum(out)):
        _, i = heapq.heappop(heap)
        out[i] += 1
        if out[i] < caps[i]:
            heapq.heappush(heap, (-weights[i] / (2 * out[i] + 1), i))
    return out


def cut_blocks(sizes: list[int], block_tokens: int) -> list[tuple[int, int, int, int]]:
    """Documents (in order) laid end to end and cut into blocks of equal tokens: (document, block, token_from, token_to).

    What remains after the last whole block is in none.
    """
    out, at, end = [], 0, sum(sizes) // block_tokens * block_tokens
    for k, n in enumerate(sizes):
        done, n = 0, min(n, end - at)
        while done < n:
            block = at // block_tokens
            take = min(n - done, (block + 1) * block_tokens - at)
            out.append((k, block, done, done + take))
            done += take
            at += take
    return out


def draw(blocks: int, quota: int, key: str) -> list[int]:
    """How often each block is used: as many full passes as fit, then the blocks that the key's order has first."""
    if blocks <= 0:
        return []
    passes, rest = divmod(quota, blocks)
    order = list(range(blocks))
    random.Random(key).shuffle(order)
    out = [passes] * blocks
    for b in order[:rest]:
        out[b] += 1
    return out


def mix(docs: DataFrame, targets: list[tuple[str, float, int]], total_tokens: int | None = None, seed: int = 17, block_tokens: int = BLOCK_TOKENS, shard_tokens: int = SHARD_TOKENS) -> tuple[DataFrame, DataFrame]:
    """Mix documents (doc_id, source, n_tokens) to target shares of tokens.

    ``targets``: (source, share, max_repeats), how often a document may be used in all. ``total_tokens``: size of the
    mixture; by default the largest at which every source that has a block reaches its share. Beyond that, sources at
    their cap fall short and the others fill up in proportion.

    A source's documents are spread over shards, laid end to end there in seeded order, and cut into blocks of equal
    tokens; what remains of a shard after its last block isn't used. Blocks are apportioned to sources, and a source's
    to its shards, and each shard draws its own in seeded order, so a source has its quota to the token and long
    documents are drawn as much as short ones.

    Returns (mixture, shares). Mixture: one row per piece of a document used, (doc_id, source, shard, block, token_from,
    token_to, n_tokens, uses); n_tokens are the piece's and every use counts them once. Shares: one row per target,
    (source, target_share, tokens, actual_share, capped). Documents of other sources, with NULL sources or without
    tokens aren't used; repeated rows are documents of their own. The seed fixes the result, whatever the files and the
    number of tasks.
    """
    spark = docs.sparkSession
    root = workdir(spark, "mixture")
    named = {s: (float(w), int(r)) for s, w, r in targets if w is not None and w > 0 and r is not None and r > 0}
    kept = docs.filter(F.col("source").isin(list(named)) & (F.col("n_tokens") > 0)).select("doc_id", "source", F.col("n_tokens").cast("bigint").alias("n_tokens"))
    kept = written(told_apart(kept), f"{root}/sizes")
    sizes = {r.source: r.t for r in kept.groupBy("source").agg(F.sum("n_tokens").alias("t")).collect()}  # one row per target
    shards = {s: max(1, math.ceil(t / shard_tokens)) for s, t in sizes.items()}
    per_source = spark.createDataFrame([(s, n) for s, n in shards.items()], "source string, shards int")
    placed = kept.join(F.broadcast(per_source), "source")  # as many rows as targets
    placed = placed.select("doc_id", "source", "n_tokens", "copy", F.xxhash64("doc_id", "n_tokens", "copy", F.lit(seed)).alias("h"), "shards")
    placed = placed.withColumn("shard", F.pmod(F.shiftright("h", 20), F.col("shards")).cast("int")).drop("shards")
    placed = written(placed, f"{root}/placed")
    held = placed.groupBy("source", "shard").agg(F.floor(F.sum("n_tokens") / block_tokens).alias("blocks"))
    limit = {s: r for s, (_, r) in named.items()}
    room = F.create_map(*[F.lit(x) for s, r in limit.items() for x in (s, r)]) if limit else F.create_map(F.lit(""), F.lit(0))
    held = written(held.withColumn("cap", F.col("blocks") * F.element_at(room, F.col("source"))), f"{root}/held")
    caps_of = {r.source: r.n for r in held.groupBy("source").agg(F.sum("cap").alias("n")).collect()}
    there = sorted(s for s, n in caps_of.items() if n > 0)
    weights, caps = [named[s][0] for s in there], [caps_of[s] for s in there]
    norm = sum(weights) or 1.0
    most = math.floor(min((c * norm / w for c, w in zip(caps, weights, strict=True)), default=0))
    seats = max(most, len(there)) if total_tokens is None else round(total_tokens / block_tokens)
    quota = dict(zip(there, sainte_lague(weights, caps, seats), strict=True))

    def spread(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("shard")
        return pdf.assign(quota=sainte_lague(pdf["blocks"].astype(float).tolist(), pdf["cap"].astype(int).tolist(), quota.get(pdf["source"].iloc[0], 0)))[["source", "shard", "quota"]]

    quotas = held.groupBy("source").applyInPandas(spread, "source string, shard int, quota bigint")
    names = ["doc_id", "source", "shard", "block", "token_from", "token_to", "n_tokens", "uses"]

    def select(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        pdf = left.sort_values(["h", "doc_id", "n_tokens", "copy"])
        pieces = pd.DataFrame(cut_blocks(pdf["n_tokens"].astype(int).tolist(), block_tokens), columns=["at", "block", "token_from", "token_to"])
        uses = draw(int(pdf["n_tokens"].sum()) // block_tokens, int(right["quota"].iloc[0]) if len(right) else 0, f"{seed}/{key[0]}/{key[1]}")
        pieces = pieces.assign(uses=[uses[b] for b in pieces["block"]], n_tokens=pieces["token_to"] - pieces["token_from"], source=key[0], shard=key[1])
        pieces["doc_id"] = pdf["doc_id"].astype("Int64").iloc[pieces["at"]].array if len(pieces) else pd.array([], dtype="Int64")
        return pieces.loc[pieces["uses"] > 0, names]

    # One shard, whose tokens are bounded, in a task.
    mixture = placed.groupBy("source", "shard").cogroup(quotas.groupBy("source", "shard")).applyInPandas(select, "doc_id bigint, source string, shard int, block bigint, token_from bigint, token_to bigint, n_tokens bigint, uses int")
    mixture = written(mixture, f"{root}/mixture")
    used = mixture.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("uses")).alias("tokens"))
    goal = spark.createDataFrame([(s, None if x is None else float(x), quota.get(s, 0) >= caps_of.get(s, 0)) for s, x, _ in targets], "source string, target_share double, capped boolean")
    whole = mixture.agg(F.sum(F.col("n_tokens") * F.col("uses"))).first()[0] or 0
    shares = goal.join(F.broadcast(used), "source", "left").select("source", "target_share", F.coalesce("tokens", F.lit(0)).cast("bigint").alias("tokens"), (F.coalesce("tokens", F.lit(0)) / F.lit(float(max(whole, 1)))).alias("actual_share"), "capped")
    return mixture, shares


def _mixed(spark: SparkSession, sf_dir: str, tokenizer: str) -> tuple[DataFrame, DataFrame]:
    goal = spark.read.parquet(f"{sf_dir}/mix_targets.parquet").limit(10_001).collect()
    if len(goal) > 10_000:
        raise ValueError("more than 10000 sources")
    names = [r.source for r in goal]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").filter(F.col("source").isin(names))
    docs = docs.select("doc_id", "source", token_count(F.col("text"), tokenizer).alias("n_tokens"))
    return mix(docs, [(r.source, r.target_share, r.max_repeats) for r in goal])


def p9_mixture(spark: SparkSession, sf_dir: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """The mixture: pieces of documents with how often each is used."""
    return _mixed(spark, sf_dir, tokenizer)[0]


def p9_shares(spark: SparkSession, sf_dir: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """Target and actual share of each source."""
    return _mixed(spark, sf_dir, tokenizer)[1]
