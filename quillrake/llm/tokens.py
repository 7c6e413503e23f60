"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import functools
import os
from collections.abc import Iterator

import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import workdir, written

#: Vocabulary file, as ranks: a byte-level BPE.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"

#: Fixed value: how that vocabulary's tokenizer cuts texts before it merges bytes.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _here(path: str) -> str:
    """Where this process has the vocabulary: at its own path, or where Spark put the driver's copy."""
    return path if os.path.exists(path) else SparkFiles.get(os.path.basename(path))


@functools.lru_cache(maxsize=2)
def encoder(path: str):
    import tiktoken

    with open(_here(path), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("from-file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(text: str | None, path: str = TOKENIZER) -> int:
    """Tokens of a text; 0 for None and ''."""
    return len(encoder(path).encode_ordinary(text)) if text else 0


def token_count(text: Column, path: str = TOKENIZER) -> Column:
    """Tokens of a text column; NULL and empty texts have none. Whole texts are read, in Arrow batches.

    The vocabulary goes to the executors with the application's files, for those that don't have it at ``path``.
    """
    spark = SparkSession.getActiveSession()
    if spark is not None and os.path.exists(path):
        spark.sparkContext.addFile(path)

    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield b.map(lambda t: count_tokens(t, path)).astype("int64")

    return F.pandas_udf(count, T.LongType())(F.coalesce(text, F.lit("")))


def told_apart(sizes: DataFrame, step: int = 100_000) -> DataFrame:
    """``sizes`` with ``copy bigint``: rows that are equal in all columns are numbered from 0.

    What is ordered or hashed by all columns then depends neither on the files nor on the number of tasks. Equal rows
    collapse in the map-side half of the aggregate and are written out again ``step`` at a time, in several tasks.
    """
    own = [F.col(f"`{c}`") for c in sizes.columns]
    n = written(sizes.groupBy(*own).agg(F.count("*").alias("qt_n")), workdir(sizes.sparkSession, "copies"))
    first = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("qt_n") - 1, F.lit(step).cast("bigint"))).alias("qt_first")
    many = n.filter(F.col("qt_n") > step).select(*own, "qt_n", first).repartition(F.col("qt_first"), F.col("qt_n"))
    parts = n.filter(F.col("qt_n") <= step).select(*own, "qt_n", F.lit(0).cast("bigint").alias("qt_first")).unionByName(many)
    last = F.least(F.col("qt_n"), F.col("qt_first") + step) - 1
    return parts.select(*own, F.explode(F.sequence("qt_first", last)).alias("copy"))
