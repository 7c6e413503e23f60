"""Slots of rate-limited requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def numbered(df: DataFrame, group: str, order: str, width: int = 100_000) -> DataFrame:
    """``df`` with ``n bigint``: the row's number within its group in the order of a bigint column, from 1.

    A group may hold most of the rows: it is numbered in ranges of ``width`` values of ``order``, and the ranges'
    counts are summed up first. Rows of equal order are numbered in any order; NULLs of ``order`` come first.
    """
    part = F.coalesce(F.floor(F.col(order) / width), F.lit(-(1 << 62)))
    rows = df.withColumn("qn_part", part)
    sizes = rows.groupBy(F.col(group).alias("qn_group"), F.col("qn_part").alias("qn_p")).agg(F.count("*").alias("qn_size"))
    before = W.partitionBy("qn_group").orderBy("qn_p").rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.select("qn_group", "qn_p", F.coalesce(F.sum("qn_size").over(before), F.lit(0)).alias("qn_before"))
    local = rows.withColumn("qn_local", F.row_number().over(W.partitionBy(group, "qn_part").orderBy(order)))
    j = local.join(sizes, F.col(group).eqNullSafe(F.col("qn_group")) & (F.col("qn_part") == F.col("qn_p")))
    return j.select(*[F.col(f"`{c}`") for c in df.columns], (F.col("qn_before") + F.col("qn_local")).cast("bigint").alias("n"))


def slots(requests: DataFrame, group: str, order: str, delay_ms: Column) -> DataFrame:
    """Requests with ``not_before_ms``: the n-th of a group starts no earlier than n times its delay."""
    return numbered(requests, group, order).withColumn("not_before_ms", (F.col("n") * delay_ms).cast("bigint")).drop("n")


def workers(jobs: DataFrame, group: str, cap: int = 10) -> DataFrame:
    """(group, jobs, workers): as many workers as jobs, ``cap`` at most."""
    n = jobs.groupBy(group).agg(F.count("*").alias("jobs"))
    return n.withColumn("workers", F.least(F.col("jobs"), F.lit(cap)).cast("bigint"))
