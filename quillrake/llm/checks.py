"""What must hold of the operators' results, as queries with SQL: counts over whole tables and numbers of violations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import containers, languages, lookalikes, mixture, reading_level, truncation
from .tokens import token_count


def p1_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By field: values that have segments, segments of no known language or of a wrong confidence, values whose parts aren't numbered through."""
    s = languages.p1_segments(spark, sf_dir)
    bad = F.count_if(~F.col("lang").isin(*languages.LANGS) | ~F.col("confidence").between(0, 1) | (F.col("n_chars") <= 0))
    each = s.groupBy("field", "row_id").agg(bad.alias("bad"), (F.max("part") + 1 != F.count_distinct("part")).cast("int").alias("gap"))
    return each.groupBy("field").agg(F.count("*").alias("values"), F.sum("bad").alias("bad_segments"), F.sum("gap").alias("gaps"))


def p3_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By field: values, those without a form, and those whose form isn't its own form."""
    v = lookalikes.article_values(spark, sf_dir)
    reader = lookalikes.learn(v)
    again = lookalikes.canonical(lookalikes.canonical(v, reader).select("row_id", "field", F.col("form").alias("value")), reader)
    return again.groupBy("field").agg(F.count("*").alias("values"), F.count_if(F.col("value").isNull()).alias("without_form"), F.count_if(F.col("form") != F.col("value")).alias("unstable"))


def p7_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By source and field: values scored, and whether the truncated ones are among them."""
    s = truncation.p7_shares(spark, sf_dir)
    return s.select("source", "field", "values", F.col("truncated").between(0, F.col("values")).alias("within"))


def p8_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By capacity: documents packed, containers filled beyond it, documents split though they fit, documents of which tokens are missing."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", token_count(F.col("text")).alias("n"))
    sizes = spark.createDataFrame(containers._specs(spark, sf_dir), "spec string, capacity bigint")
    rows = containers.p8_assignments(spark, sf_dir).join(F.broadcast(sizes), "spec")  # as many rows as capacities
    size = F.col("token_to") - F.col("token_from")
    boxes = rows.groupBy("spec", "grp", "container").agg((F.sum(size) > F.max("capacity")).cast("int").alias("over")).groupBy("spec").agg(F.sum("over").alias("overfull"))
    each = rows.groupBy("spec", "doc_id").agg(F.count("*").alias("pieces"), F.sum(size).alias("held"), F.max("capacity").alias("capacity")).join(docs, "doc_id")
    each = each.groupBy("spec").agg(F.count("*").alias("documents"), F.count_if((F.col("pieces") > 1) & (F.col("n") <= F.col("capacity"))).alias("split"), F.count_if(F.col("held") != F.col("n")).alias("incomplete"))
    return each.join(boxes, "spec").select("spec", "documents", "overfull", "split", "incomplete")


def p9_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By target: pieces used more often than a document may be, and blocks that don't hold a block's tokens."""
    goal = spark.read.parquet(f"{sf_dir}/mix_targets.parquet")
    rows = mixture.p9_mixture(spark, sf_dir)
    over = rows.join(F.broadcast(goal), "source").groupBy("source").agg(F.count_if(F.col("uses") > F.col("max_repeats")).alias("overused"))  # as many rows as targets
    odd = rows.groupBy("source", "shard", "block").agg(F.sum("n_tokens").alias("n")).groupBy("source").agg(F.count_if(F.col("n") != mixture.BLOCK_TOKENS).alias("odd_blocks"))
    none = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return goal.join(over, "source", "left").join(odd, "source", "left").select("source", "target_share", none("overused"), none("odd_blocks"))


def p10_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a level, and levels off the scale."""
    rows = reading_level.p10_levels(spark, sf_dir)
    return rows.agg(F.count("*").alias("documents"), F.count_if(~F.col("level").between(float(reading_level.GRID[0]), float(reading_level.GRID[-1]))).alias("off_scale"))


_FIELDS = "SELECT 'title' AS field, title AS value, provider_id FROM articles UNION ALL SELECT 'description', description, provider_id FROM articles"

QUERIES = {"p1_check": p1_check, "p3_check": p3_check, "p7_check": p7_check, "p8_check": p8_check, "p9_check": p9_check, "p10_check": p10_check}
ORACLES = {
    "p1_check": rf"SELECT field, count(*) AS values, 0::BIGINT AS bad_segments, 0::BIGINT AS gaps FROM ({_FIELDS}) WHERE regexp_matches(value, '\p{{L}}') GROUP BY 1",
    "p3_check": f"SELECT field, count(*) AS values, 0::BIGINT AS without_form, 0::BIGINT AS unstable FROM ({_FIELDS}) WHERE value IS NOT NULL GROUP BY 1",
    "p7_check": f"SELECT provider_id AS source, field, count(*) AS values, true AS within FROM ({_FIELDS}) WHERE value IS NOT NULL GROUP BY 1, 2",
    "p8_check": "SELECT spec, (SELECT count(*) FROM documents) AS documents, 0::BIGINT AS overfull, 0::BIGINT AS split, 0::BIGINT AS incomplete FROM container_sizes",
    "p9_check": "SELECT source, target_share, 0::BIGINT AS overused, 0::BIGINT AS odd_blocks FROM mix_targets",
    "p10_check": "SELECT count(*) AS documents, 0::BIGINT AS off_scale FROM documents",
}


def _p3_sql() -> str:
    """Pairs by a plainer form: one letter for each set of look-alikes, composed accents, widths and blanks made plain."""
    wide = "".join(map(chr, range(0xFF01, 0xFF5F)))
    source = "".join(c for g in lookalikes.LOOKALIKES for c in g[1:])
    target = "".join(g[0] for g in lookalikes.LOOKALIKES for _ in g[1:])
    form = f"translate(nfc_normalize(value), '{wide}', '{''.join(chr(ord(c) - 0xFEE0) for c in wide).replace(chr(39), chr(39) * 2)}')"
    for a, b in (("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("…", "..."), ("‐", "-"), ("‑", "-"), ("ʼ", "’")):
        form = f"replace({form}, '{a}', '{b}')"
    form = rf"regexp_replace(regexp_replace({form}, '[\s\p{{Z}}\x{{0b}}\x{{85}}]', ' ', 'g'), '[\p{{Cf}}\p{{Cc}}\x{{34f}}\x{{fe00}}-\x{{fe0f}}\x{{115f}}\x{{1160}}\x{{3164}}\x{{ffa0}}]', '', 'g')"
    form = rf"trim(regexp_replace(nfc_normalize(translate({form}, '{source}', '{target}')), ' +', ' ', 'g'))"
    return f"""WITH v AS (SELECT row_id, field, value, {form} AS form FROM (SELECT row_id, 'title' AS field, title AS value FROM articles UNION ALL SELECT row_id, 'description', description FROM articles))
SELECT a.field, a.row_id AS row_id_1, b.row_id AS row_id_2 FROM v a JOIN v b ON a.field = b.field AND a.form = b.form AND a.row_id < b.row_id WHERE a.value <> b.value AND a.form <> ''"""


ORACLES["p3_found"] = _p3_sql()
