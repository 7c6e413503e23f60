"""The core's found queries over whole small tables."""

import os

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillrake.operators import message_store
from quillrake.plans.queries import QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")

COLUMNS = {"p2_found": "delivery_id bigint", "p5_found": "tab string, row_id bigint, utc_ms bigint", "p6_found": "tab string, row_id bigint, pos bigint, val string"}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_found_has_its_columns_and_no_repeats(spark, name):
    df = QUERIES[name](spark, SF)
    assert ", ".join(f"{c} {t}" for c, t in df.dtypes) == COLUMNS[name]
    rows = [tuple(r) for r in df.collect()]
    assert rows and len(rows) == len(set(rows))


def test_repeats_against_a_window(spark):
    d = message_store.deliveries(spark, SF).filter("collected_ms IS NOT NULL")
    first = F.min("delivery_id").over(W.partitionBy("provider_id", "article_id", "collected_ms"))
    want = {r.delivery_id for r in d.withColumn("first", first).filter("delivery_id > first").collect()}
    assert {r.delivery_id for r in QUERIES["p2_found"](spark, SF).collect()} == want
    kept = QUERIES["p2_messages"](spark, SF)
    assert kept.count() == spark.read.parquet(f"{SF}/harvest_events.parquet").count() - len(want)


@pytest.mark.parametrize("missing", ["delivery_id % 3 = 0", "true"])
def test_deliveries_without_a_cycle_are_messages_too(spark, tmp_path, missing):
    e = spark.read.parquet(f"{SF}/harvest_events.parquet")
    e.withColumn("batch_no", F.when(~F.expr(missing), F.col("batch_no"))).write.parquet(f"{tmp_path}/harvest_events.parquet")
    spark.read.parquet(f"{SF}/providers.parquet").write.parquet(f"{tmp_path}/providers.parquet")
    store = message_store.replay(spark, str(tmp_path))
    kept, lost = ([r.delivery_id for r in df.collect()] for df in (store.messages(), store.dropped()))
    assert sorted(kept + lost) == sorted(r.delivery_id for r in e.select("delivery_id").collect())
