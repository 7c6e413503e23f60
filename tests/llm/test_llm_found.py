"""The queries of this subpackage over whole small tables: columns, keys and what must hold between tables."""

import os

import pytest

from quillrake.llm import queries as Q

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")

COLUMNS = {
    "p1_found": "row_id bigint, field string, lang string",
    "p3_found": "field string, row_id_1 bigint, row_id_2 bigint",
    "p4_found": "row_id bigint",
    "p7_found": "row_id bigint, field string",
    "p10_found": "doc_id bigint",
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_found_has_its_columns_and_no_repeats(spark, name):
    df = Q.QUERIES[name](spark, SF)
    assert ", ".join(f"{c} {t}" for c, t in df.dtypes) == COLUMNS[name]
    rows = [tuple(r) for r in df.collect()]
    assert rows and len(rows) == len(set(rows))


def test_every_document_is_packed_whole(spark):
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    got = Q.QUERIES["p8_assignments"](spark, SF)
    assert {r.spec: r.n for r in got.groupBy("spec").agg({"doc_id": "count"}).withColumnRenamed("count(doc_id)", "x").selectExpr("spec", "x AS n").collect()}.keys() == {"small", "medium", "large"}
    assert all(r["count"] == n for r in got.select("spec", "doc_id").distinct().groupBy("spec").count().collect())


def test_shares_sum_up(spark):
    shares = Q.QUERIES["p9_shares"](spark, SF).collect()
    assert len(shares) == 12 and abs(sum(r.actual_share for r in shares) - 1) < 1e-9
