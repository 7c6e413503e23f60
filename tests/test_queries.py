"""Every query that has SQL gives the same rows as it, over whole small tables."""

import glob
import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_rows_match_sql(spark, db, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = Counter(repr(tuple(r[c] for c in cols)) for r in df.collect())
    res = db.execute(entry.oracle_sql()[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == cols
    assert got == Counter(repr(tuple(r[names.index(c)] for c in cols)) for r in res.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_names_and_llm_are_optional():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert {"p2_found", "p5_found", "p6_found"} <= set(entry.queries())
