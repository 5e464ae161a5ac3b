"""Every registered query against its SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check import compare

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for path in glob.glob(f"{SF_DIR}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def test_entry(spark):
    got = entry(spark)
    assert got.count() > 0
    assert got.columns == ["user_id", "rank", "event_type", "score", "rmse"]


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, con, name):
    df = queries()[name](spark, SF_DIR)
    if name not in oracle_sql():
        assert df.count() > 0
        return
    done = con.execute(oracle_sql()[name])
    result = compare(df, done.fetchall(), [d[0] for d in done.description])
    assert result.startswith("ok"), result
