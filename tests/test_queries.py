"""Registered queries against their DuckDB oracles on the smallest tables."""

import math
import os

import duckdb
import pytest

from __spark_entry__ import entry
from kpispark.plans import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="driver tables not present")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if hasattr(v, "isoformat"):
        return v.isoformat()[:10]
    return repr(v)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, duck, name):
    sdf = QUERIES[name](spark, SF)
    s = sdf.toPandas()
    d = duck.sql(ORACLE[name]).df()
    stypes = {f.name: str(f.type) for f in sdf.toArrow().schema}
    dtypes = {f.name: str(f.type) for f in duck.sql(ORACLE[name]).arrow().schema}
    assert stypes == dtypes
    cols = sorted(s.columns)
    assert cols == sorted(d.columns)
    srows = sorted(tuple(_norm(v) for v in r) for r in s[cols].itertuples(index=False))
    drows = sorted(tuple(_norm(v) for v in r) for r in d[cols].itertuples(index=False))
    assert srows == drows


def test_entry_runs(spark):
    df = entry(spark)
    assert df.count() > 0
    assert "total_sales_revenue_eur" in df.columns
