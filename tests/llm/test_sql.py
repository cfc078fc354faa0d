"""Queries of this subpackage against their SQL in DuckDB, where the driver's tables are present."""

import glob
import os

import duckdb
import pytest

from lodestar.llm import registry

TABLES = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(TABLES), reason="no tables")


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    c = duckdb.connect()
    for p in glob.glob(f"{TABLES}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    got, want = registry.queries()[name](spark, TABLES).toPandas(), c.sql(registry.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert sorted(want.columns) == columns
    a, b = (x[columns].astype(str).sort_values(columns).reset_index(drop=True) for x in (got, want))
    assert a.equals(b)
