"""The operators that have SQL against it, over whole tables."""

import os

import duckdb
import pytest

from strata.llm import queries

SF = os.environ.get("STRATA_TEST_SF", "/root/testdata/sf0.001")


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for table in os.listdir(SF):
        con.sql(f"create view {table.split('.')[0]} as select * from '{SF}/{table}'")
    df = queries.queries()[name](spark, SF)
    columns = sorted(df.columns)
    rel = con.sql(queries.oracle_sql()[name])
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    got = sorted(tuple(str(r[c]) for c in columns) for r in df.collect())
    assert got == sorted(tuple(str(r[i]) for i in at) for r in rel.fetchall()) and got
