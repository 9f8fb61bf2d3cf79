"""Queries that SQL can express, against DuckDB."""
import duckdb
import pytest
from oracle_check import digest

from dockline.llm.queries import ORACLE, QUERIES

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, name):
    df = QUERIES[name](spark, SMALL)
    rows = [tuple(r) for r in df.collect()]
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    con.execute(ORACLE[name])
    columns = [c[0] for c in con.description]
    assert sorted(columns) == sorted(df.columns)
    assert digest(df.columns, rows) == digest(columns, con.fetchall())
    assert rows
