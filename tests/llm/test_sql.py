"""Queries with SQL give the SQL's rows."""

import duckdb
import pytest

from forgelens.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_gives_the_sql_s_rows(spark, name):
    db = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found, want = QUERIES[name](spark, SF), db.sql(ORACLE_SQL[name])
    names = sorted(want.columns)
    assert sorted(found.columns) == names
    assert sorted(map(repr, map(tuple, found.select(*names).collect()))) == sorted(map(repr, want.select(*names).fetchall()))
