"""The corpus queries that have SQL against DuckDB, over whole tables."""

import duckdb
import pytest

from feedloom.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_oracle(spark, sf, name):
    c = duckdb.connect()
    for t in ("documents", "conversations"):
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    q = c.execute(queries.oracle_sql()[name])
    names = [d[0] for d in q.description]
    df = queries.queries()[name](spark, sf)
    assert sorted(df.columns) == sorted(names)
    assert sorted(str(tuple(r)) for r in df.select(names).collect()) == sorted(map(str, q.fetchall()))
