"""Every registered query against its oracle on DuckDB, over whole tables."""

import math

import duckdb
import pytest

from feedloom.plans import registry, relational, textual  # noqa: F401

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


def value(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return round(float(v), 6) if hasattr(v, "as_tuple") else v


def multiset(rows):
    return sorted((tuple(value(r[k]) for k in sorted(r)) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_equals_oracle(spark, duck, sf, name):
    df = registry.QUERIES[name](spark, sf)
    q = duck.execute(registry.ORACLES[name])
    names = [d[0] for d in q.description]
    want = [dict(zip(names, r, strict=True)) for r in q.fetchall()]
    assert sorted(df.columns) == sorted(names)
    assert multiset(r.asDict() for r in df.collect()) == multiset(want)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_rows_without_oracle(spark, sf, name):
    assert registry.QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 150
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_filters_reach_the_scan(spark, sf):
    plan = registry.Tables(spark, sf).feeds.where("id = 7").select("title")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(c_custkey), EqualTo(c_custkey,7)]" in plan
    assert "ReadSchema: struct<c_custkey:bigint,c_name:string>" in plan
