"""Every query with SQL, against DuckDB on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from strataspark.plans.queries import ORACLE_SQL, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES.split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows_of(columns, rows):
    return sorted((tuple(map(repr, r)) for r in rows)), sorted(columns)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    done = con.execute(ORACLE_SQL[name])
    theirs = [d[0] for d in done.description]
    order = [theirs.index(c) for c in columns]
    assert rows_of(columns, df.select(*columns).collect()) == rows_of(theirs, [[r[i] for i in order] for r in done.fetchall()])


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)


def test_filters_and_columns_reach_the_scan(spark):
    plan = QUERIES["hash_projection"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "p_container" not in plan and "ReadSchema" in plan
    plan = QUERIES["records_by_type"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(p_type,STANDARD)" in plan
