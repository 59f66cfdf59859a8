"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import math
import os

import pytest

from chainlake import catalog

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return bytes(v) if isinstance(v, bytearray) else v


def compared(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    sql = duck.sql(catalog.ORACLE[name])
    assert sorted(df.columns) == sorted(sql.columns)
    assert compared(df.columns, df.collect()) == compared(sql.columns, sql.fetchall())


def test_entry_names():
    import __spark_entry__ as e

    assert set(catalog.QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())


def test_exact_limit_has_no_bound_of_its_own(spark, tmp_path):
    """More logs than 100,000 in the eleven blocks: all of them come back."""
    per, days = 9_200, 11
    orders = spark.range(days).selectExpr("id AS o_orderkey", "id AS o_custkey", "1.0D AS o_totalprice", "CAST(date_add(DATE '1995-10-28', CAST(id AS INT)) AS TIMESTAMP) AS o_orderdate")
    lines = spark.range(per * days).selectExpr(
        f"id % {days} AS l_orderkey", "id % 50 AS l_partkey", "id % 30 AS l_suppkey", f"CAST(id / {days} AS INT) AS l_linenumber", "1.0D AS l_quantity", "1.0D AS l_extendedprice",
        "0.0D AS l_discount", "0.0D AS l_tax", "'R' AS l_returnflag", "'F' AS l_linestatus", "TIMESTAMP '1995-11-30 00:00:00' AS l_shipdate",
    )
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    assert catalog.QUERIES["logs_limit_exact"](spark, str(tmp_path)).count() == per * days > 100_000
