"""The corpus queries that SQL can express, against DuckDB."""

from __future__ import annotations

import pytest

from chainlake.llm import registry


def plain(v):
    return round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(spark, sf_dir, name):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "embeddings"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df, sql = registry.QUERIES[name](spark, sf_dir), c.sql(registry.SQL[name])
    assert sorted(df.columns) == sorted(sql.columns)
    mine = [tuple(plain(r[k]) for k in sorted(df.columns)) for r in df.collect()]
    theirs = [tuple(plain(r[sql.columns.index(k)]) for k in sorted(sql.columns)) for r in sql.fetchall()]
    assert sorted(mine, key=repr) == sorted(theirs, key=repr)


def test_sql_only_for_known_queries():
    assert set(registry.SQL) <= set(registry.QUERIES)
