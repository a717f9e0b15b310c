"""Every query against its SQL in DuckDB, over the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry
from hushgrid.plans import oracle, queries

from conftest import TINY

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr([r[i].replace(tzinfo=None) if hasattr(r[i], "tzinfo") else r[i] for i in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(oracle.SQL))
def test_query_equals_its_sql(spark, name):
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{TINY}/{t}.parquet'")
    want = c.sql(oracle.SQL[name])
    got = queries.QUERIES[name](spark, TINY)
    assert sorted(want.columns) == sorted(got.columns)
    assert plain([tuple(r) for r in got.collect()], got.columns) == plain(want.fetchall(), want.columns)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(oracle.SQL)))
def test_query_without_sql_has_rows(spark, name):
    assert queries.QUERIES[name](spark, TINY).collect()


def test_entry_point(spark):
    assert entry.entry(spark).count()
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(queries.QUERIES) <= set(entry.queries())
