"""Every registered query against its SQL, and invariants of those without."""

import os

import duckdb
import pytest

import __spark_entry__ as entry_point

QUERIES, ORACLES = entry_point.queries(), entry_point.oracle_sql()
PLAIN = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for name in os.listdir(sf):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{name}'")
    return con


def printed(rows, columns):
    return sorted(tuple("" if r[c] is None else repr(r[c] + 0.0) if isinstance(r[c], float) else str(r[c]) for c in columns) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, sf, name):
    df = QUERIES[name](spark, sf)
    found = duck.execute(ORACLES[name])
    types = {d[0]: str(d[1]) for d in found.description}
    assert {c: PLAIN[t] for c, t in df.dtypes} == types
    columns = sorted(types)
    want = [dict(zip(types, r)) for r in found.fetchall()]
    assert printed([r.asDict() for r in df.collect()], columns) == printed(want, columns)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_other_queries_give_rows(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    assert entry_point.entry(spark).columns == ["city", "hour", "channel", "x", "y", "cnt"]
