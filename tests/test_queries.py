"""Every registered query against its SQL counterpart on a small table set, and the contract's shape."""

from __future__ import annotations

import decimal

import duckdb
import pytest
from evigrid.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if x is None or x != x or str(x) in ("<NA>", "NaT"):
        return "null"
    if isinstance(x, bool) or type(x).__name__ in ("bool", "bool_"):
        return str(bool(x))
    if isinstance(x, decimal.Decimal | int | float) or hasattr(x, "dtype"):
        return f"{float(x):.6f}"
    return str(x)


def rows(pdf):
    return sorted(tuple(plain(x) for x in r) for r in pdf[sorted(pdf.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    got = registry.queries()[name](spark, DATA).toPandas()
    want = duck.execute(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    assert registry.queries()[name](spark, DATA).columns


def test_flagship(spark):
    assert registry.flagship(spark, DATA).count() > 0
