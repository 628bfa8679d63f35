"""Each registered query against its SQL in DuckDB, on the smallest tables."""

import math

import pytest

from quadrille.queries import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return "~"
    return repr(float(x)) if isinstance(x, int | float) and not isinstance(x, bool) else str(x)


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in found), sorted(columns)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows(spark, sf, duck, name):
    df = registry.queries()[name](spark, sf)
    found = duck.execute(registry.oracle_sql()[name])
    assert rows(df.columns, df.collect()) == rows([c[0] for c in found.description], found.fetchall())


def test_all_queries_run(spark, sf):
    for name in registry.queries().keys() - registry.oracle_sql().keys():
        assert registry.queries()[name](spark, sf).count() > 0
