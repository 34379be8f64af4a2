"""Every registered query of the library against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from routelens.plans import registry

SF = "/root/testdata/sf0.001"


def rows(columns, data):
    def plain(v):
        if v is None or v != v:
            return "null"
        if isinstance(v, bool):
            return str(v)
        return f"{float(v):.5f}" if isinstance(v, (int, float)) else str(v)

    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in data)


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_sql(spark, con, name):
    got = registry.queries()[name](spark, SF)
    want = con.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0
