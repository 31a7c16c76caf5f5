"""Queries of the subpackage that have SQL give its rows, on the smallest tables."""

import os

import pytest

from keyloom.llm import queries

from .util import SF


def plain(v):
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_is_its_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in os.listdir(SF):
        con.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{SF}/{t}'")
    got = queries.QUERIES[name](spark, SF)
    expected = con.execute(queries.ORACLES[name])
    names = [d[0] for d in expected.description]
    assert sorted(got.columns) == sorted(names)
    rows = sorted(tuple(plain(r[c]) for c in names) for r in got.collect())
    assert rows == sorted(tuple(map(plain, r)) for r in expected.fetchall())
