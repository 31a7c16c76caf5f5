"""Every query that has SQL gives its rows, on the smallest tables."""

import os

import pytest

from keyloom import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SF}/{name}'")
    return con


def plain(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    return str(list(v)) if isinstance(v, (list, tuple)) else str(v)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_is_its_sql(spark, duck, name):
    got = queries.QUERIES[name](spark, SF)
    expected = duck.execute(queries.ORACLES[name])
    names = [d[0] for d in expected.description]
    assert sorted(got.columns) == sorted(names)
    order = sorted(names)
    rows = sorted(tuple(plain(r[c]) for c in order) for r in got.collect())
    assert rows == sorted(tuple(plain(r[names.index(c)]) for c in order) for r in expected.fetchall())


def test_entry_runs_without_optional_parts(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(queries.ORACLES) <= set(entry.oracle_sql())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_missing_parts_are_told(monkeypatch):
    import __spark_entry__ as entry

    def absent(name, reason):
        def load(_):
            raise ImportError(reason, name=name)

        return load

    monkeypatch.setattr(entry, "import_module", absent("keyloom.llm", "gone"))
    assert "merge_full_outer" in entry.queries() and "pipeline" not in entry.queries()
    monkeypatch.setattr(entry, "import_module", absent("zstandard", "not installed"))
    with pytest.warns(UserWarning, match="not installed"):
        assert "pipeline" not in entry.queries()
