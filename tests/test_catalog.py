"""Every query with SQL against DuckDB on the same files."""

from collections import Counter
from pathlib import Path

import duckdb
import pytest

from cairnlog.plans import audits, catalog  # noqa: F401


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.fixture(scope="module")
def con(sf):
    con = duckdb.connect()
    for p in Path(sf).iterdir():
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def test_all_have_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLE_SQL)


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_against_duckdb(spark, sf, con, name):
    df = catalog.QUERIES[name](spark, sf)
    got = con.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == sorted(df.columns)
    want = Counter(tuple(map(plain, r)) for r in got.fetchall())
    assert Counter(tuple(map(plain, r)) for r in df.select(*names).collect()) == want


def test_entry_module(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["k", "v"]
