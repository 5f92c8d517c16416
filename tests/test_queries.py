"""Every registered query that has SQL, against DuckDB on the small tables."""

import math
from pathlib import Path

import duckdb
import pytest

from tablescore.plans import oracles, queries

TABLES = Path("/root/testdata/sf0.001")


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    return round(float(value), 5) if isinstance(value, (int, float)) and not isinstance(value, bool) else value


@pytest.fixture(scope="module")
def duck():
    if not TABLES.is_dir():
        pytest.skip("no tables")
    connection = duckdb.connect()
    for file in TABLES.glob("*.parquet"):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return connection


@pytest.mark.parametrize("name", sorted(oracles.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    found = queries.queries()[name](spark, str(TABLES))
    want = duck.execute(oracles.oracle_sql()[name])
    names = [c[0] for c in want.description]
    assert sorted(found.columns) == sorted(names)
    rows = lambda some: sorted((tuple(plain(x) for x in r) for r in some), key=repr)
    assert rows(tuple(r) for r in found.select(*names).collect()) == rows(want.fetchall())


def test_every_query_has_sql():
    assert set(queries.queries()) == set(oracles.oracle_sql())
