"""Every registered query with SQL against DuckDB on the same tables; the others must return rows of a stable schema."""

import math
import os
from datetime import date, datetime
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

import __spark_entry__

SF_DIR = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))
OWN = {name: query for name, query in __spark_entry__.queries().items() if "tarmac.queries" in query.__module__}
SQL = __spark_entry__.oracle_sql()
#: Without rows where the smallest tables have no way to the node asked for.
UNREACHED = {"path_reconstruct", "tree_junction"}

pytestmark = pytest.mark.skipif(not SF_DIR.is_dir(), reason="the driver's tables are not here")


def plain(value):
    """A value that compares alike from either engine; numbers to nine significant digits."""
    if isinstance(value, bool) or value is None:
        return str(value)
    if isinstance(value, (int, float, Decimal)):
        return "nan" if math.isnan(value) else f"{float(value) + 0.0:.9g}"
    if isinstance(value, (datetime, date)):
        return value.isoformat()
    if isinstance(value, dict):
        return sorted((plain(k), plain(v)) for k, v in value.items())
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    return value.asDict() if hasattr(value, "asDict") else str(value)


def table_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(([plain(row[i]) for i in order] for row in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in SF_DIR.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(OWN))
def test_query(spark, duck, name):
    found = OWN[name](spark, str(SF_DIR))
    names, rows = table_of(found.columns, found.collect())
    assert len(set(names)) == len(names)
    if name in SQL:
        result = duck.execute(SQL[name])
        assert (names, rows) == table_of([c[0] for c in result.description], result.fetchall())
    else:
        assert rows or name in UNREACHED
