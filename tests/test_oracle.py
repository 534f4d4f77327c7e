"""Every registered query against its SQL on the same files."""

import datetime as dt
from decimal import Decimal

import duckdb
import pytest

from __spark_entry__ import oracle_sql, queries
from eventloom.sources.events import SOURCE_SCHEMAS

FOLDERS = ["/root/testdata/sf0.001", "/root/testdata/sf0.01"]


def normal(value):
    if isinstance(value, float):
        return ("number", round(value, 6))
    if isinstance(value, (bool, type(None), str)):
        return (type(value).__name__, value)
    if isinstance(value, (int, Decimal)):
        return ("number", round(float(value), 6))
    if isinstance(value, dt.datetime):
        return ("time", value.isoformat())
    return (type(value).__name__, str(value))


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(normal(row[i]) for i in order) for row in rows), key=repr)


@pytest.fixture(scope="module", params=FOLDERS)
def folder(request):
    con = duckdb.connect()
    for name in SOURCE_SCHEMAS:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{request.param}/{name}.parquet'")
    return request.param, con


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, folder, name):
    path, con = folder
    got = queries()[name](spark, path)
    rows = got.collect()
    assert len(got.columns) == len(set(got.columns))
    sql = oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    want = con.execute(sql)
    names = [d[0] for d in want.description]
    expected = rows_of(names, want.fetchall())
    assert sorted(got.columns) == sorted(names)
    assert len(rows) == len(expected)
    assert rows_of(got.columns, rows) == expected
    assert expected, "an empty result proves little"
