"""Every SQL-checkable query against DuckDB on the same tables (smallest scale)."""

import os

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from conftest import SF

QUERIES, ORACLES = queries(), oracle_sql()
# slow enough to leave to the full check
SLOW = {"m12_augmentation_study"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SF}/{name}'")
    return con


def cells(table, columns):
    return sorted(tuple(repr(row[c] + 0.0 if isinstance(row[c], float) else row[c]) for c in columns) for row in table.to_pylist())


@pytest.mark.parametrize("name", [n for n in ORACLES if n not in SLOW])
def test_same_rows(spark, duck, name):
    ours, theirs = QUERIES[name](spark, SF).toArrow(), duck.sql(ORACLES[name]).to_arrow_table()
    columns = sorted(ours.column_names)
    assert columns == sorted(theirs.column_names)
    for c in columns:
        assert str(ours.schema.field(c).type) == str(theirs.schema.field(c).type), c
    assert cells(ours, columns) == cells(theirs, columns)


def test_names_match():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    assert entry(spark).limit(1).count() == 1
