"""Every registered query against its SQL statement on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

SF_DIR = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not SF_DIR.exists(), reason="test tables absent")
STATEMENTS = entry.oracle_sql()
SLOW = {"x2_prepare_and_load"}


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"create view {table} as select * from '{SF_DIR}/{table}.parquet'")
    return connection


def comparable(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def text(value):
        if isinstance(value, float):
            return "nan" if math.isnan(value) else repr(value + 0.0)
        return str(value)

    return sorted(tuple(text(row[i]) for i in order) for row in rows)


def test_every_statement_has_a_query():
    assert set(STATEMENTS) <= set(entry.queries())


def test_entry_runs(spark):
    assert entry.entry(spark).count() == 7


@pytest.mark.parametrize("name", sorted(set(STATEMENTS) - SLOW))
def test_parity(spark, duck, name):
    found = entry.queries()[name](spark, str(SF_DIR))
    cursor = duck.execute(STATEMENTS[name])
    columns = [column[0] for column in cursor.description]
    assert sorted(found.columns) == sorted(columns)
    assert comparable(found.columns, found.collect()) == comparable(columns, cursor.fetchall())
