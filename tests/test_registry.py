"""Every registered query against its SQL on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry_point
from ledgerline.registry.oracles import all_oracles
from ledgerline.registry.queries import all_queries

SMALL = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
QUERIES = all_queries()
ORACLES = all_oracles()


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    return connection


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry_point.queries())
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())


def test_entry(spark):
    assert entry_point.entry(spark).count() > 0


def comparable(names, rows):
    order = sorted(range(len(names)), key=lambda n: names[n])

    def plain(value):
        if isinstance(value, float):
            return None if math.isnan(value) else round(value, 5) + 0.0
        return value

    return sorted((tuple(plain(row[n]) for n in order) for row in rows), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, database, name):
    frame = QUERIES[name](spark, SMALL)
    cursor = database.execute(ORACLES[name])
    columns = [column[0] for column in cursor.description]
    assert sorted(columns) == sorted(frame.columns)
    assert comparable(frame.columns, frame.collect()) == comparable(columns, cursor.fetchall())
