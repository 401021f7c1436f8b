"""Every registered query of the verbs against its SQL at the small scale."""

import math

import duckdb
import pytest

from verbspark import catalog

DATA = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return connection


def plain(value):
    return "NaN" if isinstance(value, float) and math.isnan(value) else value


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    cursor = duck.execute(catalog.SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    expected = sorted((tuple(map(plain, r)) for r in cursor.fetchall()), key=repr)
    got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
    assert len(got) == len(expected) and got == expected


def test_every_query_has_sql():
    assert set(catalog.SQL) == set(catalog.QUERIES) and len(catalog.QUERIES) > 180
