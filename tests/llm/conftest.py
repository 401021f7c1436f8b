import duckdb
import pytest

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('/root/testdata/sf0.01/{t}.parquet')")
    return connection


@pytest.fixture(scope="session")
def same_rows(spark, duck):
    """Compares a registered query with its SQL, columns by name and rows in any order."""

    def check(name, queries, sql):
        df = queries[name](spark, "/root/testdata/sf0.01")
        cursor = duck.execute(sql[name])
        names = [d[0] for d in cursor.description]
        assert sorted(names) == sorted(df.columns)
        expected = sorted((tuple(r) for r in cursor.fetchall()), key=repr)
        got = sorted((tuple(r[c] for c in names) for r in df.collect()), key=repr)
        assert len(got) == len(expected)
        assert got == expected

    return check
