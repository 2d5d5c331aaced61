"""Every query with SQL against that SQL in DuckDB, on the smallest tables where they exist."""

import os

import pytest

from arbora.plans import catalogue

duckdb = pytest.importorskip("duckdb")
DATA = os.environ.get("ARBORA_TEST_DATA", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(value):
    return round(value, 7) if isinstance(value, float) else float(value) if type(value).__name__ == "Decimal" else value


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_matches_sql(spark, duck, name):
    found = catalogue.queries()[name](spark, DATA)
    columns = sorted(found.columns)
    expected = duck.sql(catalogue.oracle_sql()[name])
    assert sorted(expected.columns) == columns
    places = [expected.columns.index(c) for c in columns]
    ours = sorted(repr([plain(r[c]) for c in columns]) for r in found.collect())
    theirs = sorted(repr([plain(r[i]) for i in places]) for r in expected.fetchall())
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(catalogue.queries().keys() - catalogue.oracle_sql().keys()))
def test_rows_come(spark, name):
    assert catalogue.queries()[name](spark, DATA).count() > 0


def test_names_are_unique():
    assert catalogue.queries().keys() >= catalogue.oracle_sql().keys()
