"""Every analytics query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from usagelake import catalog

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    db = duckdb.connect()
    for name in os.listdir(DATA):
        db.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{DATA}/{name}'")
    return db


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_same_rows(spark, oracle, name):
    df = catalog.QUERIES[name](spark, DATA)
    found = oracle.execute(catalog.ORACLE_SQL[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(df.columns)
    wanted = [tuple(r[names.index(c)] for c in df.columns) for r in found.fetchall()]
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, wanted))


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLE_SQL)


def test_receipts_of_all_lines(spark, oracle):
    assert catalog.QUERIES["receipt_join"](spark, DATA).count() == oracle.execute("SELECT count(*) FROM lineitem").fetchone()[0]
