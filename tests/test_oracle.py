"""Every catalogue query against its SQL, rows as multisets."""

import os

import duckdb
import pytest

from gnomon import catalogue

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in catalogue.TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def test_every_query_has_sql():
    assert set(catalogue.queries()) == set(catalogue.oracle_sql())


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, db, name):
    df = catalogue.queries()[name](spark, SF)
    want = db.sql(catalogue.oracle_sql()[name])
    cols = sorted(df.columns)
    assert cols == sorted(want.columns)
    key = lambda rows: sorted(str([r[c] for c in cols]) for r in rows)
    got = key([r.asDict() for r in df.collect()])
    assert got and got == key([dict(zip(want.columns, r, strict=True)) for r in want.fetchall()])
