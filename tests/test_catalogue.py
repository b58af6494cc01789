"""Every query with SQL gives the rows of its SQL on the smallest data."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

from marquetry.plans.oracles import ORACLES
from marquetry.plans.queries import QUERIES

DATA = os.environ.get("MARQUETRY_TEST_DATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def db():
    if not os.path.isdir(DATA):
        pytest.skip("no test data")
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(str(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, DATA)
    got = rows(df.columns, df.collect())
    if name in ORACLES:
        cur = db.execute(ORACLES[name])
        assert got == rows([c[0] for c in cur.description], cur.fetchall())


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
