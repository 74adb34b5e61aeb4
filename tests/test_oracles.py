"""Every query with an oracle gives the oracle's rows."""

import duckdb
import pytest

from cairnstore.plans.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr([x[i] for i in order]) for x in data)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows(spark, duck, name):
    got = QUERIES[name](spark, DATA)
    want = duck.sql(ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    got_rows = rows(got.columns, [tuple(r) for r in got.collect()])
    assert got_rows == rows(want.columns, want.fetchall())
    assert got_rows
