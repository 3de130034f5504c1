"""Every registered query of the relational engine against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from weftline import queries as relational

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents labels".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(relational.QUERIES))
def test_oracle(spark, duck, name):
    rows = relational.QUERIES[name](spark, SF)
    want = duck.sql(relational.ORACLES[name])
    columns = sorted(rows.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    got = sorted(tuple(plain(r[c]) for c in columns) for r in rows.collect())
    assert got == sorted(tuple(plain(r[i]) for i in at) for r in want.fetchall())
