"""Every registered query of the library against its SQL on DuckDB, over whole tables at the smallest size."""

import glob
import os

import pytest

from tidemark import queries

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{D}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def test_every_query_has_an_oracle():
    assert set(queries.QUERIES) == set(queries.ORACLE_SQL)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, duck, name):
    got = queries.QUERIES[name](spark, D)
    found = duck.execute(queries.ORACLE_SQL[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(got.columns)
    own = lambda row: repr(tuple(row[c] for c in sorted(columns)))
    assert sorted(own(r) for r in got.collect()) == sorted(own(dict(zip(columns, r))) for r in found.fetchall())
