"""Queries against their SQL on rows that the test tables lack: nulls, edges of rounding, numbers without end."""

import pytest

from tidemark import queries


def written(at, tables):
    """Tables given as SQL as files, and a connection that reads them."""
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t, sql in tables.items():
        con.execute(f"COPY ({sql}) TO '{at}/{t}.parquet'")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{at}/{t}.parquet'")
    return con


def differing(spark, at, name, tables):
    """Rows only the query returns and rows only its SQL returns, over tables given as SQL."""
    con = written(at, tables)
    found = con.execute(queries.ORACLE_SQL[name])
    columns = [c[0] for c in found.description]
    got = sorted(repr(tuple(r[c] for c in columns)) for r in queries.QUERIES[name](spark, str(at)).collect())
    want = sorted(map(repr, found.fetchall()))
    assert len(got) == len(want)
    return [r for r in got if r not in want], [r for r in want if r not in got]


def orders(rows):
    names = {"o_orderkey": "BIGINT", "o_custkey": "BIGINT", "o_totalprice": "DOUBLE", "o_orderdate": "TIMESTAMP"}
    return f"SELECT {', '.join(f'CAST({n} AS {t}) AS {n}' for n, t in names.items())} FROM (VALUES {', '.join(rows)}) v({', '.join(names)})"


def test_risk_functions_round_as_their_sql(spark, tmp_path):
    near = ["(2492, 518, 66379.8, '1995-01-15')", "(3437, 249, 70919.0, '1998-02-24')", "(8417, 1382, 165851.8, '1998-03-13')", "(11095, 520, 49564.2, '2000-09-08')", "(12514, 1236, 93828.2, '2001-05-15')"]
    odd = [(5, "NULL"), (7, "'nan'"), (7, "'infinity'"), (7, "'-infinity'"), (7, 0.0), (-7, 99.5), (3, 1e-300), (3, 1e305), ("NULL", 50.0)]
    rows = near + [f"({9000 + i}, {k}, {p}, '1995-03-01')" for i, (k, p) in enumerate(odd)]
    assert differing(spark, tmp_path, "risk_functions", {"orders": orders(rows)}) == ([], [])


def test_risk_functions_count_no_days_from_a_missing_date(spark, tmp_path):
    rows = ["(45, 4, 1000.0, NULL)", "(46, 4, 1000.0, NULL)", "(NULL, 4, 1000.0, '1995-02-01')", "(NULL, 4, 1000.0, NULL)"]
    assert differing(spark, tmp_path, "risk_functions", {"orders": orders(rows)}) == ([], [])


def lines(rows):
    names = {"l_orderkey": "BIGINT", "l_linenumber": "INTEGER", "l_quantity": "DOUBLE", "l_shipdate": "TIMESTAMP"}
    return f"SELECT {', '.join(f'CAST({n} AS {t}) AS {n}' for n, t in names.items())} FROM (VALUES {', '.join(rows)}) v({', '.join(names)})"


def test_lines_without_dates_or_customers_are_never_available(spark, tmp_path):
    tables = {
        "customer": "SELECT CAST(k AS BIGINT) AS c_custkey FROM (VALUES (1), (2), (3), (NULL)) v(k)",
        "orders": orders(["(10, 1, 1.0, '1998-01-01')", "(11, 1, 1.0, '1998-06-01')", "(20, 2, 1.0, '1998-01-01')", "(30, 3, 1.0, NULL)", "(31, 3, 1.0, '1999-06-01')", "(40, NULL, 1.0, '1998-01-01')"]),
        "lineitem": lines(["(10, 1, 5.0, '1998-02-01')", "(11, 1, 6.0, NULL)", "(20, 1, 7.0, NULL)", "(30, 1, 8.0, '1998-02-01')", "(31, NULL, NULL, '1999-06-01')", "(40, 1, 9.0, '1998-02-01')"]),
    }
    assert differing(spark, tmp_path, "pit_available_at", tables) == ([], [])


def test_lines_that_the_order_leaves_open_go_to_the_greatest_quantity(spark, tmp_path):
    tied = [f"(10, 1, {q}, '1998-02-01')" for q in (3.0, 9.0, "NULL", 5.0)]
    for i, rows in enumerate((tied, tied[::-1], tied[1:] + tied[:1])):
        at = tmp_path / str(i)
        at.mkdir()
        written(at, {"customer": "SELECT CAST(1 AS BIGINT) AS c_custkey", "orders": orders(["(10, 1, 1.0, '1998-01-01')"]), "lineitem": lines(rows)})
        assert [tuple(r) for r in queries.QUERIES["pit_available_at"](spark, str(at)).collect()] == [(1, 101, 9.0)]
