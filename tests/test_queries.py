"""Every registered query against DuckDB on the small tables."""

import datetime
import decimal
import os

import duckdb
import pytest

from plumbline.queries import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def sf():
    """Larger than the other tests' tables: on those of sf0.001, ties and skew hardly occur."""
    return os.environ.get("TEST_QUERIES_DIR", "/root/testdata/sf0.01")


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    return con


def plain(x):
    if isinstance(x, bool) or x is None:
        return str(x)
    if isinstance(x, (int, float, decimal.Decimal)):
        return f"{float(x):.6g}"
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    if isinstance(x, (list, tuple)):
        return str([plain(y) for y in x])
    return str(x)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    got = QUERIES[name](spark, sf)
    names = sorted(got.columns)
    quoted = ", ".join(f'"{n}"' for n in names)
    want = duck.execute(f"SELECT {quoted} FROM ({ORACLE_SQL[name]})").fetchall()
    show = lambda rows: sorted(tuple(map(plain, r)) for r in rows)
    assert show(map(tuple, got.select(*[f"`{n}`" for n in names]).collect())) == show(want)


def test_filters_and_columns_reach_the_scan(spark, sf):
    plan = QUERIES["scan_project_filter"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull" in plan
    assert "l_tax" not in plan


def test_distinct_on_combines_before_the_exchange(spark, sf):
    plan = QUERIES["distinct_on"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "partial_min_by" in plan and "Window" not in plan


def test_equal_sums_share_a_rank_however_rows_are_split(spark, tmp_path):
    """Two customers with the same prices, in files that cut them at different places; others without a price or a key."""
    folder = tmp_path / "orders.parquet"
    folder.mkdir()
    files = [[(1, 0.1), (2, 0.1), (2, 0.2), (3, None)], [(1, 0.2), (1, 0.3), (2, 0.3), (None, 0.6), (None, None)]]
    con = duckdb.connect()
    con.execute("SET threads = 1")
    for i, rows in enumerate(files):
        con.execute("CREATE OR REPLACE TABLE t (o_custkey BIGINT, o_totalprice DOUBLE)")
        con.executemany("INSERT INTO t VALUES (?, ?)", rows)
        con.execute(f"COPY t TO '{folder}/{i}.parquet'")
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{folder}/*.parquet'")
    got = {tuple(r) for r in QUERIES["win_over_agg"](spark, str(tmp_path)).collect()}
    assert got == set(con.execute(ORACLE_SQL["win_over_agg"]).fetchall())
    assert got == {(1, 0.6, 1), (2, 0.6, 1), (None, 0.6, 3), (3, None, 4)}


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
