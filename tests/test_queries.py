"""Every query with SQL, against DuckDB over the same tables."""

from __future__ import annotations

import pytest

from orderloom import queries

SQL = queries.oracle_sql()


def test_every_query_has_sql():
    assert set(SQL) == set(queries.queries())


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_matches_sql(spark, sf_dir, same, name):
    same(queries.queries()[name](spark, sf_dir), SQL[name])


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns[:3] == ["eventDate", "channel", "location"] and df.count() == 1468


def test_a_page_of_a_day_holds_the_whole_day(spark, tmp_path):
    """A day with 120 channels and locations, more than a default page."""
    import duckdb

    con = duckdb.connect()
    con.execute("CREATE TABLE nation AS SELECT CAST(i AS INTEGER) AS n_nationkey, 'n' || i AS n_name FROM range(24) t(i)")
    con.execute("CREATE TABLE customer AS SELECT i AS c_custkey, CAST(i % 24 AS INTEGER) AS c_nationkey, 's' || (i // 24) AS c_mktsegment FROM range(120) t(i)")
    con.execute("CREATE TABLE part AS SELECT CAST(1 AS BIGINT) AS p_partkey, CAST(2.5 AS DOUBLE) AS p_retailprice")
    con.execute("CREATE TABLE orders AS SELECT i AS o_orderkey, i AS o_custkey, TIMESTAMP '1997-01-01' AS o_orderdate FROM range(120) t(i)")
    con.execute("""CREATE TABLE lineitem AS SELECT i AS l_orderkey, 1 AS l_linenumber, CAST(1 AS BIGINT) AS l_partkey, CAST(1 AS BIGINT) AS l_suppkey, CAST(2 AS DOUBLE) AS l_quantity,
        CAST(5 AS DOUBLE) AS l_extendedprice, CAST(0 AS DOUBLE) AS l_discount, CAST(0 AS DOUBLE) AS l_tax, TIMESTAMP '1997-01-02' AS l_shipdate FROM range(120) t(i)""")
    for t in ("nation", "customer", "part", "orders", "lineitem"):
        con.execute(f"COPY {t} TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
    got = sorted((tuple(r) for r in queries.page_checks(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted(con.execute(SQL["q_page_checks"]).fetchall(), key=str) and ("same day", 120) in [r[:2] for r in got]
