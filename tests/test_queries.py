"""Every query with SQL gives what DuckDB gives."""

import math

import duckdb
import pytest

from keyloom import queries
from tests.conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    show = lambda v: f"{v:.9g}" if isinstance(v, float) and not math.isnan(v) else str(v)
    return sorted(tuple(show(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def compare(spark, duck, run, sql):
    df = run(spark, SF)
    got = [tuple(r) for r in df.collect()]
    cur = duck.execute(sql)
    names = [d[0] for d in cur.description]
    expected = cur.fetchall()
    assert sorted(df.columns) == sorted(names)
    assert plain(got, df.columns) == plain(expected, names)
    return len(got)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_against_sql(spark, duck, name):
    compare(spark, duck, queries.QUERIES[name], queries.ORACLE[name])


def test_halves_are_cast_as_in_sql(spark, tmp_path):
    """Halves go to the even number; limits count, nulls and what is no number don't."""
    balances = [100.49, 100.5, 101.5, 102.5, 200.49999999999997, 200.50000000000003, 900.0, 900.25, 900.26, -101.5, -0.0, 1e300, math.nan, math.inf, None]
    rows = [(i, f"c{i}", i % 25, b, "MACHINERY") for i, b in enumerate(balances)] + [(99, "c99", 3, 300.5, None), (100, "c100", 3, 300.5, "")]
    spark.createDataFrame(rows, "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW customer AS SELECT * FROM read_parquet('{tmp_path}/customer.parquet/*.parquet')")
    got = queries.QUERIES["casts_and_between"](spark, str(tmp_path)).select("c_custkey", "whole", "text")
    assert got.schema["whole"].dataType.simpleString() == "int"
    found = sorted(tuple(r) for r in got.collect())
    assert found == sorted(con.execute(queries.ORACLE["casts_and_between"]).fetchall())
    assert [r[1] for r in found] == [100, 102, 102, 200, 201, 900, 900, 300]


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 150
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_plans(spark):
    """Filters and columns reach the scan; restrictions by relations are semijoins; an antijoin on a key is no nested loop."""
    plan = lambda n: queries.QUERIES[n](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,45.0)" in plan("semijoin") and "LeftSemi" in plan("semijoin")
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint>" in plan("antijoin") and "NestedLoop" not in plan("antijoin")
    assert "TakeOrderedAndProject" in plan("top_k")
    assert "NestedLoop" not in plan("populate_todo")
