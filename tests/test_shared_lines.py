"""The lines that trips are made from: shuffled once in a query, the same rows as the SQL's."""

from __future__ import annotations

from datetime import date

import duckdb
import pytest

from punctual.sources import fixtures as fx

COLUMNS = ("l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
           "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate date")


@pytest.fixture(scope="module")
def lines(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("lines"))
    day = date(2024, 1, 5)
    made = [(o, o + n, n, n % 3 + 1, float(n), 100.0 * n + o, 0.03, 0.0, "R", "O", day) for o in range(1, 40) for n in range(1, 6)]
    odd = [(3, 4, 1, 2, 1.0, 103.0, 0.03, 0.0, "R", "O", day)] * 2 + [(5, None, 1, 9, None, None, None, 0.0, None, "O", None), (None, *made[0][1:])]
    spark.createDataFrame(made + odd, COLUMNS).write.parquet(f"{folder}/lineitem.parquet")
    return folder


def test_tables_made_from_lines_shuffle_them_once(spark, lines):
    t = fx.Fixtures(spark, lines)
    key = ["trip_id", "stop_sequence"]
    told = t["prediction_current"].unionByName(t["prediction_history"].drop("closed_at")).filter("arrival_time is not null")
    both = t["stop_events"].filter("status is not null and route_id <> 'R3'").join(told, key)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = both._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert plan.count("FileScan") == 1 and plan.count("ReusedExchange") == 2


def test_lines_are_those_of_the_sql(spark, lines):
    sql = f"with {', '.join(fx.with_clause(['line'], 'duckdb'))} select * from fx_line".replace("from lineitem", f"from '{lines}/lineitem.parquet/*.parquet'")
    got = sorted((tuple(r) for r in fx.Fixtures(spark, lines)["line"].collect()), key=repr)
    wanted = duckdb.sql(sql).fetchall()
    assert len(got) == 199 and {r[0] for r in got} == {r[0] for r in wanted}
    assert got == sorted(wanted, key=repr)
