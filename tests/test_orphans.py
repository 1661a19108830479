"""Orphans after a cut of the tables as they are."""

from __future__ import annotations

from datetime import date, datetime

import __spark_entry__ as entry
from compare import compare, connect
from conftest import SMALL

from punctual.operators import ingest

NAME = "s18_orphans_left_after_cut"
TABLES = ("vehicle_position", "prediction_current", "prediction_history", "trip_update", "alert")


def test_planted_orphans_show_after_the_cut(spark):
    fetch = spark.createDataFrame([(1, datetime(2024, 1, 1)), (2, datetime(2024, 1, 20))], "fetch_id long, fetched_at timestamp")
    day = date(2024, 1, 20)
    rows = [(1, 1, day), (2, 2, day), (99, 99, day), (None, None, day)]
    one = spark.createDataFrame(rows, "fetch_id long, first_fetch_id long, start_date date")
    cut = ingest.drop_before({"fetch": fetch, **{n: one for n in TABLES}}, date(2024, 1, 10))
    assert {tuple(r) for r in ingest.orphans(cut).collect()} == {(n, 2) for n in TABLES}


def test_all_tables_against_sql(spark):
    query = entry.queries()[NAME]
    state, n, _, note = compare(spark, connect(SMALL), SMALL, NAME, query, entry.oracle_sql()[NAME])
    assert state == "ok" and n == len(TABLES), note
