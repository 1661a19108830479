"""Registered queries against their checking SQL. A sample by default; all of them with PUNCTUAL_ALL=1."""

from __future__ import annotations

import os

import __spark_entry__ as entry
import pytest
from compare import compare, connect
from conftest import SMALL

QUERIES, SQL = entry.queries(), entry.oracle_sql()
SAMPLE = (
    "s7_vehicle_positions", "s9_stop_time_updates", "s16_prediction_intervals", "s21_access_log", "t7_active_services",
    "t9_scheduled_stop_events", "t12_observed_arrivals", "t14_headways", "m3_stop_events", "m7_lateness", "m9_prediction_daily",
    "m12_route_daily", "q1_live_buses", "q7_stop_buses", "q9_honest_countdown", "q25_stop_timetable", "q37_totals",
    "s6_archive_rejects", "s12_counts_stream", "s18_orphans_after_cut", "g4_first_pass", "g5_cornered_walk", "q3_next_two_stops",
    "q20_nearest_of_all_stops", "t10_stop_shape_fractions", "t11_positions_along_shape", "chain_route_daily", "d8_timepoint_bump", "d14_storage_ratio", "d20_loads_during_runs", "k2_unique",
)


@pytest.fixture(scope="module")
def sql_engine():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(QUERIES) if os.environ.get("PUNCTUAL_ALL") else SAMPLE)
def test_query_matches_its_sql(spark, sql_engine, name):
    state, n, _, note = compare(spark, sql_engine, SMALL, name, QUERIES[name], SQL.get(name))
    # without SQL another test compares the query with a plain version; here it must give rows
    assert state == "ok" or SQL.get(name) is None and n > 0, note


def test_most_queries_are_checked():
    assert set(SQL) <= set(QUERIES)
    assert len(SQL) > 0.9 * len(QUERIES)


def test_entry_runs(spark):
    assert entry.entry(spark).limit(1).count() == 1
