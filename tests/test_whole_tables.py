"""Checks and measurements over all schedule versions and all tables with rules."""

from __future__ import annotations

import __spark_entry__ as entry
import pytest
from compare import compare, connect
from conftest import SMALL

from punctual.operators import quality

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.mark.parametrize("name", ["g1_projected_stops", "g2_distances_all_versions", "p11_stop_names_all_versions"])
def test_all_versions_have_all_their_stops(spark, tables, name):
    expected = {(r[0], r[1]) for r in tables["stops"].select("feed_version_id", "stop_id").collect()}
    got = [(r.feed_version_id, r.stop_id) for r in QUERIES[name](spark, SMALL).collect()]
    assert len({v for v, _ in expected}) > 1 and set(got) == expected and len(got) == len(expected)


def test_stop_order_of_all_versions(spark, tables):
    versions = {r[0] for r in tables["trips"].select("feed_version_id").distinct().collect()}
    assert {r.feed_version_id for r in QUERIES["d23_stop_order_check"](spark, SMALL).collect()} == versions


def test_all_rules_are_run(spark):
    run = [r.tbl for r in QUERIES["k_all_rules"](spark, SMALL).collect()]
    assert sorted(run) == sorted(name for name, rules in quality.RULES.items() for _ in rules)


@pytest.mark.parametrize("name", ["g2_distances_all_versions", "p11_stop_names_all_versions", "k8_missing_stops"])
def test_against_sql(spark, name):
    state, _, _, note = compare(spark, connect(SMALL), SMALL, name, QUERIES[name], SQL[name])
    assert state == "ok", note
