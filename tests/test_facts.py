"""Arrivals, facts, histograms, trends and names, worked by hand."""

from __future__ import annotations

from datetime import date, datetime, timedelta, timezone

import pytest
from conftest import rows
from pyspark.sql import functions as F

from punctual.functions import histograms as h
from punctual.functions.names import clean_headsign, clean_stop_name, stop_name_rule
from punctual.functions.routeorder import by_importance, fit_patterns
from punctual.operators import arrivals, facts, history
from punctual.operators.profile import exact_percentiles

D = date(2026, 9, 16)
T0 = datetime(2026, 9, 16, 20, 0, tzinfo=timezone.utc)


def sec(n):
    return T0 + timedelta(seconds=n)


def test_observed_arrival_interpolates_the_crossing(spark):
    t = {
        "positions_along_shape": spark.createDataFrame(
            [("T", D, "V", sec(0), 0.1, 5.0), ("T", D, "V", sec(30), 0.3, 5.0), ("T", D, "V", sec(60), 0.25, 5.0),
             ("T", D, "V", sec(75), 0.9, 500.0), ("T", D, "V", sec(90), 0.5, 5.0)],
            "trip_id string, service_date date, vehicle_id string, ts timestamp, frac double, off_route_m double"),
        "stop_shape_fractions": spark.createDataFrame(
            [(1, "T", 1, 0.05, True), (1, "T", 2, 0.2, True), (1, "T", 3, 0.4, True), (1, "T", 4, 0.45, False), (1, "T", 5, 0.8, True)],
            "feed_version_id int, trip_id string, stop_sequence int, frac double, is_usable boolean"),
        "scheduled_stop_events": spark.createDataFrame(
            [(D, 1, "T", "R", 0, i, f"S{i}", True, True, sec(20 * i), i == 1, i == 5) for i in range(1, 6)],
            "service_date date, feed_version_id int, trip_id string, route_id string, direction_id int, stop_sequence int, stop_id string, "
            "is_timepoint boolean, has_scheduled_time boolean, scheduled_arrival timestamp, is_first_stop boolean, is_last_stop boolean"),
    }
    got = arrivals.observed_arrivals(t, T0 + timedelta(hours=3)).orderBy("stop_sequence").select(
        "stop_sequence", (F.unix_micros("observed_arrival") / 1e6 - T0.timestamp()).alias("s"), "uncertainty_s", "is_bounded", "is_plausible")
    # stop 3 lies between 0.3 (furthest at 60 s: still 0.3) and 0.5 at 90 s: half way from 60 to 90
    assert [tuple(r) for r in got.collect()] == [(1, 0.0, None, False, True), (2, 15.0, 15.0, True, True), (3, 75.0, 15.0, True, True)]


def samples_of(spark, preds, scored_at=1000):
    e = spark.createDataFrame(
        [(D, "T", 1, "S", "R", True, "weekday", sec(900), sec(scored_at), sec(p), sec(a), None if u is None else sec(u), scored_at - p) for p, a, u in preds],
        "service_date date, trip_id string, stop_sequence int, stop_id string, route_id string, is_timepoint boolean, weekday_type string, scheduled_arrival timestamp, "
        "observed_arrival timestamp, predicted_arrival timestamp, predicted_at timestamp, predicted_until timestamp, error_s int")
    return {r["ahead_min"]: r for r in facts.countdown_samples({"prediction_errors": e}).collect()}


def test_countdown_shows_each_minute_once(spark):
    got = samples_of(spark, [(950, 0, 500), (1010, 600, None)])
    # the first read 15:50 down to 7:30, the second 6:50 down to 0:10 at the arrival
    assert sorted(got) == list(range(1, 16)) and all(r["in_comparison"] for r in got.values())
    assert got[7]["error_s"] == 50 and got[6]["error_s"] == -10 and got[15]["schedule_error_s"] == 100


def test_countdown_without_fifteen_minutes_is_not_compared(spark):
    got = samples_of(spark, [(950, 400, None)])
    assert max(got) == 9 and not any(r["in_comparison"] for r in got.values())


def test_countdown_ignores_predictions_shown_too_far_out(spark):
    assert samples_of(spark, [(2000, 0, 10)]) == {}


def test_countdown_takes_the_newest_of_many_and_copies_count_once(spark):
    # the second, made later, covers 8 to 4 of the first's 15 to 4; both stand twice
    got = samples_of(spark, [(950, 0, 700), (1010, 500, 760)] * 2)
    assert sorted(got) == list(range(4, 16)) and [got[m]["error_s"] for m in (15, 9, 8, 4)] == [50, 50, -10, -10]


def test_countdown_repeats_rows_only_for_the_minutes_kept(spark):
    from pyspark.sql.functions import lit

    e = spark.range(1).select(
        lit(D).alias("service_date"), lit("T").alias("trip_id"), lit(1).alias("stop_sequence"), lit("S").alias("stop_id"), lit("R").alias("route_id"),
        lit(True).alias("is_timepoint"), lit("weekday").alias("weekday_type"), lit(0).alias("error_s"),
        *[F.timestamp_seconds(F.col("id")).alias(c) for c in ("scheduled_arrival", "observed_arrival", "predicted_arrival", "predicted_at", "predicted_until")])
    plan = facts.countdown_samples({"prediction_errors": e})._jdf.queryExecution().executedPlan().toString()
    assert "Generate" in plan and "SortAggregate" not in plan and plan.index("Generate") < plan.index("Window")


def test_exact_percentiles_equal_the_builtin(spark):
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, None).otherwise(F.col("id") % 7).alias("k"), ((F.col("id") * 7919 % 10007) / 13.0 - 200).alias("v"))
    ours = exact_percentiles(df, ["k"], "v", {"a": 0.1, "b": 0.5, "c": 0.95}, width=5.0)
    theirs = df.groupBy("k").agg(F.count("v").alias("n"), F.percentile("v", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.95))).alias("p"))
    flat = lambda r: (r[0], r[1], *[round(x, 6) for x in r[2]])
    assert sorted((flat((r["k"], r["n"], r["p"])) for r in theirs.collect()), key=repr) == sorted(
        (flat((r["k"], r["n"], [r["a"], r["b"], r["c"]])) for r in ours.collect()), key=repr)


def counts(spark, errors):
    return spark.createDataFrame([(e,) for e in errors], "e int").agg(F.count(F.lit(1)).alias("n"), *h.threshold_counts(F.col("e")))


def test_percentiles_read_off_counts(spark):
    df = counts(spark, [0] * 5 + [15] * 5)
    r = df.select(h.signed_percentile(0.5).alias("a"), h.signed_percentile(0.75).alias("b"), h.abs_percentile_minutes(0.75).alias("c")).first()
    assert (r["a"], r["b"], r["c"]) == (0.0, 7.5, 0.1875)
    wide = counts(spark, [-5000, 5000]).select(h.signed_percentile(0.1).alias("lo"), h.signed_percentile(0.9).alias("hi"), h.abs_percentile_minutes(0.5).alias("m")).first()
    assert (wide["lo"], wide["hi"], wide["m"]) == (-900.0, 900.0, 15.0)
    none = counts(spark, []).select(h.signed_percentile(0.5).alias("a"), h.abs_percentile_minutes(0.5).alias("b")).first()
    assert none["a"] is None and none["b"] is None


def test_trend_rolls_up_by_span(spark):
    data = [(date(2026, 1, 5) + timedelta(days=i), 10 + i, float(i), float(-i), float(2 * i)) for i in range(14)]
    daily = spark.createDataFrame(data, "d date, n int, median_delay_s double, p10_delay_s double, p90_delay_s double")
    assert history.roll_up(daily, 14).count() == 14
    weeks = history.roll_up(daily, 13).orderBy("d").collect()
    assert [str(w["d"]) for w in weeks] == ["2026-01-05", "2026-01-12"] and weeks[0]["n"] == 91
    assert weeks[0]["median_delay_s"] == 3.0 and abs(weeks[0]["p90_delay_s"] - sum(2 * i * (10 + i) for i in range(7)) / 91) < 1e-9
    assert history.roll_up(daily, 1).collect()[0]["unit"] == "month"


@pytest.mark.parametrize(
    "patterns, order, places",
    [
        ([["a", "b", "c"]], ["a", "b", "c"], [[0, 1, 2]]),
        ([["a", "b", "c", "d"], ["c", "d"]], ["a", "b", "c", "d"], [[0, 1, 2, 3], [2, 3]]),
        ([["S", "a", "b", "c", "S"], ["b", "c", "S"]], ["S", "a", "b", "c", "S"], [[0, 1, 2, 3, 4], [2, 3, 4]]),
        ([["a", "b", "c", "d"], ["x", "a", "b", "y", "d", "z"]], ["x", "a", "b", "y", "c", "d", "z"], [[1, 2, 4, 5], [0, 1, 2, 3, 5, 6]]),
        ([["a", "b"], ["x", "y"]], ["a", "b", "x", "y"], [[0, 1], [2, 3]]),
        ([["a", "b"], ["a", "p", "b"], ["a", "q", "b"]], ["a", "q", "p", "b"], [[0, 3], [0, 2, 3], [0, 1, 3]]),
    ],
)
def test_stop_lists_fit_together(patterns, order, places):
    assert fit_patterns(patterns) == (order, places)


def test_longest_list_leads():
    assert by_importance([(["a"], 9), (["a", "b", "c"], 1), (["b", "c"], 5)]) == [1, 0, 2]


@pytest.mark.parametrize(
    "raw, shown, rule",
    [
        ("W/S of Coburg S of Frontier", "Coburg south of Frontier (W side)", "side, street, direction of cross street"),
        ("n/s. of HILYARD at 24th", "Hilyard at 24th (N side)", "side, street at cross street"),
        ("E/S of Main", "Main (E side)", "side, street only"),
        ("SPFLD STA, BAY A", "Springfield Station BAY A", None),
        ("UO  Station", "UO Station", None),
    ],
)
def test_stop_names(spark, raw, shown, rule):
    r = spark.createDataFrame([(raw,)], "n string").select(clean_stop_name(F.col("n")).alias("s"), stop_name_rule(F.col("n")).alias("r")).first()
    assert (r["s"], r["r"]) == (shown, rule)


@pytest.mark.parametrize(
    "raw, route, shown",
    [
        ("11 THURSTON STA", "11", "Thurston Station"),
        ("THURSTON <> STA", "11", "Thurston → Station"),
        ("EUG STA <> TO LCC VIA 5TH", "81", "Eugene Station to LCC via 5th"),
        ("103 EmX WEST 11TH", "EmX", "West 11th"),
        ("LOWELL/LCC", "92", "Lowell/LCC"),
        ("TO SPFLD", "8", "Springfield"),
        ("11", "11", "11"),
        (None, "11", ""),
    ],
)
def test_headsigns(spark, raw, route, shown):
    df = spark.createDataFrame([(raw, route)], "h string, r string")
    assert df.select(clean_headsign(F.col("h"), F.col("r"))).first()[0] == shown


def test_stop_event_counts_add_up(tables):
    e = facts.stop_events(tables, __import__("punctual.sources.fixtures", fromlist=["AS_OF"]).AS_OF)
    r = e.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("service_date", "trip_id", "stop_sequence").alias("k"),
              F.count_if((F.col("status").isNotNull()) != F.col("scored_time").isNotNull()).alias("bad")).first()
    assert r["n"] == r["k"] == 6000 and r["bad"] == 0
    assert rows(e.filter("status is not null and delay_s is null")) == []
