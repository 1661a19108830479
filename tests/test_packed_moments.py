"""Predictions travel to their events as one moment and distances from it; nothing of a moment is lost on the way."""

from __future__ import annotations

from datetime import date, datetime, timedelta, timezone

from conftest import rows
from pyspark.sql import functions as F

from punctual.operators import arrivals, facts

DAY, T = date(2024, 1, 5), datetime(2024, 1, 5, 20, 0, tzinfo=timezone.utc)
PREDICTION = ("trip_id string, start_date date, stop_sequence int, stop_id string, arrival_time timestamp, departure_time timestamp, arrival_delay int, "
              "departure_delay int, schedule_relationship int, scheduled_time timestamp, first_seen_at timestamp, last_seen_at timestamp, first_fetch_id long")
EVENTS = ("service_date date, trip_id string, stop_sequence int, stop_id string, route_id string, direction_id int, is_timepoint boolean, "
          "scheduled_arrival timestamp, scored_time timestamp, status string")


def at(s):
    return None if s is None else T + timedelta(seconds=s)


def told(trip, seq, predicted, first, last, arrival=True, due=None, skipped=0):
    times = (at(predicted), None) if arrival else (None, at(predicted))
    return (trip, DAY, seq, f"S{seq}", *times, None, None, skipped, at(due), at(first), at(last), 1)


CURRENT = [told("a", 1, 600.25, 0.5, 599.75), told("a", 2, 900, 0, None, arrival=False), told("b", 1, 30, 60.000001, 90, due=7), told("b", 2, None, 0, 9),
           told(None, 1, 600, 0, 9), told("c", 1, 50, None, 9), told("d", 1, 100, 10, 20, skipped=1)]
HISTORY = [told("a", 1, 700, -300.125, 0.5), told("a", 1, 9000, -10, 0.5), told("a", 2, 901, -60, -1), told("a", 2, 901, -60, -1), told("d", 1, 99, 10, 15),
           told("c", 1, 49, None, 12)]
CAME = [(DAY, "a", 1, "S1", "R", 0, True, at(590), at(650.5), "late"), (DAY, "a", 2, "S2", "R", None, None, None, at(880), "early"),
        (DAY, "a", 2, "S2", "R2", 1, False, at(1), at(-30), "early"), (DAY, "b", 1, "S1", "R", 0, True, at(1), at(61), None),
        (DAY, "b", 1, "S1", "R", 1, True, at(1), at(61), "late"), (DAY, "d", 1, "S1", "R", 1, True, at(1), None, "late")]


def made(spark):
    closed = spark.createDataFrame([(*r, None) for r in HISTORY], f"{PREDICTION}, closed_at timestamp")
    return {"prediction_current": spark.createDataFrame(CURRENT, PREDICTION), "prediction_history": closed, "stop_events": spark.createDataFrame(CAME, EVENTS)}


def test_predictions_meet_their_events_with_all_their_moments(spark):
    got = facts.prediction_errors(made(spark))
    expected = []
    for day, trip, seq, stop, route, direction, timepoint, due, came, status in CAME:
        for p in CURRENT + HISTORY:
            predicted, first, last = p[4] or p[5], p[10], p[11]
            if status and came and p[:3] == (trip, day, seq) and predicted and first and first < came and -60 < (predicted - first).total_seconds() < 5400:
                expected.append((day, trip, seq, stop, route, direction, timepoint, due, came, predicted, first, last))
    columns = ["service_date", "trip_id", "stop_sequence", "stop_id", "route_id", "direction_id", "is_timepoint"]
    moments = ["scheduled_arrival", "observed_arrival", "predicted_arrival", "predicted_at", "predicted_until"]
    us = lambda t: None if t is None else round((t - datetime(1970, 1, 1, tzinfo=timezone.utc)) / timedelta(microseconds=1))
    assert rows(got.select(*columns, *[F.unix_micros(m) for m in moments])) == sorted([(*e[:7], *map(us, e[7:])) for e in expected], key=repr)
    assert len(expected) == 8 and [r.horizon_s for r in got.filter("predicted_at = timestamp '2024-01-05 20:00:00.5'").collect()] == [600]


def test_predictions_are_shuffled_as_distances(spark, tables):
    plan = facts.prediction_errors(tables)._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("Join Inner"):]
    assert "stood_us" in below and "last_seen_at" not in below.split("Union")[0]


def test_settled_times_are_those_last_told(spark):
    got = arrivals.feed_settled_times(made(spark))
    order = lambda p: tuple((t is not None, t or T) for t in (p[10], p[11]))
    expected = []
    for key in {p[:3] for p in CURRENT + HISTORY}:
        p = max((p for p in CURRENT + HISTORY if p[:3] == key and (p[4] or p[5])), key=order, default=None)
        if p:
            predicted, last = p[4] or p[5], p[11]
            held = None if last is None else round((last - predicted).total_seconds(), 6)
            expected.append((p[0], p[1], p[2], p[3], predicted.timestamp(), p[9] and p[9].timestamp(), p[8] == 1, None if held is None else held >= 0, held))
    columns = [F.unix_micros(c) / 1e6 if c in ("settled_time", "feed_scheduled_time") else F.col(c) for c in got.columns]
    assert rows(got.select(*columns)) == sorted(expected, key=repr) and len(expected) == 6
    assert got.filter("trip_id = 'c'").first()["held_after_s"] == -37  # of two first seen nobody knows when, the last seen


def test_moments_of_an_event_are_shuffled_as_distances_and_whole_events_once(spark, tables):
    plan = arrivals.feed_settled_times(tables)._jdf.queryExecution().executedPlan().toString()
    assert "max_by" not in plan and "partial_max(" in plan
    joined = facts.stop_events(tables, datetime(2024, 1, 28, 20, 0, tzinfo=timezone.utc))._jdf.queryExecution().optimizedPlan().toString()
    assert joined.count("strategy=broadcast") == 2
