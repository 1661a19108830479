"""Versions, services, filled times and moments, worked by hand."""

from __future__ import annotations

from datetime import date, datetime, timezone

from conftest import rows
from pyspark.sql import functions as F

from punctual import schemas
from punctual.functions import timeutil
from punctual.operators import schedule

LA = "America/Los_Angeles"


def table(spark, name, data):
    return spark.createDataFrame(data, schemas.SOURCES[name])


def stop_times(spark, known, dist=None):
    dist = dist or [None] * len(known)
    return table(spark, "stop_times", [(1, "T", i + 1, f"S{i}", k, None, None, None, None, d) for i, (k, d) in enumerate(zip(known, dist))])


def filled(spark, known, dist=None):
    return [r["arrival_seconds"] for r in schedule.stop_times_filled({"stop_times": stop_times(spark, known, dist)}).orderBy("stop_sequence").collect()]


def test_fill_by_stop_count_rounds_halves_away(spark):
    assert filled(spark, [100, None, 105]) == [100, 103, 105]  # 102.5
    assert filled(spark, [0, None, None, 90]) == [0, 30, 60, 90]


def test_fill_by_distance_rounds_halves_to_even(spark):
    assert filled(spark, [100, None, 105], [0.0, 5.0, 10.0]) == [100, 102, 105]  # 102.5
    assert filled(spark, [0, None, 100], [0.0, 2.0, 10.0]) == [0, 20, 100]


def test_fill_ends_copy_and_bad_distances_fall_back(spark):
    assert filled(spark, [None, 50, None]) == [50, 50, 50]
    assert filled(spark, [0, None, 100], [10.0, 10.0, 10.0]) == [0, 50, 100]
    assert filled(spark, [None, None]) == [None, None]


def test_moments_are_anchored_at_noon_on_clock_change_days(spark):
    df = spark.createDataFrame([(date(2026, 11, 1), 8 * 3600), (date(2026, 3, 8), 8 * 3600), (date(2026, 9, 16), 24 * 3600 + 300)], "d date, s int")
    got = [r[0] for r in df.select(F.date_format(timeutil.service_moment(F.col("d"), F.col("s"), LA), "yyyy-MM-dd HH:mm")).collect()]
    assert got == ["2026-11-01 16:00", "2026-03-08 15:00", "2026-09-17 07:05"]


def test_service_day_rolls_over_at_three():
    for when, day in ((datetime(2026, 9, 16, 9, 30, tzinfo=timezone.utc), 15), (datetime(2026, 9, 16, 10, 30, tzinfo=timezone.utc), 16)):
        assert timeutil.service_date(when, LA) == date(2026, 9, day)


def test_version_services_and_events(spark):
    ts = lambda d: datetime(2026, 9, d, tzinfo=timezone.utc)
    t = {
        "feed_version": spark.createDataFrame([(1, ts(1)), (2, ts(10))], "feed_version_id int, downloaded_at timestamp"),
        "calendar": table(spark, "calendar", [
            (1, "WK", True, True, True, True, True, False, False, date(2026, 9, 1), date(2026, 9, 30)),
            (2, "WK", True, True, True, True, True, False, False, date(2026, 9, 9), date(2026, 9, 30))]),
        "calendar_dates": table(spark, "calendar_dates", [(2, "WK", date(2026, 9, 10), 2), (2, "SA", date(2026, 9, 12), 1)]),
        "fetch": spark.createDataFrame([(ts(8).replace(hour=12),)], "fetched_at timestamp"),
    }
    as_of = ts(12).replace(hour=12)
    fv = schedule.feed_version_by_date(t, as_of)
    assert [(r[0].day, r[1]) for r in fv.orderBy("service_date").collect()] == [(8, 1), (9, 2), (10, 2), (11, 2), (12, 2), (13, 2)]
    t["feed_version_by_date"] = fv
    got = sorted((r["service_date"].day, r["service_id"]) for r in schedule.active_services(t).collect())
    assert got == [(8, "WK"), (9, "WK"), (11, "WK"), (12, "SA")]


def test_timepoint_flag(spark):
    df = spark.createDataFrame([(1, None), (0, 10), (None, 10), (None, None)], "timepoint int, a int")
    assert [r[0] for r in df.select(schedule.timepoint_flag(F.col("timepoint"), F.col("a"))).collect()] == [True, False, True, False]


def test_filled_times_never_decrease(tables):
    from punctual.operators import quality

    assert rows(quality.filled_times_in_order(tables)) == []
