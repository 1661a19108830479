"""What the countdown told: rows repeated by plain numbers, events sorted once, seconds rounded in whole numbers."""

from __future__ import annotations

from datetime import date

from conftest import SMALL, rows
from pyspark.sql import functions as F

from punctual.catalog import queries
from punctual.functions.timeutil import round_int, seconds_between, whole_seconds_between
from punctual.operators import marts


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_samples_are_sorted_once_after_the_join_and_repeat_without_functions(spark):
    plan = plan_of(queries.Tables(spark, SMALL)["countdown_samples"])
    assert "SortMergeJoin" not in plan and "lambda" not in plan
    assert plan.split("ShuffledHashJoin")[0].count("Sort [") == 1


def test_told_rows_repeat_numbers_and_keep_every_row(spark):
    day = date(2024, 1, 1)
    samples = spark.createDataFrame(
        [(day, 15, 10, 100, True), (day, 15, 10, 100, True), (day, 3, None, 7, True), (day, 15, 1, None, True), (day, 15, 5, 5, False)],
        "service_date date, ahead_min int, error_s int, schedule_error_s int, in_comparison boolean")
    told = marts._told(samples, ["service_date"])
    assert "lambda" not in plan_of(told)
    assert [r[1:] for r in rows(told)] == sorted(
        [("sign", 15, 10), ("timetable", None, 100)] * 2 + [("sign", 3, None), ("sign", 15, 1), ("timetable", None, None)], key=repr)


def test_seconds_round_as_before(spark):
    micros = [0, 1, 499_999, 500_000, 500_001, 1_500_000, 2_499_999, 86_400_500_000, None]
    df = spark.createDataFrame([(m, s) for m in micros for s in (1, -1)], "us long, sign int").select(
        F.timestamp_micros(F.lit(1_700_000_000_000_000) + F.col("us") * F.col("sign")).alias("a"), F.timestamp_seconds(F.lit(1_700_000_000)).alias("b"))
    whole = whole_seconds_between(F.col("a"), F.col("b"))
    assert "double" not in plan_of(df.select(whole)).lower()
    got = df.select(whole.alias("x"), round_int(seconds_between(F.col("a"), F.col("b"))).alias("y")).collect()
    assert len(got) == 18 and all(r["x"] == r["y"] for r in got)
