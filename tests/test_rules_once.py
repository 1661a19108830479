"""The rules of a table are told from one pass over it, and a build of many tables leaves no shuffle files."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from punctual.operators import quality
from punctual.session import shuffles_freed

RULES = [("unique", ("day", "trip")), ("not_null", "trip"), ("values", "status", ("early", "late")), ("range", "s", 0, 9, None),
         ("range", "s", None, 5, "status is not null"), ("unique", ("trip",))]


def odd_rows(spark):
    day = date(2024, 1, 1)
    made = [(day, "a", "early", 3), (day, "a", "odd", 7), (None, "a", None, 11), (None, "a", "late", None), (day, None, "late", -1),
            (day, None, "odd", 6), (day, "b", "early", 6), (day, "c", None, 9)]
    return spark.createDataFrame(made, "day date, trip string, status string, s int")


def failures(df, rules):
    return {r.check: r.failures for r in quality.table_summary(df, "t", rules).collect()}


def test_counts_are_those_of_the_checks_one_by_one(spark):
    df = odd_rows(spark)
    one_by_one = [quality.unique(df, ["day", "trip"]), quality.not_null(df, "trip"), quality.accepted_values(df, "status", ("early", "late")),
                  quality.accepted_range(df, "s", 0, 9), quality.accepted_range(df, "s", None, 5, F.expr("status is not null")),
                  quality.unique(df, ["trip"])]
    single = [failures(df, [r]) for r in RULES]
    assert [next(iter(f.values())) for f in single] == [d.count() for d in one_by_one] == [3, 2, 2, 2, 3, 2]
    assert failures(df, RULES[:4]) == {k: v for f in single[:4] for k, v in f.items()}
    assert sorted(r.failures for r in quality.table_summary(df, "t", RULES).collect()) == sorted(d.count() for d in one_by_one)
    assert set(failures(df.limit(0), RULES).values()) == {0}


def test_a_table_is_worked_out_once_for_all_its_rules(spark, tables):
    plan = quality.summary(tables, ["stop_events"])._jdf.queryExecution().optimizedPlan().toString()
    assert len(quality.RULES["stop_events"]) > 2 and plan.count("Relation [") == 1


def test_shuffles_are_freed_and_the_setting_comes_back(spark):
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    with shuffles_freed(spark):
        assert spark.conf.get(name) == "true"
    assert spark.conf.get(name, None) == before


def test_a_build_frees_the_shuffles_of_each_step(spark, tables, monkeypatch, tmp_path):
    from punctual.catalog.queries import AS_OF
    from punctual.plans.pipeline import Build

    name, seen = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", []
    monkeypatch.setattr(Build, "_write", lambda self, step, *_: seen.append((step, self.spark.conf.get(name))))
    before = spark.conf.get(name, None)
    Build(spark, str(tmp_path), tables, AS_OF).run(only={"shape_lines", "stop_events"})
    assert seen == [("shape_lines", "true"), ("stop_events", "true")] and spark.conf.get(name, None) == before
