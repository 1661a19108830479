"""Checks that hold two tables made from the countdown samples against each other work the samples out once."""

from __future__ import annotations

import __spark_entry__ as entry
import pytest
from conftest import SMALL

from punctual.catalog import queries


@pytest.mark.parametrize("name", ["d12_prediction_check", "d12_report_card_check"])
def test_samples_are_read_back_by_both(spark, name):
    plan = entry.queries()[name](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "predicted_until" not in plan and plan.count("error_s") > 1


def test_all_samples_in_comparison_are_kept(spark, tables):
    samples = tables["countdown_samples"].filter("in_comparison")
    kept = queries.samples_once(queries.Tables(spark, SMALL))["countdown_samples"]
    assert kept.dtypes == samples.dtypes and kept.count() == samples.count() > 0
    assert kept.exceptAll(samples).isEmpty()


def test_the_samples_shuffles_are_freed_when_they_are_written(spark, monkeypatch):
    seen, writer = [], type(spark.range(1).write)
    write = writer.parquet
    watched = lambda self, *a, **b: (seen.append(spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None)), write(self, *a, **b))
    monkeypatch.setattr(writer, "parquet", watched)
    queries.samples_once(queries.Tables(spark, SMALL))
    assert seen == ["true"]
