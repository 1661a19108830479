"""Stops on the first pass of a shape: looked for once for each stop and shape, told for every trip."""

from __future__ import annotations

import re

from conftest import rows
from pyspark.sql import functions as F

from punctual.catalog.queries import first_passes
from punctual.functions import lines
from punctual.functions.geo import utm
from punctual.operators import geometry


def made(spark):
    stops = [(1, f"S{i}", 44.0 + i * 0.001, -123.0 + i * 0.002) for i in range(6)] + [(1, "S2", 44.5, -123.1), (1, None, 44.0, -123.0), (2, "S0", 44.0, -123.0)]
    trips = [(1, f"T{k}", f"P{k % 2}") for k in range(8)] + [(1, "T1", "P1"), (1, "T3", None), (2, "T0", "P0"), (1, None, "P0")]
    times = [(1, f"T{k}", i, f"S{i}") for k in range(8) for i in range(6)] * 2 + [(1, "T0", 7, None), (2, "T0", 1, "S0"), (1, None, 1, "S1"), (1, "T9", 1, "S1")]
    shapes = [(1, f"P{p}", i, 44.0 + i * 0.001, -123.0 + i * 0.002 * (p + 1)) for p in range(2) for i in range(6)]
    return {
        "stops": spark.createDataFrame(stops, "feed_version_id int, stop_id string, stop_lat double, stop_lon double"),
        "trips": spark.createDataFrame(trips, "feed_version_id int, trip_id string, shape_id string"),
        "stop_times": spark.createDataFrame(times, "feed_version_id int, trip_id string, stop_sequence int, stop_id string"),
        "shapes": spark.createDataFrame(shapes, "feed_version_id int, shape_id string, shape_pt_sequence int, shape_pt_lat double, shape_pt_lon double"),
    }


def test_places_are_those_of_every_row_by_itself(spark):
    t, key = made(spark), ["feed_version_id", "trip_id"]
    x, y = utm(F.col("stop_lon"), F.col("stop_lat"))
    each = (
        t["stop_times"].join(t["stops"], ["feed_version_id", "stop_id"]).join(t["trips"], key).join(geometry.shape_lines(t), ["feed_version_id", "shape_id"])
        .withColumn("p", lines.first_pass(F.col("line"), x, y, F.lit(0.0), F.lit(1.0))).select(*key, "stop_sequence", "p.frac", "p.dist_m"))
    got = rows(first_passes(t))
    assert got == rows(each) and len(got) == (8 * 6 + 6) * 2 + 9 * 2


def test_a_place_is_looked_for_once_for_a_stop_and_shape(spark, tables):
    plan = first_passes(tables)._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"Aggregate \[feed_version_id#\d+, shape_id#\d+, stop_id#\d+\]", plan)
