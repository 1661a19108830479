"""The order a bus reaches a route's stops, from all of its trips' stop lists."""

from __future__ import annotations

from collections.abc import Mapping

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from punctual.functions.routeorder import by_importance, fit_patterns

Tables = Mapping[str, DataFrame]
ROUTE = ["feed_version_id", "route_id", "direction_id"]


def stop_patterns(t: Tables, fv=None) -> DataFrame:
    """Distinct stop lists per route and direction with how many trips use each. A trip's list is one
    vehicle run (tens of stops); trips are reduced to distinct lists before anything is grouped by
    route."""
    trips = t["trips"].filter(F.col("direction_id").isNotNull())
    if fv is not None:
        trips = trips.filter(F.col("feed_version_id") == fv)
    per_trip = (
        t["stop_times"]
        .groupBy("feed_version_id", "trip_id")
        .agg(F.array_sort(F.collect_list(F.struct("stop_sequence", "stop_id"))).alias("run"))
        .join(trips.select("trip_id", *ROUTE), ["feed_version_id", "trip_id"])
    )
    return per_trip.groupBy(*ROUTE, F.col("run.stop_id").alias("stops")).agg(
        F.count(F.lit(1)).alias("trips"), F.max(F.col("run.stop_sequence")).alias("seqs")
    )


_PLACED = (
    "feed_version_id int, route_id string, direction_id int, pattern int, stop_id string, "
    "stop_sequence int, place int, trips long"
)


def placed_patterns(patterns: DataFrame) -> DataFrame:
    """Each stop of each stop list with its place in the route's merged order."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        lists = [(list(s), int(n)) for s, n in zip(pdf["stops"], pdf["trips"])]
        ranked = by_importance(lists)
        _, places = fit_patterns([lists[i][0] for i in ranked])
        seqs = pdf["seqs"].tolist()
        rows = [
            (rank, stop, int(seq), place, lists[i][1])
            for rank, (i, path) in enumerate(zip(ranked, places))
            for stop, seq, place in zip(lists[i][0], seqs[i], path)
        ]
        out = pd.DataFrame(rows, columns=["pattern", "stop_id", "stop_sequence", "place", "trips"])
        for column in ROUTE:
            out[column] = pdf[column].iloc[0]
        return out[[c.split()[0] for c in _PLACED.split(", ")]]

    return patterns.groupBy(*ROUTE).applyInPandas(fit, _PLACED)


def stop_places(t: Tables, fv=None, placed: DataFrame | None = None) -> DataFrame:
    """(route, direction, stop, stop number) -> place: where stop lists disagree, the place most
    trips give it (the earlier of two equally used)."""
    placed = placed_patterns(stop_patterns(t, fv)) if placed is None else placed
    votes = placed.groupBy(*ROUTE, "stop_id", "stop_sequence", "place").agg(F.sum("trips").alias("votes"))
    return votes.groupBy(*ROUTE, "stop_id", "stop_sequence").agg(
        F.max_by("place", F.struct(F.col("votes"), -F.col("place"))).alias("place")
    )


def route_order(placed: DataFrame) -> DataFrame:
    """The merged order itself: one row per place."""
    return placed.groupBy(*ROUTE, "place").agg(F.min("stop_id").alias("stop_id"))


def order_check(t: Tables, fv=None) -> DataFrame:
    """Routes whose trips make different stops: stop lists, longest list, places, stops visited twice,
    and how many stops an order by smallest stop number would have put elsewhere."""
    patterns = stop_patterns(t, fv)
    placed = placed_patterns(patterns)
    route = Window.partitionBy(*ROUTE)
    lists = patterns.groupBy(*ROUTE).agg(
        F.sum("trips").alias("trips"),
        F.count(F.lit(1)).alias("stop_lists"),
        F.max(F.size("stops")).alias("longest"),
        F.bool_or(F.size(F.array_distinct("stops")) < F.size("stops")).alias("twice"),
    )
    order = route_order(placed)
    places = order.groupBy(*ROUTE).agg(
        F.count(F.lit(1)).alias("places"),
        (F.count(F.lit(1)) - F.count_distinct("stop_id")).alias("stops_twice"),
    )
    new = order.groupBy(*ROUTE, "stop_id").agg(F.min("place").alias("first_place")).withColumn(
        "new_rank", F.row_number().over(route.orderBy("first_place"))
    )
    old = placed.groupBy(*ROUTE, "stop_id").agg(F.min("stop_sequence").alias("lowest")).withColumn(
        "old_rank", F.row_number().over(route.orderBy("lowest", "stop_id"))
    )
    moved = (
        new.join(old, [*ROUTE, "stop_id"])
        .groupBy(*ROUTE)
        .agg(F.count_if(F.col("new_rank") != F.col("old_rank")).alias("old_order_moved"))
    )
    return (
        lists.filter((F.col("stop_lists") > 1) | F.col("twice"))
        .join(places, ROUTE)
        .join(moved, ROUTE)
        .join(t["routes"].select("feed_version_id", "route_id", "route_short_name"), ["feed_version_id", "route_id"])
        .select(
            "feed_version_id", "route_short_name", "direction_id", "trips", "stop_lists", "longest", "places", "stops_twice", "old_order_moved"
        )
    )
