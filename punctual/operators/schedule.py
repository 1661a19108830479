"""Staging views and the schedule chain: versions by date, services, filled times, stop events."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from punctual.config import DEFAULT, Config
from punctual.functions.timeutil import local_day, service_moment, utc_date
from punctual.sources.gtfs import WEEKDAYS

Tables = Mapping[str, DataFrame]


# --- staging views -------------------------------------------------------------------------


def stg_routes(t: Tables) -> DataFrame:
    return t["routes"].select("feed_version_id", "route_id", "route_short_name", "route_long_name", "route_type")


def stg_trips(t: Tables) -> DataFrame:
    return t["trips"].select(
        "feed_version_id", "trip_id", "route_id", "service_id", "direction_id", "trip_headsign", "block_id", "shape_id"
    )


def stg_stops(t: Tables) -> DataFrame:
    """Places riders board; stations and entrances are not stop events."""
    return (
        t["stops"]
        .filter(F.col("location_type") == 0)
        .select("feed_version_id", "stop_id", "stop_code", "stop_name", "stop_lat", "stop_lon")
    )


def timepoint_flag(timepoint: Column, arrival_seconds: Column) -> Column:
    """Flagged by the feed, or failing a flag, given a time at all."""
    return F.coalesce(timepoint == 1, arrival_seconds.isNotNull())


def stg_stop_times(t: Tables) -> DataFrame:
    return t["stop_times"].select(
        "feed_version_id",
        "trip_id",
        "stop_sequence",
        "stop_id",
        "arrival_seconds",
        "departure_seconds",
        timepoint_flag(F.col("timepoint"), F.col("arrival_seconds")).alias("is_timepoint"),
        "pickup_type",
        "drop_off_type",
        "shape_dist_traveled",
    )


def stg_predictions(t: Tables) -> DataFrame:
    """Every value ever asserted for a trip's stop, current and superseded."""
    both = (
        t["prediction_current"]
        .withColumn("is_superseded", F.lit(False))
        .unionByName(t["prediction_history"].drop("closed_at").withColumn("is_superseded", F.lit(True)))
    )
    return both.select(
        "trip_id",
        F.col("start_date").alias("service_date"),
        "stop_sequence",
        "stop_id",
        "arrival_time",
        "departure_time",
        "arrival_delay",
        "departure_delay",
        "schedule_relationship",
        F.coalesce("arrival_time", "departure_time").alias("predicted_time"),
        F.coalesce("arrival_delay", "departure_delay").alias("predicted_delay"),
        F.col("scheduled_time").alias("feed_scheduled_time"),
        "first_seen_at",
        "last_seen_at",
        "first_fetch_id",
        "is_superseded",
    )


def stg_vehicle_positions(t: Tables) -> DataFrame:
    p = t["vehicle_position"]
    return p.withColumnRenamed("start_date", "service_date")


# --- versions and services -----------------------------------------------------------------


def feed_version_by_date(t: Tables, as_of: datetime, cfg: Config = DEFAULT) -> DataFrame:
    """For each date, the most recently downloaded version whose service covers it.

    Each version lists its own dates (a few hundred), so the range join becomes a plain aggregation
    by date."""
    pattern = t["calendar"].groupBy("feed_version_id").agg(
        F.min("start_date").alias("cover_start"), F.max("end_date").alias("cover_end")
    )
    added = (
        t["calendar_dates"]
        .filter(F.col("exception_type") == 1)
        .groupBy("feed_version_id")
        .agg(F.min("date").alias("cover_start"), F.max("date").alias("cover_end"))
    )
    spans = (
        pattern.unionByName(added)
        .join(t["feed_version"].select("feed_version_id", "downloaded_at"), "feed_version_id")
        .groupBy("feed_version_id")
        .agg(
            F.min("cover_start").alias("cover_start"),
            F.max("cover_end").alias("cover_end"),
            F.max("downloaded_at").alias("downloaded_at"),
        )
    )
    today = utc_date(as_of)
    began = t["fetch"].agg(
        F.coalesce(F.min(local_day(F.col("fetched_at"), cfg.timezone)), F.lit(today))
    ).scalar()
    first = F.greatest(F.col("cover_start"), began)
    last = F.least(F.col("cover_end"), F.lit(today + timedelta(days=1)))
    return (
        spans.withColumn("first_day", first)
        .withColumn("last_day", last)
        .filter(F.col("first_day") <= F.col("last_day"))
        .select(
            F.explode(F.sequence("first_day", "last_day")).alias("service_date"),
            "downloaded_at",
            "feed_version_id",
        )
        .groupBy("service_date")
        .agg(F.max_by("feed_version_id", F.struct("downloaded_at", "feed_version_id")).alias("feed_version_id"))
    )


def runs_on(day: Column) -> Column:
    """The calendar's flag for the weekday of ``day``."""
    dow = F.weekday(day)
    flag = F.lit(False)
    for i, name in enumerate(WEEKDAYS):
        flag = F.when(dow == i, F.col(name)).otherwise(flag)
    return F.coalesce(flag, F.lit(False))


def active_services(t: Tables, versions: DataFrame | None = None) -> DataFrame:
    """(service_date, version, service): the weekday pattern inside its range, with the calendar's
    additions and without its removals."""
    fv = t["feed_version_by_date"] if versions is None else versions
    key = ["service_date", "feed_version_id", "service_id"]
    regular = (
        fv.join(t["calendar"], "feed_version_id")
        .filter(F.col("service_date").between(F.col("start_date"), F.col("end_date")))
        .filter(runs_on(F.col("service_date")))
        .select(*key)
    )
    exceptions = fv.join(
        t["calendar_dates"].withColumnRenamed("date", "service_date"), ["feed_version_id", "service_date"]
    ).select(*key, "exception_type")
    return (
        regular.unionByName(exceptions.filter("exception_type = 1").select(*key))
        .distinct()
        .join(exceptions.filter("exception_type = 2").select(*key), key, "left_anti")
    )


# --- times ---------------------------------------------------------------------------------


def stop_times_filled(t: Tables) -> DataFrame:
    """Blank times between timepoints, by distance along the shape where the schedule gives it, else
    by counting stops; the ends copy their nearest known time."""
    st = stg_stop_times(t).select(
        "feed_version_id",
        "trip_id",
        "stop_sequence",
        "stop_id",
        "is_timepoint",
        F.coalesce("arrival_seconds", "departure_seconds").alias("known"),
        F.col("shape_dist_traveled").alias("dist"),
    )
    trip = Window.partitionBy("feed_version_id", "trip_id")
    forward = trip.orderBy("stop_sequence")
    # the nearest known stop ahead is the last one met coming from the other end: both windows run
    # over a growing frame, so a trip's rows are read once each way
    backward = trip.orderBy(F.col("stop_sequence").desc())
    growing = (Window.unboundedPreceding, 0)
    numbered = st.withColumn("rn", F.row_number().over(forward))
    anchor = F.when(F.col("known").isNotNull(), F.struct("rn", "known", "dist"))
    a = numbered.withColumn("a", F.last(anchor, True).over(forward.rowsBetween(*growing))).withColumn(
        "b", F.last(anchor, True).over(backward.rowsBetween(*growing))
    )
    gap = F.col("b.known") - F.col("a.known")
    measured = (
        F.col("dist").isNotNull() & F.col("a.dist").isNotNull() & F.col("b.dist").isNotNull()
        & (F.col("b.dist") > F.col("a.dist"))
    )
    # the distance branch rounds halves to even, the count branch away from zero
    by_distance = F.rint(
        F.col("a.known") + gap * (F.col("dist") - F.col("a.dist")) / (F.col("b.dist") - F.col("a.dist"))
    ).cast("int")
    by_count = F.round(
        F.col("a.known") + gap * (F.col("rn") - F.col("a.rn")) / (F.col("b.rn") - F.col("a.rn"))
    ).cast("int")
    return a.select(
        "feed_version_id",
        "trip_id",
        "stop_sequence",
        "stop_id",
        "is_timepoint",
        F.col("known").isNotNull().alias("has_scheduled_time"),
        F.when(F.col("known").isNotNull(), F.col("known"))
        .when(F.col("a").isNull(), F.col("b.known"))
        .when(F.col("b").isNull(), F.col("a.known"))
        .when(measured, by_distance)
        .otherwise(by_count)
        .alias("arrival_seconds"),
    )


def scheduled_stop_events(
    t: Tables, services: DataFrame | None = None, filled: DataFrame | None = None, cfg: Config = DEFAULT
) -> DataFrame:
    """Every stop of every trip on each day its service runs, as a moment.

    First and last stop are worked out once per scheduled trip, not once per day, so the window runs
    over the timetable before it is multiplied by dates."""
    services = t["active_services"] if services is None else services
    filled = t["stop_times_filled"] if filled is None else filled
    trip = Window.partitionBy("feed_version_id", "trip_id")
    ends = filled.withColumn("lo", F.min("stop_sequence").over(trip)).withColumn(
        "hi", F.max("stop_sequence").over(trip)
    )
    timetable = ends.join(
        t["trips"].select("feed_version_id", "trip_id", "route_id", "direction_id", "service_id"),
        ["feed_version_id", "trip_id"],
    )
    return timetable.join(services, ["feed_version_id", "service_id"]).select(
        "service_date",
        "feed_version_id",
        "trip_id",
        "route_id",
        "direction_id",
        "stop_sequence",
        "stop_id",
        "is_timepoint",
        "has_scheduled_time",
        service_moment(F.col("service_date"), F.col("arrival_seconds"), cfg.timezone).alias("scheduled_arrival"),
        (F.col("stop_sequence") == F.col("lo")).alias("is_first_stop"),
        (F.col("stop_sequence") == F.col("hi")).alias("is_last_stop"),
    )


def newest_version(t: Tables) -> Column:
    """The highest version loaded, as a scalar subquery (one value; no join)."""
    return t["feed_version"].agg(F.max("feed_version_id")).scalar()
