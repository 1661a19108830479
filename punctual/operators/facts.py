"""The three fact tables: scored stop events, scored predictions, countdown samples."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import date, datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from punctual.config import DEFAULT, Config
from punctual.functions.timeutil import (
    floor_int,
    local_day,
    local_hour,
    micros_between,
    round_int,
    seconds_between,
    service_date,
    weekday_type,
    whole_seconds_between,
)
from punctual.operators.arrivals import since_day
from punctual.operators.schedule import stg_predictions

Tables = Mapping[str, DataFrame]
EVENT = ["service_date", "trip_id", "stop_sequence"]
#: The same for joins and windows: sorting by the trip first tells most rows apart by their first bytes.
KEY = ["trip_id", "service_date", "stop_sequence"]


def stop_events(t: Tables, as_of: datetime, cfg: Config = DEFAULT, start: date | None = None) -> DataFrame:
    """One row per scheduled stop event, with what was observed and how it is scored.

    The time scored is when the bus left: our time from its positions, or, at a trip's first stop
    and at timepoints, the later of that and the departure the agency's feed settled on. Our time
    counts only if bounded, plausible, precise and not at a doubtful stop."""
    last_day = F.lit(service_date(as_of, cfg.timezone, cfg.rollover_hours))
    first_day = t["fetch"].agg(F.min(local_day(F.col("fetched_at"), cfg.timezone))).scalar()
    due = since_day(t["scheduled_stop_events"], start).filter(
        (F.col("service_date") <= last_day) & (F.col("service_date") >= first_day)
    )
    names = t["routes"].select("feed_version_id", "route_id", "route_short_name")
    seen = (
        since_day(t["vehicle_position"], start, "start_date")
        .filter(F.col("trip_id").isNotNull() & F.col("start_date").isNotNull())
        .select("trip_id", F.col("start_date").alias("service_date"))
        .distinct()
        .withColumn("trip_had_realtime", F.lit(True))
    )
    obs = since_day(t["observed_arrivals"], start).select(
        *EVENT, "vehicle_id", "observed_arrival", "uncertainty_s", "is_bounded", "is_plausible"
    )
    settled = (
        since_day(t["feed_settled_times"], start)
        .filter("is_settled")
        .select(*EVENT, F.col("settled_time").alias("feed_settled_time"), "feed_scheduled_time", "was_skipped")
    )
    doubtful = t["doubtful_stops"].select(
        F.col("route_id").alias("d_route"),
        F.col("direction_id").alias("d_direction"),
        F.col("stop_id").alias("d_stop"),
        F.lit(True).alias("is_doubtful"),
    )
    # what is told of a trip comes before what is told of its events, while rows are narrow; the event joins share one
    # partitioning, and nothing is dealt anew after them: versions' routes and doubtful stops are as many as the network
    # has, whatever the days
    joined = (
        due.join(seen, ["trip_id", "service_date"], "left")
        .join(obs, KEY, "left")
        .join(settled, KEY, "left")
        .join(F.broadcast(names), ["feed_version_id", "route_id"])
        .join(
            F.broadcast(doubtful),
            (F.col("d_route") == F.col("route_id"))
            & (F.col("d_stop") == F.col("stop_id"))
            & F.col("d_direction").eqNullSafe(F.col("direction_id")),
            "left",
        )
    )
    yes = lambda c: F.coalesce(c, F.lit(False))
    agency_late = seconds_between(F.col("feed_settled_time"), F.col("scheduled_arrival"))
    gps_ok = (
        F.col("is_bounded") & F.col("is_plausible") & ~F.col("is_doubtful") & F.col("is_precise")
    )
    agency_ok = yes(
        (F.col("is_first_stop") | F.col("is_timepoint"))
        & F.col("feed_settled_time").isNotNull()
        & ~F.col("was_skipped")
        & F.col("trip_had_realtime")
        & agency_late.between(-cfg.plausible_early_s, cfg.plausible_late_s)
    )
    flagged = (
        joined.withColumn("methods_diff_s", F.when(
            F.col("is_bounded"),
            round_int(seconds_between(F.col("feed_settled_time"), F.col("observed_arrival"))),
        ))
        .withColumn("is_bounded", yes(F.col("is_bounded")))
        .withColumn("is_plausible", yes(F.col("is_plausible")))
        .withColumn("is_precise", yes(F.col("uncertainty_s") <= cfg.max_uncertainty_s))
        .withColumn("was_skipped", yes(F.col("was_skipped")))
        .withColumn("trip_had_realtime", yes(F.col("trip_had_realtime")))
        .withColumn("is_doubtful", yes(F.col("is_doubtful")))
    )
    picked = flagged.withColumn("gps_ok", gps_ok).withColumn(
        "agency_scored",
        agency_ok & ~yes(F.col("gps_ok") & (F.col("observed_arrival") > F.col("feed_settled_time"))),
    )
    scored = picked.withColumn(
        "scored_time",
        F.when(F.col("agency_scored"), F.col("feed_settled_time")).when(
            F.col("gps_ok"), F.col("observed_arrival")
        ),
    )
    late = seconds_between(F.col("scored_time"), F.col("scheduled_arrival"))
    gps_late = seconds_between(F.col("observed_arrival"), F.col("scheduled_arrival"))
    return scored.select(
        *EVENT,
        "stop_id",
        "route_id",
        "route_short_name",
        "direction_id",
        "is_timepoint",
        "is_first_stop",
        "is_last_stop",
        "scheduled_arrival",
        local_hour(F.col("scheduled_arrival"), cfg.timezone).alias("hour_local"),
        weekday_type(F.col("service_date")).alias("weekday_type"),
        "trip_had_realtime",
        "vehicle_id",
        "observed_arrival",
        "uncertainty_s",
        "is_bounded",
        "is_plausible",
        "is_precise",
        "is_doubtful",
        "feed_settled_time",
        "feed_scheduled_time",
        "was_skipped",
        "methods_diff_s",
        "scored_time",
        F.when(F.col("agency_scored"), cfg.source_agency)
        .when(F.col("observed_arrival").isNotNull(), cfg.source_gps)
        .alias("time_source"),
        F.when(F.col("agency_scored"), round_int(late))
        .when(F.col("is_bounded") & ~F.col("is_doubtful"), round_int(gps_late))
        .alias("delay_s"),
        F.when(F.col("scored_time").isNull(), F.lit(None).cast("string"))
        .when(late < -cfg.early_s, "early")
        .when(late > cfg.late_s, "late")
        .otherwise("on_time")
        .alias("status"),
    )


def prediction_errors(t: Tables, cfg: Config = DEFAULT, start: date | None = None) -> DataFrame:
    """Every prediction made before the bus came and not absurdly far ahead, against the time scored
    for its stop. Positive error = the bus came later than predicted."""
    second = 1_000_000
    ahead_us = micros_between(F.col("predicted_time"), F.col("first_seen_at"))
    # what travels to the join is one moment a row and how far the others are from it: small numbers are packed well
    # where moments are not
    made = (
        since_day(stg_predictions(t), start)
        .select(
            *EVENT,
            F.unix_micros("first_seen_at").alias("predicted_us"),
            ahead_us.alias("ahead_us"),
            micros_between(F.col("last_seen_at"), F.col("first_seen_at")).alias("stood_us"),
        )
        # both bounds are about the prediction alone, so they run before the join
        .filter((F.col("ahead_us") > -cfg.prediction_slack_s * second) & (F.col("ahead_us") < cfg.prediction_max_ahead_s * second))
    )
    came = (
        since_day(t["stop_events"], start)
        .filter(F.col("status").isNotNull())
        .select(
            *EVENT,
            "stop_id",
            "route_id",
            "direction_id",
            "is_timepoint",
            "scheduled_arrival",
            F.col("scored_time").alias("observed_arrival"),
        )
    )
    told = lambda us: F.timestamp_micros(F.col("predicted_us") + us)
    # an event is one row and its predictions are many: held by its key, it spares the sort of both sides
    return (
        came.hint("shuffle_hash")
        .join(made, KEY)
        .filter(F.timestamp_micros("predicted_us") < F.col("observed_arrival"))
        .select(
            *came.columns,
            told(F.col("ahead_us")).alias("predicted_arrival"),
            F.timestamp_micros("predicted_us").alias("predicted_at"),
            told(F.col("stood_us")).alias("predicted_until"),
            "ahead_us",
        )
        .select(
            *came.columns,
            "predicted_arrival",
            "predicted_at",
            "predicted_until",
            round_int(F.col("ahead_us") / second).alias("horizon_s"),
            floor_int(F.col("ahead_us") / (60 * second)).alias("horizon_min"),
            whole_seconds_between(F.col("observed_arrival"), F.col("predicted_arrival")).alias("error_s"),
            local_hour(F.col("predicted_at"), cfg.timezone).alias("hour_local"),
            weekday_type(F.col("service_date")).alias("weekday_type"),
        )
    )


def countdown_samples(t: Tables, cfg: Config = DEFAULT, start: date | None = None) -> DataFrame:
    """What the countdown showed at each whole minute from 1 to 15 before one bus at one stop: the
    prediction on display while it read that many minutes (the latest, if several did)."""
    e = since_day(t["prediction_errors"], start)
    shown_until = F.least(F.coalesce("predicted_until", "observed_arrival"), F.col("observed_arrival"))
    reads = lambda moment: floor_int(micros_between(F.col("predicted_arrival"), moment) / 60_000_000)
    lo = F.greatest(F.lit(1), reads(shown_until))
    hi = F.least(F.lit(cfg.countdown_max_min), reads(F.col("predicted_at")))
    kept = [
        "stop_id", "route_id", "is_timepoint", "weekday_type", "scheduled_arrival", "observed_arrival",
        "predicted_arrival", "error_s",
    ]
    # a prediction's minutes are bits: it keeps those that no later one showed, and only these become rows
    minutes = F.expr("shiftleft(1L, hi + 1) - shiftleft(1L, lo)")
    # the hash in front tells events apart by the first bytes compared, however long and alike their trips' names are
    event = Window.partitionBy("hashed", *KEY)
    newest = event.orderBy(F.desc("predicted_at"))
    later = F.bit_or("minutes").over(newest.rowsBetween(Window.unboundedPreceding, -1))
    shown = (
        e.withColumn("lo", lo)
        .withColumn("hi", hi)
        .filter(F.col("lo") <= F.col("hi"))
        .select(*EVENT, "predicted_at", *kept, minutes.alias("minutes"), F.xxhash64(*KEY).alias("hashed"))
        .withColumn("later", F.coalesce(later, F.lit(0)))
        .withColumn("ever", F.bit_or("minutes").over(newest.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    )
    whole = F.col("ever").bitwiseAND(1 << cfg.countdown_max_min) != 0
    latest = (
        shown.withColumn("own", F.col("minutes").bitwiseAND(F.bitwise_not("later")))
        .filter("own <> 0")
        .withColumn("in_comparison", whole)
        .withColumn("schedule_error_s", whole_seconds_between(F.col("observed_arrival"), F.col("scheduled_arrival")))
        .withColumn("ahead_min", F.explode(F.array(*[F.lit(m) for m in range(1, cfg.countdown_max_min + 1)])))
        .filter("(shiftright(own, ahead_min) & 1L) = 1L")
    )
    showing_at = F.timestamp_micros(
        F.unix_micros("predicted_arrival") - F.col("ahead_min").cast("long") * 60_000_000
    )
    return latest.select(
        *EVENT,
        "stop_id",
        "route_id",
        "is_timepoint",
        "weekday_type",
        "ahead_min",
        local_hour(showing_at, cfg.timezone).alias("hour_local"),
        "error_s",
        "schedule_error_s",
        "in_comparison",
    )
