"""Observed arrivals, settled times, headways and doubtful stops."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from punctual.config import DEFAULT, Config
from punctual.functions.timeutil import plus_seconds, seconds_between, utc_date
from punctual.operators.chunked import time_chunk, with_previous, with_running_max
from punctual.operators.profile import exact_percentiles
from punctual.operators.schedule import stg_predictions

Tables = Mapping[str, DataFrame]


def since_day(df: DataFrame, start: date | None, column: str = "service_date") -> DataFrame:
    """Restrict to the days a build recomputes; a literal, so partitions are pruned at the scan."""
    return df if start is None else df.filter(F.col(column) >= F.lit(start))


def observed_arrivals(
    t: Tables, as_of: datetime, cfg: Config = DEFAULT, start: date | None = None
) -> DataFrame:
    """When each bus reached each stop: the moment its furthest place along the shape stepped past
    the stop, on a straight line between the two reports.

    The running maximum and the previous report are chunked by time inside (trip, day). Steps and
    stops then form one list per trip and day, from the far end of the line back: the step that passes
    a stop is the last one met before it, so each row is looked at once and no pairs are formed."""
    key = ["trip_id", "service_date"]
    today = F.lit(utc_date(as_of))
    chunk = time_chunk(F.col("ts"), cfg.chunk_s)
    order = ["ts", "vehicle_id"]
    on_route = since_day(t["positions_along_shape"], start).filter(
        (F.col("service_date") <= today) & (F.col("off_route_m") <= cfg.off_route_m)
    )
    reached = with_running_max(on_route, key, order, chunk, "frac", "frac_hi")
    steps = with_previous(reached, key, order, chunk, ["ts", "frac_hi"])
    step = F.struct(
        "vehicle_id",
        F.col("ts").alias("ts_hi"),
        "frac_hi",
        F.col("prev.ts").alias("ts_lo"),
        F.col("prev.frac_hi").alias("frac_lo"),
    )
    crossings = steps.filter(
        F.col("frac_hi") > F.coalesce(F.col("prev.frac_hi"), F.lit(-1.0))
    ).select(*key, F.col("frac_hi").alias("at"), F.lit(0).alias("rank"), step.alias("step"))
    usable = t["stop_shape_fractions"].filter("is_usable").select(
        "feed_version_id", "trip_id", "stop_sequence", "frac"
    )
    fields = [
        "stop_sequence", "stop_id", "route_id", "direction_id", "scheduled_arrival", "is_timepoint",
        "is_first_stop", "is_last_stop",
    ]
    due = (
        since_day(t["scheduled_stop_events"], start)
        .filter(F.col("service_date") <= today)
        .join(usable, ["feed_version_id", "trip_id", "stop_sequence"])
        .select(*key, F.col("frac").alias("at"), F.lit(1).alias("rank"), F.struct(*fields).alias("stop"))
    )
    # a step that ends exactly at a stop passes it, so at one place steps come first
    backwards = Window.partitionBy(*key).orderBy(F.col("at").desc(), "rank")
    passed = F.last("step", True).over(backwards.rowsBetween(Window.unboundedPreceding, 0))
    listed = due.unionByName(crossings, allowMissingColumns=True).withColumn("c", passed)
    share = (F.col("at") - F.col("c.frac_lo")) / (F.col("c.frac_hi") - F.col("c.frac_lo"))
    gap = seconds_between(F.col("c.ts_hi"), F.col("c.ts_lo"))
    bounded = F.col("c.ts_lo").isNotNull()
    matched = listed.filter(
        F.col("stop").isNotNull()
        & F.col("c").isNotNull()
        & (F.col("at") > F.coalesce(F.col("c.frac_lo"), F.lit(-1.0)))
    ).select(
        *key,
        "stop.*",
        "c.vehicle_id",
        F.when(bounded, plus_seconds(F.col("c.ts_lo"), gap * share))
        .otherwise(F.col("c.ts_hi"))
        .alias("observed_arrival"),
        F.when(bounded, gap / 2).alias("uncertainty_s"),
        bounded.alias("is_bounded"),
    )
    late = seconds_between(F.col("observed_arrival"), F.col("scheduled_arrival"))
    return matched.withColumn(
        "is_plausible", late.between(-cfg.plausible_early_s, cfg.plausible_late_s)
    )


def feed_settled_times(t: Tables, start: date | None = None) -> DataFrame:
    """The last value the feed asserted for each trip's stop, and whether it was still asserting it
    once that moment had passed. ``max`` combines map-side: one row per key leaves each task, with one moment and how
    far the others are from it, which packs better than four. Of values first and last seen at the same moments the
    latest counts."""
    p = since_day(stg_predictions(t), start).filter(F.col("predicted_time").isNotNull())
    key = ["trip_id", "service_date", "stop_sequence"]
    origin = F.coalesce(F.unix_micros("first_seen_at"), F.lit(0))
    since = lambda c: (F.unix_micros(c) - origin).alias(c)
    final = p.groupBy(*key).agg(
        F.max(
            F.struct(
                F.unix_micros("first_seen_at").alias("first_us"), since("last_seen_at"), since("predicted_time"),
                since("feed_scheduled_time"), "schedule_relationship", "stop_id",
            )
        ).alias("f")
    )
    moment = lambda c: F.timestamp_micros(F.coalesce("f.first_us", F.lit(0)) + F.col(f"f.{c}"))
    return final.select(
        *key,
        "f.stop_id",
        moment("predicted_time").alias("settled_time"),
        moment("feed_scheduled_time").alias("feed_scheduled_time"),
        (F.col("f.schedule_relationship") == 1).alias("was_skipped"),
        (F.col("f.last_seen_at") >= F.col("f.predicted_time")).alias("is_settled"),
        ((F.col("f.last_seen_at") - F.col("f.predicted_time")) / 1e6).alias("held_after_s"),
    )


def headways(t: Tables, cfg: Config = DEFAULT, start: date | None = None) -> DataFrame:
    """Time since the previous bus of the same route and direction at the same stop, as it ran and
    as it was scheduled. Ties are broken by trip and stop number."""
    key = ["service_date", "route_id", "direction_id", "stop_id"]
    # a null direction is a group of its own, so it must survive the carry across chunks
    safe = [*key[:2], "__dir", key[3]]
    ties = ["trip_id", "stop_sequence"]
    obs = (
        since_day(t["observed_arrivals"], start)
        .filter("is_bounded and is_plausible")
        .filter(F.col("uncertainty_s") <= cfg.max_uncertainty_s)
        .select(*key, *ties, "scheduled_arrival", "observed_arrival")
        .withColumn("__dir", F.coalesce(F.col("direction_id"), F.lit(-1)))
    )
    ran = with_previous(
        obs, safe, ["observed_arrival", *ties], time_chunk(F.col("observed_arrival"), cfg.feed_chunk_s),
        ["observed_arrival"], out="ran",
    )
    due = with_previous(
        ran, safe, ["scheduled_arrival", *ties], time_chunk(F.col("scheduled_arrival"), cfg.feed_chunk_s),
        ["scheduled_arrival"], out="due",
    )
    return due.filter(
        F.col("ran").isNotNull()
        & F.col("due").isNotNull()
        & (F.col("scheduled_arrival") > F.col("due.scheduled_arrival"))
    ).select(
        *key,
        *ties,
        "scheduled_arrival",
        "observed_arrival",
        seconds_between(F.col("observed_arrival"), F.col("ran.observed_arrival")).alias("observed_headway_s"),
        seconds_between(F.col("scheduled_arrival"), F.col("due.scheduled_arrival")).alias("scheduled_headway_s"),
    )


def spikes(observed: DataFrame) -> DataFrame:
    """Lateness at a stop against the mean of the stops either side of it on the trip."""
    trip = Window.partitionBy("service_date", "trip_id").orderBy("stop_sequence")
    late = seconds_between(F.col("observed_arrival"), F.col("scheduled_arrival"))
    return (
        observed.withColumn("late_s", late)
        .withColumn("before_s", F.lag("late_s").over(trip))
        .withColumn("after_s", F.lead("late_s").over(trip))
        .withColumn("spike_s", F.col("late_s") - (F.col("before_s") + F.col("after_s")) / 2.0)
        .filter(F.col("spike_s").isNotNull())
    )


def doubtful_stops(t: Tables, as_of: datetime, cfg: Config = DEFAULT) -> DataFrame:
    """Stops of a route and direction where our time is, as a rule, minutes out of line with our own
    times just before and after."""
    recent = t["observed_arrivals"].filter("is_bounded and is_plausible").filter(
        F.col("service_date") >= F.lit(utc_date(as_of) - timedelta(days=cfg.doubtful_days))
    )
    inner = spikes(recent).filter("not is_first_stop and not is_last_stop")
    return exact_percentiles(
        inner, ["route_id", "direction_id", "stop_id"], "spike_s", {"median_spike_s": 0.5}
    ).filter((F.col("n") >= cfg.doubtful_min_trips) & (F.abs("median_spike_s") > cfg.doubtful_spike_s))
