"""Diagnostics: is collection healthy, can the numbers be trusted, where do they come from.

Shares and medians are rounded half away from zero, as printed. Functions that report on several
questions return one DataFrame per question.
"""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from punctual.config import DEFAULT, Config
from punctual.functions.bands import horizon_band
from punctual.functions.histograms import SIGNED_NAMES, signed_percentile, summed_counts
from punctual.functions.timeutil import (
    as_utc,
    lit_ts,
    local_date,
    local_day,
    seconds_between,
    service_date,
    to_local,
    utc_date,
)
from punctual.operators.arrivals import spikes
from punctual.operators.chunked import number_chunk, time_chunk, with_previous, with_running_sum
from punctual.operators.live import ago, ahead, told, version_in_force, with_next
from punctual.operators.marts import scored
from punctual.operators.profile import exact_percentiles, grouping_sets, histogram, pct, percentiles
from punctual.operators.schedule import newest_version

Tables = Mapping[str, DataFrame]
EVENT = ["service_date", "trip_id", "stop_sequence"]


def _n() -> Column:
    return F.count(F.lit(1))


def _med(value: Column, share: float = 0.5, n: Column | None = None) -> Column:
    """A rounded percentile of whole-second values."""
    return F.round(percentiles(value, [share], n)[0])


def _share(cond: Column, digits: int = 1) -> Column:
    """Per cent of the rows where the condition is known for which it holds."""
    return F.round(F.lit(100.0) * F.avg(cond.cast("int")), digits)


def _since(df: DataFrame, day, column: str = "service_date") -> DataFrame:
    return df.filter(F.col(column) >= F.lit(day))


def _days_back(as_of: datetime, n: int):
    return utc_date(as_of) - timedelta(days=n)


def _local_back(as_of: datetime, n: int, cfg: Config):
    return local_date(as_of, cfg.timezone) - timedelta(days=n)


def _between(column: str, as_of: datetime, **back) -> Column:
    return (F.col(column) > ago(as_of, **back)) & (F.col(column) <= lit_ts(as_of))


# --- D1, D2, D3: collection and freshness --------------------------------------------------


def schedule_versions(t: Tables) -> DataFrame:
    trips = t["trips"].groupBy("feed_version_id").agg(_n().alias("trips"))
    stop_times = t["stop_times"].groupBy("feed_version_id").agg(_n().alias("stop_times"))
    return (
        t["feed_version"]
        .select("feed_version_id", F.to_date("downloaded_at").alias("downloaded"), "feed_start_date", "feed_end_date")
        .join(trips, "feed_version_id", "left")
        .join(stop_times, "feed_version_id", "left")
        .na.fill(0, ["trips", "stop_times"])
    )


def fetches_per_feed(t: Tables) -> DataFrame:
    return t["fetch"].groupBy("feed").agg(
        _n().alias("fetches"),
        F.min("fetched_at").alias("first_at"),
        F.max("fetched_at").alias("last_at"),
        F.round(F.avg("byte_size")).alias("avg_bytes"),
    )


def cadence(t: Tables, as_of: datetime, hours: float = 2, cfg: Config = DEFAULT) -> DataFrame:
    """Seconds between a feed's consecutive messages."""
    recent = t["fetch"].filter(_between("fetched_at", as_of, hours=hours)).select("feed", "header_timestamp", "fetch_id")
    gaps = with_previous(
        recent, ["feed"], ["header_timestamp", "fetch_id"], time_chunk(F.col("header_timestamp"), cfg.chunk_s), ["header_timestamp"]
    ).withColumn("gap", seconds_between(F.col("header_timestamp"), F.col("prev.header_timestamp")))
    return gaps.filter("gap is not null").groupBy("feed").agg(
        F.percentile("gap", F.lit(0.5)).alias("median_s"), F.min("gap").alias("min_s"), F.max("gap").alias("max_s")
    )


def discarded_by_hour(t: Tables, k: int = 12) -> DataFrame:
    return t["fetch_unchanged"].orderBy(F.col("hour").desc(), "feed").limit(k)


def positions_lately(t: Tables, as_of: datetime, days: int = 7) -> DataFrame:
    return t["vehicle_position"].filter(_between("position_timestamp", as_of, days=days)).agg(
        _n().alias("rows"),
        F.count_distinct("vehicle_id").alias("vehicles"),
        F.count_distinct("trip_id").alias("trips"),
        F.min("position_timestamp").alias("first_at"),
        F.max("position_timestamp").alias("last_at"),
    )


def superseded(t: Tables, as_of: datetime, days: int = 7) -> DataFrame:
    old = t["prediction_history"].filter(_between("closed_at", as_of, days=days)).agg(_n()).scalar()
    return t["prediction_current"].agg(_n().alias("current_rows")).withColumn("superseded_rows", old)


def change_frequency(t: Tables, as_of: datetime, days: int = 7) -> DataFrame:
    """How often predictions change once made, per trip's stop."""
    key = ["trip_id", "start_date", "stop_sequence"]
    day = _days_back(as_of, days)
    both = _since(t["prediction_current"], day, "start_date").select(*key).unionByName(
        _since(t["prediction_history"], day, "start_date").select(*key)
    )
    return both.groupBy(*key).agg(_n().alias("n")).agg(
        F.count_if(F.col("n") == 1).alias("never_changed"),
        F.count_if(F.col("n").between(2, 5)).alias("changed_1_to_4_times"),
        F.count_if(F.col("n") > 5).alias("changed_5_plus"),
    )


def unmatched_trips(t: Tables) -> DataFrame:
    return (
        t["prediction_current"].select("trip_id").distinct()
        .join(t["trips"].select("trip_id"), "trip_id", "left_anti")
        .agg(_n().alias("unmatched_trip_ids"))
    )


def poller_health(t: Tables, as_of: datetime) -> DataFrame:
    at = F.col("fetched_at")
    return t["fetch"].filter(at <= lit_ts(as_of)).groupBy("feed").agg(
        F.count_if(at > ago(as_of, hours=1)).alias("last_hour"),
        F.count_if(at > ago(as_of, hours=24)).alias("last_24h"),
        _n().alias("total"),
        F.round(seconds_between(lit_ts(as_of), F.max(at)) / 60).alias("min_since_last"),
        F.min(F.to_date(at)).alias("first_day"),
    )


def feed_lags(t: Tables, as_of: datetime) -> DataFrame:
    """Seconds since each feed's last message and header, and the last three lags between them."""
    recent = t["fetch"].filter(_between("fetched_at", as_of, days=2))
    last = F.row_number().over(Window.partitionBy("feed").orderBy(F.col("fetched_at").desc(), F.col("fetch_id").desc()))
    # a rank limit, so each task keeps three rows per feed before anything is gathered
    three = recent.withColumn("rn", last).filter("rn <= 3").groupBy("feed").agg(
        F.array_sort(
            F.collect_list(
                F.struct("rn", F.round(seconds_between(F.col("fetched_at"), F.col("header_timestamp"))).alias("lag"), "entity_count")
            )
        ).alias("x")
    )
    text = lambda f: F.array_join(F.transform("x", lambda e: e[f].cast("int").cast("string")), ",")
    since = recent.groupBy("feed").agg(
        F.round(seconds_between(lit_ts(as_of), F.max("fetched_at"))).alias("s_since_fetch"),
        F.round(seconds_between(lit_ts(as_of), F.max("header_timestamp"))).alias("s_since_header"),
    )
    return since.join(three, "feed").select(
        "feed", "s_since_fetch", "s_since_header", text("lag").alias("lags_last3"), text("entity_count").alias("entities_last3")
    )


def prediction_freshness(t: Tables, as_of: datetime) -> DataFrame:
    now = lit_ts(as_of)
    fresh = t["prediction_current"].filter(F.col("last_seen_at") > ago(as_of, minutes=3)).withColumn("t", told())
    at = F.col("t")
    return fresh.agg(
        _n().alias("predictions_updated"),
        F.count_if(at.between(now, ahead(as_of, minutes=5))).alias("due_next_5min"),
        F.count_if(at.between(now, ahead(as_of, minutes=15))).alias("due_next_15min"),
        F.count_if(at.between(ago(as_of, minutes=5), now)).alias("passed_last_5min"),
        F.round(F.min(F.when(at > now, seconds_between(at, now))) / 60, 1).alias("nearest_future_min"),
    )


def schedule_match(t: Tables, as_of: datetime, cfg: Config = DEFAULT) -> DataFrame:
    """Trips predicted now, and how many of them are in the schedule version in force."""
    fv = version_in_force(t, as_of, cfg)
    now = t["prediction_current"].filter(F.col("last_seen_at") > ago(as_of, minutes=3)).select("trip_id").distinct()
    known = t["trips"].filter(F.col("feed_version_id") == fv).select("trip_id", F.lit(1).alias("known"))
    return now.join(known, "trip_id", "left").agg(
        _n().alias("trips_predicted_now"), F.count("known").alias("of_which_match_schedule")
    ).withColumn("schedule_version_in_force", fv)


# --- D4, D5: outages and collection --------------------------------------------------------


def empty_feed(t: Tables, cfg: Config = DEFAULT) -> DataFrame:
    """Empty messages during scheduled service, by service day.

    A message can fall inside the service hours of its own day and of the neighbouring ones, so it is
    matched by date (equality) to three candidate days and then to their hours."""
    span = t["scheduled_stop_events"].groupBy("service_date").agg(
        F.min("scheduled_arrival").alias("first_stop"), F.max("scheduled_arrival").alias("last_stop")
    )
    day = local_day(F.col("fetched_at"), cfg.timezone)
    msgs = (
        t["fetch"]
        .filter(F.col("feed") == "vehicle_positions")
        .select(
            "fetched_at",
            (F.col("entity_count") == 0).alias("empty"),
            F.explode(F.array(*[F.date_add(day, i) for i in (-2, -1, 0, 1)])).alias("service_date"),
        )
    )
    return (
        msgs.join(span, "service_date")
        .filter(F.col("fetched_at").between(F.col("first_stop"), F.col("last_stop")))
        .groupBy("service_date")
        .agg(
            _n().alias("vehicle_msgs_in_service_hours"),
            F.count_if("empty").alias("empty_msgs"),
            F.round(F.count_if("empty") * 0.5).alias("approx_empty_minutes"),
            F.date_format(to_local(F.min(F.when(F.col("empty"), F.col("fetched_at"))), cfg.timezone), "HH:mm").alias("first_empty"),
            F.date_format(to_local(F.max(F.when(F.col("empty"), F.col("fetched_at"))), cfg.timezone), "HH:mm").alias("last_empty"),
        )
    )


def collection_by_day(t: Tables) -> DataFrame:
    old = t["prediction_history"].groupBy("start_date").agg(_n().alias("superseded_predictions"))
    return (
        t["vehicle_position"]
        .filter(F.col("start_date").isNotNull())
        .groupBy("start_date")
        .agg(
            _n().alias("positions"),
            F.count_distinct("vehicle_id").alias("buses"),
            F.count_distinct("trip_id").alias("trips"),
        )
        .join(old, "start_date", "left")
        .na.fill(0, ["superseded_predictions"])
        .withColumnRenamed("start_date", "service_date")
    )


def feed_shape(t: Tables, as_of: datetime) -> DataFrame:
    rows = t["vehicle_position"].filter(_between("position_timestamp", as_of, hours=24))
    return rows.agg(
        _n().alias("positions"),
        *[pct(F.count(c), _n()).alias(f"pct_{name}") for c, name in (("bearing", "bearing"), ("speed_mps", "speed"), ("occupancy_status", "occupancy"))],
        F.count("current_stop_sequence").alias("with_stop_seq"),
        F.count("stop_id").alias("with_stop_id"),
    )


def trips_not_in_schedule(t: Tables, as_of: datetime) -> DataFrame:
    known = t["trips"].filter(F.col("feed_version_id") == newest_version(t)).select("trip_id")
    recent = t["fetch"].filter(_between("fetched_at", as_of, hours=24)).select("fetch_id")
    return (
        t["trip_update"]
        .join(recent, "fetch_id", "left_semi")
        .select("trip_id")
        .distinct()
        .join(known, "trip_id", "left_anti")
        .agg(_n().alias("realtime_trips_not_in_schedule"), F.count_if(~F.col("trip_id").rlike("^[0-9]+$")).alias("non_numeric_ids"))
    )


# --- D6: the run log -----------------------------------------------------------------------


def _took() -> Column:
    return seconds_between(F.col("finished_at"), F.col("started_at"))


def run_share(t: Tables, as_of: datetime) -> DataFrame:
    """Share of the last day spent on ordinary runs, and the typical one."""
    rows = t["build_log"].filter(
        _between("started_at", as_of, hours=24) & F.col("finished_at").isNotNull() & ~F.coalesce("full_refresh", F.lit(False))
    )
    return rows.agg(
        _n().alias("builds"),
        F.round(100 * F.sum(_took()) / 86400).alias("pct_of_day_building"),
        F.round(F.percentile(_took(), F.lit(0.5))).alias("median_s"),
        F.round(F.max(_took())).alias("max_s"),
    )


def slowest_steps(t: Tables, as_of: datetime, k: int = 12) -> DataFrame:
    runs = t["build_log"].filter(
        _between("started_at", as_of, hours=24) & ~F.coalesce("full_refresh", F.lit(False))
    ).select("invocation_id")
    steps = t["build_step_log"].join(runs, "invocation_id", "left_semi").groupBy("node", "kind").agg(
        F.round(F.percentile("seconds", F.lit(0.5)), 1).alias("median_s"),
        F.round(F.max("seconds"), 1).alias("max_s"),
        _n().alias("builds"),
    )
    return steps.orderBy(F.col("median_s").desc(), "node", "kind").limit(k)


def full_refresh_time(t: Tables) -> DataFrame:
    return t["build_log"].filter(F.col("full_refresh") & F.col("finished_at").isNotNull()).agg(
        F.percentile(_took(), F.lit(0.5)).alias("typical_full_refresh_s"), _n().alias("builds")
    )


def storage_growth(t: Tables, k: int = 14, cfg: Config = DEFAULT) -> DataFrame:
    """Size at the end of each day, and the growth since the day before."""
    per_day = (
        t["build_log"]
        .filter(F.col("db_bytes").isNotNull())
        .groupBy(local_day(F.col("finished_at"), cfg.timezone).alias("day"))
        .agg(F.max_by("db_bytes", F.struct("finished_at", "db_bytes")).alias("size"))
    )
    # one row per day of operation
    before = F.lag("size").over(Window.orderBy("day"))
    return per_day.withColumn("growth", F.col("size") - before).orderBy(F.col("day").desc()).limit(k)


# --- D7: why stops were not scored ---------------------------------------------------------


def _due(as_of: datetime, cfg: Config) -> Column:
    return F.col("scheduled_arrival") < lit_ts(as_utc(as_of) - timedelta(seconds=cfg.due_after_s))


REASONS = (
    "trip_not_in_feed", "skipped", "first_stop", "last_stop", "never_reached", "before_first_report",
    "implausible", "doubtful", "imprecise", "other",
)


def unscored_reasons(t: Tables, as_of: datetime, cfg: Config = DEFAULT) -> DataFrame:
    """One reason per unscored stop event, the first that applies."""
    reason = (
        F.when(F.col("status").isNotNull(), "scored")
        .when(~F.col("trip_had_realtime"), "trip_not_in_feed")
        .when(F.col("was_skipped"), "skipped")
        .when(F.col("is_first_stop"), "first_stop")
        .when(F.col("is_last_stop"), "last_stop")
        .when(F.col("observed_arrival").isNull(), "never_reached")
        .when(~F.col("is_bounded"), "before_first_report")
        .when(~F.col("is_plausible"), "implausible")
        .when(F.col("is_doubtful"), "doubtful")
        .when(~F.col("is_precise"), "imprecise")
        .otherwise("other")
    )
    rows = t["stop_events"].filter(_due(as_of, cfg)).select("service_date", reason.alias("r"))
    return rows.groupBy("service_date").agg(
        _n().alias("sched"),
        pct(F.count_if(F.col("r") == "scored"), _n(), 1).alias("pct_scored"),
        *[F.count_if(F.col("r") == r).alias(r) for r in REASONS],
    )


def missing_trips_by_hour(t: Tables, as_of: datetime, cfg: Config = DEFAULT) -> DataFrame:
    return (
        t["stop_events"]
        .filter(F.col("is_first_stop") & ~F.col("trip_had_realtime") & _due(as_of, cfg))
        .groupBy(F.col("hour_local").alias("trip_start_hour"))
        .agg(_n().alias("trips_not_in_feed"))
    )


def daily_scores(t: Tables) -> DataFrame:
    cells = histogram(
        scored(t), ["service_date", "uncertainty_s"], "delay_s",
        on_time=F.count_if(F.col("status") == "on_time"), early=F.count_if(F.col("status") == "early"),
    )
    n = F.col("n")
    return cells.groupBy("service_date").agg(
        F.sum(n).alias("scored"),
        pct(F.sum("on_time"), F.sum(n)).alias("pct_on_time"),
        pct(F.sum("early"), F.sum(n)).alias("pct_early"),
        _med(F.col("delay_s"), 0.5, n).alias("median_delay_s"),
        _med(F.col("uncertainty_s"), 0.5, n).alias("median_unc_s"),
        F.coalesce(F.sum(F.when(F.col("uncertainty_s") > 120, n)), F.lit(0)).alias("unc_over_2min"),
    )


# --- D8, D15: between timepoints -----------------------------------------------------------


def _between_timepoints(events: DataFrame) -> DataFrame:
    """Each event with the timepoints before and after it on its trip (strictly)."""
    trip = Window.partitionBy("service_date", "trip_id")
    strictly = (Window.unboundedPreceding, -1)
    tp = F.when(F.col("is_timepoint"), F.struct("delay_s", "time_source", "scheduled_arrival"))
    before = trip.orderBy("stop_sequence").rowsBetween(*strictly)
    after = trip.orderBy(F.col("stop_sequence").desc()).rowsBetween(*strictly)
    return events.withColumn("a", F.last(tp, True).over(before)).withColumn("b", F.last(tp, True).over(after))


def timepoint_bump(t: Tables, as_of: datetime, days: int = 3, by_source: bool = False) -> DataFrame:
    """Lateness at a minor stop against the mean of the timepoints either side on the same trip."""
    rows = _between_timepoints(_since(scored(t), _days_back(as_of, days))).filter(
        ~F.col("is_timepoint") & F.col("a").isNotNull() & F.col("b").isNotNull()
    )
    bump = F.col("delay_s") - (F.col("a.delay_s") + F.col("b.delay_s")) / 2.0
    keys = [F.col("a.time_source").alias("prev_src"), F.col("b.time_source").alias("next_src")] if by_source else []
    return rows.groupBy(*keys).agg(
        _n().alias("minor_stops"),
        _med(bump).alias("median_bump_s"),
        _med(bump, 0.25).alias("p25_s"),
        _med(bump, 0.75).alias("p75_s"),
    )


def early_between_timepoints(t: Tables, as_of: datetime, days: int = 7) -> DataFrame:
    """Minor stops by where they fall between the timepoints around them: early against a guessed
    time, or against a promised one?"""
    events = _since(scored(t), _days_back(as_of, days))
    placed = _between_timepoints(events)
    total = seconds_between(F.col("b.scheduled_arrival"), F.col("a.scheduled_arrival"))
    share = seconds_between(F.col("scheduled_arrival"), F.col("a.scheduled_arrival")) / total
    minor = ~F.col("is_timepoint") & ~F.col("is_first_stop") & (total > 0)
    place = (
        F.when(F.col("is_timepoint") & ~F.col("is_first_stop"), "0 timepoints")
        .when(minor & (share < 1.0 / 3), "1 first third")
        .when(minor & (share < 2.0 / 3), "2 middle third")
        .when(minor, "3 last third")
    )
    early = F.col("delay_s") < -120
    next_late = F.col("b.delay_s")
    is_minor = F.col("place") != "0 timepoints"
    return placed.withColumn("place", place).filter("place is not null").groupBy("place").agg(
        _n().alias("n"),
        _med(F.col("delay_s")).alias("median_s"),
        _share(early).alias("over_2min_early_pct"),
        _share(F.when(is_minor, early & (next_late >= -60))).alias("early_here_on_time_at_next_tp_pct"),
        _med(F.when(is_minor, next_late)).alias("next_tp_median_s"),
    )


def arrival_or_departure(t: Tables, as_of: datetime, days: int = 7) -> DataFrame:
    """At timepoints: does our time catch the bus arriving or leaving?"""
    rows = _since(t["stop_events"], _days_back(as_of, days)).filter(
        F.col("is_timepoint") & F.col("methods_diff_s").isNotNull() & F.col("is_bounded")
    )
    diff = F.col("methods_diff_s")
    gps_early = seconds_between(F.col("observed_arrival"), F.col("scheduled_arrival")) < -60
    return rows.agg(
        _n().alias("n"),
        _med(diff).alias("median_diff_s"),
        _share(diff > 60).alias("later_1min_pct"),
        _share(diff < -60).alias("earlier_1min_pct"),
        _share(F.when(gps_early, diff > 60)).alias("later_1min_pct_when_gps_early"),
    )


# --- D9, D10: how arrivals are timed -------------------------------------------------------


def _sample_events(t: Tables, ahead_min: int, start) -> DataFrame:
    """Countdown samples at one distance with their stop event."""
    c = _since(t["countdown_samples"], start).filter(F.col("in_comparison") & (F.col("ahead_min") == ahead_min))
    e = _since(t["stop_events"], start).select(
        *EVENT, "route_short_name", "time_source", "methods_diff_s", F.col("is_timepoint").alias("tp"), F.col("stop_id").alias("event_stop")
    )
    return c.join(e, EVENT)


def predictions_by_timing(t: Tables, as_of: datetime, cfg: Config = DEFAULT) -> DataFrame:
    rows = _sample_events(t, 5, _local_back(as_of, 29, cfg))
    err = F.col("error_s")
    return rows.groupBy(F.col("tp").alias("is_timepoint"), "time_source").agg(
        _n().alias("n"),
        _med(err).alias("signed_median_s"),
        _med(err, 0.1).alias("p10_s"),
        _med(err, 0.9).alias("p90_s"),
        _share(err > 0, 0).alias("pct_bus_later"),
    )


def first_stops_and_timepoints(t: Tables, as_of: datetime, cfg: Config = DEFAULT) -> DataFrame:
    """The agency's recorded departure against our time for the same bus."""
    rows = _since(scored(t), _local_back(as_of, 6, cfg)).filter(
        (F.col("is_timepoint") | F.col("is_first_stop"))
        & F.col("methods_diff_s").isNotNull()
        & F.col("feed_settled_time").isNotNull()
    )
    agency = seconds_between(F.col("feed_settled_time"), F.col("scheduled_arrival"))
    ours = seconds_between(F.col("observed_arrival"), F.col("scheduled_arrival"))
    diff = F.col("methods_diff_s")
    by_gps = exact_percentiles(rows.select("is_first_stop", ours.alias("ours")), ["is_first_stop"], "ours", {"lateness_by_gps_s": 0.5})
    by_gps = by_gps.select(F.col("is_first_stop").alias("__first"), F.round("lateness_by_gps_s").alias("lateness_by_gps_s"))
    counted = rows.groupBy("is_first_stop").agg(
        _n().alias("n"),
        _share(F.col("time_source") == cfg.source_agency).alias("pct_agency_scored"),
        _med(diff).alias("agency_minus_gps_s"),
        _med(diff, 0.25).alias("p25_s"),
        _med(diff, 0.75).alias("p75_s"),
        _share(agency == 0).alias("pct_exactly_scheduled"),
        _med(agency).alias("lateness_by_agency_s"),
        _med(F.col("delay_s")).alias("lateness_scored_s"),
    )
    return counted.join(by_gps, F.col("is_first_stop").eqNullSafe(F.col("__first")), "left").drop("__first")


def _compared(t: Tables) -> DataFrame:
    return t["stop_events"].filter(F.col("methods_diff_s").isNotNull() & F.col("is_bounded"))


def agreement_by_stop_type(t: Tables) -> DataFrame:
    diff, far = F.col("methods_diff_s"), F.abs("methods_diff_s")
    n = F.col("n")
    cells = histogram(_compared(t), ["is_timepoint"], "methods_diff_s")
    total = lambda cond: F.coalesce(F.sum(F.when(cond, n)), F.lit(0))
    return cells.groupBy("is_timepoint").agg(
        F.sum(n).alias("n"),
        _med(diff, 0.5, n).alias("median_diff_s"),
        _med(far, 0.5, n).alias("median_abs_s"),
        pct(total(far <= 60), F.sum(n)).alias("pct_within_1min"),
        total(far > 300).alias("over_5min"),
    )


def agreement_by_route(t: Tables, as_of: datetime, k: int = 8, min_n: int = 50) -> DataFrame:
    diff, far = F.col("methods_diff_s"), F.abs("methods_diff_s") > 300
    late = F.col("service_date") >= F.lit(_days_back(as_of, 1))
    out = _compared(t).groupBy(F.col("route_short_name").alias("route")).agg(
        _n().alias("n"),
        F.count_if(far).alias("over_5min"),
        pct(F.count_if(far), _n()).alias("pct"),
        pct(F.count_if(far & late), F.count_if(late)).alias("pct_last_2_days"),
        _med(diff).alias("median_diff_s"),
        _med(F.when(F.col("is_timepoint"), diff)).alias("median_diff_timepoints_s"),
    )
    return out.filter(F.col("n") >= min_n).orderBy(F.col("pct").desc(), "route").limit(k)


def unplaceable_stops(t: Tables, k: int = 10) -> DataFrame:
    """Stops the method cannot place on the route shape, by route, in the newest version."""
    fv = newest_version(t)
    trips = t["trips"].filter(F.col("feed_version_id") == fv).select("trip_id", "route_id")
    names = t["routes"].filter(F.col("feed_version_id") == fv).select("route_id", F.col("route_short_name").alias("route"))
    bad = ~F.col("is_usable")
    per_trip = t["stop_shape_fractions"].filter(F.col("feed_version_id") == fv).groupBy("trip_id").agg(
        _n().alias("stop_times"), F.count_if(bad).alias("unusable")
    )
    return (
        per_trip.join(trips, "trip_id")
        .join(names, "route_id")
        .groupBy("route")
        .agg(F.sum("stop_times").alias("stop_times"), F.sum("unusable").alias("unusable"))
        .filter("unusable > 0")
        .withColumn("pct_unusable", pct(F.col("unusable"), F.col("stop_times"), 1))
        .orderBy(F.col("pct_unusable").desc(), "route")
        .limit(k)
    )


def worst_stops(t: Tables, as_of: datetime, cfg: Config = DEFAULT, min_route: int = 200, routes: int = 3) -> DataFrame:
    """Stops on the routes where the two methods disagree most."""
    rows = _since(_compared(t), _days_back(as_of, 30))
    far = F.abs("methods_diff_s")
    worst = (
        rows.groupBy("route_short_name")
        .agg(_n().alias("n"), F.avg((far > 300).cast("int")).alias("bad"))
        .filter(F.col("n") >= min_route)
        .orderBy(F.col("bad").desc(), "route_short_name")
        .limit(routes)
    )
    return (
        rows.join(worst.select("route_short_name"), "route_short_name", "left_semi")
        .groupBy(F.col("route_short_name").alias("route"), F.col("stop_sequence").alias("seq"))
        .agg(
            F.bool_or("is_timepoint").alias("timepoint"),
            _n().alias("n"),
            _med(F.col("methods_diff_s")).alias("methods_median_s"),
            _share(far > 120, 0).alias("over_2min_pct"),
            _med(F.col("uncertainty_s")).alias("uncertainty_s"),
        )
        .filter("n >= 10")
    )


# --- D11: calibration and counting ---------------------------------------------------------


def calibration_sample(t: Tables) -> DataFrame:
    return (
        t["mart_calibration"]
        .filter(F.col("route_id").isNull() & F.col("horizon_min").isin(1, 3, 5, 10, 15, 20, 30, 45, 60))
        .select(
            "horizon_min",
            F.col("n_predictions").alias("n"),
            "n_days",
            pct(F.col("n_within_1min"), F.col("n_predictions")).alias("pct_within_1min"),
            pct(F.col("n_within_2min"), F.col("n_predictions")).alias("pct_within_2min"),
            F.round("median_error_s").alias("median_err_s"),
            pct(F.col("n_schedule_within_1min"), F.col("n_predictions")).alias("timetable_within_1min"),
        )
    )


def rows_vs_arrivals(t: Tables) -> DataFrame:
    """Counting every value sent against counting each bus once."""
    at = (1, 3, 5, 10, 15)
    tt = F.abs(seconds_between(F.col("observed_arrival"), F.col("scheduled_arrival")))
    e = t["prediction_errors"].filter(F.col("horizon_min").isin(*at))
    # per arrival first: distinct arrivals are then rows
    per = e.groupBy("horizon_min", *EVENT).agg(
        _n().alias("rows"), F.count_if(F.abs("error_s") <= 60).alias("near"), F.count_if(tt <= 60).alias("tt_near")
    )
    by_rows = per.groupBy(F.col("horizon_min").alias("minutes_ahead")).agg(
        F.sum("rows").alias("n_rows"),
        _n().alias("n_arrivals"),
        F.round(F.sum("rows") / _n(), 1).alias("rows_per_arrival"),
        pct(F.sum("near"), F.sum("rows")).alias("countdown_rows"),
        pct(F.sum("tt_near"), F.sum("rows")).alias("timetable_same_rows"),
    )
    samples = t["countdown_samples"].filter("in_comparison")
    # one pass over the samples: the timetable's share on the same arrivals is that of their 15-minute rows
    by_arrival = samples.filter(F.col("ahead_min").isin(*at)).groupBy(F.col("ahead_min").alias("minutes_ahead")).agg(
        _share(F.abs("error_s") <= 60, 0).alias("countdown_per_arrival"),
        _share(F.abs("schedule_error_s") <= 60, 0).alias("timetable_share"),
    )
    same = F.max(F.when(F.col("minutes_ahead") == 15, F.col("timetable_share"))).over(Window.partitionBy(F.lit(0)))
    everything = scored(t).agg(_share(F.abs("delay_s") <= 60, 0)).scalar()
    return (
        by_rows.join(by_arrival, "minutes_ahead", "full")  # five rows at most
        .withColumn("timetable_same_arrivals", same)
        .filter(F.col("n_rows").isNotNull())
        .drop("timetable_share")
        .withColumn("timetable_all", everything)
    )


def values_sent(t: Tables) -> DataFrame:
    err = F.abs(seconds_between(F.col("observed_arrival"), F.col("scheduled_arrival")))
    per = (
        t["prediction_errors"]
        .filter(F.col("horizon_min").between(1, 15))
        .groupBy(*EVENT)
        .agg(_n().alias("n_values"), F.max(err).alias("err"))
    )
    n = F.col("n_values")
    band = F.when(n <= 2, "1-2").when(n <= 5, "3-5").when(n <= 10, "6-10").otherwise("11+")
    return per.groupBy(band.alias("values_sent")).agg(
        _n().alias("arrivals"), _share(F.col("err") <= 60, 0).alias("timetable_within_1min_pct")
    )


# --- D12: the marts against their base tables ----------------------------------------------


def _verdict(same: Column) -> Column:
    return F.when(F.coalesce(same, F.lit(False)), "PASS").otherwise("DIFFERENT")


def lateness_check(t: Tables, as_of: datetime, cfg: Config = DEFAULT) -> DataFrame:
    """Overview numbers from the mart and straight from the events, on one row. Both sides are one
    row, tied by a constant key."""
    one = F.lit(1).alias("k")
    site = t["mart_lateness"].filter(
        (F.col("period") == "30d") & (F.col("days") == "all")
        & F.col("route_id").isNull() & F.col("stop_id").isNull() & F.col("hour_local").isNull()
    ).select(one, F.col("median_delay_s").alias("site_typical_s"), F.col("n").alias("site_n"))
    direct = _since(scored(t), _local_back(as_of, 29, cfg)).agg(
        percentiles(F.col("delay_s"), [0.5])[0].alias("direct_typical_s"), _n().alias("direct_n")
    ).select(one, "*")
    return site.join(direct, "k").drop("k").withColumn(
        "result",
        _verdict((F.abs(F.col("site_typical_s") - F.col("direct_typical_s")) <= 1) & (F.col("site_n") == F.col("direct_n"))),
    )


def prediction_check(t: Tables) -> DataFrame:
    """The daily prediction mart against the samples, per distance (null = the timetable)."""
    site = t["mart_prediction_daily"].groupBy("ahead_min").agg(
        F.sum("n").alias("site_n"),
        F.sum("n_within_1min").alias("site_near"),
        (F.sum("sum_abs_s") / F.sum("n")).alias("site_avg"),
    ).withColumnRenamed("ahead_min", "site_min")
    samples = t["countdown_samples"].filter("in_comparison")
    told_err = F.explode(
        F.array_compact(
            F.array(
                F.struct(F.col("ahead_min").alias("m"), F.col("error_s").alias("e")),
                F.when(F.col("ahead_min") == DEFAULT.countdown_max_min, F.struct(F.lit(None).cast("int").alias("m"), F.col("schedule_error_s").alias("e"))),
            )
        )
    )
    direct = samples.select(told_err.alias("x")).groupBy(F.col("x.m").alias("ahead_min")).agg(
        _n().alias("direct_n"),
        F.count_if(F.abs("x.e") <= 60).alias("direct_near"),
        F.avg(F.abs("x.e")).alias("direct_avg"),
    )
    both = direct.join(site, F.col("ahead_min").eqNullSafe(F.col("site_min")), "left")
    return both.filter(F.col("ahead_min").isNull() | F.col("ahead_min").isin(1, 2, 3, 5, 10, 15)).select(
        F.coalesce(F.col("ahead_min").cast("string"), F.lit("timetable")).alias("countdown_at"),
        F.round("site_avg").alias("site_avg_off_s"),
        F.round("direct_avg").alias("direct_avg_off_s"),
        pct(F.col("site_near"), F.col("site_n")).alias("site_within_1min_pct"),
        pct(F.col("direct_near"), F.col("direct_n")).alias("direct_within_1min_pct"),
        "site_n",
        "direct_n",
        _verdict(
            (F.col("site_n") == F.col("direct_n"))
            & (F.col("site_near") == F.col("direct_near"))
            & (F.abs(F.col("site_avg") - F.col("direct_avg")) < 0.5)
        ).alias("result"),
    )


def prediction_avg_by_route(t: Tables) -> DataFrame:
    fv = newest_version(t)
    names = t["routes"].filter(F.col("feed_version_id") == fv).select("route_id", F.col("route_short_name").alias("route"))
    at = lambda m, c: F.when(F.col("ahead_min") == m, F.abs(c))
    return (
        t["countdown_samples"]
        .filter("in_comparison")
        .join(names, "route_id")
        .groupBy("route")
        .agg(
            F.round(F.avg(at(DEFAULT.countdown_max_min, "schedule_error_s"))).alias("timetable_s"),
            *[F.round(F.avg(at(m, "error_s"))).alias(f"at_{m}_s") for m in (1, 5, 10, 15)],
            F.count_if(F.col("ahead_min") == DEFAULT.countdown_max_min).alias("arrivals"),
        )
    )


def report_card_check(t: Tables, as_of: datetime) -> DataFrame:
    """The per-stop prediction mart against the per-route one."""
    start = _days_back(as_of, 30)
    m = F.coalesce("ahead_min", F.lit(0)).alias("m")
    totals = lambda name, n, s: _since(t[name], start).groupBy("basis", m).agg(
        F.sum("n").alias(n), F.sum("sum_abs_s").alias(s)
    )
    a = totals("mart_prediction_daily", "page_n", "page_s")
    b = totals("mart_prediction_stop_daily", "card_n", "card_s")
    return (
        a.join(b, ["basis", "m"], "left")
        .filter(F.col("m").isin(0, 1, 5, 10, 15))
        .select(
            "basis",
            F.nullif("m", F.lit(0)).alias("ahead_min"),
            "page_n",
            "card_n",
            F.round(F.col("page_s") / F.col("page_n")).alias("page_avg_s"),
            F.round(F.col("card_s") / F.col("card_n")).alias("card_avg_s"),
            _verdict((F.col("page_n") == F.col("card_n")) & (F.col("page_s") == F.col("card_s"))).alias("result"),
        )
    )


# --- D13: outliers -------------------------------------------------------------------------


def outlier_stops(t: Tables, as_of: datetime, k: int = 25, cfg: Config = DEFAULT) -> DataFrame:
    """Stops typically over 5 minutes late, or where 8 in 10 start over 5 minutes early."""
    e = _since(scored(t), _days_back(as_of, 30))
    diff = F.col("methods_diff_s")
    out = e.groupBy("stop_id").agg(
        F.array_join(F.array_sort(F.collect_set("route_short_name")), ",").alias("routes"),
        _n().alias("n"),
        percentiles(F.col("delay_s"), [0.5, 0.1, 0.9]).alias("p"),
        _share(F.col("is_timepoint"), 0).alias("timepoint_pct"),
        _share(F.col("is_first_stop"), 0).alias("first_pct"),
        _share(F.col("is_last_stop"), 0).alias("last_pct"),
        _med(diff).alias("methods_median_s"),
        pct(F.count_if(F.abs(diff) > 120), F.count(diff)).alias("methods_over_2min_pct"),
    )
    return (
        out.filter((F.col("n") >= cfg.min_report) & ((F.col("p")[0] > 300) | (F.col("p")[1] < -300)))
        .orderBy(F.abs(F.col("p")[0]).desc(), "stop_id")
        .limit(k)
        .select(
            "stop_id", "routes", "n",
            F.round(F.col("p")[0]).alias("median_s"), F.round(F.col("p")[1]).alias("p10_s"), F.round(F.col("p")[2]).alias("p90_s"),
            "timepoint_pct", "first_pct", "last_pct", "methods_median_s", "methods_over_2min_pct",
        )
    )


def early_by_kind(t: Tables, as_of: datetime) -> DataFrame:
    kind = (
        F.when(F.col("is_first_stop"), "first stop").when(F.col("is_last_stop"), "last stop")
        .when(F.col("is_timepoint"), "timepoint").otherwise("other stop")
    )
    d = F.col("delay_s")
    return _since(scored(t), _days_back(as_of, 30)).groupBy(kind.alias("kind"), "time_source").agg(
        _n().alias("n"),
        pct(F.count_if(d == 0), _n(), 1).alias("pct_exactly_0s"),
        pct(F.count_if(d < -180), _n(), 1).alias("pct_over_3min_early"),
        pct(F.count_if(d < -300), _n(), 1).alias("pct_over_5min_early"),
        pct(F.count_if(d > 300), _n(), 1).alias("pct_over_5min_late"),
    )


def first_stop_departures(t: Tables, as_of: datetime, cfg: Config = DEFAULT) -> DataFrame:
    rows = _since(t["stop_events"], _days_back(as_of, 30)).filter("is_first_stop and trip_had_realtime")
    wait = seconds_between(F.col("feed_settled_time"), F.col("observed_arrival"))
    waits = exact_percentiles(rows.select(F.lit(0).alias("all"), wait.alias("wait")), ["all"], "wait", {"mid": 0.5, "high": 0.9})
    return rows.agg(
        _n().alias("n_first_stops_seen"),
        _share(F.col("time_source") == cfg.source_agency).alias("pct_agency_departure"),
        _share(F.col("status").isNotNull()).alias("pct_scored"),
    ).select(
        "*",
        waits.select(F.round("mid")).scalar().alias("arrived_before_departure_median_s"),
        waits.select(F.round("high")).scalar().alias("arrived_before_departure_p90_s"),
    )


def first_stop_conditions(t: Tables, as_of: datetime) -> DataFrame:
    """Which condition keeps a first stop off the agency's departure."""
    e = _since(t["stop_events"], _days_back(as_of, 7)).filter("is_first_stop and trip_had_realtime").select(
        *EVENT, "scheduled_arrival"
    )
    f = _since(t["feed_settled_times"], _days_back(as_of, 7)).select(*EVENT, "settled_time", "is_settled", "was_skipped")
    has, skipped = F.col("settled_time").isNotNull(), F.col("was_skipped")
    off = F.abs(seconds_between(F.col("settled_time"), F.col("scheduled_arrival")))
    return e.join(f, EVENT, "left").agg(
        _n().alias("n"),
        F.count_if(has).alias("has_agency_time"),
        F.count_if("is_settled").alias("settled"),
        F.count_if(skipped).alias("skipped_true"),
        F.count_if(~skipped).alias("skipped_false"),
        F.count_if(has & skipped.isNull()).alias("skipped_null"),
        F.count_if(off <= 1800).alias("within_30min_of_schedule"),
    )


# --- D14: what change-only storage saves ---------------------------------------------------


def storage_ratio(t: Tables, as_of: datetime) -> DataFrame:
    """Stored prediction rows against one row per message that repeated them.

    Messages inside [first, last] are counted without pairing rows with messages: messages and the
    ends of intervals form one ordered list, a running count of messages goes down it, and each
    interval is the count at its end less the count just before its start."""
    span = ["first_seen_at", "last_seen_at"]
    rows = (
        t["prediction_current"].filter(_between("last_seen_at", as_of, hours=24)).select(*span)
        .unionByName(t["prediction_history"].filter(_between("closed_at", as_of, hours=24)).select(*span))
    )
    us = lambda c: F.unix_micros(c).alias("us")
    messages = (
        t["fetch"].filter(F.col("feed") == "trip_updates")
        .groupBy(us("header_timestamp"))
        .agg(_n().alias("k"))
        .select("us", F.lit(1).alias("rank"), "k", F.lit(0).cast("long").alias("weight"))
    )
    # at one moment: starts come before the message, ends after it
    ends = (
        rows.filter(F.col("first_seen_at") <= F.col("last_seen_at"))
        .select(
            F.explode(
                F.array(
                    F.struct(us("first_seen_at"), F.lit(0).alias("rank"), F.lit(-1).alias("sign")),
                    F.struct(us("last_seen_at"), F.lit(2).alias("rank"), F.lit(1).alias("sign")),
                )
            ).alias("x")
        )
        .groupBy("x.us", "x.rank")
        .agg(F.sum("x.sign").alias("weight"))
        .select("us", "rank", F.lit(0).cast("long").alias("k"), "weight")
    )
    counted = with_running_sum(
        messages.unionByName(ends), [], ["us", "rank"], number_chunk(F.col("us"), 3_600_000_000), "k", "upto"
    )
    total = counted.agg(F.sum(F.col("weight") * F.col("upto"))).scalar()
    return rows.agg(_n().alias("stored_rows")).withColumn("rows_if_every_message", total).withColumn(
        "ratio", F.round(F.col("rows_if_every_message") / F.nullif("stored_rows", F.lit(0)), 1)
    )


# --- D16, D17, D18: where predictions lose -------------------------------------------------


def predictions_that_lose(t: Tables, as_of: datetime) -> DataFrame:
    """Routes where the prediction at 5 minutes is further off than the timetable, and the total."""
    rows = _sample_events(t, 5, _days_back(as_of, 30))
    pred, tt = F.abs("error_s"), F.abs("schedule_error_s")
    agree = F.abs("methods_diff_s") <= 60
    avg = lambda c, cond=None: F.round(F.avg(c if cond is None else F.when(cond, c)))
    out = rows.rollup("route_short_name").agg(
        F.grouping("route_short_name").alias("all_routes"),
        _n().alias("n"),
        avg(pred).alias("pred_s"),
        avg(tt).alias("timetable_s"),
        avg(pred, F.col("tp")).alias("pred_tp_s"),
        avg(tt, F.col("tp")).alias("timetable_tp_s"),
        avg(pred, agree).alias("pred_agree_s"),
        avg(tt, agree).alias("timetable_agree_s"),
    )
    return (
        out.withColumn("route", F.when(F.col("all_routes") == 1, "ALL").otherwise(F.col("route_short_name")))
        .filter((F.col("pred_s") > F.col("timetable_s")) | (F.col("route") == "ALL"))
        .drop("all_routes", "route_short_name")
    )


def stops_that_lose(t: Tables, as_of: datetime, k: int = 20, min_n: int = 30) -> DataFrame:
    rows = _sample_events(t, 5, _days_back(as_of, 30))
    pred, tt = F.avg(F.abs("error_s")), F.avg(F.abs("schedule_error_s"))
    return (
        rows.groupBy(F.col("route_short_name").alias("route"), F.col("event_stop").alias("stop_id"))
        .agg(
            F.bool_or("tp").alias("tp"),
            _n().alias("n"),
            F.round(pred).alias("pred_s"),
            F.round(tt).alias("timetable_s"),
            _med(F.col("methods_diff_s")).alias("methods_median_s"),
            F.round(pred - tt, 6).alias("loss"),
        )
        .filter(F.col("n") >= min_n)
        .orderBy(F.col("loss").desc(), "route", "stop_id")
        .limit(k)
        .drop("loss")
    )


def one_minute_error(t: Tables, k: int = 10, min_n: int = 100) -> DataFrame:
    c = t["countdown_samples"].filter("in_comparison and ahead_min = 1")
    e = t["stop_events"].select(*EVENT, "route_short_name", "methods_diff_s")
    off, diff = F.abs("error_s"), F.abs("methods_diff_s")
    return (
        c.join(e, EVENT, "left")
        .groupBy(F.coalesce("route_short_name", "route_id").alias("route"))
        .agg(
            _n().alias("n"),
            F.round(F.avg(off)).alias("avg_off_s"),
            _med(F.col("error_s")).alias("median_signed_s"),
            F.round(F.avg(F.when(F.col("is_timepoint"), off))).alias("avg_off_timepoints_s"),
            F.round(F.avg(F.when(diff <= 60, off))).alias("avg_off_methods_agree_s"),
            pct(F.count_if(diff > 120), F.count("methods_diff_s")).alias("pct_methods_differ_2min"),
        )
        .filter(F.col("n") >= min_n)
        .orderBy(F.col("avg_off_s").desc(), "route")
        .limit(k)
    )


def calibration_by_stop_type(t: Tables) -> DataFrame:
    err = F.col("error_s")
    cells = histogram(
        t["prediction_errors"].filter(F.col("horizon_min").isin(1, 3, 5, 10, 15, 30)), ["horizon_min", "is_timepoint"], "error_s"
    )
    n = F.col("n")
    total = lambda cond: F.coalesce(F.sum(F.when(cond, n)), F.lit(0))
    return cells.groupBy("horizon_min", "is_timepoint").agg(
        F.sum(n).alias("n"),
        _med(err, 0.5, n).alias("median_err_s"),
        pct(total(F.abs(err) <= 60), F.sum(n)).alias("pct_within_1min"),
        pct(total(err > 60), F.sum(n)).alias("pct_bus_later"),
    )


def cancelled_trips(t: Tables, as_of: datetime, days: int = 14) -> DataFrame:
    recent = t["fetch"].filter(_between("fetched_at", as_of, days=days)).select(
        "fetch_id", F.to_date("fetched_at").alias("fetch_day")
    )
    return (
        t["trip_update"].filter("schedule_relationship = 3").join(recent, "fetch_id")
        .groupBy("fetch_day").agg(F.count_distinct("trip_id").alias("trips_marked_cancelled"))
    )


def destination_names(t: Tables) -> DataFrame:
    fv = newest_version(t)
    names = t["routes"].filter(F.col("feed_version_id") == fv).select("route_id", F.col("route_short_name").alias("route"))
    return (
        t["trips"].filter(F.col("feed_version_id") == fv)
        .groupBy("route_id", F.col("direction_id").alias("dir"), F.col("trip_headsign").alias("raw_headsign"))
        .agg(_n().alias("trips"))
        .join(names, "route_id")
        .select("route", "dir", "raw_headsign", "trips")
    )


def honest_countdown_test(t: Tables, as_of: datetime, cfg: Config = DEFAULT) -> DataFrame:
    """The corrected countdown on the latest finished day, with corrections learned before it."""
    today = F.lit(service_date(as_of, cfg.timezone, cfg.rollover_hours))
    base = t["prediction_errors"]
    day = base.filter(F.col("service_date") < today).agg(F.max("service_date")).scalar()
    e = base.filter(F.col("horizon_min").between(0, cfg.honest_max_min)).select(
        "route_id", "is_timepoint", horizon_band(F.col("horizon_min")).alias("band"), "service_date", "error_s"
    )
    level = ["is_timepoint", "band"]
    cells = histogram(e.filter(F.col("service_date") < day), ["route_id", *level], "error_s")
    learned = grouping_sets(
        cells, [["route_id", *level], level], ["route_id", *level],
        F.sum("n").alias("k"), percentiles(F.col("error_s"), [0.5], F.col("n"))[0].alias("p50"), F.grouping("route_id").alias("g"),
    )
    by_route = learned.filter((F.col("g") == 0) & (F.col("k") >= cfg.honest_min_n)).select("route_id", *level, F.col("p50").alias("p_route"))
    by_all = learned.filter("g = 1").select(*level, F.col("p50").alias("p_all"))
    tested = (
        histogram(e.filter(F.col("service_date") == day), ["route_id", *level], "error_s")
        .join(by_route, ["route_id", *level], "left")
        .join(by_all, level, "left")
        .withColumn("adjusted", F.col("error_s") - F.coalesce("p_route", "p_all", F.lit(0.0)))
    )
    n, raw, adj = F.col("n"), F.abs("error_s"), F.abs("adjusted")
    total = lambda cond: F.coalesce(F.sum(F.when(cond, n)), F.lit(0))
    return tested.agg(
        F.coalesce(F.sum(n), F.lit(0)).alias("predictions"),
        pct(total(raw <= 60), F.sum(n)).alias("feed_within_1min_pct"),
        pct(total(adj <= 60), F.sum(n)).alias("adjusted_within_1min_pct"),
        _med(raw, 0.5, n).alias("feed_median_abs_err_s"),
        _med(adj, 0.5, n).alias("adjusted_median_abs_err_s"),
    ).withColumn("test_day", day)


def range_rows(t: Tables, cfg: Config = DEFAULT) -> DataFrame:
    return t["mart_prediction_error_ranges"].agg(
        _n().alias("rows"),
        F.count_if(F.col("route_id").isNotNull() & F.col("day_part").isNotNull()).alias("route_and_time_rows"),
        F.count_if(F.col("n_predictions") >= cfg.honest_min_n).alias("rows_with_50_plus"),
    )


# --- D19, D20, D21 -------------------------------------------------------------------------


def board_balance(t: Tables, as_of: datetime, cfg: Config = DEFAULT) -> DataFrame:
    """Stop events 5 to 35 minutes ago recognised as left, by the old rule and the new one."""
    rows = t["prediction_current"].withColumn("t", told()).filter(
        F.col("t").between(ago(as_of, minutes=35), ago(as_of, minutes=5))
    )
    ev = with_next(rows, t["prediction_current"], {"next_seen": F.col("last_seen_at")})
    held = seconds_between(F.col("last_seen_at"), F.col("t")) >= cfg.left_rule_s
    onward = F.coalesce(seconds_between(F.col("nx.next_seen"), F.col("t")) >= cfg.left_rule_s, F.lit(False))
    return ev.agg(
        _n().alias("stop_events"),
        F.count_if(held).alias("old_rule_left"),
        F.count_if(held | onward).alias("new_rule_left"),
        F.count_if(F.col("nx.next_seen").isNull()).alias("last_stop_of_trip"),
    )


def loads_during_runs(t: Tables, as_of: datetime, days: int = 7) -> DataFrame:
    """Page-load times by whether a run was in progress. Runs are marked on the minutes they touch, so
    a page view looks at one minute's runs, found by equality, not at all of them."""
    minute = lambda c: F.floor(F.unix_seconds(c) / 60)
    runs = (
        t["build_log"]
        .withColumn("ends", F.coalesce("finished_at", lit_ts(as_of)))
        .filter(F.col("ends") > ago(as_of, days=days))
        .filter(F.col("started_at") <= F.col("ends"))
        .select("started_at", "ends", F.explode(F.sequence(minute("started_at"), minute("ends"))).alias("minute"))
    )
    views = t["page_view"].filter(
        (F.col("device") != "bot") & F.col("load_ms").isNotNull() & _between("viewed_at", as_of, days=days)
    ).select("page", "load_ms", "viewed_at", minute("viewed_at").alias("minute"))
    on = (F.col("v.minute") == F.col("r.minute")) & F.col("v.viewed_at").between(F.col("r.started_at"), F.col("r.ends"))
    busy = views.alias("v").join(runs.alias("r"), on, "left_semi").withColumn("during_build", F.lit(True))
    idle = views.alias("v").join(runs.alias("r"), on, "left_anti").withColumn("during_build", F.lit(False))
    ms = F.col("load_ms")
    return busy.unionByName(idle).groupBy("page", "during_build").agg(
        _n().alias("n"),
        F.round(percentiles(ms, [0.5])[0] / 1000, 1).alias("median_s"),
        F.round(percentiles(ms, [0.9])[0] / 1000, 1).alias("p90_s"),
        F.round(F.max(ms) / 1000, 1).alias("slowest_s"),
    )


def coverage_by_hour(t: Tables, as_of: datetime, days: int = 4, cfg: Config = DEFAULT) -> DataFrame:
    """Hour by hour: messages stored, buses, gaps over 4 minutes, unscored mid-trip stops, and whether
    a full run was on. Hours are local, 5 to 23."""
    hour = lambda c: F.date_trunc("hour", to_local(F.col(c), cfg.timezone)).alias("hr")
    fetches = (
        t["fetch"].filter((F.col("feed") == "vehicle_positions") & _between("fetched_at", as_of, days=days))
        .groupBy(hour("fetched_at")).agg(_n().alias("fetches"))
    )
    reports = t["vehicle_position"].filter(_between("position_timestamp", as_of, days=days)).select(
        "vehicle_id", "position_timestamp", "fetch_id"
    )
    gapped = with_previous(
        reports, ["vehicle_id"], ["position_timestamp", "fetch_id"],
        time_chunk(F.col("position_timestamp"), cfg.feed_chunk_s), ["position_timestamp"],
    ).withColumn("gap", seconds_between(F.col("position_timestamp"), F.col("prev.position_timestamp")))
    positions = (
        gapped.filter(F.col("gap").isNull() | (F.col("gap") < 3600))
        .groupBy(hour("position_timestamp"))
        .agg(_n().alias("positions"), F.count_distinct("vehicle_id").alias("buses"), _share(F.col("gap") > 240).alias("gaps_4min_pct"))
    )
    events = (
        _since(t["stop_events"], _days_back(as_of, days))
        .filter("trip_had_realtime and not is_first_stop and not is_last_stop")
        .filter(_due(as_of, cfg))
        .groupBy(hour("scheduled_arrival"))
        .agg(_share(F.col("status").isNull()).alias("unscored_mid_pct"))
    )
    s = to_local(F.col("started_at"), cfg.timezone)
    e = to_local(F.coalesce("finished_at", lit_ts(as_of)), cfg.timezone)
    first, last = F.date_trunc("hour", s), F.date_trunc("hour", e - F.expr("interval 1 microsecond"))
    full = (
        t["build_log"]
        .filter(F.col("full_refresh") & _between("started_at", as_of, days=days + 1))
        .filter(first <= last)
        .select(F.explode(F.sequence(first, last, F.expr("interval 1 hour"))).alias("hr"))
        .distinct()
        .withColumn("full_rebuild", F.lit(True))
    )
    return (
        positions.join(fetches, "hr", "left")
        .join(events, "hr", "left")
        .join(full, "hr", "left")
        .filter(F.hour("hr").between(5, 23))
        .select(
            "hr", F.coalesce("fetches", F.lit(0)).alias("fetches"), "positions", "buses", "gaps_4min_pct",
            "unscored_mid_pct", F.coalesce("full_rebuild", F.lit(False)).alias("full_rebuild"),
        )
    )


# --- D22, D24, D25, D26 --------------------------------------------------------------------


def doubtful_counts(t: Tables, as_of: datetime) -> DataFrame:
    recent = _since(t["stop_events"], _days_back(as_of, 30)).agg(
        F.count_if(F.col("is_doubtful") & F.col("status").isNull()).alias("arrivals_left_out_30d"),
        F.count_if(F.col("status").isNotNull()).alias("arrivals_scored_30d"),
    )
    stops = t["doubtful_stops"].agg(_n()).scalar()
    return recent.withColumn("stops_left_out", stops)


def doubtful_list(t: Tables) -> DataFrame:
    fv = newest_version(t)
    stops = t["stops"].filter(F.col("feed_version_id") == fv).select("stop_id", "stop_name", "stop_code")
    routes = t["routes"].filter(F.col("feed_version_id") == fv).select("route_id", F.col("route_short_name").alias("route"))
    return (
        t["doubtful_stops"].join(stops, "stop_id", "left").join(routes, "route_id", "left")
        .select("route", F.col("direction_id").alias("dir"), "stop_name", "stop_code", F.col("n").alias("trips"), F.round("median_spike_s").alias("median_spike_s"))
    )


def doubtful_rule_comparison(t: Tables, as_of: datetime, cfg: Config = DEFAULT) -> DataFrame:
    """Stops the previous rule (two methods minutes apart) flagged, how many the present one flags
    too, and how far out of line our time was there."""
    stop = ["route_id", "direction_id", "stop_id"]
    start = _days_back(as_of, cfg.doubtful_days)
    o = _since(t["observed_arrivals"], start)
    f = _since(t["feed_settled_times"], start).filter("is_settled").select(*EVENT, "settled_time")
    apart = o.filter("is_bounded").join(f, EVENT).withColumn(
        "apart", seconds_between(F.col("settled_time"), F.col("observed_arrival"))
    )
    old = exact_percentiles(apart, stop, "apart", {"p50": 0.5}).filter(
        (F.col("n") >= cfg.doubtful_min_trips) & (F.abs("p50") > cfg.doubtful_spike_s)
    ).select(*[F.col(c).alias(f"o_{c}") for c in stop])
    inner = o.filter("is_bounded and is_plausible and not is_first_stop and not is_last_stop")
    per_stop = exact_percentiles(spikes(inner), stop, "spike_s", {"median_spike_s": 0.5}).drop("n")
    now = t["doubtful_stops"].select(*[F.col(c).alias(f"n_{c}") for c in stop])
    same = lambda a, b: [
        (F.col(f"{a}route_id") == F.col(f"{b}route_id")), (F.col(f"{a}stop_id") == F.col(f"{b}stop_id")),
        F.col(f"{a}direction_id").eqNullSafe(F.col(f"{b}direction_id")),
    ]
    return (
        old.join(per_stop, same("o_", ""), "left")
        .join(now, same("o_", "n_"), "left")
        .agg(
            _n().alias("old_rule_stops"),
            F.count("n_stop_id").alias("also_new_rule"),
            F.round(F.percentile("median_spike_s", F.lit(0.5))).alias("median_spike_s"),
            F.round(F.percentile(F.abs("median_spike_s"), F.lit(0.9))).alias("p90_abs_spike_s"),
        )
    )


def strips_check(t: Tables, as_of: datetime, cfg: Config = DEFAULT) -> DataFrame:
    """Percentiles read off the summed counts beside the exact ones, per route, over 30 days."""
    start = _local_back(as_of, 29, cfg)
    what = lambda sign: F.when(sign, "sign 5 min").otherwise("timetable")
    marts = _since(t["mart_prediction_daily"], start).filter((F.col("basis") == "timetable") | (F.col("ahead_min") == 5))
    read = marts.groupBy("route_id", what(F.col("basis") == "sign").alias("what")).agg(
        F.sum("n").alias("n"), *summed_counts(names=SIGNED_NAMES)
    ).select(
        "route_id", "what", "n", *[signed_percentile(q).alias(f"read_p{int(q * 100)}") for q in (0.1, 0.5, 0.9)]
    )
    s = _since(t["countdown_samples"], start).filter(F.col("in_comparison") & F.col("ahead_min").isin(5, 15))
    exact_rows = s.select(
        "route_id", what(F.col("ahead_min") == 5).alias("what"),
        F.when(F.col("ahead_min") == 5, F.col("error_s")).otherwise(F.col("schedule_error_s")).alias("e"),
    )
    cells = histogram(exact_rows, ["route_id", "what"], "e")
    exact = cells.groupBy("route_id", "what").agg(
        percentiles(F.col("e"), [0.1, 0.5, 0.9], F.col("n")).alias("p"), (F.sum(F.abs("e") * F.col("n")) / F.sum("n")).alias("mean_abs_s")
    )
    return read.join(exact, ["route_id", "what"]).select(
        "route_id", "what", "n", "read_p10", "read_p50", "read_p90",
        F.col("p")[0].alias("exact_p10"), F.col("p")[1].alias("exact_p50"), F.col("p")[2].alias("exact_p90"), "mean_abs_s",
    )


def off_shape(t: Tables, cfg: Config = DEFAULT) -> DataFrame:
    return t["positions_along_shape"].groupBy("service_date").agg(
        _n().alias("positions"), pct(F.count_if(F.col("off_route_m") > cfg.off_route_m), _n(), 1).alias("pct_over_100m")
    )


def next_stop_check(buses: DataFrame, placed: DataFrame, trips: DataFrame) -> DataFrame:
    """The feed's next stop against the one worked out from where each bus is: placed or not and why;
    same, behind or ahead. ``buses``: vehicle_id, trip_id, hint_seq; ``placed``: vehicle_id, seq1."""
    known = trips.select("trip_id").distinct().withColumn("in_schedule", F.lit(True))
    rows = buses.join(known, "trip_id", "left").join(placed.select("vehicle_id", "seq1"), "vehicle_id", "left")
    ok = F.col("seq1").isNotNull()
    trip = F.col("trip_id").isNotNull()
    unknown = trip & ~F.coalesce("in_schedule", F.lit(False))
    both = ok & F.col("hint_seq").isNotNull()
    return rows.agg(
        _n().alias("buses"),
        F.count_if(ok).alias("placed"),
        F.count_if(~ok & ~trip).alias("no_trip_id"),
        F.count_if(~ok & unknown).alias("not_in_schedule"),
        F.count_if(~ok & trip & ~unknown).alias("other"),
        F.count_if(both & (F.col("hint_seq") == F.col("seq1"))).alias("same"),
        F.count_if(both & (F.col("hint_seq") < F.col("seq1"))).alias("behind"),
        F.count_if(both & (F.col("hint_seq") > F.col("seq1"))).alias("ahead"),
        F.count_if(F.col("hint_seq").isNull()).alias("no_upcoming_stop"),
    )
