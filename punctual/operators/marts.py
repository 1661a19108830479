"""The marts: reliability, coverage, headways and prediction accuracy, ready to serve."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from punctual.config import DEFAULT, Config
from punctual.functions.bands import day_part, horizon_band
from punctual.functions.histograms import threshold_counts
from punctual.functions.timeutil import (
    isodow,
    lit_ts,
    local_date,
    local_day,
    local_hour,
    round_int,
    seconds_between,
    weekday_type,
)
from punctual.operators.arrivals import since_day
from punctual.operators.chunked import time_chunk, with_previous
from punctual.operators.profile import (
    exact_percentiles,
    grouping_sets,
    histogram,
    percentiles,
    unpacked,
    weighted_mean,
)

Tables = Mapping[str, DataFrame]


def scored(t: Tables, start: date | None = None) -> DataFrame:
    return since_day(t["stop_events"], start).filter(F.col("status").isNotNull())


def _status_counts() -> dict[str, Column]:
    return {f"n_{s}": F.count_if(F.col("status") == s) for s in ("on_time", "early", "late")}


def _status_sums() -> list[Column]:
    return [F.sum(f"n_{s}").alias(f"n_{s}") for s in ("on_time", "early", "late")]


def _delay_mart(
    events: DataFrame, keys: Sequence[str], names: dict[str, float], day_span: bool = False
) -> DataFrame:
    """Counts by status and exact percentiles of lateness per group, by way of a histogram."""
    by = [*keys, "service_date"] if day_span and "service_date" not in keys else list(keys)
    cells = histogram(events, by, "delay_s", **_status_counts())
    aggs = [F.sum("n").alias("n_events"), *_status_sums()]
    aggs.append(percentiles(F.col("delay_s"), list(names.values()), F.col("n")).alias("p"))
    if day_span:
        aggs += [
            F.min("service_date").alias("first_day"),
            F.max("service_date").alias("last_day"),
            F.size(F.collect_set("service_date")).alias("n_days"),
        ]
    return unpacked(cells.groupBy(*keys).agg(*aggs), "p", list(names))


def route_daily(t: Tables, start: date | None = None) -> DataFrame:
    keys = ["route_id", "route_short_name", "direction_id", "service_date", "weekday_type", "hour_local"]
    return _delay_mart(
        scored(t, start).filter("is_timepoint"),
        keys,
        {"median_delay_s": 0.5, "p90_delay_s": 0.9, "p10_delay_s": 0.1},
    )


def stop_route_daily(t: Tables, start: date | None = None) -> DataFrame:
    keys = ["stop_id", "route_id", "route_short_name", "direction_id", "service_date", "weekday_type"]
    return _delay_mart(
        scored(t, start), keys, {"median_delay_s": 0.5, "p05_delay_s": 0.05, "p95_delay_s": 0.95}
    )


def stop_route_hourly(t: Tables) -> DataFrame:
    keys = ["stop_id", "route_id", "route_short_name", "direction_id", "weekday_type", "hour_local"]
    return _delay_mart(
        scored(t),
        keys,
        {"median_delay_s": 0.5, "p05_delay_s": 0.05, "p95_delay_s": 0.95},
        day_span=True,
    )


def trend_daily(t: Tables, start: date | None = None) -> DataFrame:
    """Typical lateness per day for everything, each route, direction and stop and their pairs. The
    by_* flags tell "all" from a value that happens to be null."""
    choice = ["route_id", "direction_id", "stop_id"]
    cells = histogram(scored(t, start), ["service_date", *choice], "delay_s")
    sets = [
        [],
        ["route_id"],
        ["route_id", "direction_id"],
        ["stop_id"],
        ["route_id", "stop_id"],
        ["route_id", "direction_id", "stop_id"],
    ]
    out = grouping_sets(
        cells,
        [["service_date", *s] for s in sets],
        ["service_date", *choice],
        (F.grouping("route_id") == 0).alias("by_route"),
        (F.grouping("direction_id") == 0).alias("by_direction"),
        (F.grouping("stop_id") == 0).alias("by_stop"),
        F.sum("n").alias("n"),
        percentiles(F.col("delay_s"), [0.5, 0.1, 0.9], F.col("n")).alias("p"),
    )
    return unpacked(out, "p", ["median_delay_s", "p10_delay_s", "p90_delay_s"])


def lateness(t: Tables, as_of: datetime, cfg: Config = DEFAULT) -> DataFrame:
    """Lateness for every combination of period, kind of day and level the pages ask for.

    Events are first reduced per level to day, second of delay and count, one plain hash aggregation
    with a map-side combine. Only those rows are repeated for the 3 periods and up to 3 kinds of day
    they belong to, so coarse levels repeat a few thousand rows per day whatever the traffic."""
    today = local_date(as_of, cfg.timezone)
    base = scored(t)
    by = ["route_id", "hour_local", "stop_id", "route_short_name"]
    levels = [[], ["hour_local"], ["route_id", by[3]], ["route_id", by[3], "hour_local"], ["stop_id", by[3]]]
    fixed = ["service_date", "weekday_type", "delay_s"]
    cells = grouping_sets(
        base,
        [[*fixed, *level] for level in levels],
        [*fixed, *by],
        F.grouping_id().alias("level"),
        (F.grouping("route_id") == 0).alias("is_route"),
        (F.grouping("stop_id") == 0).alias("is_stop"),
        F.count(F.lit(1)).alias("n"),
        *[c.alias(k) for k, c in _status_counts().items()],
    )
    first = base.agg(F.min("service_date")).scalar()
    dow = F.concat(F.lit("dow"), isodow(F.col("service_date")).cast("string"))
    kinds = F.array_compact(
        F.array(F.lit("all"), F.col("weekday_type"), F.when(F.col("weekday_type") == "weekday", dow))
    )

    def span(name: str, since: Column) -> Column:
        covered = F.col("service_date") >= since
        return F.when(covered, F.struct(F.lit(name).alias("period"), since.alias("since")))

    spans = F.array_compact(
        F.array(
            span("7d", F.lit(today - timedelta(days=6))),
            span("30d", F.lit(today - timedelta(days=29))),
            span("all", first),
        )
    )
    fanned = (
        cells.withColumn("s", F.explode(spans))
        .withColumn("days", F.explode(kinds))
        .select("*", "s.period", "s.since")
    )
    names = F.col("route_short_name")
    out = fanned.groupBy("period", "since", "days", "level", *by[:3]).agg(
        F.max(F.when(F.col("is_route"), names)).alias("route_short_name"),
        F.collect_set(F.when(F.col("is_stop"), names)).alias("here"),
        F.bool_or("is_stop").alias("is_stop"),
        F.sum("n").alias("n"),
        *_status_sums(),
        percentiles(F.col("delay_s"), [0.5, 0.1, 0.9], F.col("n")).alias("p"),
        weighted_mean(F.abs("delay_s"), F.col("n")).alias("mean_abs_delay_s"),
        F.size(F.collect_set("service_date")).alias("n_days"),
    )
    named = out.withColumn(
        "routes_here", F.when(F.col("is_stop"), F.array_join(F.array_sort("here"), ", "))
    ).drop("here", "is_stop", "level")
    return unpacked(named, "p", ["median_delay_s", "p10_delay_s", "p90_delay_s"])


def method_agreement(t: Tables, start: date | None = None) -> DataFrame:
    """Our time against the departure the feed settled on, per day and route: at all stops, and at
    timepoints, where the feed's time is a measurement."""
    keys = ["service_date", "route_id", "route_short_name"]
    diff, far = F.col("methods_diff_s"), F.abs("methods_diff_s")
    cells = histogram(
        since_day(t["stop_events"], start).filter("trip_had_realtime"),
        [*keys, "is_timepoint"],
        "methods_diff_s",
        n_position_method=F.count_if(F.col("observed_arrival").isNotNull() & F.col("is_bounded")),
        n_feed_method=F.count_if(F.col("feed_settled_time").isNotNull()),
        n_bounded=F.count_if(F.col("is_bounded")),
    )
    n, nb, tp = F.col("n"), F.col("n_bounded"), F.col("is_timepoint")
    total = lambda cond, c: F.coalesce(F.sum(F.when(cond, c)), F.lit(0))
    at_tp = lambda c: F.when(tp, c)
    return (
        cells.groupBy(*keys)
        .agg(
            F.sum("n_position_method").alias("n_position_method"),
            F.sum("n_feed_method").alias("n_feed_method"),
            total(diff.isNotNull(), nb).alias("n_both"),
            percentiles(diff, [0.5], n)[0].alias("median_diff_s"),
            percentiles(far, [0.5, 0.9], n).alias("far"),
            total(far <= 60, n).alias("n_within_1min"),
            total(far <= 120, n).alias("n_within_2min"),
            total(diff.isNotNull() & tp, nb).alias("n_both_timepoints"),
            percentiles(at_tp(diff), [0.5], n)[0].alias("median_diff_timepoints_s"),
            percentiles(at_tp(far), [0.5], n)[0].alias("median_abs_diff_timepoints_s"),
            total((far <= 60) & tp, nb).alias("n_within_1min_timepoints"),
            total((far <= 120) & tp, nb).alias("n_within_2min_timepoints"),
        )
        .select(
            "*", F.col("far")[0].alias("median_abs_diff_s"), F.col("far")[1].alias("p90_abs_diff_s")
        )
        .drop("far")
    )


def calibration(t: Tables, cfg: Config = DEFAULT) -> DataFrame:
    """How accurate the sign is by how far out it is, for all routes (null) and each, with the
    timetable as the baseline on the same stop events."""
    e = t["prediction_errors"].filter(F.col("horizon_min").between(0, cfg.calibration_max_min))
    off = F.abs(round_int(seconds_between(F.col("observed_arrival"), F.col("scheduled_arrival"))))
    cells = histogram(
        e,
        ["service_date", "route_id", "horizon_min"],
        "error_s",
        tt1=F.count_if(off <= 60),
        tt2=F.count_if(off <= 120),
        tt5=F.count_if(off <= 300),
    )
    n, err = F.col("n"), F.col("error_s")
    total = lambda cond: F.coalesce(F.sum(F.when(cond, n)), F.lit(0))
    out = grouping_sets(
        cells,
        [["horizon_min"], ["route_id", "horizon_min"]],
        ["route_id", "horizon_min"],
        F.sum(n).alias("n_predictions"),
        total(F.abs(err) <= 60).alias("n_within_1min"),
        total(F.abs(err) <= 120).alias("n_within_2min"),
        total(F.abs(err) <= 300).alias("n_within_5min"),
        total(err < -60).alias("n_bus_earlier_than_sign"),
        total(err > 60).alias("n_bus_later_than_sign"),
        percentiles(err, [0.5, 0.1, 0.9], n).alias("p"),
        weighted_mean(err, n).alias("mean_error_s"),
        F.sum("tt1").alias("n_schedule_within_1min"),
        F.sum("tt2").alias("n_schedule_within_2min"),
        F.sum("tt5").alias("n_schedule_within_5min"),
        F.min("service_date").alias("first_day"),
        F.max("service_date").alias("last_day"),
        F.size(F.collect_set("service_date")).alias("n_days"),
    )
    return unpacked(out, "p", ["median_error_s", "p10_error_s", "p90_error_s"])


def prediction_error_ranges(t: Tables, cfg: Config = DEFAULT) -> DataFrame:
    """Where buses actually came against what the sign said, per route, part of the day, kind of
    stop and horizon; coarser rows (null day_part, null route) to fall back on."""
    e = (
        t["prediction_errors"]
        .filter(F.col("horizon_min").between(0, cfg.honest_max_min))
        .select(
            "route_id",
            "is_timepoint",
            horizon_band(F.col("horizon_min")).alias("horizon_band"),
            day_part(F.col("hour_local")).alias("day_part"),
            "error_s",
        )
    )
    base = ["is_timepoint", "horizon_band"]
    cells = histogram(e, ["route_id", "day_part", *base], "error_s")
    out = grouping_sets(
        cells,
        [["route_id", "day_part", *base], ["route_id", *base], base],
        ["route_id", "day_part", *base],
        F.sum("n").alias("n_predictions"),
        percentiles(F.col("error_s"), [0.1, 0.5, 0.9], F.col("n")).alias("p"),
        F.size(F.collect_set("route_id")).alias("n_routes"),
    )
    return unpacked(out, "p", ["p10_error_s", "p50_error_s", "p90_error_s"])


def _told(samples: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What riders were told: the sign at every minute, and the timetable once per arrival. One scan:
    the arrival's 15-minute sample yields both rows."""
    last = F.col("ahead_min") == DEFAULT.countdown_max_min
    # numbers are repeated, not structs: 0 is the sign's row, 1 the timetable's
    twice = F.when(last, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    sign = F.col("row") == 0
    return (
        samples.filter("in_comparison")
        .select(*keys, "ahead_min", "error_s", "schedule_error_s", F.explode(twice).alias("row"))
        .select(
            *keys,
            F.when(sign, "sign").otherwise("timetable").alias("basis"),
            F.when(sign, F.col("ahead_min")).alias("ahead_min"),
            F.when(sign, F.col("error_s")).otherwise(F.col("schedule_error_s")).alias("error_s"),
        )
    )


def _told_measures() -> list[Column]:
    return [F.count(F.lit(1)).alias("n"), F.sum(F.abs("error_s")).cast("long").alias("sum_abs_s")]


def prediction_daily(t: Tables, start: date | None = None) -> DataFrame:
    told = _told(
        since_day(t["countdown_samples"], start), ["service_date", "weekday_type", "route_id", "hour_local"]
    )
    within = [F.count_if(F.abs("error_s") <= 60 * m).alias(f"n_within_{m}min") for m in (1, 2, 3, 5)]
    return told.groupBy(
        "service_date", "weekday_type", "route_id", "basis", "ahead_min", "hour_local"
    ).agg(*_told_measures(), *within, *threshold_counts(F.col("error_s")))


def prediction_stop_daily(t: Tables, start: date | None = None) -> DataFrame:
    """Per stop and direction as well. Samples carry no direction, so they take it from their stop
    event, on the key both tables are already grouped by."""
    event = ["trip_id", "service_date", "stop_sequence"]
    directions = since_day(t["stop_events"], start).select(*event, "direction_id")
    c = since_day(t["countdown_samples"], start).filter("in_comparison").join(directions, event)
    told = _told(c, ["service_date", "weekday_type", "route_id", "direction_id", "stop_id"])
    return told.groupBy(
        "service_date", "weekday_type", "route_id", "direction_id", "stop_id", "basis", "ahead_min"
    ).agg(*_told_measures(), *threshold_counts(F.col("error_s")))


def fetch_gaps(fetch: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Messages with the seconds since the feed's previous one. A feed is one of three values, so the
    lag is chunked by day instead of sorting a whole feed in one task."""
    rows = with_previous(
        fetch.select("feed", "fetched_at", "fetch_id"),
        ["feed"],
        ["fetched_at", "fetch_id"],
        time_chunk(F.col("fetched_at"), cfg.feed_chunk_s),
        ["fetched_at"],
    )
    return rows.withColumn("gap_s", seconds_between(F.col("fetched_at"), F.col("prev.fetched_at"))).drop("prev")


def daily_coverage(
    t: Tables, as_of: datetime, cfg: Config = DEFAULT, start: date | None = None
) -> DataFrame:
    """How complete each day's collection is: feed gaps, trips reported, stops timed, and why stops
    were left out."""
    fetch = t["fetch"].filter(F.col("feed").isin("trip_updates", "vehicle_positions"))
    if start is not None:
        # one day more, so the first day's first gap is measured too
        from punctual.functions.timeutil import local_midnight

        fetch = fetch.filter(
            F.col("fetched_at") >= lit_ts(local_midnight(start - timedelta(days=1), cfg.timezone))
        )
    per_feed = (
        fetch_gaps(fetch, cfg)
        .groupBy(local_day(F.col("fetched_at"), cfg.timezone).alias("service_date"), "feed")
        .agg(
            F.count(F.lit(1)).alias("n"),
            (F.sum(F.when(F.col("gap_s") > cfg.feed_gap_s, F.col("gap_s")).otherwise(0.0)) / 60.0).alias("gap"),
        )
    )
    feeds = per_feed.groupBy("service_date").agg(
        F.sum(F.when(F.col("feed") == "trip_updates", F.col("n"))).alias("trip_update_fetches"),
        F.sum(F.when(F.col("feed") == "vehicle_positions", F.col("n"))).alias("vehicle_fetches"),
        F.max("gap").alias("gap_minutes"),
    )
    status, seen = F.col("status"), F.col("trip_had_realtime")
    due = F.col("scheduled_arrival") < lit_ts(as_of - timedelta(seconds=cfg.due_after_s))
    mid = ~F.col("is_first_stop") & ~F.col("is_last_stop")
    left_out = status.isNull() & F.col("is_bounded")
    events = since_day(t["stop_events"], start)
    # counts per trip first: trips are then one row each, so distinct trips are plain counts
    per_trip = events.groupBy("service_date", "trip_id").agg(
        F.count(F.lit(1)).alias("stop_events_scheduled"),
        F.count_if(seen).alias("stop_events_trip_seen"),
        F.count_if(status.isNotNull()).alias("stop_events_observed"),
        F.count_if(left_out & ~F.col("is_plausible")).alias("stop_events_implausible"),
        F.count_if(left_out & F.col("is_plausible") & F.col("is_doubtful")).alias("stop_events_doubtful"),
        F.count_if(
            left_out & F.col("is_plausible") & ~F.col("is_doubtful") & ~F.col("is_precise")
        ).alias("stop_events_imprecise"),
        F.count_if(F.col("is_first_stop") & due).alias("trips_due"),
        F.count_if(F.col("is_first_stop") & due & seen).alias("trips_reported"),
        F.count_if(mid & due & seen).alias("mid_stops_due"),
        F.count_if(mid & due & seen & status.isNotNull()).alias("mid_stops_timed"),
    )
    counts = [c for c in per_trip.columns if c not in ("service_date", "trip_id")]
    per_day = per_trip.groupBy("service_date").agg(
        F.count(F.lit(1)).alias("trips_scheduled"),
        F.count_if(F.col("stop_events_trip_seen") > 0).alias("trips_seen"),
        *[F.sum(c).alias(c) for c in counts],
    )
    vehicles = (
        since_day(t["vehicle_position"], start, "start_date")
        .filter(F.col("start_date").isNotNull())
        .groupBy(F.col("start_date").alias("service_date"))
        .agg(F.count_distinct("vehicle_id").alias("vehicles_reporting"))
    )
    none = F.lit(0)
    return (
        per_day.join(feeds, "service_date", "left")
        .join(vehicles, "service_date", "left")
        .select(
            "service_date",
            F.coalesce("trip_update_fetches", none).alias("trip_update_fetches"),
            F.coalesce("vehicle_fetches", none).alias("vehicle_fetches"),
            F.coalesce("gap_minutes", F.lit(0.0)).alias("gap_minutes"),
            "vehicles_reporting",
            "trips_scheduled",
            "trips_seen",
            *counts,
        )
    )


def headway_adherence(t: Tables, cfg: Config = DEFAULT) -> DataFrame:
    """Evenness of frequent service: typical gaps, bunched and gapped buses, by route, direction,
    hour and kind of day, named by the schedule in force on each day."""
    names = t["routes"].select("feed_version_id", "route_id", "route_short_name")
    h = (
        t["headways"]
        .filter(F.col("scheduled_headway_s").between(0, cfg.frequent_headway_s) & (F.col("scheduled_headway_s") > 0))
        .join(t["feed_version_by_date"], "service_date")
        .join(names, ["feed_version_id", "route_id"])
        .select(
            "route_id",
            "route_short_name",
            "direction_id",
            weekday_type(F.col("service_date")).alias("weekday_type"),
            local_hour(F.col("scheduled_arrival"), cfg.timezone).alias("hour_local"),
            "service_date",
            "scheduled_headway_s",
            "observed_headway_s",
        )
    )
    keys = ["route_id", "route_short_name", "direction_id", "weekday_type", "hour_local"]
    ran, due = F.col("observed_headway_s"), F.col("scheduled_headway_s")
    counts = h.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_headways"),
        F.count_if(ran < cfg.bunched_below * due).alias("n_bunched"),
        F.count_if(ran > cfg.gapped_above * due).alias("n_gapped"),
        F.avg(F.abs(ran - due)).alias("mean_abs_headway_dev_s"),
        F.min("service_date").alias("first_day"),
        F.max("service_date").alias("last_day"),
        F.size(F.collect_set("service_date")).alias("n_days"),
    )
    # observed gaps are not whole seconds: exact ranks cell by cell
    typical = {
        "median_scheduled_headway_s": exact_percentiles(
            h, keys, "scheduled_headway_s", {"median_scheduled_headway_s": 0.5}
        ),
        "median_observed_headway_s": exact_percentiles(
            h, keys, "observed_headway_s", {"median_observed_headway_s": 0.5}
        ),
    }
    out = counts
    for name, part in typical.items():
        part = part.select(*[F.col(k).alias(f"__{k}") for k in keys], name)
        same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
        out = out.join(part, same).drop(*[f"__{k}" for k in keys])
    return out
