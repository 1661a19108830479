"""Serving queries over the marts and facts: lateness, accuracy, trends, reports."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from punctual.config import DEFAULT, Config
from punctual.functions.bands import day_kind, scope, service_hour_key
from punctual.functions.geo import distance_m
from punctual.functions.histograms import (
    ABS_NAMES,
    SIGNED_NAMES,
    abs_percentile_minutes,
    signed_percentile,
    summed_counts,
)
from punctual.functions.names import clean_headsign, clean_stop_name
from punctual.functions.timeutil import local_date, service_date, to_local, utc_date
from punctual.operators.live import of_version, stop_names, version_in_force
from punctual.operators.marts import scored
from punctual.operators.profile import grouping_sets, histogram, percentiles, unpacked, weighted_mean
from punctual.operators.routes import placed_patterns, route_order, stop_patterns, stop_places

Tables = Mapping[str, DataFrame]
ALL = ""
TYPICAL = ["median_delay_s", "p10_delay_s", "p90_delay_s"]


def since(as_of: datetime, days: int, cfg: Config = DEFAULT) -> date:
    """First day of "the last N days", today included."""
    return local_date(as_of, cfg.timezone) - timedelta(days=days - 1)


def _chosen(df: DataFrame, start: date | None, kind: str | None, where: Column | None = None) -> DataFrame:
    out = df if start is None else df.filter(F.col("service_date") >= F.lit(start))
    out = out.filter(day_kind(kind, F.col("service_date")))
    return out if where is None else out.filter(where)


def _n_days() -> Column:
    return F.size(F.collect_set("service_date")).alias("n_days")


# --- lateness ------------------------------------------------------------------------------


def level(name: str) -> Column:
    """Which rows of the lateness mart make up a level: overall, hour, route, route_hour or stop."""
    r, s, h = (F.col(c).isNotNull() for c in ("route_id", "stop_id", "hour_local"))
    return {
        "overall": ~r & ~s & ~h,
        "hour": ~r & ~s & h,
        "route": r & ~h,
        "route_hour": r & h,
        "stop": s,
    }[name]


def lateness_at(t: Tables, period: str, days: str, name: str) -> DataFrame:
    return t["mart_lateness"].filter((F.col("period") == period) & (F.col("days") == days)).filter(level(name))


def stops_with_numbers(
    t: Tables, as_of: datetime, period: str = "30d", days: str = "all", cfg: Config = DEFAULT
) -> DataFrame:
    """Every stop with enough arrivals, with its name, sign number and place."""
    fv = version_in_force(t, as_of, cfg)
    names = stop_names(t, fv, "stop_code", F.col("stop_lat").alias("lat"), F.col("stop_lon").alias("lon"))
    return (
        lateness_at(t, period, days, "stop")
        .filter(F.col("n") >= cfg.min_report)
        .join(names, "stop_id")
        .select(
            "stop_id", "stop_name", "stop_code", "lat", "lon", F.col("routes_here").alias("routes"), "n", *TYPICAL,
            (F.col("median_delay_s") / 60).alias("typical_min"),
        )
    )


def route_rank(t: Tables, period: str = "30d", days: str = "all", cfg: Config = DEFAULT) -> DataFrame:
    """Each route's record, and the hour at which its typical bus runs latest."""
    worst = (
        lateness_at(t, period, days, "route_hour")
        .filter(F.col("n") >= cfg.min_range)
        .groupBy("route_id")
        .agg(
            F.max_by(
                F.struct(F.col("hour_local").alias("worst_hour"), F.col("median_delay_s").alias("worst_delay_s")),
                F.struct("median_delay_s", -F.col("hour_local")),
            ).alias("w")
        )
        .select("route_id", "w.*")
    )
    return (
        lateness_at(t, period, days, "route")
        .join(worst, "route_id", "left")
        .select(
            "route_id", "route_short_name", "n", "n_early", "n_on_time", "n_late",
            F.col("median_delay_s").alias("median_delay"), "p10_delay_s", "p90_delay_s", "mean_abs_delay_s",
            "worst_hour", "worst_delay_s",
        )
    )


def _hourly(events: DataFrame, keys: list[str], sets: list[list[str]]) -> DataFrame:
    cells = histogram(events, [*keys, "service_date"], "delay_s")
    out = grouping_sets(
        cells,
        sets,
        keys,
        F.sum("n").alias("n"),
        percentiles(F.col("delay_s"), [0.5, 0.1, 0.9], F.col("n")).alias("p"),
        weighted_mean(F.abs("delay_s"), F.col("n")).alias("mean_abs_delay_s"),
        _n_days(),
    )
    return unpacked(out, "p", TYPICAL)


def hourly_by(
    t: Tables, key: str, start: date, kind: str | None = None, where: Column | None = None
) -> DataFrame:
    """Lateness by hour for everything together (key '') and for each value of ``key``."""
    events = _chosen(scored(t), start, kind, where).withColumn("key", F.col(key).cast("string"))
    return (
        _hourly(events, ["key", "hour_local"], [["hour_local"], ["key", "hour_local"]])
        .withColumn("key", F.coalesce("key", F.lit(ALL)))
        .select("key", "hour_local", "n", *TYPICAL, "n_days")
    )


def scope_lateness(
    t: Tables, start: date, kind: str | None = None, route_id: str | None = None, stop_id: str | None = None
) -> DataFrame:
    """Headline (null hour) and hourly lateness for a choice of route and stop."""
    events = _chosen(scored(t), start, kind, scope(route_id, stop_id))
    return _hourly(events, ["hour_local"], [[], ["hour_local"]])


def today_so_far(
    t: Tables, as_of: datetime, route_id: str | None = None, stop_id: str | None = None, cfg: Config = DEFAULT
) -> DataFrame:
    """Lateness of today's service day, for all routes (null) and each."""
    day = F.lit(service_date(as_of, cfg.timezone, cfg.rollover_hours))
    events = scored(t).filter(F.col("service_date") == day).filter(scope(route_id, stop_id))
    cells = histogram(events, ["route_id"], "delay_s")
    return grouping_sets(
        cells, [[], ["route_id"]], ["route_id"],
        F.sum("n").alias("n"),
        percentiles(F.col("delay_s"), [0.5], F.col("n"))[0].alias("median_delay_s"),
    )


# --- prediction accuracy -------------------------------------------------------------------


def _off_measures() -> list[Column]:
    return [
        F.sum("n").alias("n"),
        (F.sum("sum_abs_s") / F.nullif(F.sum("n"), F.lit(0))).alias("mean_abs_s"),
        *summed_counts(),
    ]


def with_read_offs(df: DataFrame) -> DataFrame:
    """Typical and 8-in-10 errors read off the summed counts, instead of the counts themselves."""
    kept = [c for c in df.columns if c not in ABS_NAMES and c not in SIGNED_NAMES]
    return df.select(
        *kept,
        signed_percentile(0.1).alias("p10_s"),
        signed_percentile(0.5).alias("p50_s"),
        signed_percentile(0.9).alias("p90_s"),
        abs_percentile_minutes(0.8).alias("within_80pct_min"),
    )


def prediction_off(t: Tables, start: date, kind: str | None = None) -> DataFrame:
    """How far off predictions were at each distance, and the timetable, for all routes and each."""
    rows = _chosen(t["mart_prediction_daily"], start, kind)
    return with_read_offs(
        grouping_sets(
            rows, [["basis", "ahead_min"], ["basis", "ahead_min", "route_id"]], ["basis", "ahead_min", "route_id"], *_off_measures()
        ).filter("basis is not null")
    )


def prediction_off_by(
    t: Tables, key: str, start: date, kind: str | None = None, where: Column | None = None,
    wanted: list[str] | None = None,
) -> DataFrame:
    """The same from the per-stop mart, for a scope: together (null) and per ``key``, optionally only
    for the values wanted."""
    rows = _chosen(t["mart_prediction_stop_daily"], start, kind, where).withColumn("key", F.col(key))
    out = grouping_sets(
        rows, [["basis", "ahead_min"], ["basis", "ahead_min", "key"]], ["basis", "ahead_min", "key"],
        *_off_measures(), F.grouping("key").alias("all_keys"),
    )
    if wanted is not None:
        out = out.filter((F.col("all_keys") == 1) | F.col("key").isin(*(wanted or ["-"])))
    return with_read_offs(out.drop("all_keys"))


def accuracy_by_hour(
    t: Tables, start: date, ahead_lo: int, ahead_hi: int, kind: str | None = None, stop_id: str | None = None,
    route_id: str | None = None, cfg: Config = DEFAULT,
) -> DataFrame:
    """Share right within 2, 3 and 5 minutes by hour of day, hours in service order."""
    near = F.col("ahead_min").between(ahead_lo, ahead_hi)
    if stop_id is not None:
        rows = _chosen(t["countdown_samples"].filter("in_comparison"), start, kind, near & scope(route_id, stop_id))
        off = F.abs("error_s")
        out = rows.groupBy("hour_local").agg(
            F.count(F.lit(1)).alias("n"),
            *[F.count_if(off <= 60 * m).alias(f"within_{m}min") for m in (2, 3, 5)],
        )
    else:
        rows = _chosen(t["mart_prediction_daily"], start, kind, near & (F.col("basis") == "sign") & scope(route_id))
        out = rows.groupBy("hour_local").agg(
            F.sum("n").alias("n"), *[F.sum(f"n_within_{m}min").alias(f"within_{m}min") for m in (2, 3, 5)]
        )
    return (
        out.filter(F.col("n") >= cfg.min_range)
        .withColumn("service_order", service_hour_key(F.col("hour_local")))
        .withColumns({f"share_{m}min": F.col(f"within_{m}min") / F.col("n") for m in (2, 3, 5)})
    )


def predictions_vs_timetable(
    t: Tables, key: str, start: date, ahead: int = 5, kind: str | None = None, where: Column | None = None,
    min_n: int = 20,
) -> DataFrame:
    """Per route or stop: the prediction at ``ahead`` minutes beside the timetable on the same
    arrivals."""
    source = "mart_prediction_daily" if key == "route_id" and where is None else "mart_prediction_stop_daily"
    rows = _chosen(t[source], start, kind, where).filter(
        F.col(key).isNotNull() & ((F.col("basis") == "timetable") | (F.col("ahead_min") == ahead))
    )
    sums = [F.sum("n").alias("n"), F.sum("sum_abs_s").alias("off"), *summed_counts(names=SIGNED_NAMES)]
    both = rows.groupBy(key, "basis").agg(*sums)
    measures = F.struct(
        "n",
        (F.col("off") / F.nullif("n", F.lit(0))).alias("mean_abs_s"),
        *[signed_percentile(q).alias(name) for q, name in ((0.1, "p10_s"), (0.5, "p50_s"), (0.9, "p90_s"))],
    )
    wide = (
        both.select(key, "basis", measures.alias("m"))
        .groupBy(key)
        .agg(
            F.max(F.when(F.col("basis") == "sign", F.col("m"))).alias("p"),
            F.max(F.when(F.col("basis") == "timetable", F.col("m"))).alias("t"),
        )
        .filter(F.col("p").isNotNull() & (F.col("t.n") >= min_n))
    )
    names = ("mean_abs_s", "p10_s", "p50_s", "p90_s")
    return wide.select(
        F.col(key).alias("id"),
        F.col("t.n").alias("arrivals"),
        *[F.col(f"p.{n}").alias(f"prediction_{n}") for n in names],
        *[F.col(f"t.{n}").alias(f"timetable_{n}") for n in names],
    )


# --- trends --------------------------------------------------------------------------------


def trend(
    t: Tables, route_id: str | None = None, direction_id: int | None = None, stop_id: str | None = None,
    start: date | None = None, kind: str | None = None, max_points: int | None = None, cfg: Config = DEFAULT,
) -> DataFrame:
    """The typical bus over time for one choice: per day, or rolled up to weeks or months once there
    are too many days, then the weighted median of the days' typical buses and the weighted mean of
    their ranges."""
    points = cfg.trend_max_points if max_points is None else max_points
    rows = t["mart_trend_daily"].filter(F.col("n") >= cfg.min_typical)
    for column, flag, wanted in (
        ("route_id", "by_route", route_id), ("direction_id", "by_direction", direction_id), ("stop_id", "by_stop", stop_id),
    ):
        rows = rows.filter(~F.col(flag) if wanted is None else F.col(flag) & (F.col(column) == wanted))
    daily = _chosen(rows, start, kind).select(F.col("service_date").alias("d"), "n", *TYPICAL)
    return roll_up(daily, points)


def roll_up(daily: DataFrame, max_points: int) -> DataFrame:
    """(d, n, typical, range) per day to per day, week (from Monday) or month, by the span covered."""
    span = daily.agg(F.datediff(F.max("d"), F.min("d")) + 1).scalar()
    unit = F.when(span <= max_points, "day").when(span <= 7 * max_points, "week").otherwise("month")
    at = (
        F.when(unit == "day", F.col("d"))
        .when(unit == "week", F.to_date(F.date_trunc("week", "d")))
        .otherwise(F.to_date(F.date_trunc("month", "d")))
    )
    w = Window.partitionBy("at").orderBy("median_delay_s", "d")
    weighed = (
        daily.withColumn("at", at)
        .withColumn("unit", unit)
        .withColumn("upto", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("total", F.sum("n").over(Window.partitionBy("at")))
    )
    half = F.col("upto") >= F.col("total") / 2
    return weighed.groupBy("at", "unit").agg(
        F.sum("n").alias("n"),
        F.min(F.when(half, F.col("median_delay_s"))).alias("median_delay_s"),
        weighted_mean(F.col("p10_delay_s"), F.col("n")).alias("p10_delay_s"),
        weighted_mean(F.col("p90_delay_s"), F.col("n")).alias("p90_delay_s"),
    ).withColumnRenamed("at", "d")


# --- reports -------------------------------------------------------------------------------


def stop_report(t: Tables, stop_id: str, start: date, kind: str | None = None, cfg: Config = DEFAULT) -> DataFrame:
    """Each route and direction at a stop, and how many minutes early to be there to catch 19 buses
    in 20."""
    events = _chosen(scored(t), start, kind, F.col("stop_id") == stop_id)
    keys = ["route_id", "route_short_name", "direction_id"]
    cells = histogram(
        events, [*keys, "service_date"], "delay_s",
        n_early=F.count_if(F.col("status") == "early"), n_late=F.count_if(F.col("status") == "late"),
    )
    out = unpacked(
        cells.groupBy(*keys).agg(
            F.sum("n").alias("n"),
            F.sum("n_early").alias("early"),
            F.sum("n_late").alias("late"),
            weighted_mean(F.abs("delay_s"), F.col("n")).alias("mean_abs"),
            percentiles(F.col("delay_s"), [0.5, 0.1, 0.9, 0.05], F.col("n")).alias("p"),
            F.min("service_date").alias("first_day"),
            F.max("service_date").alias("last_day"),
            _n_days(),
        ),
        "p",
        ["median_delay", "p10", "p90", "p05"],
    )
    early = F.when(F.col("n") >= cfg.min_report, F.when(F.col("p05") >= -30, F.lit(0.0)).otherwise(F.rint(-F.col("p05") / 60)))
    return out.withColumn("be_early_min", early)


def departures(
    t: Tables, stop_id: str, start: date, route: str | None = None, direction_id: int | None = None,
    kind: str | None = None, cfg: Config = DEFAULT,
) -> DataFrame:
    """Each scheduled departure at a stop, day after day, in service order."""
    where = F.col("stop_id") == stop_id
    if route is not None:
        where = where & (F.col("route_short_name") == route) & F.col("direction_id").eqNullSafe(F.lit(direction_id))
    at = to_local(F.col("scheduled_arrival"), cfg.timezone)
    events = _chosen(scored(t), start, kind, where).withColumn("sched", F.date_format(at, "HH:mm"))
    cells = histogram(events, ["sched", "weekday_type"], "delay_s")
    out = (
        cells.groupBy("sched", "weekday_type")
        .agg(
            F.sum("n").alias("n"),
            weighted_mean(F.abs("delay_s"), F.col("n")).alias("mean_abs"),
            percentiles(F.col("delay_s"), [0.5, 0.1, 0.9], F.col("n")).alias("p"),
        )
        .filter(F.col("n") >= cfg.min_departure_days)
    )
    minute = F.left("sched", F.lit(2)).cast("int") * 60 + F.right("sched", F.lit(2)).cast("int")
    return unpacked(out, "p", ["median_delay", "p10", "p90"]).withColumn(
        "service_min", F.pmod(minute - 240, F.lit(1440))
    )


def nearby_stops(t: Tables, as_of: datetime, stop_id: str, k: int = 8, cfg: Config = DEFAULT) -> DataFrame:
    """The nearest stops that have measured arrivals."""
    fv = version_in_force(t, as_of, cfg)
    stops = t["stops"].filter((F.col("feed_version_id") == fv) & (F.col("location_type") == 0))
    here = t["stops"].filter((F.col("feed_version_id") == fv) & (F.col("stop_id") == stop_id))
    lon, lat = here.agg(F.max("stop_lon")).scalar(), here.agg(F.max("stop_lat")).scalar()
    recent = t["stop_events"].filter(
        F.col("service_date") >= F.lit(utc_date(as_of) - timedelta(days=30))
    ).select("stop_id").distinct()
    return (
        stops.filter(F.col("stop_id") != stop_id)
        .join(recent, "stop_id", "left_semi")
        .select(
            "stop_id", "stop_name", "stop_code",
            distance_m(lon, lat, F.col("stop_lon"), F.col("stop_lat")).alias("distance_m"),
        )
        .orderBy("distance_m", "stop_id")
        .limit(k)
    )


def along_route(
    t: Tables, as_of: datetime, route_id: str, direction_id: int | None, start: date, kind: str | None = None,
    cfg: Config = DEFAULT,
) -> DataFrame:
    """Lateness along a route in stop order. Each arrival is placed by its trip's stop number; one the
    timetable does not know takes its stop's first place; without directions, the stop's earliest."""
    fv = version_in_force(t, as_of, cfg)
    where = F.col("route_id") == route_id
    if direction_id is not None:
        where = where & (F.col("direction_id") == direction_id)
    events = _chosen(scored(t), start, kind, where).select("stop_id", "stop_sequence", "is_timepoint", "delay_s")
    if direction_id is None:
        first = events.groupBy("stop_id").agg(F.min("stop_sequence").alias("place"))
        placed = events.join(first, "stop_id")
    else:
        on_route = (F.col("route_id") == route_id) & (F.col("direction_id") == direction_id)
        fitted = placed_patterns(stop_patterns(t, fv).filter(on_route))
        exact = stop_places(t, placed=fitted).select("stop_id", "stop_sequence", F.col("place").alias("exact"))
        first = route_order(fitted).groupBy("stop_id").agg(F.min("place").alias("first"))
        placed = (
            events.join(exact, ["stop_id", "stop_sequence"], "left")
            .join(first, "stop_id", "left")
            .withColumn("place", F.coalesce("exact", "first", F.lit(9999)))
        )
    cells = histogram(
        placed, ["place"], "delay_s", stop_id=F.min("stop_id"), is_timepoint=F.bool_or("is_timepoint")
    )
    out = (
        cells.groupBy("place")
        .agg(
            F.min("stop_id").alias("stop_id"),
            F.bool_or("is_timepoint").alias("is_timepoint"),
            F.sum("n").alias("n"),
            weighted_mean(F.abs("delay_s"), F.col("n")).alias("mean_abs"),
            percentiles(F.col("delay_s"), [0.5, 0.1, 0.9], F.col("n")).alias("p"),
        )
        .filter(F.col("n") >= cfg.min_typical)
    )
    named = unpacked(out, "p", ["median_delay", "p10", "p90"]).join(stop_names(t, fv), "stop_id", "left")
    return named.withColumn("stop_name", F.coalesce("stop_name", F.lit("Stop"))).withColumn("no", F.col("place") + 1)


def report_lateness(t: Tables, as_of: datetime, cfg: Config = DEFAULT) -> DataFrame:
    """Each route at each stop, and each stop by hour, over 30 days."""
    events = scored(t).filter(F.col("service_date") >= F.lit(since(as_of, 30, cfg)))
    cells = histogram(
        events, ["route_id", "stop_id", "hour_local"], "delay_s", first_seq=F.min("stop_sequence")
    )
    out = grouping_sets(
        cells,
        [["route_id", "stop_id"], ["stop_id", "hour_local"]],
        ["route_id", "stop_id", "hour_local"],
        F.min("first_seq").alias("seq"),
        F.sum("n").alias("n"),
        percentiles(F.col("delay_s"), [0.5, 0.1, 0.9], F.col("n")).alias("p"),
        weighted_mean(F.abs("delay_s"), F.col("n")).alias("mean_abs_delay_s"),
    )
    return unpacked(out, "p", TYPICAL)


def report_predictions(t: Tables, as_of: datetime, by_stop: bool, ahead: int = 5, cfg: Config = DEFAULT) -> DataFrame:
    """Predictions at 5 minutes against the timetable, per route and in all, or per stop."""
    source, key = ("mart_prediction_stop_daily", "stop_id") if by_stop else ("mart_prediction_daily", "route_id")
    rows = t[source].filter(F.col("service_date") >= F.lit(since(as_of, 30, cfg)))
    sign = (F.col("basis") == "sign") & (F.col("ahead_min") == ahead)
    printed = F.col("basis") == "timetable"
    total = lambda cond, c: F.sum(F.when(cond, F.col(c)))
    aggs = [
        (total(sign, "sum_abs_s") / F.nullif(total(sign, "n"), F.lit(0))).alias("pred_s"),
        (total(printed, "sum_abs_s") / F.nullif(total(printed, "n"), F.lit(0))).alias("tt_s"),
        total(printed, "n").alias("n_tt"),
        total(sign, "n").alias("n"),
        *summed_counts(sign, SIGNED_NAMES),
    ]
    out = rows.groupBy(key).agg(*aggs) if by_stop else grouping_sets(rows, [[key], []], [key], *aggs)
    if by_stop:
        out = out.filter(F.col("n_tt") >= cfg.min_report)
    kept = [c for c in out.columns if c not in SIGNED_NAMES]
    return out.select(*kept, signed_percentile(0.5).alias("typical_s"))


def steadiest(t: Tables, cfg: Config = DEFAULT) -> DataFrame:
    """Overall shares and the steadiest and least steady busy route of the last 30 days, one row."""
    all_rows = lateness_at(t, "30d", "all", "overall").select(
        "n", *TYPICAL, "mean_abs_delay_s",
        *[(F.col(f"n_{s}") / F.col("n")).alias(f"{s}_share") for s in ("on_time", "early", "late")],
    )
    busy = lateness_at(t, "30d", "all", "route").filter(F.col("n") >= cfg.min_route_arrivals)
    ends = busy.agg(
        F.count(F.lit(1)).alias("k"),
        F.min_by("route_id", F.struct("mean_abs_delay_s", "route_id")).alias("best_route"),
        F.min("mean_abs_delay_s").alias("best_s"),
        F.max_by("route_id", F.struct("mean_abs_delay_s", "route_id")).alias("worst_route"),
        F.max("mean_abs_delay_s").alias("worst_s"),
    )
    pick = lambda c: ends.select(F.when(F.col("k") >= 2, F.col(c))).scalar()
    return all_rows.withColumns(
        {c: pick(c) for c in ("best_route", "best_s", "worst_route", "worst_s")}
    )


def layer_status(t: Tables) -> DataFrame:
    """Rows and first and last day of the analysis tables."""
    parts = (
        ("scheduled_stop_events", None),
        ("observed_arrivals", None),
        ("stop_events", F.col("status").isNotNull()),
        ("prediction_errors", None),
        ("mart_route_daily", None),
    )
    out = None
    for name, counted in parts:
        n = F.count(F.lit(1)) if counted is None else F.count_if(counted)
        one = t[name].agg(
            n.alias("rows"), F.min("service_date").alias("first_day"), F.max("service_date").alias("last_day")
        ).select(F.lit(name).alias("tbl"), "rows", "first_day", "last_day")
        out = one if out is None else out.unionByName(one)
    return out


def observed_lately(t: Tables, as_of: datetime) -> DataFrame:
    """Observed arrivals since yesterday."""
    recent = t["observed_arrivals"].filter(F.col("service_date") >= F.lit(utc_date(as_of) - timedelta(days=1)))
    return recent.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("is_bounded") & F.col("is_plausible")).alias("bounded"),
        F.percentile("uncertainty_s", F.lit(0.5)).alias("median_uncertainty_s"),
    )


def agreement_summary(t: Tables, as_of: datetime) -> DataFrame:
    return t["mart_method_agreement"].filter(
        F.col("service_date") >= F.lit(utc_date(as_of) - timedelta(days=30))
    ).agg(
        F.sum("n_both_timepoints").alias("n_tp"),
        F.sum("n_within_2min_timepoints").alias("w_tp"),
        F.percentile("median_abs_diff_timepoints_s", F.lit(0.5)).alias("med_tp"),
    )


def agreement_histogram(t: Tables, as_of: datetime) -> DataFrame:
    """Differences between the two methods at timepoints, in 15-second bins up to 5 minutes."""
    cell = (F.floor(F.col("methods_diff_s") / 15.0) * 15).cast("int")
    return (
        t["stop_events"]
        .filter(F.col("methods_diff_s").isNotNull() & F.col("is_bounded") & F.col("is_timepoint"))
        .filter(F.col("service_date") >= F.lit(utc_date(as_of) - timedelta(days=30)))
        .groupBy(F.greatest(F.lit(-300), F.least(F.lit(300), cell)).alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def coverage_week(t: Tables, as_of: datetime, cfg: Config = DEFAULT) -> DataFrame:
    """Share of stops timed and trips reported over the last 7 finished days."""
    done = t["mart_daily_coverage"].filter(F.col("service_date") < F.lit(local_date(as_of, cfg.timezone)))
    return done.orderBy(F.col("service_date").desc()).limit(7).agg(
        F.sum("mid_stops_timed").alias("timed"),
        F.sum("mid_stops_due").alias("due"),
        F.sum("trips_reported").alias("trips_reported"),
        F.sum("trips_due").alias("trips_due"),
    )


def destinations(t: Tables, as_of: datetime, cfg: Config = DEFAULT) -> DataFrame:
    """Distinct destinations by route and direction in the version in force."""
    fv = version_in_force(t, as_of, cfg)
    return (
        of_version(t["trips"], fv)
        .groupBy("route_id", "direction_id")
        .agg(F.array_join(F.array_sort(F.collect_set("trip_headsign")), " / ").alias("headsigns"))
    )


def readable_destinations(t: Tables, as_of: datetime, cfg: Config = DEFAULT) -> DataFrame:
    """Up to two readable destinations per route and direction, as report cards show them."""
    fv = version_in_force(t, as_of, cfg)
    routes = of_version(t["routes"], fv).select("route_id", "route_short_name")
    signs = (
        of_version(t["trips"], fv)
        .select("route_id", "direction_id", "trip_headsign")
        .distinct()
        .join(routes, "route_id")
        .withColumn("headsign", clean_headsign(F.col("trip_headsign"), F.col("route_short_name")))
        .filter("headsign <> ''")
    )
    return signs.groupBy("route_short_name", "direction_id").agg(
        F.array_join(F.slice(F.array_sort(F.collect_set("headsign")), 1, 2), " / ").alias("headsign")
    )


def route_shapes(t: Tables, as_of: datetime, route_id: str, cfg: Config = DEFAULT) -> DataFrame:
    """Shape points of a route in drawing order."""
    fv = version_in_force(t, as_of, cfg)
    used = of_version(t["trips"], fv).filter(F.col("route_id") == route_id).select("shape_id").distinct()
    return (
        of_version(t["shapes"], fv)
        .join(used, "shape_id", "left_semi")
        .select("shape_id", "shape_pt_sequence", F.col("shape_pt_lon").alias("lon"), F.col("shape_pt_lat").alias("lat"))
    )


def names_by_rule(t: Tables, as_of: datetime, cfg: Config = DEFAULT) -> DataFrame:
    """Distinct stop names with the rule that rewrites each and the result."""
    from punctual.functions.names import stop_name_rule
    from punctual.operators.schedule import newest_version

    names = (
        t["stops"]
        .filter((F.col("feed_version_id") == newest_version(t)) & (F.col("location_type") == 0))
        .select("stop_name")
        .distinct()
    )
    return names.select(
        "stop_name", stop_name_rule(F.col("stop_name")).alias("rule"), clean_stop_name(F.col("stop_name")).alias("shown")
    )

