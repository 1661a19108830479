"""Serving queries about right now: buses, boards, countdowns, feed state, alerts, activity.

Every function takes the tables and ``as_of`` and returns a DataFrame. They start from the few rows
inside their time window and join those to the rest, so the large tables are only ever filtered or
probed by key.
"""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from punctual.config import DEFAULT, Config
from punctual.functions.bands import day_part, horizon_band, live_status
from punctual.functions.geo import distance_m, utm
from punctual.functions.timeutil import (
    as_utc,
    lit_ts,
    local_hour,
    plus_seconds,
    round_int,
    seconds_between,
    service_date,
    to_local,
    weekday_type,
)
from punctual.functions.lines import piece
from punctual.operators.geometry import place_on_stretch
from punctual.operators.schedule import timepoint_flag

Tables = Mapping[str, DataFrame]
KEY = ["trip_id", "start_date", "stop_sequence"]


def version_in_force(t: Tables, as_of: datetime, cfg: Config = DEFAULT) -> Column:
    """The schedule version of today's service date, else the newest, as a scalar subquery: no job runs
    while a query is built, and scans prune their version partitions when the number is known."""
    today = service_date(as_of, cfg.timezone, cfg.rollover_hours)
    by_date = t["feed_version_by_date"].filter(F.col("service_date") == F.lit(today))
    newest = t["feed_version"].agg(F.max("feed_version_id")).scalar()
    return F.coalesce(by_date.agg(F.max("feed_version_id")).scalar(), newest).cast("int")


def of_version(df: DataFrame, fv: Column) -> DataFrame:
    return df.filter(F.col("feed_version_id") == fv).drop("feed_version_id")


def ago(as_of: datetime, **parts: float) -> Column:
    return lit_ts(as_utc(as_of) - timedelta(**parts))


def ahead(as_of: datetime, **parts: float) -> Column:
    return lit_ts(as_utc(as_of) + timedelta(**parts))


def told() -> Column:
    return F.coalesce("arrival_time", "departure_time")


def trip_names(t: Tables, fv: Column) -> DataFrame:
    """(trip_id, route_id, direction_id, headsign, route) of one version."""
    trips = of_version(t["trips"], fv).select(
        "trip_id", "route_id", "direction_id", F.col("trip_headsign").alias("headsign"), "shape_id"
    )
    routes = of_version(t["routes"], fv).select("route_id", F.col("route_short_name").alias("route"))
    return trips.join(routes, "route_id")


def stop_names(t: Tables, fv: Column, *extra: str) -> DataFrame:
    return of_version(t["stops"], fv).select("stop_id", "stop_name", *extra)


def with_schedule(df: DataFrame, t: Tables) -> DataFrame:
    """Adds ``scheduled``: our own scheduled moment of the stop, else the feed's, and is_last_stop."""
    se = t["scheduled_stop_events"].select(
        "trip_id",
        F.col("service_date").alias("start_date"),
        "stop_sequence",
        F.col("scheduled_arrival").alias("ours"),
        "is_last_stop",
    )
    return (
        df.join(se, KEY, "left")
        .withColumn("scheduled", F.coalesce("ours", "scheduled_time"))
        .withColumn("is_last_stop", F.coalesce("is_last_stop", F.lit(False)))
        .drop("ours")
    )


def with_next(candidates: DataFrame, predictions: DataFrame, fields: Mapping[str, Column]) -> DataFrame:
    """Adds a struct ``nx`` with ``fields`` of the trip's next stop after each candidate row. The
    candidates' trips select the rows; each is then looked at once, next to its successor."""
    trip = ["trip_id", "start_date"]
    after = F.lead(F.struct(*[c.alias(n) for n, c in fields.items()])).over(
        Window.partitionBy(*trip).orderBy("stop_sequence")
    )
    nearest = (
        predictions.join(candidates.select(*trip).distinct(), trip, "left_semi")
        .withColumn("nx", after)
        .select(*KEY, "nx")
    )
    return candidates.join(nearest, KEY, "left")


def has_left(moment: Column, cfg: Config = DEFAULT) -> Column:
    """A stop counts as left when the feed kept reporting it after its time, or the bus's next stop
    was still being updated after it."""
    enough = plus_seconds(moment, cfg.left_rule_s)
    return F.coalesce(F.col("last_seen_at") >= enough, F.lit(False)) | F.coalesce(
        F.col("nx.next_seen") >= enough, F.lit(False)
    )


# --- buses ---------------------------------------------------------------------------------


def latest_reports(t: Tables, as_of: datetime, back_min: int = 10, ahead_min: int | None = 5) -> DataFrame:
    """The newest report of each bus inside the live window."""
    p = t["vehicle_position"].filter(F.col("position_timestamp") >= ago(as_of, minutes=back_min))
    if ahead_min is not None:
        p = p.filter(F.col("position_timestamp") <= ahead(as_of, minutes=ahead_min))
    rest = [c for c in p.columns if c != "vehicle_id"]
    return (
        p.groupBy("vehicle_id")
        .agg(F.max_by(F.struct(*rest), F.struct("position_timestamp", "fetch_id")).alias("p"))
        .select("vehicle_id", "p.*")
    )


def hinted_stops(buses: DataFrame, t: Tables) -> DataFrame:
    """Adds structs p1, p2: the trip's first stop not yet passed by the feed's times, and the one
    after. The fleet's trips select the prediction rows; the window then runs per bus."""
    stops = t["prediction_current"].select(
        *KEY, "stop_id", told().alias("at"), "scheduled_time", F.coalesce("arrival_delay", "departure_delay").alias("delay")
    )
    along = Window.partitionBy("vehicle_id").orderBy("stop_sequence")
    here = F.struct("stop_sequence", "stop_id", "at", "scheduled_time", "delay")
    found = (
        buses.select("vehicle_id", "trip_id", "start_date", "position_timestamp")
        .join(stops, ["trip_id", "start_date"])
        .withColumn("p1", here)
        .withColumn("p2", F.lead(here).over(along))
        .filter(F.col("at") >= plus_seconds(F.col("position_timestamp"), -30))
        .groupBy("vehicle_id")
        .agg(F.min_by(F.struct("p1", "p2"), "stop_sequence").alias("h"))
        .select("vehicle_id", "h.p1", "h.p2")
    )
    return buses.join(found, "vehicle_id", "left")


def live_buses(
    t: Tables, as_of: datetime, cfg: Config = DEFAULT, route_id: str | None = None, direction: int | None = None
) -> DataFrame:
    """Every bus that reported lately: where it is, its next two predicted stops, how late the
    prediction puts it, and its status band."""
    fv = version_in_force(t, as_of, cfg)
    names = trip_names(t, fv).drop("shape_id").withColumnRenamed("route_id", "trip_route_id")
    buses = hinted_stops(latest_reports(t, as_of), t).join(names, "trip_id", "left")
    if route_id is not None:
        buses = buses.filter(F.col("trip_route_id") == route_id)
    if direction is not None:
        buses = buses.filter(F.col("direction_id") == direction)
    stops = stop_names(t, fv)
    due = t["scheduled_stop_events"].select(
        "trip_id", F.col("service_date").alias("start_date"), F.col("stop_sequence").alias("s_seq"), "scheduled_arrival"
    )
    known = F.col("trip_route_id").isNotNull()
    out = (
        buses.withColumn("s_seq", F.col("p1.stop_sequence"))
        .join(due, ["trip_id", "start_date", "s_seq"], "left")
        .withColumn("n1", F.when(known, F.col("p1.stop_id")))
        .withColumn("n2", F.when(known, F.col("p2.stop_id")))
        .join(stops.select(F.col("stop_id").alias("n1"), F.col("stop_name").alias("next_stop")), "n1", "left")
        .join(stops.select(F.col("stop_id").alias("n2"), F.col("stop_name").alias("stop2")), "n2", "left")
    )
    late = F.coalesce(
        F.col("p1.delay"),
        round_int(
            seconds_between(F.col("p1.at"), F.coalesce(F.col("scheduled_arrival"), F.col("p1.scheduled_time")))
        ),
    )
    return out.select(
        "vehicle_id",
        "trip_id",
        "start_date",
        "route",
        "headsign",
        F.col("latitude").alias("lat"),
        F.col("longitude").alias("lon"),
        "bearing",
        "occupancy_status",
        "position_timestamp",
        F.col("p1.stop_sequence").alias("next_seq"),
        "next_stop",
        F.col("p1.at").alias("next_time"),
        F.col("p2.stop_sequence").alias("seq2"),
        "stop2",
        F.col("p2.at").alias("time2"),
        late.alias("delay_s"),
        live_status(late, cfg).alias("live_status"),
    )


def status_bands(t: Tables, as_of: datetime, cfg: Config = DEFAULT) -> DataFrame:
    """Buses by live status band."""
    return live_buses(t, as_of, cfg).groupBy("live_status").agg(F.count(F.lit(1)).alias("buses"))


def next_stops(
    t: Tables, as_of: datetime, cfg: Config = DEFAULT, buses: DataFrame | None = None, lines: DataFrame | None = None
) -> DataFrame:
    """The next two stops from where each bus is on its shape, with the pieces of the line that lead to them
    (points of longitude and latitude). The feed's own next stop only says which pass of a street
    it is on: the bus is looked for between two stops either side of it."""
    fv = version_in_force(t, as_of, cfg)
    if buses is None:
        buses = hinted_stops(latest_reports(t, as_of), t).withColumn("hint_seq", F.col("p1.stop_sequence"))
    lines = t["shape_lines"] if lines is None else lines
    x, y = utm(F.col("longitude"), F.col("latitude"))
    usable = (
        of_version(t["stop_shape_fractions"], fv)
        .filter("is_usable")
        .select("trip_id", F.struct(F.col("stop_sequence").alias("seq"), "stop_id", "frac").alias("s"))
    )
    # the fleet's trips select the stops; a bus carries its own trip's stops (tens of them) with it
    on_trip = (
        buses.filter(F.col("trip_id").isNotNull())
        .select("vehicle_id", "trip_id", "start_date", "hint_seq", x.alias("x"), y.alias("y"))
        .join(of_version(t["trips"], fv).select("trip_id", "shape_id"), "trip_id")
        .join(usable, "trip_id")
        .groupBy("vehicle_id", "trip_id", "start_date", "hint_seq", "x", "y", "shape_id")
        .agg(F.array_sort(F.collect_list("s")).alias("stops"))
        .join(of_version(lines, fv), "shape_id")
    )
    passed = F.size(F.filter("stops", lambda s: s["seq"] < F.col("hint_seq")))
    hinted = F.col("hint_seq").isNotNull() & (passed < F.size("stops"))
    at = lambda step: F.when(hinted & (passed + step >= 0), F.get("stops", passed + step)["frac"])
    placed = place_on_stretch(
        on_trip.withColumn("lo", F.coalesce(at(-2), F.lit(0.0)))
        .withColumn("hi", F.coalesce(at(2), F.lit(1.0)))
    )
    clear = F.col("bus_frac") + F.lit(cfg.next_stop_clearance_m) / F.nullif("length_m", F.lit(0.0))
    ahead_of = (
        placed.withColumn("clear", clear)
        .withColumn("two", F.slice(F.filter("stops", lambda s: s["frac"] > F.col("clear")), 1, 2))
        .withColumn("reached", F.transform("two", lambda s: s["frac"]))
        .withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(1))))
        .filter(F.col("i") < F.size("two"))
        .withColumn("s", F.get("two", F.col("i")))
        .select(
            "vehicle_id", "trip_id", "start_date", "hint_seq", "bus_frac", (F.col("i") + 1).alias("n"),
            F.col("s.seq").alias("stop_sequence"), "s.stop_id", "s.frac",
            # the line to draw: from the bus to the first stop, from there to the second
            piece(F.col("line"), F.when(F.col("i") == 0, F.col("bus_frac")).otherwise(F.get("reached", F.lit(0))), F.col("s.frac")).alias("path"),
        )
    )
    timed = with_schedule(
        ahead_of.join(
            t["prediction_current"].select(*KEY, told().alias("predicted"), "scheduled_time"), KEY, "left"
        ),
        t,
    ).join(stop_names(t, fv), "stop_id")
    s = F.struct(
        "stop_sequence",
        "stop_id",
        "stop_name",
        "frac",
        F.coalesce("predicted", "scheduled").alias("at"),
        F.when(F.col("predicted").isNotNull(), cfg.source_feed).otherwise("timetable").alias("src"),
        "path",
    )
    both = timed.groupBy("vehicle_id", "bus_frac", "hint_seq").agg(
        F.max(F.when(F.col("n") == 1, s)).alias("a"), F.max(F.when(F.col("n") == 2, s)).alias("b")
    )
    spread = [
        F.col(f"{side}.{f}").alias(f"{name}{i}")
        for i, side in ((1, "a"), (2, "b"))
        for f, name in (
            ("stop_sequence", "seq"), ("stop_id", "stop_id"), ("stop_name", "name"), ("frac", "frac"), ("at", "time"), ("src", "src"),
            ("path", "path"),
        )
    ]
    return both.filter(F.col("a").isNotNull()).select(
        "vehicle_id", "bus_frac", F.col("hint_seq").alias("feed_seq"), *spread
    )


# --- boards --------------------------------------------------------------------------------


def _board_rows(t: Tables, fv: Column, lo: Column, hi: Column, route_id: str | None) -> DataFrame:
    rows = (
        t["prediction_current"]
        .withColumn("at", told())
        .filter(F.col("at").between(lo, hi))
        .join(trip_names(t, fv).drop("shape_id"), "trip_id")
    )
    if route_id is not None:
        rows = rows.filter(F.col("route_id") == route_id)
    fields = {"next_stop_id": F.col("stop_id"), "next_time": told(), "next_seen": F.col("last_seen_at")}
    return with_schedule(with_next(rows, t["prediction_current"], fields), t)


def coming_up(t: Tables, as_of: datetime, cfg: Config = DEFAULT, route_id: str | None = None) -> DataFrame:
    """Buses due within the window and not yet confirmed as left, with how late that bus usually is
    there at this hour."""
    minutes = cfg.board_all_min if route_id is None else cfg.board_route_min
    fv = version_in_force(t, as_of, cfg)
    now = lit_ts(as_of)
    rows = _board_rows(t, fv, ago(as_of, minutes=2), ahead(as_of, minutes=minutes), route_id)
    rows = rows.filter(F.col("last_seen_at") > ago(as_of, seconds=cfg.fresh_s)).filter(
        ~((F.col("at") < now) & has_left(F.col("at"), cfg))
    )
    flags = of_version(t["stop_times"], fv).select(
        "trip_id", "stop_sequence", timepoint_flag(F.col("timepoint"), F.col("arrival_seconds")).alias("is_timepoint")
    )
    usual = t["mart_stop_route_hourly"].select(
        F.col("stop_id").alias("u_stop"),
        F.col("route_id").alias("u_route"),
        F.col("direction_id").alias("u_dir"),
        F.col("weekday_type").alias("u_kind"),
        F.col("hour_local").alias("u_hour"),
        "n_events",
        "median_delay_s",
    )
    return (
        rows.join(flags, ["trip_id", "stop_sequence"], "left")
        .join(stop_names(t, fv), "stop_id", "left")
        .join(
            usual,
            (F.col("u_stop") == F.col("stop_id"))
            & (F.col("u_route") == F.col("route_id"))
            & F.col("u_dir").eqNullSafe(F.col("direction_id"))
            & (F.col("u_hour") == local_hour(F.col("at"), cfg.timezone))
            & (F.col("u_kind") == weekday_type(F.col("start_date"))),
            "left",
        )
        .select(
            "trip_id",
            "stop_sequence",
            "stop_id",
            "stop_name",
            "route_id",
            "route",
            "direction_id",
            "headsign",
            F.coalesce("is_timepoint", F.lit(False)).alias("is_timepoint"),
            F.col("at").alias("predicted"),
            "scheduled",
            round_int(seconds_between(F.col("at"), F.col("scheduled"))).alias("delay_s"),
            "n_events",
            "median_delay_s",
        )
        .orderBy("trip_id", "stop_sequence")
    )


def just_left(t: Tables, as_of: datetime, cfg: Config = DEFAULT, route_id: str | None = None) -> DataFrame:
    """Buses that left a stop within the window, and the stop each is heading for; newest first."""
    minutes = cfg.board_all_min if route_id is None else cfg.board_route_min
    fv = version_in_force(t, as_of, cfg)
    names = stop_names(t, fv)
    rows = _board_rows(t, fv, ago(as_of, minutes=minutes), lit_ts(as_of), route_id)
    return (
        rows.filter(has_left(F.col("at"), cfg))
        .join(names, "stop_id", "left")
        .withColumn("next_stop_id", F.col("nx.next_stop_id"))
        .join(
            names.select(F.col("stop_id").alias("next_stop_id"), F.col("stop_name").alias("next_stop")),
            "next_stop_id",
            "left",
        )
        .select(
            "trip_id",
            "stop_sequence",
            "stop_id",
            "stop_name",
            "route",
            "headsign",
            F.col("at").alias("departed"),
            "scheduled",
            round_int(seconds_between(F.col("at"), F.col("scheduled"))).alias("delay_s"),
            "next_stop_id",
            "next_stop",
            F.col("nx.next_time").alias("next_time"),
        )
        .orderBy(F.col("departed").desc(), "trip_id", "stop_sequence")
    )


PASSING = 99


def minute_blocks(
    t: Tables, as_of: datetime, cfg: Config = DEFAULT, route_id: str | None = None
) -> DataFrame:
    """Buses by minute block around now: -3..-1 left, 0..2 due, 99 passing (due but not confirmed)."""
    window = 60 * (cfg.board_all_min if route_id is None else cfg.board_route_min)
    now = lit_ts(as_of)
    due = coming_up(t, as_of, cfg, route_id).select("route", F.col("predicted").alias("at"), F.lit("coming").alias("kind"))
    gone = just_left(t, as_of, cfg, route_id).select("route", F.col("departed").alias("at"), F.lit("left").alias("kind"))
    sec = seconds_between(F.col("at"), now)
    minutes = sec / 60
    block = (
        F.when((F.col("kind") == "coming") & (sec < 0), F.lit(PASSING))
        .when(F.col("kind") == "left", -F.least(F.lit(3), F.greatest(F.lit(1), F.ceil(-minutes).cast("int"))))
        .otherwise(F.least(F.lit(3), F.floor(minutes).cast("int")))
    )
    return (
        due.unionByName(gone)
        .withColumn("block", block)
        .filter((F.col("block").between(-3, 2) | (F.col("block") == PASSING)) & (sec >= -window))
        .groupBy("route", "block")
        .agg(F.count(F.lit(1)).alias("buses"))
    )


def stop_buses(
    t: Tables, as_of: datetime, stop_id: str, per_route: int = 3, cfg: Config = DEFAULT
) -> DataFrame:
    """The next buses of each route and direction at a stop (live, else from the timetable up to 36
    hours ahead) and those that left it in the last minutes."""
    fv = version_in_force(t, as_of, cfg)
    now = lit_ts(as_of)
    at_stop = t["prediction_current"].withColumn("t", told()).filter(
        (F.col("stop_id") == stop_id) & F.col("t").isNotNull()
    )
    pred = with_schedule(
        with_next(at_stop, t["prediction_current"], {"next_seen": F.col("last_seen_at")}), t
    ).filter(~F.col("is_last_stop"))
    left = (F.col("t") < now) & has_left(F.col("t"), cfg)
    source = F.when(left & (F.col("t") >= ago(as_of, seconds=cfg.just_left_s)), "left").when(
        ~left
        & (F.col("last_seen_at") > ago(as_of, seconds=cfg.fresh_s))
        & (F.col("t") >= ago(as_of, minutes=2)),
        "live",
    )
    cols = [*KEY, "t", "scheduled", "source"]
    live = pred.withColumn("source", source).filter(F.col("source").isNotNull()).select(*cols)
    table = (
        t["scheduled_stop_events"]
        .filter((F.col("stop_id") == stop_id) & ~F.col("is_last_stop"))
        .filter(F.col("scheduled_arrival").between(now, ahead(as_of, hours=36)))
        .withColumnRenamed("service_date", "start_date")
        .join(t["prediction_current"].select(*KEY), KEY, "left_anti")
        .select(*KEY, F.col("scheduled_arrival").alias("t"), F.col("scheduled_arrival").alias("scheduled"), F.lit("timetable").alias("source"))
    )
    flags = of_version(t["stop_times"], fv).select(
        "trip_id", "stop_sequence", timepoint_flag(F.col("timepoint"), F.col("arrival_seconds")).alias("is_timepoint")
    )
    gone = F.col("source") == "left"
    when = F.unix_micros("t") * F.when(gone, F.lit(-1)).otherwise(F.lit(1))
    rank = F.row_number().over(
        Window.partitionBy("route_id", "direction_id", gone).orderBy(when, "trip_id", "stop_sequence")
    )
    return (
        live.unionByName(table)
        .join(trip_names(t, fv).drop("shape_id"), "trip_id")
        .withColumn("n", rank)
        .filter(F.col("n") <= per_route)
        .join(flags, ["trip_id", "stop_sequence"], "left")
        .select(
            "trip_id", "start_date", "stop_sequence", "route_id", "direction_id", "route", "headsign",
            "t", "scheduled", "source",
            F.coalesce("is_timepoint", F.lit(False)).alias("is_timepoint"),
            F.when(F.col("source") != "timetable", round_int(seconds_between(F.col("t"), F.col("scheduled")))).alias("delay_s"),
            "n",
        )
    )


# --- predictions as they changed -----------------------------------------------------------


def prediction_values(t: Tables) -> DataFrame:
    cols = [*KEY, told().alias("predicted"), "first_seen_at", "last_seen_at"]
    return t["prediction_current"].select(*cols).unionByName(t["prediction_history"].select(*cols)).filter(
        F.col("predicted").isNotNull()
    )


def coming_history(t: Tables, as_of: datetime, stop_id: str, cfg: Config = DEFAULT) -> DataFrame:
    """Every value held for the buses due at a stop within 45 minutes, as lateness over time."""
    fv = version_in_force(t, as_of, cfg)
    due = (
        t["prediction_current"]
        .filter(F.col("stop_id") == stop_id)
        .filter(told().between(ago(as_of, minutes=2), ahead(as_of, minutes=45)))
        .filter(F.col("last_seen_at") > ago(as_of, seconds=cfg.fresh_s))
        .select(*KEY)
    )
    values = prediction_values(t).join(due, KEY, "left_semi").withColumn("scheduled_time", F.lit(None).cast("timestamp"))
    return with_schedule(values, t).join(trip_names(t, fv), "trip_id").select(
        "trip_id",
        "route",
        "headsign",
        "first_seen_at",
        "last_seen_at",
        "predicted",
        "scheduled",
        seconds_between(F.col("predicted"), F.col("scheduled")).alias("late_s"),
    )


def route_now_history(
    t: Tables, as_of: datetime, route_id: str, direction: int | None = None, cfg: Config = DEFAULT
) -> DataFrame:
    """Every value held for the end of each trip running on a route now."""
    fv = version_in_force(t, as_of, cfg)
    names = trip_names(t, fv).filter(F.col("route_id") == route_id)
    if direction is not None:
        names = names.filter(F.col("direction_id") == direction)
    se = t["scheduled_stop_events"].withColumnRenamed("service_date", "start_date")
    last = se.filter("is_last_stop").select(*KEY, F.col("scheduled_arrival").alias("scheduled"))
    first = se.filter("is_first_stop").select("trip_id", "start_date", F.col("scheduled_arrival").alias("starts"))
    running = (
        t["prediction_current"]
        .filter(F.col("last_seen_at") > ago(as_of, seconds=cfg.fresh_s))
        .filter(told() > ago(as_of, minutes=2))
        .select(*KEY, "stop_id")
        .join(names, "trip_id")
        .join(last, KEY)
        .join(first, ["trip_id", "start_date"])
        .filter(F.col("starts") <= ahead(as_of, minutes=5))
        .join(stop_names(t, fv).withColumnRenamed("stop_name", "last_stop"), "stop_id")
    )
    return prediction_values(t).join(running, KEY).select(
        "trip_id", "route", "headsign", "last_stop", "first_seen_at", "last_seen_at", "predicted", "scheduled", "starts",
        seconds_between(F.col("predicted"), F.col("scheduled")).alias("late_s"),
    )


def honest_countdown(
    rows: DataFrame, t: Tables, as_of: datetime, minutes: str = "minutes", cfg: Config = DEFAULT
) -> DataFrame:
    """Adds likely_min, lo_min and hi_min to rows with a countdown (and route_id, is_timepoint): the
    prediction corrected by how wrong such predictions have been, from the finest level with enough
    of them. The error ranges are an aggregate of routes x 4 x 2 x 7 rows; Spark sizes the joins."""
    from zoneinfo import ZoneInfo

    hour = as_utc(as_of).astimezone(ZoneInfo(cfg.timezone)).hour
    ranges = t["mart_prediction_error_ranges"].filter(F.col("n_predictions") >= cfg.honest_min_n)
    packed = F.struct("p10_error_s", "p50_error_s", "p90_error_s")

    def level(where: Column, keys: list[str], name: str) -> DataFrame:
        return ranges.filter(where).select(
            *[F.col(k).alias(f"__{name}_{k}") for k in keys], packed.alias(name)
        )

    tp = F.coalesce("is_timepoint", F.lit(False))
    out = rows.withColumn("__band", horizon_band(F.col(minutes))).withColumn("__tp", tp)
    part = day_part(F.lit(hour))
    base = ["is_timepoint", "horizon_band"]
    levels = (
        ("fine", F.col("day_part") == part, ["route_id", *base]),
        ("route_wide", F.col("day_part").isNull() & F.col("route_id").isNotNull(), ["route_id", *base]),
        ("network", F.col("day_part").isNull() & F.col("route_id").isNull(), base),
    )
    for name, where, keys in levels:
        on = (F.col(f"__{name}_is_timepoint") == F.col("__tp")) & (F.col(f"__{name}_horizon_band") == F.col("__band"))
        if "route_id" in keys:
            on = on & (F.col(f"__{name}_route_id") == F.col("route_id"))
        out = out.join(level(where, keys, name), on, "left").drop(*[f"__{name}_{k}" for k in keys])
    hit = F.coalesce("fine", "route_wide", "network")
    m = F.col(minutes).cast("double")

    def shifted(q: str) -> Column:
        # rounding halves to even, as the countdown was always shown
        return F.greatest(F.lit(0), F.rint(m + hit[q] / 60).cast("int"))

    said = F.col(minutes).isNotNull() & hit.isNotNull()
    return (
        out.withColumn("likely_min", F.when(said, F.rint(F.greatest(F.lit(0.0), m + hit["p50_error_s"] / 60)).cast("int")))
        .withColumn("lo_min", F.when(said, shifted("p10_error_s")))
        .withColumn("hi_min", F.when(said, shifted("p90_error_s")))
        .drop("fine", "route_wide", "network", "__band", "__tp")
    )


# --- feed state ----------------------------------------------------------------------------


def _latest_fetches(t: Tables, as_of: datetime, feeds: tuple[str, ...], days: int = 2) -> DataFrame:
    return (
        t["fetch"]
        .filter(F.col("feed").isin(*feeds) & (F.col("fetched_at") > ago(as_of, days=days)) & (F.col("fetched_at") <= lit_ts(as_of)))
        .groupBy("feed")
        .agg(F.max_by(F.struct("fetched_at", "entity_count"), F.struct("fetched_at", "fetch_id")).alias("m"))
        .select("feed", "m.*")
    )


def feed_state(t: Tables, as_of: datetime, cfg: Config = DEFAULT) -> DataFrame:
    """stopped: nothing received for 10 minutes; empty: answering with nothing while buses are
    scheduled; fine."""
    latest = _latest_fetches(t, as_of, ("vehicle_positions", "trip_updates")).agg(
        F.max("fetched_at").alias("last_at"), F.coalesce(F.sum("entity_count"), F.lit(0)).alias("entities_in_latest")
    )
    nonempty = (
        t["fetch"]
        .filter((F.col("feed") == "vehicle_positions") & (F.col("entity_count") > 0))
        .filter((F.col("fetched_at") > ago(as_of, days=2)) & (F.col("fetched_at") <= lit_ts(as_of)))
        .agg(F.max("fetched_at"))
        .scalar()
    )
    due = (
        t["scheduled_stop_events"]
        .filter(F.col("scheduled_arrival").between(ago(as_of, minutes=10), ahead(as_of, minutes=10)))
        .agg(F.count(F.lit(1)))
        .scalar()
    )
    since = seconds_between(lit_ts(as_of), F.col("last_at"))
    return (
        latest.withColumn("s_since_message", since)
        .withColumn("last_nonempty_at", nonempty)
        .withColumn("scheduled_stop_events_now", due)
        .withColumn(
            "state",
            F.when(F.col("s_since_message").isNull() | (F.col("s_since_message") > cfg.feed_stopped_s), "stopped")
            .when((F.col("entities_in_latest") == 0) & (F.col("scheduled_stop_events_now") > 0), "empty")
            .otherwise("fine"),
        )
        .drop("last_at")
    )


# --- alerts --------------------------------------------------------------------------------


def current_alerts(t: Tables, as_of: datetime, cfg: Config = DEFAULT) -> DataFrame:
    """Alerts in the newest message, newest first, without those whose every period has ended."""
    from punctual.schemas import ALERT_DDL

    now = as_utc(as_of).timestamp()
    newest = t["fetch"].filter(F.col("feed") == "alerts").agg(F.max("fetch_id")).scalar()
    seen = (
        t["alert"]
        .join(t["fetch"].select("fetch_id", "fetched_at"), "fetch_id")
        .groupBy("alert_id")
        .agg(F.min("fetched_at").alias("first_seen"))
    )
    said = F.from_json("payload", ALERT_DDL)
    periods = F.coalesce(F.col("a.active_period"), F.array())
    starts = F.filter(F.transform(periods, lambda p: F.nullif(p["start"], F.lit(0))), lambda s: s.isNotNull())
    over = (F.size(periods) > 0) & F.forall(
        periods, lambda p: F.coalesce((p["end"] != 0) & (p["end"] < F.lit(now)), F.lit(False))
    )
    text = lambda field: F.coalesce(
        F.get(F.filter(F.transform(F.col(f"a.{field}.translation"), lambda x: x["text"]), lambda x: x != ""), F.lit(0)),
        F.lit(""),
    )
    when = lambda epoch: F.date_format(to_local(F.timestamp_seconds(epoch), cfg.timezone), "MMM dd")
    spans = F.array_join(
        F.transform(
            periods,
            lambda p: F.concat(
                F.coalesce(when(p["start"]), F.lit("?")), F.lit(" to "), F.coalesce(when(p["end"]), F.lit("no end"))
            ),
        ),
        "; ",
    )
    return (
        t["alert"]
        .filter(F.col("fetch_id") == newest)
        .join(seen, "alert_id")
        .select("alert_id", "first_seen", said.alias("a"))
        .filter(~over)
        .select(
            "alert_id",
            "first_seen",
            F.coalesce(F.timestamp_seconds(F.array_min(starts)), F.col("first_seen")).alias("began"),
            F.coalesce(F.nullif(text("header_text"), F.lit("")), F.lit("Alert")).alias("header"),
            text("description_text").alias("description"),
            spans.alias("periods"),
        )
        .orderBy(F.col("began").desc(), "alert_id")
    )


# --- recent activity -----------------------------------------------------------------------


def latest_messages(t: Tables) -> DataFrame:
    """The newest message of each feed."""
    return (
        t["fetch"]
        .groupBy("feed")
        .agg(
            F.max_by(
                F.struct("fetched_at", "header_timestamp", "entity_count", "byte_size"), "fetch_id"
            ).alias("m")
        )
        .select("feed", "m.*")
    )


def bus_movement(t: Tables, as_of: datetime) -> DataFrame:
    """Each bus that reported in the last 15 minutes: how far it moved since its report before."""
    recent = t["vehicle_position"].filter(
        (F.col("position_timestamp") > ago(as_of, minutes=15)) & (F.col("position_timestamp") <= lit_ts(as_of))
    )
    bus = Window.partitionBy("vehicle_id").orderBy("position_timestamp", "fetch_id")
    before = F.lag(F.struct("longitude", "latitude", "position_timestamp")).over(bus)
    stepped = recent.withColumn("b", before)
    moved = F.round(distance_m(F.col("b.longitude"), F.col("b.latitude"), F.col("longitude"), F.col("latitude")))
    return (
        stepped.select(
            "vehicle_id",
            "trip_id",
            "position_timestamp",
            "fetch_id",
            moved.alias("moved_m"),
            seconds_between(F.col("position_timestamp"), F.col("b.position_timestamp")).alias("since_prev_s"),
        )
        .groupBy("vehicle_id")
        .agg(
            F.max_by(
                F.struct("trip_id", "position_timestamp", "moved_m", "since_prev_s"),
                F.struct("position_timestamp", "fetch_id"),
            ).alias("m")
        )
        .select("vehicle_id", "m.*")
    )


def recent_revisions(t: Tables, as_of: datetime, cfg: Config = DEFAULT) -> DataFrame:
    """The latest revision of each trip's stop revised in the last 5 minutes; the 25 newest."""
    fv = version_in_force(t, as_of, cfg)
    recent = t["prediction_history"].filter(
        (F.col("closed_at") > ago(as_of, minutes=5)) & (F.col("closed_at") <= lit_ts(as_of))
    )
    last = (
        recent.groupBy(*KEY)
        .agg(F.max_by(F.struct("stop_id", "closed_at", told().alias("old_time")), "last_seen_at").alias("r"))
        .select(*KEY, "r.*")
    )
    now = t["prediction_current"].select(*KEY, told().alias("new_time"))
    return (
        last.join(now, KEY)
        .join(trip_names(t, fv), "trip_id", "left")
        .join(stop_names(t, fv), "stop_id", "left")
        .select(
            *KEY, "closed_at", "route", "headsign", "stop_name", "old_time", "new_time",
            seconds_between(F.col("new_time"), F.col("old_time")).alias("shift_s"),
        )
        .orderBy(F.col("closed_at").desc(), *KEY)
        .limit(25)
    )


def recently_settled(t: Tables, as_of: datetime, cfg: Config = DEFAULT) -> DataFrame:
    """Departures the feed settled in the last 30 minutes; the 40 newest."""
    fv = version_in_force(t, as_of, cfg)
    rows = (
        t["prediction_current"]
        .withColumn("settled_time", told())
        .filter(F.col("settled_time").between(ago(as_of, minutes=30), lit_ts(as_of)))
        .filter(F.col("last_seen_at") >= plus_seconds(F.col("settled_time"), cfg.left_rule_s))
        .join(trip_names(t, fv), "trip_id")
    )
    return (
        with_schedule(rows, t)
        .join(stop_names(t, fv), "stop_id", "left")
        .select(
            *KEY, "route", "stop_name", "settled_time", "scheduled",
            seconds_between(F.col("last_seen_at"), F.col("settled_time")).alias("held_after_s"),
        )
        .orderBy(F.col("settled_time").desc(), *KEY)
        .limit(40)
    )


def just_measured(t: Tables, as_of: datetime, route_id: str, cfg: Config = DEFAULT) -> DataFrame:
    """Arrivals of the last 45 minutes on a route; the 60 newest."""
    fv = version_in_force(t, as_of, cfg)
    return (
        t["observed_arrivals"]
        .filter((F.col("route_id") == route_id) & F.col("is_bounded") & F.col("is_plausible"))
        .filter(
            (F.col("observed_arrival") > ago(as_of, minutes=45)) & (F.col("observed_arrival") <= lit_ts(as_of))
        )
        .join(stop_names(t, fv), "stop_id", "left")
        .select(
            "trip_id", "stop_sequence", "stop_name", "vehicle_id", "observed_arrival", "uncertainty_s", "scheduled_arrival",
            round_int(seconds_between(F.col("observed_arrival"), F.col("scheduled_arrival"))).alias("delay_s"),
        )
        .orderBy(F.col("observed_arrival").desc(), "trip_id", "stop_sequence")
        .limit(60)
    )


# --- feed health ---------------------------------------------------------------------------


def fetch_health(t: Tables, as_of: datetime) -> DataFrame:
    """Messages stored per feed in the last hour, day and ever."""
    at = F.col("fetched_at")
    return (
        t["fetch"]
        .filter(at <= lit_ts(as_of))
        .groupBy("feed")
        .agg(
            F.max(at).alias("last_fetch"),
            F.count_if(at > ago(as_of, hours=1)).alias("fetches_last_hour"),
            F.count_if(at > ago(as_of, hours=24)).alias("fetches_last_day"),
            F.count(F.lit(1)).alias("fetches_total"),
        )
    )


def five_minute_buckets(t: Tables, as_of: datetime, hours: int = 6) -> DataFrame:
    w = F.window("fetched_at", "5 minutes")
    return (
        t["fetch"]
        .filter((F.col("fetched_at") > ago(as_of, hours=hours)) & (F.col("fetched_at") <= lit_ts(as_of)))
        .groupBy(w.alias("w"), "feed")
        .agg(F.count(F.lit(1)).alias("fetches"))
        .select(F.col("w.start").alias("bucket"), "feed", "fetches")
    )


def discarded(t: Tables, as_of: datetime, hours: int = 24) -> DataFrame:
    return (
        t["fetch_unchanged"]
        .filter((F.col("hour") > ago(as_of, hours=hours)) & (F.col("hour") <= lit_ts(as_of)))
        .groupBy("feed")
        .agg(F.sum("unchanged_count").alias("discarded"))
    )


def growth(t: Tables, as_of: datetime) -> DataFrame:
    """Rows in all and rows of the last hour, per realtime table."""
    hour, now = ago(as_of, hours=1), lit_ts(as_of)
    recent = t["fetch"].filter((F.col("fetched_at") > hour) & (F.col("fetched_at") <= now)).select(
        "fetch_id", F.lit(True).alias("is_recent")
    )
    out = None
    for name, column in (
        ("vehicle_position", "position_timestamp"),
        ("prediction_current", "last_seen_at"),
        ("prediction_history", "closed_at"),
        ("trip_update", None),
    ):
        df = t[name]
        if column is None:
            df = df.join(recent, "fetch_id", "left")
            fresh = F.coalesce(F.col("is_recent"), F.lit(False))
        else:
            fresh = (F.col(column) > hour) & (F.col(column) <= now)
        one = df.agg(F.count(F.lit(1)).alias("total"), F.count_if(fresh).alias("last_hour")).select(
            F.lit(name).alias("tbl"), "total", "last_hour"
        )
        out = one if out is None else out.unionByName(one)
    return out


def field_fill(t: Tables, as_of: datetime) -> DataFrame:
    """Which fields the feed fills, over the last 24 hours."""
    at = F.col("position_timestamp")
    return t["vehicle_position"].filter((at > ago(as_of, hours=24)) & (at <= lit_ts(as_of))).agg(
        F.count(F.lit(1)).alias("positions"),
        F.count("current_stop_sequence").alias("with_stop_sequence"),
        F.count("stop_id").alias("with_stop_id"),
        F.count("bearing").alias("with_bearing"),
        F.count("speed_mps").alias("with_speed"),
        F.count("occupancy_status").alias("with_occupancy"),
        F.count_if(F.col("trip_id").isNull()).alias("without_trip"),
        F.count_distinct("vehicle_id").alias("vehicles"),
    )


def prediction_fill(t: Tables, as_of: datetime) -> DataFrame:
    at = F.col("last_seen_at")
    return t["prediction_current"].filter((at > ago(as_of, hours=24)) & (at <= lit_ts(as_of))).agg(
        F.count(F.lit(1)).alias("n"),
        F.count("arrival_time").alias("with_arrival"),
        F.count("departure_time").alias("with_departure"),
        F.count_if(F.coalesce("arrival_delay", "departure_delay").isNotNull()).alias("with_delay"),
        F.count("scheduled_time").alias("with_scheduled"),
        F.count_if(F.col("schedule_relationship") == 1).alias("skipped"),
    )


def buses_now(t: Tables, as_of: datetime, minutes: int = 5) -> DataFrame:
    at = F.col("position_timestamp")
    return t["vehicle_position"].filter((at > ago(as_of, minutes=minutes)) & (at <= lit_ts(as_of))).agg(
        F.count_distinct("vehicle_id").alias("n")
    )
