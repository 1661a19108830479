"""Transit-shaped tables derived from the benchmark's own tables (lineitem, orders, part, events).

Each is one SQL text that Spark and the checking engine both run, so a query and its check start
from the same rows. Times are whole or half seconds since 1970; the Spark side turns the columns
listed in ``TIMES`` into timestamps. All of them grow with the tables they come from.

    line                 lineitem with a stop number inside its order (rows repeat, so by all columns)
    scheduled_stop_events, observed_arrivals, stop_events, positions_along_shape, ...
                         one row per line: an order is a trip, a line is a stop
    prediction_*         five successive predictions per stop event
    fetch, vehicle_position, snapshot, page_view, access log
                         from events and lines
    routes, stops, trips, calendar*, stop_times, shapes, feed_version
                         from part and orders, in five schedule versions
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BASE = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
)
AS_OF = datetime(2024, 1, 28, 20, 0, tzinfo=timezone.utc)
LIVE = datetime(2024, 1, 15, 20, 0, tzinfo=timezone.utc)
DAY0 = 1704067200  # 2024-01-01 00:00 UTC
OFFSET = 28800  # local midnight is 08:00 UTC all through the fixture's dates

SQL: dict[str, str] = {}
TIMES: dict[str, tuple[str, ...]] = {}


def _add(name: str, sql: str, times: str = "") -> None:
    SQL[name] = sql.strip()
    TIMES[name] = tuple(times.split())


_add(
    "line",
    f"""
select l_orderkey as ok,
       l_orderkey % 28 as day,
       {DAY0} + {OFFSET} + (l_orderkey % 28) * 86400 + 18000 + (l_orderkey * 37) % 57600 as starts,
       cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey,
            l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) as bigint) as seq,
       cast(count(*) over (partition by l_orderkey) as bigint) as n_stops,
       cast(round(l_extendedprice * 100) as bigint) as cents,
       cast(l_quantity as bigint) as qty,
       cast(l_linenumber as bigint) as ln,
       l_returnflag as rf,
       cast(round(l_discount * 100) as bigint) as disc
from lineitem
""",
)

# The same rows for Spark. What is worked out from a line stays above the window, and filters on the order do too (the
# window goes by a copy of its key): every table made from lines asks for the same shuffle, which a query does once.
_NUMBERED = re.compile(r"cast\(((?:row_number|count)\(.*?\)) as bigint\) as (seq|n_stops)", re.S)
SPARK_SQL = {
    "line": _NUMBERED.sub(r"cast(\2 as bigint) as \2", SQL["line"]).replace(
        "from lineitem",
        "from (select *, {} from (select *, l_orderkey as of_order from lineitem) l) n".format(
            ", ".join(f"{m[1]} as {m[2]}" for m in _NUMBERED.finditer(SQL["line"])).replace("by l_orderkey", "by of_order")
        ),
    )
}

# --- schedule ------------------------------------------------------------------------------

_add(
    "feed_version",
    f"""
select cast(v as int) as feed_version_id, concat('hash', v) as sha256, concat('url', v) as source_url,
       {DAY0} - 864000 + v * 86400 as downloaded_at, cast(null as date) as feed_start_date,
       date '2024-02-10' as feed_end_date, concat('label', v) as feed_version, n as byte_size
from (select 1 + cast(floor((o_orderkey % 28) / 6) as bigint) as v, count(*) as n from orders group by 1) x
""",
    "downloaded_at",
)
_add(
    "routes",
    """
select cast(v as int) as feed_version_id, concat('R', r) as route_id, '' as agency_id,
       case when r = 18 then 'Loop' else concat('', r + 1) end as route_short_name, name as route_long_name,
       3 as route_type, cast(null as string) as route_color
from (select EXPLODE(1, 2, 3, 4, 5) as v, r, name
      from (select p_partkey % 20 as r, min(p_name) as name from part group by 1) a) b
""",
)
_add(
    "stops",
    """
select cast(v as int) as feed_version_id, concat('S', n) as stop_id, concat('00', n + 100) as stop_code,
       case when n % 5 = 0 then concat('W/S of OAK S of Avenue ', n)
            when n % 5 = 1 then concat('N/S of W 11TH at ', name)
            when n % 5 = 2 then concat('Approaching ', name, ' STA')
            when n % 5 = 3 then concat('SPFLD STA, BAY ', n)
            else concat(name, ' MKTPL') end as stop_name,
       4.4e1 + floor(n / 20) * 1.0e-2 as stop_lat, -1.231e2 + (n % 20) * 4.0e-3 as stop_lon,
       case when n % 20 = 19 then 1 else 0 end as location_type, cast(null as string) as parent_station
from (select EXPLODE(1, 2, 3, 4, 5) as v, n, name
      from (select p_partkey % 200 as n, min(p_name) as name from part group by 1) a) b
""",
)
_add(
    "trips",
    """
select cast(1 + floor((o_orderkey % 28) / 6) as int) as feed_version_id, concat('T', o_orderkey) as trip_id,
       concat('R', o_orderkey % 20) as route_id, concat('C', o_orderkey % 14) as service_id,
       case when o_orderkey % 7 = 0 then null
            else concat(o_orderkey % 20 + 1, ' THURSTON <> STA TO', case when o_orderkey % 3 = 0 then ' VIA 5TH' else ' CTR' end) end
            as trip_headsign,
       cast(case when o_orderkey % 20 = 19 then null when o_orderkey % 40 >= 20 then 1 else 0 end as int) as direction_id,
       concat('B', o_orderkey % 50) as block_id, concat('P', o_orderkey % 10) as shape_id
from orders
""",
)
_add(
    "calendar",
    """
select cast(v as int) as feed_version_id, concat('C', k) as service_id,
       k % 7 < 2 as monday, (k + 1) % 7 < 2 as tuesday, (k + 2) % 7 < 2 as wednesday, (k + 3) % 7 < 2 as thursday,
       (k + 4) % 7 < 2 as friday, (k + 5) % 7 < 2 as saturday, (k + 6) % 7 < 2 as sunday,
       date '2024-01-01' + cast((v - 1) * 6 as int) as start_date, date '2024-02-10' as end_date
from (select distinct 1 + cast(floor((o_orderkey % 28) / 6) as bigint) as v, o_orderkey % 14 as k from orders) x
""",
)
_add(
    "calendar_dates",
    """
select cast(v as int) as feed_version_id, concat('C', k) as service_id,
       date '2024-01-01' + cast((v - 1) * 6 + d as int) as date,
       case when (v * 3 + k * 5 + d * 7) % 11 = 0 then 1 else 2 end as exception_type
from (select distinct 1 + cast(floor((o_orderkey % 28) / 6) as bigint) as v, o_custkey % 14 as k, o_custkey % 31 as d from orders) x
where (v * 3 + k * 5 + d * 7) % 11 in (0, 1)
""",
)
_add(
    "stop_times",
    """
select cast(1 + floor(day / 6) as int) as feed_version_id, concat('T', ok) as trip_id,
       cast(seq as int) as stop_sequence, concat('S', (ok % 10) * 20 + (seq + ok % 3) % 12) as stop_id,
       cast(case when ln % 3 = 1 and cents % 7 <> 0 then 18000 + (ok * 37) % 57600 + seq * 180 + cents % 60 end as int)
            as arrival_seconds,
       cast(case when ln % 3 = 1 then 18000 + (ok * 37) % 57600 + seq * 180 + cents % 60 + ok % 2 end as int)
            as departure_seconds,
       cast(case when disc = 3 then null when ln % 3 = 1 then 1 else 0 end as int) as timepoint,
       cast(case when qty % 10 = 0 then 1 when qty % 10 = 1 then 0 end as int) as pickup_type,
       cast(null as int) as drop_off_type,
       case when ok % 4 <> 0 then seq * 3.5e2 + cents % 100 end as shape_dist_traveled
from FX(line)
""",
)
_add(
    "shapes",
    """
select cast(v as int) as feed_version_id, concat('P', g) as shape_id, cast(i as int) as shape_pt_sequence,
       4.4e1 + g * 1.0e-2 as shape_pt_lat, -1.231e2 + i * 4.0e-3 as shape_pt_lon,
       cast(null as double) as shape_dist_traveled
from (select EXPLODE(1, 2, 3, 4, 5) as v, g, i
      from (select distinct p_partkey % 10 as g, cast(floor((p_partkey % 120) / 10) as bigint) as i from part) a) b
""",
)

# --- events along trips --------------------------------------------------------------------

# a trip's start is worked out in ``line``, below its window, so that what is built on it stays short
_SCHED = "(starts + seq * 180)"
_add(
    "scheduled_stop_events",
    f"""
select date '2024-01-01' + cast(day as int) as service_date,
       cast(1 + floor(day / 6) as int) as feed_version_id,
       concat('T', ok) as trip_id, concat('R', ok % 20) as route_id,
       cast(case when ok % 20 = 19 then null when ok % 40 >= 20 then 1 else 0 end as int) as direction_id,
       cast(seq as int) as stop_sequence, concat('S', (ok % 10) * 20 + (seq + ok % 3) % 12) as stop_id,
       ln % 3 = 1 as is_timepoint, ln % 3 = 1 as has_scheduled_time, {_SCHED} as scheduled_arrival,
       seq = 1 as is_first_stop, seq = n_stops as is_last_stop
from FX(line)
""",
    "scheduled_arrival",
)
# lateness as the bus ran it; a few stops sit 400 s off, a few trips are not plausible at all
_LATE = (
    "cents % 901 - 200 + (cents % 2) * 5.0e-1"
    " + case when ok % 10 = 3 and (seq + ok % 3) % 12 = 4 then 400 else 0 end"
    " + case when cents % 97 = 0 then 7200 else 0 end"
)
_add(
    "observed_arrivals",
    f"""
select service_date, trip_id, stop_sequence, stop_id, route_id, direction_id, scheduled_arrival,
       is_timepoint, is_first_stop, is_last_stop, vehicle_id, scheduled_arrival + late as observed_arrival,
       uncertainty_s, is_bounded, late between -1800 and 5400 as is_plausible
from (select date '2024-01-01' + cast(day as int) as service_date, concat('T', ok) as trip_id,
             cast(seq as int) as stop_sequence, concat('S', (ok % 10) * 20 + (seq + ok % 3) % 12) as stop_id,
             concat('R', ok % 20) as route_id,
             cast(case when ok % 20 = 19 then null when ok % 40 >= 20 then 1 else 0 end as int) as direction_id,
             {_SCHED} as scheduled_arrival, ln % 3 = 1 as is_timepoint, seq = 1 as is_first_stop,
             seq = n_stops as is_last_stop, concat('V', ok % 70) as vehicle_id, {_LATE} as late,
             case when cents % 17 <> 1 then qty * 3.0e0 end as uncertainty_s, cents % 17 <> 1 as is_bounded
      from FX(line) where cents % 13 <> 0) x
""",
    "scheduled_arrival observed_arrival",
)
_add(
    "vehicle_position",
    f"""
select ok * 10 + seq as fetch_id, concat('V', ok % 70) as vehicle_id,
       {_SCHED} - 40 + cents % 30 as position_timestamp,
       case when cents % 41 = 0 then null else concat('T', ok) end as trip_id, concat('R', ok % 20) as route_id,
       date '2024-01-01' + cast(day as int) as start_date,
       4.4e1 + (ok % 10) * 1.0e-2 + (cents % 7) * 1.0e-4 + case when cents % 23 = 0 then 1.0e-2 else 0 end as latitude,
       -1.231e2 + (seq + ok % 3) * 4.0e-3 + 1.0e-3 as longitude,
       cast(case when cents % 5 <> 0 then cents % 360 end as float) as bearing, cast(null as float) as speed_mps,
       cast(null as string) as stop_id, cast(null as int) as current_stop_sequence,
       cast(null as int) as current_status,
       cast(case when qty % 2 = 0 then qty % 4 end as int) as occupancy_status, cast(null as int) as occupancy_percentage
from FX(line) where ok % 9 <> 0
""",
    "position_timestamp",
)
_PRED = f"""
select ok, day, seq, cents, disc, k, {_SCHED} as sched,
       {_SCHED} - (k + 1) * 200 - cents % 60 as first_seen,
       {_SCHED} + cents % 901 - 260 + 30 * k as told
from (select ok, day, starts, seq, cents, disc, EXPLODE(0, 1, 2, 3, 4) as k from FX(line)) p
"""
_PRED_COLS = """concat('T', ok) as trip_id, date '2024-01-01' + cast(day as int) as start_date,
       cast(seq as int) as stop_sequence, concat('S', (ok % 10) * 20 + (seq + ok % 3) % 12) as stop_id,
       case when seq % 3 = 0 then told end as arrival_time, case when seq % 3 <> 0 then told end as departure_time,
       cast(null as int) as arrival_delay, cast(case when cents % 29 = 0 then 45 end as int) as departure_delay,
       cast(case when disc = 10 then 1 when disc = 0 then null else 0 end as int) as schedule_relationship,
       sched as scheduled_time, first_seen as first_seen_at"""
_add("prediction_value", _PRED)
_add(
    "prediction_current",
    f"""
select {_PRED_COLS}, told + cents % 90 - 30 as last_seen_at, ok * 100 + seq as first_fetch_id
from FX(prediction_value) where k = 0
""",
    "arrival_time departure_time scheduled_time first_seen_at last_seen_at",
)
_add(
    "prediction_history",
    f"""
select {_PRED_COLS}, first_seen + 170 as last_seen_at, ok * 100 + seq as first_fetch_id, first_seen + 200 as closed_at
from FX(prediction_value) where k > 0
""",
    "arrival_time departure_time scheduled_time first_seen_at last_seen_at closed_at",
)
_add(
    "trip_update",
    f"""
select o_orderkey as fetch_id, concat('T', o_orderkey) as trip_id,
       date '2024-01-01' + cast(o_orderkey % 28 as int) as start_date, concat('R', o_orderkey % 20) as route_id,
       concat('V', o_orderkey % 70) as vehicle_id, cast(case when o_custkey % 37 = 0 then 3 else 0 end as int)
            as schedule_relationship,
       {DAY0} + (o_orderkey % 28) * 86400 + 43200 as trip_timestamp, cast(o_custkey % 600 as int) as trip_delay_seconds
from orders
""",
    "trip_timestamp",
)
_add(
    "fetch",
    """
select event_id + 1 as fetch_id,
       case event_id % 3 when 0 then 'trip_updates' when 1 then 'vehicle_positions' else 'alerts' end as feed,
       us / 1.0e6 as fetched_at, floor(us / 6.0e7) * 60 as header_timestamp,
       cast(case when event_id % 50 < 3 then 0 else floor(value) end as int) as entity_count,
       cast(floor(value * 100) as int) as byte_size, event_type as sha256, concat('raw/', event_id) as archive_path
from (select event_id, value, event_type, EPOCH_US(ts) as us from events) x
""",
    "fetched_at header_timestamp",
)
_add(
    "fetch_unchanged",
    """
select feed, floor(fetched_at / 3600) * 3600 as hour, count(*) as unchanged_count
from FX(fetch) where fetch_id % 5 = 0 group by 1, 2
""",
    "hour",
)
_add(
    "snapshot",
    """
select concat('U', user_id) as trip_id, date '2024-01-01' + cast(floor(us / 8.64e10) - 19723 as int) as start_date,
       cast(event_id % 5 as int) as stop_sequence, event_id as fetch_id, event_id as ingest_seq,
       floor(us / 1.0e6) as header_timestamp,
       cast(case when event_id % 11 = 0 then null else floor(value / 40) end as int) as told,
       concat('S', event_id % 5) as stop_id, floor(us / 1.0e6) + 600 as scheduled_time
from (select event_id, user_id, value, EPOCH_US(ts) as us from events) x
""",
    "header_timestamp scheduled_time",
)
_add(
    "page_view",
    """
select us / 1.0e6 as viewed_at, concat(user_id, '-', cast(floor(us / 8.64e10) as bigint)) as session_id,
       case event_id % 6 when 0 then 'overview' when 1 then 'stops' when 2 then 'route' when 3 then 'map'
            when 4 then 'stops' else 'accuracy' end as page,
       case when event_id % 6 = 1 then concat('S', event_id % 200) when event_id % 6 = 2 then concat('R', event_id % 25) end as detail,
       case event_id % 7 when 0 then 'bot' when 1 then 'phone' when 2 then 'phone' else 'computer' end as device,
       cast(case when event_id % 13 <> 0 then floor(value * 10) end as int) as load_ms,
       case when event_id % 17 <> 0 then concat('v', user_id) end as visitor
from (select event_id, user_id, value, EPOCH_US(ts) as us from events) x
""",
    "viewed_at",
)
_add(
    "positions_along_shape",
    f"""
select concat('T', ok) as trip_id, date '2024-01-01' + cast(day as int) as service_date,
       concat('V', ok % 2) as vehicle_id, {_SCHED} + cents % 120 as ts,
       (seq + (cents % 12) / 1.0e1) / (n_stops + 1.0e0) as frac, (cents % 130) * 1.0e0 as off_route_m
from FX(line)
""",
    "ts",
)
_add(
    "stop_shape_fractions",
    """
select cast(1 + floor(day / 6) as int) as feed_version_id, concat('T', ok) as trip_id,
       cast(seq as int) as stop_sequence, concat('S', (ok % 10) * 20 + (seq + ok % 3) % 12) as stop_id,
       concat('P', ok % 10) as shape_id, seq / (n_stops + 1.0e0) as frac, (qty % 70) * 1.0e0 as dist_to_shape_m,
       qty % 70 < 48 as is_usable
from FX(line)
""",
)
# the fact table as scored, straight from the lines (M3 computes the same shape from its parts)
_add(
    "stop_events",
    f"""
select service_date, trip_id, stop_sequence, stop_id, route_id, route_short_name, direction_id, is_timepoint,
       is_first_stop, is_last_stop, scheduled_arrival,
       cast(floor((scheduled_arrival - {OFFSET}) / 3600) as bigint) % 24 as hour_local,
       case when dow = 5 then 'saturday' when dow = 6 then 'sunday' else 'weekday' end as weekday_type,
       trip_had_realtime, vehicle_id, observed_arrival, uncertainty_s, is_bounded, is_plausible,
       uncertainty_s is not null and uncertainty_s <= 120 as is_precise, is_doubtful, feed_settled_time,
       scheduled_arrival as feed_scheduled_time, was_skipped,
       case when is_bounded then feed_settled_time - observed_arrival end as methods_diff_s,
       case when ok_gps then observed_arrival end as scored_time,
       case when settled_wins then 'ltd_departure' when observed_arrival is not null then 'gps' end as time_source,
       case when is_bounded and not is_doubtful then late end as delay_s,
       case when ok_gps then case when late < -60 then 'early' when late > 300 then 'late' else 'on_time' end end as status
from (select y.*, is_bounded and is_plausible and not is_doubtful and uncertainty_s <= 120 as ok_gps,
             (is_timepoint or is_first_stop) and feed_settled_time is not null and feed_settled_time > observed_arrival
                 as settled_wins
      from (select date '2024-01-01' + cast(day as int) as service_date, day % 7 as dow,
                   concat('T', ok) as trip_id, cast(seq as int) as stop_sequence,
                   concat('S', (ok % 10) * 20 + (seq + ok % 3) % 12) as stop_id, concat('R', ok % 20) as route_id,
                   case when ok % 20 = 18 then 'Loop' else concat('', ok % 20 + 1) end as route_short_name,
                   cast(case when ok % 20 = 19 then null when ok % 40 >= 20 then 1 else 0 end as int) as direction_id,
                   ln % 3 = 1 as is_timepoint, seq = 1 as is_first_stop, seq = n_stops as is_last_stop,
                   {_SCHED} as scheduled_arrival, ok % 9 <> 0 as trip_had_realtime,
                   case when cents % 13 <> 0 then concat('V', ok % 70) end as vehicle_id,
                   case when cents % 13 <> 0 then {_SCHED} + cents % 901 - 200 end as observed_arrival,
                   case when cents % 13 <> 0 then cents % 901 - 200 end as late,
                   case when cents % 13 <> 0 and cents % 17 <> 1 then qty * 3.0e0 end as uncertainty_s,
                   cents % 13 <> 0 and cents % 17 <> 1 as is_bounded, cents % 13 <> 0 and cents % 97 <> 0 as is_plausible,
                   ok % 10 = 3 and (seq + ok % 3) % 12 = 4 as is_doubtful,
                   case when rf <> 'R' then {_SCHED} + cents % 701 - 100 end as feed_settled_time, disc = 10 as was_skipped
            from FX(line)) y) z
""",
    "scheduled_arrival observed_arrival feed_settled_time feed_scheduled_time scored_time",
)
_add(
    "build_log",
    """
select concat('b', b) as invocation_id, b * 900 as started_at, b * 900 + n % 600 + 30 as finished_at,
       cast(n % 3 as int) as n_errors, cast(0 as int) as n_warnings, 1000000 + b * 1000 + n as db_bytes,
       b % 40 = 0 as full_refresh
from (select cast(floor(us / 9.0e8) as bigint) as b, count(*) as n
      from (select EPOCH_US(ts) as us from events) e group by 1) x
""",
    "started_at finished_at",
)
_add(
    "build_step_log",
    """
select concat('b', cast(floor(us / 9.0e8) as bigint)) as invocation_id, us / 1.0e6 as logged_at,
       concat('step_', event_type) as node, case when event_id % 4 = 0 then 'test' else 'model' end as kind,
       value as seconds, 'success' as status
from (select event_id, event_type, value, EPOCH_US(ts) as us from events) x
""",
    "logged_at",
)


# --- rendering -----------------------------------------------------------------------------

_CALL = re.compile(r"\b(FX|EXPLODE|EPOCH_US)\(([^()]*)\)")


def references(sql: str) -> list[str]:
    return list(dict.fromkeys(m[2] for m in _CALL.finditer(sql) if m[1] == "FX"))


def render(sql: str, dialect: str) -> str:
    def call(m: re.Match) -> str:
        kind, arg = m[1], m[2]
        if kind == "FX":
            return f"fx_{arg}"
        if kind == "EXPLODE":
            return f"explode(array({arg}))" if dialect == "spark" else f"unnest([{arg}])"
        return f"unix_micros(cast({arg} as timestamp))" if dialect == "spark" else f"epoch_us({arg})"

    text = _CALL.sub(call, sql)
    return text if dialect == "spark" else text.replace("as string)", "as varchar)")


def closure(names: list[str]) -> list[str]:
    """The fixtures a text needs, each after the ones it is made from."""
    out: list[str] = []

    def visit(name: str) -> None:
        if name in out:
            return
        for needed in references(SQL[name]):
            visit(needed)
        out.append(name)

    for name in names:
        visit(name)
    return out


def with_clause(names: list[str], dialect: str) -> list[str]:
    texts = SQL | SPARK_SQL if dialect == "spark" else SQL
    return [f"fx_{n} as (\n{render(texts[n], dialect)}\n)" for n in closure(names)]


class Fixtures(Mapping[str, DataFrame]):
    """The fixture tables of one data folder as lazy DataFrames; ``derived`` adds tables that
    operators compute from them, each built once, when first asked for."""

    def __init__(self, spark: SparkSession, folder: str, derived=None):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._derived = dict(derived or {})
        self._ready: dict[str, DataFrame] = {}
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._ready:
            if name in self._derived:
                self._ready[name] = self._derived[name](self)
            elif name in SQL:
                self._ready[name] = self._fixture(name)
            elif name in BASE:
                self._ready[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
            else:
                raise KeyError(name)
        return self._ready[name]

    def __iter__(self) -> Iterator[str]:
        return iter([*SQL, *self._derived, *BASE])

    def __len__(self) -> int:
        return len(SQL) + len(self._derived) + len(BASE)

    def _fixture(self, name: str) -> DataFrame:
        body = ",\n".join(with_clause([name], "spark"))
        tables = {b: self[b] for b in BASE if re.search(rf"\bfrom {b}\b", body)}
        text = f"with {body} select * from fx_{name}"
        for b in tables:
            text = re.sub(rf"\bfrom {b}\b", f"from {{{b}}}", text)
        df = self.spark.sql(text, **tables)
        kinds = dict(df.dtypes)

        def moment(c: str):
            if kinds[c] in ("int", "bigint"):
                return F.timestamp_seconds(F.col(c))
            return F.timestamp_micros(F.round(F.col(c).cast("double") * 1e6).cast("long"))

        moments = {c: moment(c) for c in TIMES[name]}
        return df.withColumns(moments) if moments else df


# --- raw inputs that are not tables: messages, log lines, downloads ---------------------------


def _event_second(t: Mapping[str, DataFrame]) -> DataFrame:
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return t["events"].select("*", us.alias("us"), F.floor(us / 1_000_000).alias("sec"))


def messages(t: Mapping[str, DataFrame]) -> DataFrame:
    """One decoded realtime message per event, with a vehicle, a trip update and sometimes an alert,
    each missing a field here and there."""
    from punctual.schemas import MESSAGE_DDL

    ddl = "struct<" + MESSAGE_DDL.replace("header struct", "header:struct", 1).replace(
        ",entity array", ",entity:array", 1
    ) + ">"
    vehicle = """named_struct('id', concat('e', event_id), 'vehicle', named_struct(
        'vehicle', named_struct('id', if(event_id % 3 = 2, concat('bus', user_id), ''), 'label', if(event_id % 3 = 1, concat('label', user_id), '')),
        'trip', named_struct('trip_id', if(event_id % 6 <> 0, concat('T', user_id), ''), 'start_date', '20240110'),
        'position', if(event_id % 10 <> 0, named_struct('latitude', 44.0D + value / 100, 'longitude', -123.0D, 'bearing', if(event_id % 2 = 0, event_id % 360, null)), null),
        'timestamp', if(event_id % 4 = 0, 0, sec - 5)))"""
    stop = """transform(array(0, 1, 2), i -> named_struct(
        'stop_sequence', if(i = 2 and event_id % 4 = 0, null, i + 1), 'stop_id', concat('S', (event_id + i) % 200),
        'arrival', if(i <> 1, named_struct('time', sec + 60 * (i + 1), 'delay', if(event_id % 2 = 0, 15, null), 'scheduled_time', sec + 100), null),
        'departure', if(i <> 0, named_struct('time', sec + 60 * (i + 1) + 20, 'scheduled_time', sec + 200), null)))"""
    update = f"""named_struct('id', concat('u', event_id), 'trip_update', named_struct(
        'trip', named_struct('trip_id', concat('T', user_id), 'route_id', concat('R', user_id % 20),
                             'start_date', if(event_id % 5 = 0, '', '20240110'), 'schedule_relationship', 0),
        'vehicle', named_struct('id', if(event_id % 3 = 2, concat('bus', user_id), ''), 'label', if(event_id % 3 = 1, concat('label', user_id), '')),
        'timestamp', sec, 'stop_time_update', {stop}))"""
    alert = """named_struct('id', concat('a', event_id % 40), 'alert', named_struct(
        'header_text', named_struct('translation', array(named_struct('text', concat('Detour ', event_type))))))"""
    entity = "concat_ws(',', to_json({0}), to_json({1}), if(event_id % 20 = 0, to_json({2}), null))".format(vehicle, update, alert)
    text = f"concat('{{\"header\":{{\"timestamp\":', sec, '}},\"entity\":[', {entity}, ']}}')"
    return _event_second(t).select(
        (F.col("event_id") + 1).alias("fetch_id"),
        F.timestamp_seconds("sec").alias("header_timestamp"),
        F.from_json(F.expr(text), ddl).alias("message"),
    )


def archive_lines(t: Mapping[str, DataFrame]) -> DataFrame:
    """The same messages as archived text: a third of them in each feed, one per feed and second, a few cut
    short and a few without entities."""
    feed = F.expr("element_at(array('trip_updates', 'vehicle_positions', 'alerts'), cast(fetch_id % 3 as int) + 1)")
    text = F.to_json("message")
    cut = F.when(F.col("fetch_id") % 97 == 0, F.expr("left(text, length(text) - 10)")).when(
        F.col("fetch_id") % 101 == 0, F.concat(F.lit('{"header":{"timestamp":'), F.unix_seconds("header_timestamp"), F.lit("}}"))
    )
    rows = messages(t).select(feed.alias("feed"), "header_timestamp", "fetch_id", text.alias("text"))
    first = rows.groupBy("feed", "header_timestamp").agg(F.min_by(F.struct("fetch_id", "text"), "fetch_id").alias("m"))
    return first.select("feed", "header_timestamp", "m.*").withColumn("text", F.coalesce(cut, "text"))


def alert_table(t: Mapping[str, DataFrame]) -> DataFrame:
    """Stored alerts: three per alerts message, with periods that have or have not ended."""
    end = "if(j = 0, 1706400000, if(j = 1, 1709000000, null))"
    payload = f"""to_json(named_struct('active_period', if(j = 2 and event_id % 2 = 0, null,
        array(named_struct('start', 1704000000 + event_id % 100 * 3600, 'end', {end}))),
        'header_text', named_struct('translation', array(named_struct('text', concat('Detour ', j)))),
        'description_text', named_struct('translation', array(named_struct('text', event_type)))))"""
    return (
        t["events"]
        .filter("event_id % 3 = 2")
        .withColumn("j", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
        .select(
            (F.col("event_id") + 1).alias("fetch_id"),
            F.expr("concat('a', event_id % 4 * 3 + j)").alias("alert_id"),
            F.expr(payload).alias("payload"),
        )
    )


def log_lines(t: Mapping[str, DataFrame]) -> DataFrame:
    """A web server's log: pages, parts of pages, bots, errors and lines that are not JSON."""
    path = """case event_id % 5 when 0 then '/' when 1 then concat('/reports/route/', user_id % 20, '/')
        when 2 then '/stops?stop=1' when 3 then '/static/main.js' else '/route' end"""
    agent = "if(event_id % 13 = 0, 'Googlebot/2.1', 'Mozilla/5.0')"
    referer = "case event_id % 7 when 0 then array('https://www.reddit.com/r/x') when 1 then array('https://x.com/route') end"
    line = f"""to_json(named_struct('ts', us / 1e6D, 'status', if(event_id % 23 = 0, 500, if(event_id % 2 = 0, 200, 304)),
        'request', named_struct('uri', {path}, 'method', if(event_id % 11 = 0, 'POST', 'GET'), 'host', 'www.x.com',
        'headers', named_struct('User-Agent', array({agent}), 'Referer', {referer}))))"""
    return _event_second(t).select(F.expr(f"if(event_type = 'error', concat('not json ', event_id), {line})").alias("value"))


def page_hits(t: Mapping[str, DataFrame]) -> DataFrame:
    agent = """case when event_id % 9 = 0 then 'Googlebot/2.1' when event_id % 9 < 4 then 'Mozilla/5.0 (Android) Mobi'
        else 'Mozilla/5.0' end"""
    return _event_second(t).select(
        F.timestamp_micros("us").alias("viewed_at"),
        F.expr("concat('s', user_id)").alias("session_id"),
        F.col("event_type").alias("page"),
        F.lit(None).cast("string").alias("detail"),
        F.lit(None).cast("int").alias("load_ms"),
        F.expr("concat('10.0.0.', user_id % 250)").alias("ip"),
        F.expr(agent).alias("agent"),
    )


def salts(t: Mapping[str, DataFrame]) -> DataFrame:
    day = F.to_date(F.timestamp_seconds(F.col("sec") - OFFSET))
    return (
        _event_second(t).select(day.alias("day")).distinct()
        .withColumn("salt", F.concat(F.lit("salt-"), F.col("day").cast("string")))
    )


def raw_stop_times(t: Mapping[str, DataFrame]) -> DataFrame:
    """stop_times.txt as read: all text, a byte-order mark on the first column, stray spaces, blanks."""
    secs = "(18000 + (ok * 37) % 86400 + seq * 180)"
    clock = f"concat(' ', cast({secs} div 3600 as string), ':', lpad(cast({secs} div 60 % 60 as string), 2, '0'), ':', lpad(cast({secs} % 60 as string), 2, '0'))"
    return t["line"].select(
        F.expr("concat('T', ok, ' ')").alias("﻿trip_id"),
        F.expr(f"if(ln % 3 = 1, {clock}, '')").alias("arrival_time"),
        F.expr("concat('S', ok % 200)").alias(" stop_id"),
        F.expr("cast(seq as string)").alias("stop_sequence"),
        F.expr("if(ln % 2 = 0, '1', '')").alias("timepoint"),
        F.expr("if(ok % 2 = 0, cast(qty * 1.5D as string), ' ')").alias("shape_dist_traveled"),
    )
