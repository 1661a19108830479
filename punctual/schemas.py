"""Declared schemas of every source table; nothing is inferred from files."""

from __future__ import annotations

from pyspark.sql import types as T

_TYPES = {
    "str": T.StringType(),
    "int": T.IntegerType(),
    "long": T.LongType(),
    "short": T.ShortType(),
    "double": T.DoubleType(),
    "float": T.FloatType(),
    "bool": T.BooleanType(),
    "date": T.DateType(),
    "ts": T.TimestampType(),
}


def table(text: str) -> T.StructType:
    """"name:type name:type ..." as a schema."""
    fields = (item.split(":") for item in text.split())
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in fields])


SCHEDULE = {
    "feed_version": table(
        "feed_version_id:int sha256:str source_url:str downloaded_at:ts feed_start_date:date "
        "feed_end_date:date feed_version:str byte_size:long"
    ),
    "agency": table("feed_version_id:int agency_id:str agency_name:str agency_url:str agency_timezone:str"),
    "routes": table(
        "feed_version_id:int route_id:str agency_id:str route_short_name:str route_long_name:str "
        "route_type:int route_color:str"
    ),
    "stops": table(
        "feed_version_id:int stop_id:str stop_code:str stop_name:str stop_lat:double stop_lon:double "
        "location_type:int parent_station:str"
    ),
    "calendar": table(
        "feed_version_id:int service_id:str monday:bool tuesday:bool wednesday:bool thursday:bool "
        "friday:bool saturday:bool sunday:bool start_date:date end_date:date"
    ),
    "calendar_dates": table("feed_version_id:int service_id:str date:date exception_type:int"),
    "trips": table(
        "feed_version_id:int trip_id:str route_id:str service_id:str trip_headsign:str "
        "direction_id:int block_id:str shape_id:str"
    ),
    "stop_times": table(
        "feed_version_id:int trip_id:str stop_sequence:int stop_id:str arrival_seconds:int "
        "departure_seconds:int timepoint:int pickup_type:int drop_off_type:int "
        "shape_dist_traveled:double"
    ),
    "shapes": table(
        "feed_version_id:int shape_id:str shape_pt_sequence:int shape_pt_lat:double "
        "shape_pt_lon:double shape_dist_traveled:double"
    ),
}

_PREDICTION = (
    "trip_id:str start_date:date stop_sequence:int stop_id:str arrival_time:ts departure_time:ts "
    "arrival_delay:int departure_delay:int schedule_relationship:int scheduled_time:ts "
    "first_seen_at:ts last_seen_at:ts first_fetch_id:long"
)
REALTIME = {
    "fetch": table(
        "fetch_id:long feed:str fetched_at:ts header_timestamp:ts entity_count:int byte_size:int "
        "sha256:str archive_path:str"
    ),
    "fetch_unchanged": table("feed:str hour:ts unchanged_count:long"),
    "vehicle_position": table(
        "fetch_id:long vehicle_id:str position_timestamp:ts trip_id:str route_id:str "
        "start_date:date latitude:double longitude:double bearing:float speed_mps:float stop_id:str "
        "current_stop_sequence:int current_status:int occupancy_status:int occupancy_percentage:int"
    ),
    "trip_update": table(
        "fetch_id:long trip_id:str start_date:date route_id:str vehicle_id:str "
        "schedule_relationship:int trip_timestamp:ts trip_delay_seconds:int"
    ),
    "prediction_current": table(_PREDICTION),
    "prediction_history": table(_PREDICTION + " closed_at:ts"),
    "alert": table("fetch_id:long alert_id:str payload:str"),
}
SITE = {
    "page_view": table(
        "viewed_at:ts session_id:str page:str detail:str device:str load_ms:int visitor:str"
    ),
    "visitor_salt": table("day:date salt:str"),
}
RUNS = {
    "build_log": table(
        "invocation_id:str started_at:ts finished_at:ts n_errors:int n_warnings:int db_bytes:long "
        "full_refresh:bool"
    ),
    "build_step_log": table("invocation_id:str logged_at:ts node:str kind:str seconds:double status:str"),
}
SOURCES = {**SCHEDULE, **REALTIME, **SITE, **RUNS}

# A realtime message as decoded JSON: header, and entities that each carry one of three payloads.
_TRANSLATED = "struct<translation:array<struct<text:string,language:string>>>"
_TRIP = (
    "struct<trip_id:string,route_id:string,start_date:string,schedule_relationship:int>"
)
_VEHICLE_ID = "struct<id:string,label:string>"
_STOP_TIME = "struct<time:bigint,delay:int,scheduled_time:bigint>"
ALERT_DDL = (
    "struct<active_period:array<struct<start:bigint,`end`:bigint>>,"
    f"header_text:{_TRANSLATED},description_text:{_TRANSLATED}>"
)
MESSAGE_DDL = (
    "header struct<timestamp:bigint>,"
    "entity array<struct<id:string,"
    f"vehicle:struct<vehicle:{_VEHICLE_ID},trip:{_TRIP},"
    "position:struct<latitude:double,longitude:double,bearing:float,speed:float>,"
    "timestamp:bigint,stop_id:string,current_stop_sequence:int,current_status:int,"
    "occupancy_status:int,occupancy_percentage:int>,"
    f"trip_update:struct<trip:{_TRIP},vehicle:{_VEHICLE_ID},timestamp:bigint,delay:int,"
    f"stop_time_update:array<struct<stop_sequence:int,stop_id:string,arrival:{_STOP_TIME},"
    f"departure:{_STOP_TIME},schedule_relationship:int>>>,"
    f"alert:{ALERT_DDL}>>"
)

# A web server's access log, one JSON object per line.
ACCESS_LOG_DDL = (
    "ts double, status int, request struct<uri:string,method:string,host:string,"
    "headers:struct<`User-Agent`:array<string>,Referer:array<string>>>"
)
