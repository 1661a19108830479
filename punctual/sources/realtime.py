"""Realtime messages: the archive, its scan, and the flattening of vehicles, trip updates and alerts."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from punctual import schemas
from punctual.config import DEFAULT, Config
from punctual.functions.timeutil import lit_ts, service_day
from punctual.plans.files import Files

FEEDS = ("trip_updates", "vehicle_positions", "alerts")


def _said(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def _moment(epoch: Column) -> Column:
    """0 means "not given" in these messages."""
    return F.timestamp_seconds(F.nullif(epoch, F.lit(0)))


HOUR = "yyyy-MM-dd-HH"
_NOT_JSON, _NO_ENTITIES, _NO_TIME = "not a message", "no entities", "no header time"


def write_archive(lines: DataFrame, root: str, period: str = HOUR) -> None:
    """``lines(feed, header_timestamp, text)``, a message each, into ``<root>/<feed>/hour=<period>/``: compressed text files
    of many messages. Rows of one period share a file unless they are many."""
    for feed in FEEDS:
        (
            lines.filter(F.col("feed") == feed)
            .select(F.date_format("header_timestamp", period).alias("hour"), "text")
            .hint("rebalance", "hour")
            .write.mode("append")
            .partitionBy("hour")
            .option("compression", "gzip")
            .text(f"{root.rstrip('/')}/{feed}")
        )


def scan_archive(
    spark: SparkSession, root: str, feed: str, streaming: bool = False, since: datetime | None = None, files_per_trigger: int | None = None
) -> DataFrame:
    """Every line of one feed's archive, told apart into messages and what is none (``problem``).

    Two layouts are read: ``.../<header epoch>.json[.gz]``, where the name is the header time, and files of many messages
    below ``hour=<period>``, where the message says its own time and the period stands in for it. ``since`` leaves out
    whole periods before it unread. As a stream, files come oldest first, so many at a time."""
    place = f"{root.rstrip('/')}/{feed}"
    places = [place]
    if since is not None and not streaming:
        first = since.strftime("hour=%Y-%m-%d-%H")
        kept = [n for n in Files(spark, place).names(place) if not n.startswith("hour=") or n >= first[: len(n)]]
        places = [f"{place}/{n}" for n in kept]
    if not places:
        text = spark.createDataFrame([], "value string")
    elif streaming:
        reader = spark.readStream.format("text").schema("value string").option("recursiveFileLookup", "true")
        text = (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).load(place)
    else:
        text = spark.read.format("text").schema("value string").option("recursiveFileLookup", "true").load(places)
    path = F.input_file_name()
    named = F.regexp_extract(path, r"/(\d+)\.[^/]*$", 1)
    hour = F.regexp_extract(path, r"/hour=([\d-]+)/", 1)
    period = F.coalesce(F.try_to_timestamp(hour, F.lit(HOUR)), F.try_to_timestamp(hour, F.lit("yyyy-MM-dd")))
    lines = text.select(
        F.lit(feed).alias("feed"),
        F.when(named != "", F.timestamp_seconds(named.cast("long"))).alias("__named"),
        period.alias("__period"),
        F.regexp_extract(path, rf"({feed}/.*)$", 1).alias("archive_path"),
        F.octet_length("value").alias("byte_size"),
        F.sha2("value", 256).alias("sha256"),
        F.from_json("value", f"{schemas.MESSAGE_DDL},_unread string", {"columnNameOfCorruptRecord": "_unread"}).alias("m"),
    ).filter("byte_size > 0")
    read = lines.withColumn("header_timestamp", F.coalesce("__named", _moment(F.col("m.header.timestamp")), "__period"))
    problem = (
        F.when(F.col("m._unread").isNotNull() | F.col("m").isNull(), _NOT_JSON)
        .when(F.col("m.entity").isNull(), _NO_ENTITIES)
        .when(F.col("header_timestamp").isNull(), _NO_TIME)
    )
    out = read.select(
        "feed", "header_timestamp", "archive_path", "byte_size", "sha256", F.col("m").dropFields("_unread").alias("message"),
        problem.alias("problem"), F.coalesce("__named", "__period").alias("filed_at"),
    )
    return out if since is None else out.filter(F.col("header_timestamp").isNull() | (F.col("header_timestamp") >= lit_ts(since)))


def archived_messages(scan: DataFrame) -> DataFrame:
    return scan.filter("problem is null").drop("problem", "filed_at")


def archive_rejects(scan: DataFrame) -> DataFrame:
    """What of an archive cannot be stored, and why: to be looked at, not lost."""
    return scan.filter("problem is not null").select("feed", "filed_at", "archive_path", "byte_size", "sha256", "problem")


def read_archive(spark: SparkSession, root: str, feed: str, streaming: bool = False, **how) -> DataFrame:
    """The messages of one feed's archive; ``scan_archive`` says what else is in it."""
    return archived_messages(scan_archive(spark, root, feed, streaming, **how))


def with_header(messages: DataFrame) -> DataFrame:
    """Header time of a message, falling back to when it was fetched."""
    return messages.withColumn(
        "header_timestamp", F.coalesce(_moment(F.col("message.header.timestamp")), F.col("fetched_at"))
    )


def _entities(messages: DataFrame) -> DataFrame:
    return messages.select(
        "fetch_id", "header_timestamp", F.posexplode("message.entity").alias("entity_no", "e")
    )


def vehicle_positions(messages: DataFrame) -> DataFrame:
    """One row per entity that is a vehicle with a position."""
    v = F.col("e.vehicle")
    return (
        _entities(messages)
        .filter(v.isNotNull() & v["position"].isNotNull())
        .select(
            "fetch_id",
            "entity_no",
            F.coalesce(_said(v["vehicle"]["id"]), _said(v["vehicle"]["label"]), F.col("e.id")).alias(
                "vehicle_id"
            ),
            F.coalesce(_moment(v["timestamp"]), F.col("header_timestamp")).alias("position_timestamp"),
            _said(v["trip"]["trip_id"]).alias("trip_id"),
            _said(v["trip"]["route_id"]).alias("route_id"),
            F.to_date(_said(v["trip"]["start_date"]), "yyyyMMdd").alias("start_date"),
            v["position"]["latitude"].alias("latitude"),
            v["position"]["longitude"].alias("longitude"),
            v["position"]["bearing"].alias("bearing"),
            v["position"]["speed"].alias("speed_mps"),
            _said(v["stop_id"]).alias("stop_id"),
            v["current_stop_sequence"].alias("current_stop_sequence"),
            v["current_status"].alias("current_status"),
            v["occupancy_status"].alias("occupancy_status"),
            v["occupancy_percentage"].alias("occupancy_percentage"),
        )
    )


def _trips(messages: DataFrame, cfg: Config) -> DataFrame:
    tu = F.col("e.trip_update")
    fallback = service_day(F.col("header_timestamp"), cfg.timezone, cfg.rollover_hours)
    return (
        _entities(messages)
        .filter(tu.isNotNull())
        .select(
            "fetch_id",
            "header_timestamp",
            "entity_no",
            F.coalesce(tu["trip"]["trip_id"], F.lit("")).alias("trip_id"),
            F.coalesce(F.to_date(_said(tu["trip"]["start_date"]), "yyyyMMdd"), fallback).alias("start_date"),
            tu.alias("tu"),
        )
    )


def trip_updates(messages: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """One row per trip update, trip-level fields only."""
    tu = F.col("tu")
    return _trips(messages, cfg).select(
        "fetch_id",
        "entity_no",
        "trip_id",
        "start_date",
        _said(tu["trip"]["route_id"]).alias("route_id"),
        F.coalesce(_said(tu["vehicle"]["id"]), _said(tu["vehicle"]["label"])).alias("vehicle_id"),
        tu["trip"]["schedule_relationship"].alias("schedule_relationship"),
        _moment(tu["timestamp"]).alias("trip_timestamp"),
        tu["delay"].alias("trip_delay_seconds"),
    )


def stop_time_updates(messages: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """One prediction per stop of a trip update; those without a stop number cannot be matched to
    the schedule and are dropped. The feed's own scheduled time comes from the departure where it
    has one, else from the arrival."""
    s = F.col("s")
    return (
        _trips(messages, cfg)
        .select(
            "fetch_id",
            "header_timestamp",
            "entity_no",
            "trip_id",
            "start_date",
            F.posexplode("tu.stop_time_update").alias("update_no", "s"),
        )
        .filter(s["stop_sequence"].isNotNull())
        .select(
            "fetch_id",
            "header_timestamp",
            "entity_no",
            "update_no",
            "trip_id",
            "start_date",
            s["stop_sequence"].alias("stop_sequence"),
            _said(s["stop_id"]).alias("stop_id"),
            _moment(s["arrival"]["time"]).alias("arrival_time"),
            _moment(s["departure"]["time"]).alias("departure_time"),
            s["arrival"]["delay"].alias("arrival_delay"),
            s["departure"]["delay"].alias("departure_delay"),
            s["schedule_relationship"].alias("schedule_relationship"),
            F.when(
                s["departure"]["scheduled_time"].isNotNull(), _moment(s["departure"]["scheduled_time"])
            )
            .otherwise(_moment(s["arrival"]["scheduled_time"]))
            .alias("scheduled_time"),
        )
    )


def alerts(messages: DataFrame) -> DataFrame:
    return (
        _entities(messages)
        .filter(F.col("e.alert").isNotNull())
        .select("fetch_id", F.col("e.id").alias("alert_id"), F.to_json("e.alert").alias("payload"))
        .dropDuplicates(["fetch_id", "alert_id"])
    )
