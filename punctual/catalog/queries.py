"""Every registered query: an operator applied to the fixture tables, with portable columns."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from punctual import schemas
from punctual.catalog.sqltext import portable
from punctual.config import DEFAULT as CFG
from punctual.functions import bands, histograms, lines, timeutil
from punctual.functions.geo import utm
from punctual.operators import (
    arrivals,
    changes,
    facts,
    geometry,
    history,
    ingest,
    live,
    marts,
    routes,
    schedule,
)
from punctual.plans import policy
from punctual.session import shared_folder, shuffles_freed
from punctual.sources import fixtures as fx
from punctual.sources import gtfs, realtime, weblog
from punctual.streaming import predictions as streaming
from punctual.streaming import replay
from punctual.streaming.keyed import run_batches
from punctual.streaming.silence import SilenceStore

AS_OF, LIVE = fx.AS_OF, fx.LIVE
START30 = date(2023, 12, 30)

# tables that operators make from the fixtures, by the name other operators know them under
DERIVED: dict[str, Callable] = {
    "feed_version_by_date": lambda t: schedule.feed_version_by_date(t, AS_OF),
    "active_services": lambda t: schedule.active_services(t),
    "stop_times_filled": lambda t: schedule.stop_times_filled(t),
    "feed_settled_times": lambda t: arrivals.feed_settled_times(t),
    "headways": lambda t: arrivals.headways(t),
    "doubtful_stops": lambda t: arrivals.doubtful_stops(t, AS_OF),
    "shape_lines": lambda t: geometry.shape_lines(t),
    "prediction_errors": lambda t: facts.prediction_errors(t),
    "countdown_samples": lambda t: facts.countdown_samples(t),
    "mart_route_daily": lambda t: marts.route_daily(t),
    "mart_stop_route_daily": lambda t: marts.stop_route_daily(t),
    "mart_stop_route_hourly": lambda t: marts.stop_route_hourly(t),
    "mart_trend_daily": lambda t: marts.trend_daily(t),
    "mart_lateness": lambda t: marts.lateness(t, AS_OF),
    "mart_method_agreement": lambda t: marts.method_agreement(t),
    "mart_calibration": lambda t: marts.calibration(t),
    "mart_prediction_error_ranges": lambda t: marts.prediction_error_ranges(t),
    "mart_prediction_daily": lambda t: marts.prediction_daily(t),
    "mart_prediction_stop_daily": lambda t: marts.prediction_stop_daily(t),
    "mart_daily_coverage": lambda t: marts.daily_coverage(t, AS_OF),
    "alert": fx.alert_table,
    "messages": fx.messages,
}


class Tables(fx.Fixtures):
    def __init__(self, spark: SparkSession, folder: str, derived: dict[str, Callable] = DERIVED):
        super().__init__(spark, folder, derived)


def stored(t: Tables, name: str, rows: DataFrame) -> Tables:
    """The tables with ``rows`` written and read back as the one named, for queries that make several from it: all are
    still made whole, from rows worked out once, whose shuffle files are gone before the next step."""
    folder = f"{shared_folder(t.spark)}/{name}-{uuid.uuid4().hex}"
    with shuffles_freed(t.spark):
        rows.write.parquet(folder)
    kept = t.spark.read.schema(rows.schema).parquet(folder)
    return Tables(t.spark, t.folder, {**DERIVED, name: lambda _: kept})


def samples_once(t: Tables) -> Tables:
    """The tables with the countdown samples in comparison written and read back, for queries that hold two tables made
    from them against each other."""
    return stored(t, "countdown_samples", t["countdown_samples"].filter("in_comparison"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str, make: Callable[[Tables], DataFrame]) -> None:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return portable(make(Tables(spark, folder)))

    run.__name__ = name
    QUERIES[name] = run


# --- ingest and storage --------------------------------------------------------------------

query("s1_typed_stop_times", lambda t: gtfs.typed("stop_times", fx.raw_stop_times(t), 7).select(
    "feed_version_id", "trip_id", "stop_sequence", "stop_id", "arrival_seconds", "timepoint", "shape_dist_traveled"))


def agencies(t: Tables) -> DataFrame:
    return t["feed_version"].select(
        "feed_version_id", F.lit("").alias("agency_id"), F.concat(F.lit("Agency "), "feed_version").alias("agency_name"),
        F.col("source_url").alias("agency_url"), F.lit("America/Los_Angeles").alias("agency_timezone"))


def as_file(df: DataFrame) -> DataFrame:
    """A schedule table as the text of its file: clock times, compact dates, 1 and 0."""
    out = []
    for name, kind in df.drop("feed_version_id").dtypes:
        c = F.col(name)
        if name.endswith("_seconds"):
            clock = F.format_string("%d:%02d:%02d", F.floor(c / 3600), F.floor(c / 60) % 60, c % 60)
            out.append(F.when(c.isNotNull(), clock).alias(name.replace("_seconds", "_time")))
        elif kind == "date":
            out.append(F.date_format(c, "yyyyMMdd").alias(name))
        elif kind == "boolean":
            out.append(c.cast("int").cast("string").alias(name))
        else:
            out.append(c.cast("string").alias(name))
    return df.select(*out)


def appended_versions(t: Tables) -> DataFrame:
    """All eight files of every schedule version, written as a download, read back and appended; the newest one
    twice, as after a failed load. Rows and content by table and version."""
    folder = f"{shared_folder(t.spark)}/gtfs-{uuid.uuid4().hex}"
    tables = {name: agencies(t) if name == "agency" else t[name] for name in gtfs.FILES if name != "feed_info"}
    versions = sorted(r[0] for r in t["feed_version"].select("feed_version_id").distinct().collect())  # a few a year
    for v in [*versions, versions[-1]]:
        place = f"{folder}/download-{v}"
        for name, df in tables.items():
            as_file(df.filter(F.col("feed_version_id") == v)).write.mode("overwrite").csv(f"{place}/{gtfs.FILES[name]}", header=True, escape='"')
        gtfs.append_version(gtfs.read_gtfs(t.spark, place, v), f"{folder}/stored")
    out = None
    for name in tables:
        schema = schemas.SCHEDULE[name]
        text = [F.round(F.col(f.name) * 10000).cast("long") if f.dataType.simpleString() == "double" else F.col(f.name) for f in schema]
        line = F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("~")) for c in text])
        code = F.conv(F.substring(F.md5(line), 1, 12), 16, 10).cast("decimal(38,0)")
        rows = t.spark.read.schema(schema).parquet(f"{folder}/stored/{name}")
        one = rows.groupBy("feed_version_id").agg(F.count(F.lit(1)).alias("n"), F.sum(code).cast("string").alias("content")).select(F.lit(name).alias("tbl"), "*")
        out = one if out is None else out.unionByName(one)
    return out


query("s5_versioned_append", appended_versions)
query("s2_schedule_seconds", lambda t: t["line"].select(
    gtfs.schedule_seconds(F.expr(
        "concat(cast((18000 + (ok * 37) % 86400 + seq * 180) div 3600 as string), ':', (18000 + (ok * 37) % 86400 + seq * 180) div 60 % 60, ':', (18000 + (ok * 37) % 86400 + seq * 180) % 60)"
    )).alias("secs")).groupBy("secs").agg(F.count(F.lit(1)).alias("n")))
query("s3_schedule_dates", lambda t: t["orders"].select(
    gtfs.schedule_date(F.expr("date_format(date_add(date '2024-01-01', cast(o_orderkey % 60 as int)), 'yyyyMMdd')")).alias("day")
).groupBy("day").agg(F.count(F.lit(1)).alias("n")))
query("s4_new_versions", lambda t: gtfs.new_versions(
    *(lambda c: (c, c.filter("k < 10")))(t["orders"].select(
        (F.col("o_orderkey") % 97).alias("k"), F.expr("sha2(concat('content ', o_orderkey % 97), 256)").alias("sha256"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("o_orderkey")).alias("downloaded_at"), F.lit("url").alias("source_url"), F.lit(1).alias("byte_size"))),
    first_id=6).select("feed_version_id", "sha256", "downloaded_at"))
query("s7_vehicle_positions", lambda t: realtime.vehicle_positions(t["messages"]).select(
    "fetch_id", "entity_no", "vehicle_id", "position_timestamp", "trip_id", "start_date", "latitude", "bearing"))
query("s8_trip_updates", lambda t: realtime.trip_updates(t["messages"]))
query("s9_stop_time_updates", lambda t: realtime.stop_time_updates(t["messages"]).select(
    "fetch_id", "update_no", "trip_id", "stop_sequence", "stop_id", "arrival_time", "departure_time", "arrival_delay", "scheduled_time"))
query("s10_alerts", lambda t: realtime.alerts(t["messages"]).select(
    "fetch_id", "alert_id", F.get_json_object("payload", "$.header_text.translation[0].text").alias("header")))


def polls(t: Tables) -> DataFrame:
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    feed = F.expr("case event_id % 3 when 0 then 'trip_updates' when 1 then 'vehicle_positions' else 'alerts' end")
    return t["events"].select(
        F.col("event_id").alias("poll_id"), feed.alias("feed"), F.timestamp_micros(us).alias("fetched_at"),
        F.timestamp_seconds(F.floor(us / 3_600_000_000) * 3600).alias("header_timestamp"))


query("s11_new_messages", lambda t: ingest.new_messages(polls(t)))
query("s12_unchanged_polls", lambda t: ingest.unchanged_polls(polls(t)))
query("s13_new_positions", lambda t: ingest.new_positions(t["events"].select(
    F.expr("concat('V', user_id % 20)").alias("vehicle_id"), F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("position_timestamp"),
    (F.col("event_id") + 1).alias("fetch_id"), F.lit(0).alias("entity_no"))))
query("s14_trip_updates_once", lambda t: ingest.new_trip_updates(t["events"].select(
    F.expr("(event_id + 1) div 4").alias("fetch_id"), F.expr("concat('T', user_id % 3)").alias("trip_id"),
    F.col("event_type").alias("route_id"), F.col("event_id").alias("entity_no"))))
query("s15_first_predictions", lambda t: ingest.first_predictions(t["events"].select(
    F.expr("(event_id + 1) div 8").alias("fetch_id"), F.expr("concat('T', user_id % 2)").alias("trip_id"),
    F.lit(date(2024, 1, 1)).alias("start_date"), (F.col("event_id") % 3).alias("stop_sequence"), F.col("event_type").alias("stop_id"),
    F.col("event_id").alias("entity_no"), F.lit(0).alias("update_no"))).drop("start_date"))
SNAPSHOT_VALUE = ["stop_id", "told"]
RUN_COLUMNS = ["trip_id", "start_date", "stop_sequence", "stop_id", "told", "scheduled_time", "first_seen_at", "last_seen_at", "first_fetch_id", "closed_at"]
query("s16_prediction_intervals", lambda t: changes.intervals(t["snapshot"], value=SNAPSHOT_VALUE).select(*RUN_COLUMNS))


def as_arrived(t: Tables) -> DataFrame:
    late = t["snapshot"].withColumn("header_timestamp", timeutil.plus_seconds(
        F.col("header_timestamp"), F.when(F.col("fetch_id") % 17 == 0, -7200).otherwise(0)))
    return changes.intervals(changes.in_header_order(late, "ingest_seq"), value=SNAPSHOT_VALUE).select(*RUN_COLUMNS)


query("s16_prediction_intervals_as_arrived", as_arrived)


def snapshots_of(events: DataFrame) -> DataFrame:
    second = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000)
    return events.select(
        F.expr("concat('U', user_id)").alias("trip_id"), F.to_date("ts").alias("start_date"),
        (F.col("event_id") % 5).cast("int").alias("stop_sequence"), F.col("event_id").alias("fetch_id"),
        F.timestamp_seconds(second).alias("header_timestamp"),
        F.expr("cast(if(event_id % 11 = 0, null, floor(value / 40)) as int)").alias("told"),
        F.expr("concat('S', event_id % 5)").alias("stop_id"), F.timestamp_seconds(second + 600).alias("scheduled_time"))


def streamed(t: Tables) -> DataFrame:
    """The streaming form over the same events: files in, closed intervals out, until none are left."""
    folder = f"{shared_folder(t.spark)}/stream-{uuid.uuid4().hex}"
    schema = t["events"].schema
    snapshots = snapshots_of(t.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(t.folder))
    closed = streaming.change_only(streaming.encode(snapshots, SNAPSHOT_VALUE))
    streaming.run_available(closed, f"{folder}/out", f"{folder}/checkpoint")
    rows = t.spark.read.schema(streaming.CLOSED).parquet(f"{folder}/out")
    return streaming.decode(rows, "stop_id string, told int").select(*RUN_COLUMNS)


query("s16_prediction_intervals_stream", streamed)
STORED_RUN = ("trip_id string, start_date date, stop_sequence int, stop_id string, told int, scheduled_time timestamp, "
              "first_seen_at timestamp, last_seen_at timestamp, first_fetch_id long, closed_at timestamp")


def stored_stream(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Current and history of the same events, arriving in four batches out of header order."""
    folder = f"{shared_folder(t.spark)}/stream-{uuid.uuid4().hex}"
    for k in range(4):
        t["events"].filter(F.col("event_id") % 4 == k).write.mode("append").parquet(f"{folder}/in")
        source = t.spark.readStream.schema(t["events"].schema).parquet(f"{folder}/in")
        store = streaming.store_intervals(snapshots_of(source), folder, f"{folder}/checkpoint", STORED_RUN, SNAPSHOT_VALUE, buckets=2)
    return store.current(), store.history()


query("s16_current_stored_stream", lambda t: stored_stream(t)[0].withColumn("closed_at", F.lit(None).cast("timestamp")).select(*RUN_COLUMNS))
query("s16_history_stored_stream", lambda t: stored_stream(t)[1].select(*RUN_COLUMNS))


def expiring_stream(t: Tables) -> streaming.IntervalStore:
    """The events arriving a week at a time, days that ended more than two days ago closing as the events go on."""
    folder = f"{shared_folder(t.spark)}/stream-{uuid.uuid4().hex}"
    week = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / (7 * 86400))
    weeks = t["events"].select(week.alias("w")).distinct()
    for (w,) in sorted(weeks.collect()):  # a row a week of the collection
        t["events"].filter(week == w).write.mode("append").parquet(f"{folder}/in")
        source = t.spark.readStream.schema(t["events"].schema).parquet(f"{folder}/in")
        store = streaming.store_intervals(
            snapshots_of(source), folder, f"{folder}/checkpoint", STORED_RUN, SNAPSHOT_VALUE,
            stale_days=CFG.stale_prediction_days, buckets=2)
    return store


query("s17_expired_stream_current", lambda t: expiring_stream(t).current().select(*[c for c in RUN_COLUMNS if c != "closed_at"]))
query("s17_expired_stream_history", lambda t: expiring_stream(t).history().select(*RUN_COLUMNS))
query("s17_current_after_close_out", lambda t: ingest.close_out(t["prediction_current"], t["prediction_history"], AS_OF)[0])
query("s17_history_after_close_out", lambda t: ingest.close_out(t["prediction_current"], t["prediction_history"], AS_OF)[1])


def watermarked(make: Callable[[DataFrame], DataFrame]) -> Callable[[Tables], DataFrame]:
    """A query under a watermark over the polls, which arrive in three parts, some of them minutes late; after each
    part the stream stops, and it goes on from its checkpoint."""

    def run(t: Tables) -> DataFrame:
        folder = f"{shared_folder(t.spark)}/stream-{uuid.uuid4().hex}"
        rows = polls(t)
        part = F.floor((F.unix_seconds("fetched_at") + F.when(F.col("poll_id") % 3 == 0, 300).otherwise(0)) / (10 * 86400))
        for (p,) in sorted(rows.select(part.alias("p")).distinct().collect()):  # a row for ten days of the collection
            rows.filter(part == p).write.mode("append").parquet(f"{folder}/in")
            told = make(t.spark.readStream.schema(rows.schema).parquet(f"{folder}/in"))
            streaming.run_available(told, f"{folder}/out", f"{folder}/checkpoint")
        return t.spark.read.schema(told.schema).parquet(f"{folder}/out")

    return run


query("s11_new_messages_stream", watermarked(streaming.first_messages))
query("s12_counts_stream", watermarked(streaming.counts))
SILENT_S = 1200


def silence_stream(t: Tables) -> DataFrame:
    """Polls arriving in three parts, one feed stopping before the others, half of each part an hour late."""
    folder = f"{shared_folder(t.spark)}/stream-{uuid.uuid4().hex}"
    kept = polls(t).filter("feed <> 'alerts' or fetched_at < timestamp '2024-01-29'").select("feed", F.col("fetched_at").alias("at"), "poll_id")
    part = F.floor((F.unix_seconds("at") - F.when(F.col("poll_id") % 2 == 0, 3600).otherwise(0)) / (10 * 86400))
    store = SilenceStore(t.spark, folder, SILENT_S, late=3600)
    for (p,) in sorted(kept.select(part.alias("p")).distinct().collect()):  # a row for ten days of the collection
        kept.filter(part == p).select("feed", "at").write.mode("append").parquet(f"{folder}/in")
        source = t.spark.readStream.schema("feed string, at timestamp").parquet(f"{folder}/in")
        run_batches(source, store.apply, f"{folder}/checkpoint")
    store.finish()
    return store.closed().unionByName(store.silent_now()).withColumn("gap_s", F.floor("gap_s"))


query("d1_silences_stream", silence_stream)
DAY_FILES = "yyyy-MM-dd"


def archive_streamed(part: Callable[[DataFrame], DataFrame]) -> Callable[[Tables], DataFrame]:
    """An archive of the messages, read as a stream of some files at a time."""

    def run(t: Tables) -> DataFrame:
        folder = f"{shared_folder(t.spark)}/archive-{uuid.uuid4().hex}"
        realtime.write_archive(fx.archive_lines(t), f"{folder}/raw", DAY_FILES)
        rows = part(replay.scan_feeds(t.spark, f"{folder}/raw", streaming=True, files_per_trigger=8))
        streaming.run_available(rows, f"{folder}/out", f"{folder}/checkpoint")
        return t.spark.read.schema(rows.schema).parquet(f"{folder}/out")

    return run


query("s6_archive_scan", archive_streamed(lambda scan: realtime.archived_messages(scan).select(
    "feed", "header_timestamp", F.size("message.entity").alias("entities"), F.col("message.header.timestamp").alias("said"))))
query("s6_archive_rejects", archive_streamed(lambda scan: realtime.archive_rejects(scan).select("feed", "filed_at", "problem")))


def rebuilt_and_live(t: Tables) -> DataFrame:
    """The archive filling in three parts, messages up to two hours late and in no order, followed live; and the
    whole archive rebuilt in one batch. The tables must come out the same."""
    folder = f"{shared_folder(t.spark)}/replay-{uuid.uuid4().hex}"
    lines = fx.archive_lines(t)
    arrival = F.unix_seconds("header_timestamp") + F.col("fetch_id") * 7919 % 7200
    part = F.floor(arrival / (10 * 86400))
    store = replay.LiveStore(t.spark, folder, late=7200, buckets=4)
    for (p,) in sorted(lines.select(part.alias("p")).distinct().collect()):  # a row for ten days of the collection
        realtime.write_archive(lines.filter(part == p), f"{folder}/raw", DAY_FILES)
        replay.follow(replay.scan_feeds(t.spark, f"{folder}/raw", streaming=True), store, f"{folder}/checkpoint")
    store.finish()
    names = ("vehicle_position", "trip_update", "alert", "prediction_current", "prediction_history")
    live, again = store.tables(), replay.rebuild(realtime.archived_messages(replay.scan_feeds(t.spark, f"{folder}/raw")))
    return replay.fingerprints({n: live[n] for n in names}, "live").unionByName(replay.fingerprints({n: again[n] for n in names}, "rebuilt"))


query("s19_rebuild_fingerprint", rebuilt_and_live)
query("s18_kept_positions", lambda t: ingest.drop_before(t, date(2024, 1, 10))["vehicle_position"].groupBy("start_date").agg(
    F.count(F.lit(1)).alias("n"), F.count_distinct("vehicle_id").alias("vehicles")))
query("s18_orphans", lambda t: ingest.orphans({n: t[n] for n in ("fetch", "vehicle_position", "trip_update", "prediction_current")}))
query("s19_messages_to_replay", lambda t: ingest.not_yet_stored(ingest.new_messages(polls(t)), t["fetch"]))
query("s20_fingerprint", lambda t: ingest.fingerprint({n: t[n] for n in ("trip_update", "fetch")}))
query("s20_fingerprint_predictions", lambda t: ingest.fingerprint({n: t[n] for n in ("prediction_current", "prediction_history", "vehicle_position")}))


def orphans_after_cut(t: Tables) -> DataFrame:
    """Rows that a cut itself made orphans: kept, with a message before it and none after it, in every table."""
    cut, before = ingest.drop_before(t, date(2024, 1, 10)), t["fetch"].select("fetch_id")
    pointed = {}
    for name in ("vehicle_position", "prediction_current", "prediction_history", "trip_update", "alert"):
        column = "first_fetch_id" if name.startswith("prediction") else "fetch_id"
        pointed[name] = cut[name].join(before.withColumnRenamed("fetch_id", column), column, "left_semi")
    return ingest.orphans({"fetch": cut["fetch"], **pointed})


query("s18_orphans_after_cut", orphans_after_cut)
# the tables as they are: rows that pointed nowhere before the cut are left after it
query("s18_orphans_left_after_cut", lambda t: ingest.orphans(ingest.drop_before(t, date(2024, 1, 10))))
query("s21_access_log", lambda t: weblog.access_log(fx.log_lines(t), AS_OF))
query("s21_access_counts", lambda t: weblog.access_counts(weblog.access_log(fx.log_lines(t), AS_OF)))
query("s22_page_views", lambda t: weblog.page_views(fx.page_hits(t), fx.salts(t)).select("viewed_at", "session_id", "page", "device", "visitor"))


def kept_steps(t: Tables) -> DataFrame:
    from punctual.plans import runlog

    return runlog.kept_steps(t["build_step_log"], AS_OF)


query("s23_kept_steps", kept_steps)

# --- geometry ------------------------------------------------------------------------------


def utm_stops(t: Tables) -> DataFrame:
    x, y = utm(F.col("stop_lon"), F.col("stop_lat"))
    return t["stops"].select("feed_version_id", "stop_id", x.alias("x"), y.alias("y"))


query("g1_projected_stops", utm_stops)


def distances(t: Tables) -> DataFrame:
    from punctual.functions.geo import distance_m

    s = t["stops"].filter("feed_version_id = 5")
    here = s.filter("stop_id = 'S0'")
    lon, lat = here.agg(F.max("stop_lon")).scalar(), here.agg(F.max("stop_lat")).scalar()
    return s.select("stop_id", distance_m(lon, lat, F.col("stop_lon"), F.col("stop_lat")).alias("metres"))


query("g2_distances", distances)


def distances_all_versions(t: Tables) -> DataFrame:
    """Every version's stops, measured from the same version's S0."""
    from punctual.functions.geo import distance_m

    here = t["stops"].filter("stop_id = 'S0'").select("feed_version_id", F.col("stop_lon").alias("lon"), F.col("stop_lat").alias("lat"))
    return t["stops"].join(here, "feed_version_id", "left").select(
        "feed_version_id", "stop_id", distance_m(F.col("lon"), F.col("lat"), F.col("stop_lon"), F.col("stop_lat")).alias("metres"))


query("g2_distances_all_versions", distances_all_versions)
query("g3_shape_lines", lambda t: geometry.shape_lines(t).select("feed_version_id", "shape_id", "n_points", "length_m"))


def straight_walk(t: Tables) -> DataFrame:
    """A walk along straight lines, where the answer is the projection itself."""
    points = t["line"].select(
        F.expr("concat('T', ok)").alias("trip_id"), "seq", (F.col("seq") * 30.0).alias("at_s"),
        F.expr("cast(seq * 300 + cents % 100 as double)").alias("x"),
        F.expr("cast(if(cents % 19 = 0, 150, cents % 90) as double)").alias("y"))
    lines = points.select("trip_id").distinct().select(
        "trip_id", F.array(*[F.lit(v) for v in (0.0, 5000.0, 12000.0, 30000.0)]).alias("xs"), F.array(*[F.lit(0.0)] * 4).alias("ys"))
    return geometry.shape_walk(points, lines, ["trip_id"], ["seq"]).select("trip_id", "seq", "frac", "dist_m")


query("g5_shape_walk", straight_walk)


def first_passes(t: Tables) -> DataFrame:
    """Every timed stop on the first pass of its trip's whole shape. Trips share shapes, and a stop's place on one is the
    same for all of them: it is looked for once for each stop and shape that meet, and joined to the trips' stops."""
    key, spot = ["feed_version_id", "trip_id"], ["feed_version_id", "shape_id", "stop_id"]
    x, y = utm(F.col("stop_lon"), F.col("stop_lat"))
    place = lines.first_pass(F.col("line"), x, y, F.lit(0.0), F.lit(1.0))
    timed = t["stop_times"].select(*key, "stop_sequence", "stop_id").join(t["trips"].select(*key, "shape_id"), key)
    places = (
        timed.select(*spot).distinct()
        .join(t["stops"], ["feed_version_id", "stop_id"])
        .join(geometry.shape_lines(t), ["feed_version_id", "shape_id"])
        .select(*spot, place.alias("p")).select(*spot, "p.frac", "p.dist_m"))
    return timed.join(places, spot).select(*key, "stop_sequence", "frac", "dist_m")


query("g4_first_pass", first_passes)
#: Lines that bend, close, and come back along the same street, in metres.
CORNERS = {"bent": [(0, 0), (2000, 0), (2000, 1500), (4000, 1500)], "loop": [(0, 0), (2000, 0), (2000, 2000), (0, 2000), (0, 0)],
           "back": [(0, 0), (1500, 0), (3000, 0), (3000, 14), (1500, 14), (0, 14)]}
ROAD = "element_at(array('bent', 'loop', 'back'), cast(user_id % 3 as int) + 1)"


def cornered_walk(t: Tables) -> DataFrame:
    """A user's events of a day as points along one of these lines, jumping about and leaving it now and then."""
    points = t["events"].select(
        F.concat("user_id", F.lit("/"), F.to_date("ts")).alias("trip"), F.expr(ROAD).alias("road"), "event_id",
        F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).cast("double").alias("at_s"))
    made = t.spark.createDataFrame(
        [(n, [float(x) for x, _ in c], [float(y) for _, y in c]) for n, c in CORNERS.items()], "road string, xs array<double>, ys array<double>")
    # noise and the odd place far off the line, by whole numbers that both engines make
    noisy = points.select("trip", "road", "event_id", "at_s",
        F.expr("(event_id * 7919) % 4000 * 1D").alias("x"), F.expr("if(event_id % 3 = 0, (event_id * 104729) % 2000, (event_id * 31) % 40) * 1D").alias("y"))
    per_trip = noisy.select("trip", "road").distinct().join(made, "road").select("trip", "xs", "ys")
    walked = geometry.shape_walk(noisy, per_trip, ["trip"], ["at_s", "event_id"])
    metres = F.col("frac") * F.expr("case road when 'bent' then 5500 when 'loop' then 8000 else 6014 end")
    return walked.select("trip", "event_id", metres.alias("at_m"), "dist_m")


query("g5_cornered_walk", cornered_walk)
query("g6_live_placement", lambda t: live.next_stops(t, LIVE).select("vehicle_id", "bus_frac", "feed_seq"))
query("t10_stop_shape_fractions", lambda t: geometry.stop_shape_fractions(t))
query("t11_positions_along_shape", lambda t: geometry.positions_along_shape(t))

# --- staging and intermediate --------------------------------------------------------------

query("t1_stg_routes", schedule.stg_routes)
query("t1_stg_trips", schedule.stg_trips)
query("t2_stg_stops", schedule.stg_stops)
query("t3_stg_stop_times", schedule.stg_stop_times)
query("t4_stg_predictions", schedule.stg_predictions)
query("t5_stg_vehicle_positions", schedule.stg_vehicle_positions)
query("t6_feed_version_by_date", lambda t: t["feed_version_by_date"])
query("t7_active_services", lambda t: t["active_services"])
query("t8_stop_times_filled", lambda t: t["stop_times_filled"])
query("t9_scheduled_stop_events", lambda t: schedule.scheduled_stop_events(t))
query("t12_observed_arrivals", lambda t: arrivals.observed_arrivals(t, AS_OF))
query("t13_feed_settled_times", lambda t: t["feed_settled_times"])
query("t14_headways", lambda t: t["headways"])
query("t15_doubtful_stops", lambda t: t["doubtful_stops"])

# --- facts and marts -----------------------------------------------------------------------

query("m1_prediction_errors", lambda t: t["prediction_errors"])
query("m2_countdown_samples", lambda t: t["countdown_samples"])
query("m3_stop_events", lambda t: facts.stop_events(t, AS_OF))
query("m4_calibration", lambda t: t["mart_calibration"])
query("m5_daily_coverage", lambda t: t["mart_daily_coverage"])
query("m6_headways", lambda t: marts.headway_adherence(t))
query("m7_lateness", lambda t: t["mart_lateness"])
query("m8_method_agreement", lambda t: t["mart_method_agreement"])
query("m9_prediction_daily", lambda t: t["mart_prediction_daily"])
query("m10_prediction_error_ranges", lambda t: t["mart_prediction_error_ranges"])
query("m11_prediction_stop_daily", lambda t: t["mart_prediction_stop_daily"])
query("m12_route_daily", lambda t: t["mart_route_daily"])
query("m13_stop_route_daily", lambda t: t["mart_stop_route_daily"])
query("m14_stop_route_hourly", lambda t: t["mart_stop_route_hourly"])


def built_in_steps(t: Tables, name: str, build: Callable[[str], None]) -> DataFrame:
    """What a build wrote, read back from the shared folder."""
    root = f"{shared_folder(t.spark)}/build-{uuid.uuid4().hex}"
    build(root)
    return policy.read_table(t.spark, root, name)


def incremental_build(t: Tables) -> DataFrame:
    """A mart by days: a first build that sees some of the days, then one that sees all."""
    def build(root: str) -> None:
        for last in (date(2024, 1, 20), date(2024, 1, 21), date(2030, 1, 1)):
            seen = {"stop_events": t["stop_events"].filter(F.col("service_date") <= F.lit(last))}
            policy.build_recent_days(t.spark, root, "trend", lambda start: marts.trend_daily(seen, start), AS_OF)

    return built_in_steps(t, "trend", build).select(*t["mart_trend_daily"].columns)


def version_build(t: Tables) -> DataFrame:
    """Filled stop times by versions: the older ones first, then those that are new."""
    def build(root: str) -> None:
        for newest in (5, 10**6):
            times = t["stop_times"].filter(F.col("feed_version_id") <= newest)
            policy.build_new_versions(t.spark, root, "filled", lambda new: schedule.stop_times_filled({"stop_times": new(times)}))

    return built_in_steps(t, "filled", build).select(*t["stop_times_filled"].columns)


def stale_build(t: Tables) -> DataFrame:
    """A summary that is kept while fresh and computed again when stale."""
    def build(root: str) -> None:
        few = {"prediction_errors": t["prediction_errors"].limit(0)}
        policy.refresh_if_stale(t.spark, root, "calibration", lambda: marts.calibration(few), AS_OF)
        for minutes in (10, 56):
            policy.refresh_if_stale(t.spark, root, "calibration", lambda: t["mart_calibration"], AS_OF + timedelta(minutes=minutes))

    return built_in_steps(t, "calibration", build).drop("built_at")


query("p1_incremental_build", incremental_build)
query("p2_new_versions", version_build)
query("p3_refresh_if_stale", stale_build)
query("m15_trend_daily", lambda t: t["mart_trend_daily"])

# --- shared expressions --------------------------------------------------------------------

query("p4_horizon_bands", lambda t: t["prediction_errors"].groupBy(bands.horizon_band(F.col("horizon_min")).alias("band")).agg(F.count(F.lit(1)).alias("n")))
query("p5_day_parts", lambda t: t["stop_events"].groupBy(
    timeutil.weekday_type(F.col("service_date")).alias("weekday_type"), bands.day_part(F.col("hour_local")).alias("part")).agg(F.count(F.lit(1)).alias("n")))


def route_counts(t: Tables) -> DataFrame:
    return marts.scored(t).groupBy("route_id").agg(F.count(F.lit(1)).alias("n"), *histograms.threshold_counts(F.col("delay_s")))


query("p6_threshold_counts", route_counts)
query("p7_signed_percentiles", lambda t: route_counts(t).select("route_id", *[
    histograms.signed_percentile(p).alias(n) for p, n in ((0.1, "p10_s"), (0.5, "p50_s"), (0.9, "p90_s"))]))
query("p8_absolute_percentiles", lambda t: route_counts(t).select(
    "route_id", histograms.abs_percentile_minutes(0.5).alias("half_min"), histograms.abs_percentile_minutes(0.8).alias("most_min")))
query("p9_trend_by_week", lambda t: history.trend(t, max_points=10))
query("p9_trend_by_month", lambda t: history.trend(t, max_points=2))
query("p10_stop_places", lambda t: routes.stop_places(t))


# --- the chain -----------------------------------------------------------------------------

COLLECTED = ("routes", "stops", "trips", "calendar", "calendar_dates", "stop_times", "shapes", "feed_version", "fetch",
             "vehicle_position", "prediction_current", "prediction_history")
_TO_EVENTS = ("feed_version_by_date", "active_services", "shape_lines", "stop_times_filled", "stop_shape_fractions", "scheduled_stop_events",
              "positions_along_shape", "observed_arrivals", "feed_settled_times", "doubtful_stops", "stop_events")


def chain(name: str, *steps: str) -> Callable[[Tables], DataFrame]:
    """A table of the build from the collected tables alone: every layer is written and feeds the next."""

    def run(t: Tables) -> DataFrame:
        from punctual.plans.pipeline import Build

        root = f"{shared_folder(t.spark)}/chain-{uuid.uuid4().hex}"
        return Build(t.spark, root, {n: t[n] for n in COLLECTED}, AS_OF).run(only={*_TO_EVENTS, *steps})[name]

    return run




def to_hundredths(df: DataFrame, *moments: str) -> DataFrame:
    return df.withColumns({c: F.timestamp_micros((F.round(F.unix_micros(c) / 10_000) * 10_000).cast("long")) for c in moments})


query("chain_stop_events", lambda t: to_hundredths(chain("stop_events")(t), "observed_arrival", "scored_time"))
query("chain_route_daily", chain("mart_route_daily", "mart_route_daily"))
query("chain_prediction_daily", chain("mart_prediction_daily", "prediction_errors", "countdown_samples", "mart_prediction_daily"))
