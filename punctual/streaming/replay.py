"""All realtime tables from the archive: in one batch, or live as messages come; both give the same tables.

Ids are made from header time and feed, so they do not depend on who stored a message when. Live messages wait
``late`` seconds for older ones and are applied in header order; so the tables do not depend on the order of arrival, as
long as no message comes later than that.
"""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from punctual import schemas
from punctual.operators import changes, ingest
from punctual.sources import realtime
from punctual.streaming.keyed import HeldBack, States, run_batches
from punctual.streaming.predictions import IntervalStore

ARCHIVED = f"feed string, header_timestamp timestamp, archive_path string, byte_size int, sha256 string, message struct<{schemas.MESSAGE_DDL}>"
REJECTED = "feed string, filed_at timestamp, archive_path string, byte_size int, sha256 string, problem string"
PREDICTIONS = (
    "trip_id string, start_date date, stop_sequence int, stop_id string, arrival_time timestamp, departure_time timestamp, "
    "arrival_delay int, departure_delay int, schedule_relationship int, scheduled_time timestamp, first_seen_at timestamp, "
    "last_seen_at timestamp, first_fetch_id long, closed_at timestamp"
)
APPENDED = ("fetch", "vehicle_position", "trip_update", "alert")


def once(messages: DataFrame) -> DataFrame:
    """One message per feed and header time: the first in archive order."""
    key = ["feed", "header_timestamp"]
    rest = F.struct("archive_path", "sha256", "byte_size", "message")
    first = messages.groupBy(*key).agg(F.min_by(rest, F.struct("archive_path", "sha256")).alias("m"))
    return first.select(*key, "m.archive_path", "m.byte_size", "m.sha256", "m.message")


def identified(messages: DataFrame) -> DataFrame:
    feed = F.array_position(F.array(*map(F.lit, realtime.FEEDS)), F.col("feed"))
    return messages.withColumn("fetch_id", F.unix_micros("header_timestamp") * 4 + feed).withColumn("fetched_at", F.col("header_timestamp"))


def flattened(messages: DataFrame) -> dict[str, DataFrame]:
    """Rows of each table as the messages hold them, still with repeats; a feed speaks of its own kind only."""
    of = lambda feed: messages.filter(F.col("feed") == feed)
    return {
        "fetch": messages.select(
            "fetch_id", "feed", "fetched_at", "header_timestamp", F.size("message.entity").alias("entity_count"), "byte_size", "sha256", "archive_path"
        ),
        "vehicle_position": realtime.vehicle_positions(of("vehicle_positions")),
        "trip_update": realtime.trip_updates(of("trip_updates")),
        "alert": realtime.alerts(of("alerts")),
        "prediction": realtime.stop_time_updates(of("trip_updates")),
    }


def rebuild(archive: DataFrame) -> dict[str, DataFrame]:
    """The tables from the archived messages of all feeds, whatever order they are read in."""
    flat = flattened(identified(once(archive)))
    runs = changes.intervals(ingest.first_predictions(flat["prediction"]))
    current, history = changes.split(runs)
    return {
        "fetch": flat["fetch"],
        "vehicle_position": ingest.new_positions(flat["vehicle_position"]),
        "trip_update": ingest.new_trip_updates(flat["trip_update"]),
        "alert": flat["alert"],
        "prediction_current": current,
        "prediction_history": history,
    }


def scan_feeds(spark: SparkSession, root: str, streaming: bool = False, since: datetime | None = None, files_per_trigger: int | None = None) -> DataFrame:
    """All feeds of an archive under one root."""
    out = None
    for feed in realtime.FEEDS:
        one = realtime.scan_archive(spark, root, feed, streaming, since, files_per_trigger)
        out = one if out is None else out.unionByName(one)
    return out


class LiveStore:
    """The same tables under a folder, from an archive as it fills; what cannot be read goes to ``rejects``."""

    def __init__(self, spark: SparkSession, folder: str, late: float, buckets: int = 16, stale_days: int | None = None):
        self.spark, self.folder = spark, folder
        self.states = States(spark, folder)
        self.held = HeldBack(spark, folder, ARCHIVED, "header_timestamp", late)
        self.predictions = IntervalStore(spark, f"{folder}/prediction", PREDICTIONS, changes.VALUE, buckets=buckets, stale_days=stale_days)

    def _stored(self, name: str, upto: int, schema: StructType) -> DataFrame:
        placed = StructType([*schema, *StructType.fromDDL("batch int, day date")])
        if upto < 0:
            return self.spark.createDataFrame([], placed)
        rows = self.spark.read.schema(placed).parquet(f"{self.folder}/{name}")
        return rows.filter(F.col("batch") <= upto)

    def apply(self, scan: DataFrame, number: int, all_: bool = False) -> None:
        before = self.states.before(number)
        rejects = realtime.archive_rejects(scan)
        rejects.write.mode("overwrite").parquet(f"{self.folder}/rejects/batch={number}")
        rows, state = self.held.take(realtime.archived_messages(scan), before, number, once, all_)
        flat = flattened(identified(rows))
        known = flat["fetch"]
        stored = self._stored("fetch", before.number, known.schema).select("feed", "header_timestamp", "day")
        new = self._unseen(known, stored, ["feed", "header_timestamp"], "header_timestamp")
        self._append("fetch", new, number, "header_timestamp")
        fresh = self.spark.read.schema("fetch_id long").parquet(f"{self.folder}/fetch/batch={number}")
        mine = {n: df.join(fresh, "fetch_id", "left_semi").select(*df.columns) for n, df in flat.items() if n != "fetch"}
        positions = ingest.new_positions(mine["vehicle_position"])
        stored = self._stored("vehicle_position", before.number, positions.schema).select("vehicle_id", "position_timestamp", "day")
        positions = self._unseen(positions, stored, ["vehicle_id", "position_timestamp"], "position_timestamp")
        self._append("vehicle_position", positions, number, "position_timestamp")
        self._append("trip_update", ingest.new_trip_updates(mine["trip_update"]), number, "trip_timestamp")
        self._append("alert", mine["alert"], number, None)
        self.predictions.apply(ingest.first_predictions(mine["prediction"]), number)
        self.states.commit(state)
        self.held.clean(before, state)

    @staticmethod
    def _unseen(rows: DataFrame, stored: DataFrame, key: list[str], time: str) -> DataFrame:
        """Rows whose key is not stored; only the days the rows speak of are looked at."""
        days = rows.select(F.to_date(time).alias("day")).distinct()
        same_days = stored.join(days, "day", "left_semi")
        return rows.join(same_days.select(*key), key, "left_anti").select(*rows.columns)

    def _append(self, name: str, rows: DataFrame, number: int, time: str | None) -> None:
        day = F.to_date(time) if time else F.lit(None).cast("date")
        rows.withColumn("day", day).hint("rebalance", "day").write.mode("overwrite").partitionBy("day").parquet(f"{self.folder}/{name}/batch={number}")

    def finish(self) -> None:
        nothing = self.spark.createDataFrame([], f"{ARCHIVED}, problem string, filed_at timestamp")
        self.apply(nothing, self.states.before(ended=False).number + 1, all_=True)

    def tables(self) -> dict[str, DataFrame]:
        n = self.states.before().number
        empty = flattened(identified(self.spark.createDataFrame([], ARCHIVED)))
        empty["vehicle_position"] = empty["vehicle_position"].drop("entity_no")
        empty["trip_update"] = empty["trip_update"].drop("entity_no")
        out = {name: self._stored(name, n, empty[name].schema).select(*empty[name].columns) for name in APPENDED}
        return out | {"prediction_current": self.predictions.current(), "prediction_history": self.predictions.history()}

    def rejects(self) -> DataFrame:
        rows = self.spark.read.schema(f"{REJECTED}, batch int").parquet(f"{self.folder}/rejects")
        return rows.filter(F.col("batch") <= self.states.before().number).drop("batch")


def follow(stream: DataFrame, store: LiveStore, checkpoint: str) -> LiveStore:
    run_batches(stream, store.apply, checkpoint)
    return store


def fingerprints(tables: Mapping[str, DataFrame], source: str) -> DataFrame:
    return ingest.fingerprint(tables).select(F.lit(source).alias("source"), "*")
