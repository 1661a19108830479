"""De-duplication and storage of realtime messages (batch forms)."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from punctual.config import DEFAULT, Config
from punctual.functions.timeutil import lit_ts, local_midnight, utc_date
from punctual.operators.changes import HISTORY, PREDICTION

PREDICTION_KEY = ["trip_id", "start_date", "stop_sequence"]


# --- messages ------------------------------------------------------------------------------


def new_messages(polls: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """The first poll that carried each (feed, header time), unless already stored. ``min_by`` keeps
    one candidate per task before the shuffle, so a feed polled a million times costs one row."""
    key = ["feed", "header_timestamp"]
    rest = [c for c in polls.columns if c not in key]
    first = (
        polls.groupBy(*key)
        .agg(F.min_by(F.struct(*rest), F.struct("fetched_at", "poll_id")).alias("m"))
        .select(*key, "m.*")
    )
    if stored is not None:
        first = first.join(stored.select(*key), key, "left_anti")
    return first


def unchanged_polls(polls: DataFrame) -> DataFrame:
    """Polls discarded because their header time was already known, per feed and hour."""
    kept = new_messages(polls).select("poll_id")
    return (
        polls.join(kept, "poll_id", "left_anti")
        .groupBy("feed", F.date_trunc("hour", "fetched_at").alias("hour"))
        .agg(F.count(F.lit(1)).alias("unchanged_count"))
    )


def _first(df: DataFrame, key: list[str], order: list[str], stored: DataFrame | None) -> DataFrame:
    rest = [c for c in df.columns if c not in key]
    out = df.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("m")).select(*key, "m.*")
    return out if stored is None else out.join(stored.select(*key).distinct(), key, "left_anti")


def new_positions(flat: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """The first row per (vehicle, report time), across messages and against what is stored."""
    return _first(flat, ["vehicle_id", "position_timestamp"], ["fetch_id", "entity_no"], stored).drop(
        "entity_no"
    )


def new_trip_updates(flat: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    return _first(flat, ["fetch_id", "trip_id"], ["entity_no"], stored).drop("entity_no")


def first_predictions(flat: DataFrame) -> DataFrame:
    """A message that names a trip's stop twice is ambiguous: its first mention counts."""
    key = ["fetch_id", *PREDICTION_KEY]
    return _first(flat, key, ["entity_no", "update_no"], None).drop("entity_no", "update_no")


# --- maintenance ---------------------------------------------------------------------------


def close_out(
    current: DataFrame, history: DataFrame, as_of: datetime, cfg: Config = DEFAULT
) -> tuple[DataFrame, DataFrame]:
    """Predictions of days long over move from current to history. Running it again moves nothing:
    rows already in history (same key and first moment) are not added twice."""
    oldest = F.lit(utc_date(as_of) - timedelta(days=cfg.stale_prediction_days))
    stale = F.col("start_date") < oldest
    moved = (
        current.filter(stale)
        .withColumn("closed_at", lit_ts(as_of))
        .select(*HISTORY)
        .join(
            history.filter(stale).select(*PREDICTION_KEY, "first_seen_at"),
            [*PREDICTION_KEY, "first_seen_at"],
            "left_anti",
        )
        .select(*HISTORY)
    )
    return current.filter(~stale), history.select(*HISTORY).unionByName(moved)


def drop_before(
    t: Mapping[str, DataFrame], before: date, cfg: Config = DEFAULT
) -> dict[str, DataFrame]:
    """Everything collected before a local date goes: predictions by service date or by their first
    message, other rows by their message. Returns the tables to keep."""
    start = lit_ts(local_midnight(before, cfg.timezone))
    old = t["fetch"].filter(F.col("fetched_at") < start).select("fetch_id")

    def by_message(name: str, column: str = "fetch_id") -> DataFrame:
        return t[name].join(old.withColumnRenamed("fetch_id", column), column, "left_anti").select(
            *t[name].columns
        )

    out = {name: by_message(name) for name in ("fetch", "vehicle_position", "trip_update", "alert") if name in t}
    for name in ("prediction_current", "prediction_history"):
        if name in t:
            out[name] = by_message(name, "first_fetch_id").filter(F.col("start_date") >= F.lit(before))
    if "fetch_unchanged" in t:
        out["fetch_unchanged"] = t["fetch_unchanged"].filter(F.col("hour") >= start)
    return out


def orphans(t: Mapping[str, DataFrame]) -> DataFrame:
    """Rows that still point at a message that is gone, per table (all zero after a clean cut)."""
    parts = []
    for name, column in (
        ("vehicle_position", "fetch_id"),
        ("prediction_current", "first_fetch_id"),
        ("prediction_history", "first_fetch_id"),
        ("trip_update", "fetch_id"),
        ("alert", "fetch_id"),
    ):
        if name in t:
            known = t["fetch"].select(F.col("fetch_id").alias(column))
            parts.append(
                t[name]
                .join(known, column, "left_anti")
                .agg(F.count(F.lit(1)).alias("orphans"))
                .select(F.lit(name).alias("tbl"), "orphans")
            )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def not_yet_stored(archive: DataFrame, fetch: DataFrame, since: datetime | None = None) -> DataFrame:
    """Archived messages whose (feed, header time) is not in the message table: what a replay adds.
    A rebuild is the same against an empty table."""
    key = ["feed", "header_timestamp"]
    rows = archive if since is None else archive.filter(F.col("header_timestamp") >= lit_ts(since))
    return rows.join(fetch.select(*key), key, "left_anti")


# --- fingerprints --------------------------------------------------------------------------

_FINGERPRINTED = {
    "fetch": ("feed", "header_timestamp", "entity_count", "byte_size", "sha256", "archive_path"),
    "prediction_current": (
        "trip_id", "start_date", "stop_sequence", "stop_id", "arrival_time", "departure_time",
        "scheduled_time", "first_seen_at", "last_seen_at",
    ),
    "prediction_history": (
        "trip_id", "start_date", "stop_sequence", "arrival_time", "departure_time", "first_seen_at",
        "last_seen_at", "closed_at",
    ),
    "vehicle_position": (
        "vehicle_id", "position_timestamp", "latitude", "longitude", "trip_id", "start_date",
    ),
    "trip_update": ("trip_id", "start_date", "vehicle_id", "trip_delay_seconds"),
    "alert": ("alert_id", "payload"),
}


def _as_text(df: DataFrame, name: str) -> Column:
    kind = dict(df.dtypes)[name]
    c = F.col(name)
    return (F.unix_micros(c) if kind == "timestamp" else c).cast("string")


def fingerprint(t: Mapping[str, DataFrame]) -> DataFrame:
    """Per table: rows, and a sum of row hashes. Ids and our own clock are left out, so a rebuild
    must reproduce it. A sum needs no order and combines map-side; nothing is gathered."""
    out = None
    for name, columns in _FINGERPRINTED.items():
        if name not in t:
            continue
        df = t[name]
        line = F.concat_ws("|", *[_as_text(df, c) for c in columns])
        code = F.conv(F.substring(F.md5(line), 1, 12), 16, 10).cast("long")
        one = df.agg(
            F.count(F.lit(1)).alias("n"),
            F.coalesce(F.sum(code.cast("decimal(38,0)")), F.lit(0)).cast("string").alias("fingerprint"),
        ).select(F.lit(name).alias("tbl"), "n", "fingerprint")
        out = one if out is None else out.unionByName(one)
    return out


__all__ = [
    "HISTORY", "PREDICTION", "close_out", "drop_before", "fingerprint", "first_predictions",
    "new_messages", "new_positions", "new_trip_updates", "not_yet_stored", "orphans",
    "unchanged_polls",
]
