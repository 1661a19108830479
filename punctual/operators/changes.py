"""Change-only storage: predictions as intervals over which the feed asserted one value.

A trip's stop keeps one row per distinct value: from the header time of the message that first said
it to that of the last message still saying it. Six columns make up the value; the feed's own
scheduled time is carried along but does not count as a change.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from punctual.operators.chunked import number_chunk, time_chunk, with_previous, with_running_max

KEY = ["trip_id", "start_date", "stop_sequence"]
VALUE = [
    "stop_id",
    "arrival_time",
    "departure_time",
    "arrival_delay",
    "departure_delay",
    "schedule_relationship",
]
PREDICTION = [*KEY, *VALUE, "scheduled_time", "first_seen_at", "last_seen_at", "first_fetch_id"]
HISTORY = [*PREDICTION, "closed_at"]


def in_header_order(
    snapshots: DataFrame, arrival: str, keys: Sequence[str] = KEY, chunk_rows: int = 100_000
) -> DataFrame:
    """Snapshots as they arrived, without those that were not newer than everything the key had
    seen by then: an older message is recorded, but moves no prediction."""
    timed = snapshots.withColumn("__header_us", F.unix_micros("header_timestamp"))
    seen = with_running_max(
        timed, keys, [arrival], number_chunk(F.col(arrival), chunk_rows), "__header_us", "__seen", before_only=True
    )
    return seen.filter(F.col("__seen").isNull() | (F.col("__header_us") > F.col("__seen"))).drop(
        "__header_us", "__seen"
    )


def intervals(
    snapshots: DataFrame,
    keys: Sequence[str] = KEY,
    value: Sequence[str] = VALUE,
    carried: Sequence[str] = ("scheduled_time",),
    chunk: Column | None = None,
    chunk_s: int = 3600,
) -> DataFrame:
    """One row per run of equal values of a key in header order (replay order): the key, value and
    carried columns, first_seen_at, last_seen_at, first_fetch_id, and closed_at (null while current).

    Only rows where the value changed go on to the per-key steps, and the comparison with the row
    before is chunked by time, so a key with a very long history is never one task's work."""
    keys, value, carried = list(keys), list(value), list(carried)
    told = F.struct(*value)
    cut = time_chunk(F.col("header_timestamp"), chunk_s) if chunk is None else chunk
    order = ["header_timestamp"]
    rows = with_previous(
        snapshots, keys, order, cut, [*value, *carried, "header_timestamp"], out="before"
    )
    same = F.col("before").isNotNull() & told.eqNullSafe(F.struct(*[F.col(f"before.{c}") for c in value]))
    starts = rows.filter(~same)
    latest = snapshots.groupBy(*keys).agg(
        F.max("header_timestamp").alias("latest_header"),
        F.max_by(F.struct(*carried), "header_timestamp").alias("latest_carried")
        if carried
        else F.lit(None).alias("latest_carried"),
    )
    runs = with_previous(
        starts.select(*keys, *value, "header_timestamp", "fetch_id", "before"),
        keys,
        order,
        cut,
        ["header_timestamp", "before"],
        out="next_start",
        following=True,
    )
    open_ended = F.col("next_start").isNull()
    return runs.join(latest, keys).select(
        *keys,
        *value,
        *[
            F.when(open_ended, F.col(f"latest_carried.{c}")).otherwise(F.col(f"next_start.before.{c}")).alias(c)
            for c in carried
        ],
        F.col("header_timestamp").alias("first_seen_at"),
        F.when(open_ended, F.col("latest_header"))
        .otherwise(F.col("next_start.before.header_timestamp"))
        .alias("last_seen_at"),
        F.col("fetch_id").alias("first_fetch_id"),
        F.col("next_start.header_timestamp").alias("closed_at"),
    )


def split(runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(current, history) as they are stored."""
    current = runs.filter(F.col("closed_at").isNull()).select(*PREDICTION)
    history = runs.filter(F.col("closed_at").isNotNull()).select(*HISTORY)
    return current, history
