"""Structured Streaming forms: message de-duplication, counts, and change-only predictions."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace
from datetime import datetime, timedelta, timezone

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from punctual.operators.changes import KEY, intervals
from punctual.streaming.keyed import NO_DAY, HeldBack, KeyedTable, States, run_batches


def new_messages(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """The first message per (feed, header time) as soon as it comes, with the state bounded by a watermark. Which
    of several in one micro-batch is kept is left open; ``first_messages`` says it. A message more than ``late``
    behind the newest header is dropped."""
    return stream.withWatermark("header_timestamp", late).dropDuplicatesWithinWatermark(["feed", "header_timestamp"])


def first_messages(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """The earliest poll of each (feed, header time), once the watermark has passed the header: until then a
    poll that comes late can still be the earlier one, afterwards it changes nothing. ``operators.ingest.new_messages``
    is the batch form."""
    rest = [c for c in stream.columns if c not in ("feed", "header_timestamp")]
    first = F.min_by(F.struct(*rest), F.struct("fetched_at", "poll_id")).alias("m")
    return stream.withWatermark("header_timestamp", late).groupBy("feed", "header_timestamp").agg(first).select("feed", "header_timestamp", "m.*")


def counts(stream: DataFrame, width: str = "1 hour", late: str = "10 minutes", at: str = "fetched_at") -> DataFrame:
    """Messages per feed and window, each window once, when the watermark has passed its end. Messages up to
    ``late`` behind the newest one count; later ones do not, once their window is told."""
    return (
        stream.withWatermark(at, late)
        .groupBy(F.window(at, width).alias("w"), "feed")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("w.start").alias("window_start"), "feed", "n")
    )


#: A bucket's keys and the values they assert, as one Arrow table (``HELD``).
STATE = "held binary"
HELD = pa.schema([("key", pa.string()), ("told", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("fetch", pa.int64()),
                  ("carried", pa.int64()), ("until", pa.int64())])
KEY_TYPES = "trip_id string, start_date date, stop_sequence int"
CLOSED = (
    f"{KEY_TYPES}, told string, first_seen_us long, last_seen_us long, "
    "first_fetch_id long, scheduled_us long, closed_us long"
)
_CLOSED_RUN = "key string, " + CLOSED.removeprefix(f"{KEY_TYPES}, ")


def encode(snapshots: DataFrame, value: list[str]) -> DataFrame:
    """Snapshots with the value as one JSON text (nulls kept), so the state is a few plain fields."""
    return snapshots.select(
        *KEY,
        F.to_json(F.struct(*value), {"ignoreNullFields": "false"}).alias("told"),
        F.unix_micros("header_timestamp").alias("header_us"),
        F.unix_micros("scheduled_time").alias("scheduled_us"),
        "fetch_id",
    )


def change_only(snapshots: DataFrame, idle: int | None = None, buckets: int = 1024) -> DataFrame:
    """Closed prediction intervals as they close, from a stream of ``encode``d snapshots.

    State per trip's stop: the value being asserted and since when. A message not newer than the last
    one the key took is ignored, whatever order messages arrive in. An interval is emitted when a
    different value replaces it; with ``idle``, also when the key has been silent that many milliseconds (its trip
    is over), which frees the state. Within a trigger all rows of a key (one stop of one trip) are put in
    header order, whatever pieces they come in; ``store_intervals`` does the same on plain tables, keeps
    the current half too, and splits a key of any length.

    Keys are many and most have a row or two a trigger, so they are not called one by one: a hash deals them to
    ``buckets`` groups, whose keys advance together as columns and share one row of state. The number of buckets
    belongs to a stream's checkpoint."""
    key = F.to_json(F.struct(*KEY), {"ignoreNullFields": "false"})

    def step(_: tuple, pieces: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = _held(state.get[0]) if state.exists else HELD.empty_table().to_pandas()
        now = state.getCurrentProcessingTimeMs() if idle else 0
        new = None if state.hasTimedOut else pd.concat(list(pieces), ignore_index=True)
        closed, held = _advance(held, new, now, idle)
        if len(held):
            state.update((_packed(held),))
            if idle:
                state.setTimeoutDuration(max(1, int(held["until"].min()) - now))
        elif state.exists:
            state.remove()
        if len(closed):
            yield closed

    runs = (
        snapshots.select(F.pmod(F.xxhash64(*KEY), F.lit(buckets)).cast("int").alias("bucket"), key.alias("key"),
                         "told", "header_us", "scheduled_us", "fetch_id")
        .groupBy("bucket")
        .applyInPandasWithState(
            step,
            _CLOSED_RUN,
            STATE,
            "append",
            GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout,
        )
    )
    return runs.select(F.from_json("key", KEY_TYPES).alias("k"), "*").select("k.*", *[c for c in runs.columns if c != "key"])


def _held(packed: bytes) -> pd.DataFrame:
    table = pa.ipc.open_stream(pa.py_buffer(bytes(packed))).read_all()
    return table.to_pandas(types_mapper={pa.int64(): pd.Int64Dtype()}.get).astype({"first": "int64", "last": "int64", "fetch": "int64", "until": "int64"})


def _packed(held: pd.DataFrame) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, HELD, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(pa.Table.from_pandas(held, HELD, preserve_index=False))
    return sink.getvalue().to_pybytes()


def _advance(held: pd.DataFrame, new: pd.DataFrame | None, now: int, idle: int | None) -> tuple[pd.DataFrame, pd.DataFrame]:
    """Closed runs and the values held after a trigger's rows of a bucket (None: none came, some keys' time is up).

    What a key holds is put in front of its newer rows in header order; a run is a stretch of one value, and all of
    a key's runs but the last are closed by the run after them."""
    n = len(held)
    if new is None:
        new = pd.DataFrame({"key": [], "told": [], "header_us": [], "scheduled_us": [], "fetch_id": []})
    codes, keys = pd.factorize(np.concatenate([held["key"].to_numpy(object), new["key"].to_numpy(object)]))
    last = np.full(len(keys), np.iinfo(np.int64).min)
    last[codes[:n]] = held["last"]
    heard = np.zeros(len(keys), bool)
    heard[codes[n:]] = True
    header, fetch = new["header_us"].to_numpy("int64"), new["fetch_id"].to_numpy("int64")
    newer = np.flatnonzero(header > last[codes[n:]])
    newer = newer[np.lexsort((fetch[newer], header[newer], codes[n:][newer]))]
    code, at = codes[n:][newer], header[newer]
    first_told = np.ones(len(newer), bool)  # of rows with the same header the one of the smallest id is taken
    first_told[1:] = (code[1:] != code[:-1]) | (at[1:] != at[:-1])
    newer = newer[first_told]
    carried = pd.concat([held["carried"].astype("Int64"), new["scheduled_us"].iloc[newer].astype("Int64")], ignore_index=True)
    rows = pd.DataFrame({
        "code": np.concatenate([codes[:n], codes[n:][newer]]),
        "told": np.concatenate([held["told"].to_numpy(object), new["told"].to_numpy(object)[newer]]),
        "first": np.concatenate([held["first"].to_numpy("int64"), header[newer]]),
        "last": np.concatenate([held["last"].to_numpy("int64"), header[newer]]),
        "fetch": np.concatenate([held["fetch"].to_numpy("int64"), fetch[newer]]),
    })
    rows["carried"] = carried
    rows = rows.iloc[np.argsort(rows["code"].to_numpy(), kind="stable")]
    code, told = rows["code"].to_numpy(), rows["told"].to_numpy(object)
    starts = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (told[1:] != told[:-1])]) if len(rows) else np.zeros(0, int)
    ends = np.r_[starts[1:], len(rows)].astype(int) - 1
    runs = pd.DataFrame({
        "key": keys[code[starts]], "told": told[starts], "first": rows["first"].to_numpy()[starts], "last": rows["last"].to_numpy()[ends],
        "fetch": rows["fetch"].to_numpy()[starts],
    })
    runs["carried"] = rows["carried"].iloc[ends].array
    final = np.r_[code[starts][1:] != code[starts][:-1], True] if len(runs) else np.zeros(0, bool)
    closes = pd.Series(np.r_[runs["first"].to_numpy()[1:], 0][: len(runs)]).astype("Int64")
    current = runs[final].copy()
    owner = code[starts][final]
    current["until"] = 0
    over = np.zeros(len(current), bool)
    if idle:
        until = np.zeros(len(keys), np.int64)
        until[codes[:n]] = held["until"]
        until[heard] = now + idle
        current["until"] = until[owner]
        over = ~heard[owner] & (current["until"].to_numpy() <= now)
    closed = pd.concat([runs[~final].assign(closed=closes[~final]), current[over].drop(columns="until").assign(closed=pd.array([pd.NA] * int(over.sum()), "Int64"))])
    closed.columns = [c.split()[0] for c in _CLOSED_RUN.split(", ")]
    return closed, current[~over]


def day_over(stale_days: int) -> Column:
    """The moment from which a service day counts as long over: midnight UTC after ``stale_days`` more days."""
    return F.date_add("start_date", stale_days + 1).cast("timestamp")


class IntervalStore:
    """``current`` and ``history`` tables under a folder, kept by a stream of snapshots.

    ``late``: seconds a message may come after a newer one; messages wait that long and are applied in header
    order, so the tables do not depend on the order of arrival. Without it all rows are applied as they come:
    within a batch in header order, and a message not newer than the last one its key took before changes nothing.

    ``stale_days``: predictions of days long over close at the moment the event time (the newest header applied)
    passes ``day_over`` and leave ``current``, whose size is then that of the live days; a message about such a day
    after that moment is not a prediction any more and changes nothing. The batch form of this is
    ``operators.ingest.close_out``, which closes at the time it runs.

    A batch rewrites only the units (day and bucket of the key) that its rows or the expiry touch."""

    def __init__(self, spark: SparkSession, folder: str, schema: str, value: list[str], carried: tuple[str, ...] = ("scheduled_time",),
                 late: float | None = None, stale_days: int | None = None, buckets: int = 16):
        """``schema``: that of the history."""
        self.spark, self.folder, self.history_schema = spark, folder, schema
        self.value, self.carried, self.stale_days = value, carried, stale_days
        kinds = {f.name: f.dataType.simpleString() for f in StructType.fromDDL(schema)}
        self.states = States(spark, folder)
        self.current_schema = ", ".join(f"{n} {k}" for n, k in kinds.items() if n != "closed_at")
        self.table = KeyedTable(spark, f"{folder}/current", self.current_schema, KEY, "start_date", buckets)
        arrived = ", ".join([f"{n} {kinds[n]}" for n in (*KEY, *value, *carried)] + ["header_timestamp timestamp", "fetch_id long"])
        self.held = HeldBack(spark, folder, arrived, "header_timestamp", late)

    def _once(self, rows: DataFrame) -> DataFrame:
        """A message that speaks of a stop twice is taken by its smallest id."""
        told = F.struct(*self.value, *self.carried, "fetch_id")
        rows = rows.groupBy(*KEY, "header_timestamp").agg(F.min_by(told, "fetch_id").alias("told"))
        return rows.select(*KEY, "told.*", "header_timestamp")

    def apply(self, snapshots: DataFrame, number: int, all_: bool = False) -> None:
        before = self.states.before(number)
        rows, state = self.held.take(snapshots, before, number, self._once, all_)
        if self.stale_days is not None:
            over = day_over(self.stale_days)
            rows = rows.filter(F.coalesce(F.col("header_timestamp") < over, F.lit(True)))
            if before.applied is not None:
                rows = rows.filter(F.coalesce(F.unix_micros(over) > before.applied, F.lit(True)))
        touched = self.table.units(rows)
        old = self.table.read({u: n for u, n in before.units.items() if u in touched})
        stored = old.select(*KEY, F.col("last_seen_at").alias("stored_until"))
        same_key = F.lit(True)
        for k in KEY:
            same_key &= F.col(f"r.{k}").eqNullSafe(F.col(f"s.{k}"))
        rows = rows.alias("r").join(stored.alias("s"), same_key, "left").filter("stored_until is null or header_timestamp > stored_until").select("r.*")
        names = rows.select(*KEY).distinct()
        known = old.alias("r").join(names.alias("s"), same_key, "left_semi")
        ends = F.explode(F.array_distinct(F.array("first_seen_at", "last_seen_at")))
        seen = known.select(*KEY, *self.value, *self.carried, F.col("first_fetch_id").alias("fetch_id"), ends.alias("header_timestamp"))
        runs = intervals(rows.unionByName(seen), value=self.value, carried=self.carried)
        runs = runs.unionByName(old.alias("r").join(names.alias("s"), same_key, "left_anti").withColumn("closed_at", F.lit(None).cast("timestamp")))
        gone: set[str] = set()
        if self.stale_days is not None:
            gone = {u for u in before.units if u not in touched and self._is_over(u, state.applied)}
            resting = self.table.read({u: before.units[u] for u in gone}).withColumn("closed_at", F.lit(None).cast("timestamp"))
            ended = F.unix_micros(over) <= state.applied
            runs = runs.unionByName(resting).withColumn("closed_at", F.coalesce("closed_at", F.when(ended, over)))
        runs = runs.persist()
        closed = runs.filter("closed_at is not null")
        closed.select(*[f.name for f in StructType.fromDDL(self.history_schema)]).write.mode("overwrite").parquet(f"{self.folder}/history/batch={number}")
        written = self.table.write(runs.filter("closed_at is null"), number)
        runs.unpersist()
        state = replace(state, units={u: n for u, n in before.units.items() if u not in touched and u not in gone} | written)
        self.states.commit(state)
        self.table.clean(before, state)
        self.held.clean(before, state)

    def _is_over(self, unit: str, applied: int) -> bool:
        day = unit.split("/")[0].partition("=")[2]
        if day == NO_DAY:
            return False
        over = datetime.fromisoformat(day).replace(tzinfo=timezone.utc) + timedelta(days=self.stale_days + 1)
        return over.timestamp() * 1e6 <= applied

    def finish(self) -> None:
        """Applies what still waits, as if nothing more came. Later batches go on from the state before."""
        self.apply(self.spark.createDataFrame([], self.held.schema), self.states.before(ended=False).number + 1, all_=True)

    def current(self) -> DataFrame:
        return self.table.read(self.states.before().units)

    def history(self) -> DataFrame:
        """Of batches that were committed."""
        rows = self.spark.read.schema(f"{self.history_schema}, batch int").parquet(f"{self.folder}/history")
        return rows.filter(F.col("batch") <= self.states.before().number).drop("batch")


def store_intervals(stream: DataFrame, folder: str, checkpoint: str, schema: str, value: list[str], **how) -> IntervalStore:
    """Process all snapshots there are into the tables of an ``IntervalStore`` and return it."""
    store = IntervalStore(stream.sparkSession, folder, schema, value, **how)
    run_batches(stream, store.apply, checkpoint)
    return store


def decode(closed: DataFrame, value_ddl: str) -> DataFrame:
    """Closed intervals with the value's columns and proper timestamps again."""
    moment = lambda c: F.timestamp_micros(F.col(c))
    return closed.select(
        *KEY,
        F.from_json("told", value_ddl).alias("v"),
        moment("first_seen_us").alias("first_seen_at"),
        moment("last_seen_us").alias("last_seen_at"),
        "first_fetch_id",
        moment("scheduled_us").alias("scheduled_time"),
        moment("closed_us").alias("closed_at"),
    ).select(*KEY, "v.*", "scheduled_time", "first_seen_at", "last_seen_at", "first_fetch_id", "closed_at")


def run_available(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """Process everything there is into Parquet and stop. The file sink and its checkpoint make a
    restarted run continue without repeating rows."""
    query = (
        stream.writeStream.format("parquet")
        .outputMode(mode)
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()

