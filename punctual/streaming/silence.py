"""Silences of feeds, found as messages come: closed gaps, and the one a feed is in now.

In a batch a gap shows when the message after it has come. Here each batch also moves a clock, the newest message
of any feed, and a feed whose last message lies further back than the limit is silent now, though nothing came
from it. State is one row per feed and the messages that still wait for older ones (``late`` seconds).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from punctual.config import DEFAULT, Config
from punctual.functions.timeutil import seconds_between
from punctual.operators.chunked import time_chunk, with_previous
from punctual.streaming.keyed import HeldBack, States

GAPS = "feed string, silent_from timestamp, silent_to timestamp, gap_s double"
_LAST = "feed string, at timestamp"


def silences(rows: DataFrame, limit_s: float, cfg: Config = DEFAULT) -> DataFrame:
    """Batch form: gaps over ``limit_s`` between a feed's messages ``(feed, at)``. A feed is one of a few
    values, so its messages are compared inside chunks of time."""
    before = with_previous(rows, ["feed"], ["at"], time_chunk(F.col("at"), cfg.feed_chunk_s), ["at"])
    gap = seconds_between(F.col("at"), F.col("prev.at"))
    return before.filter(gap > limit_s).select("feed", F.col("prev.at").alias("silent_from"), F.col("at").alias("silent_to"), gap.alias("gap_s"))


class SilenceStore:
    def __init__(self, spark: SparkSession, folder: str, limit_s: float, late: float = 0, cfg: Config = DEFAULT):
        self.spark, self.folder, self.limit_s, self.cfg = spark, folder, limit_s, cfg
        self.states = States(spark, folder)
        self.held = HeldBack(spark, folder, _LAST, "at", late)

    def _last(self, number: int) -> DataFrame:
        if number < 0:
            return self.spark.createDataFrame([], _LAST)
        return self.spark.read.schema(_LAST).parquet(f"{self.folder}/last/batch={number}")

    def apply(self, messages: DataFrame, number: int, all_: bool = False) -> None:
        """``messages(feed, at)``; messages that come again count once, those without a feed or time not at all.
        One that comes more than ``late`` seconds behind the clock cannot split a gap any more."""
        before = self.states.before(number)
        rows, state = self.held.take(messages.dropna(subset=["feed", "at"]), before, number, DataFrame.distinct, all_)
        last = self._last(before.number)
        known = last.select("feed", F.col("at").alias("known_at"))
        rows = rows.join(known, "feed", "left").filter("known_at is null or at > known_at").select("feed", "at")
        silences(rows.unionByName(last), self.limit_s, self.cfg).write.mode("overwrite").parquet(f"{self.folder}/gaps/batch={number}")
        newest = rows.unionByName(last).groupBy("feed").agg(F.max("at").alias("at"))
        newest.write.mode("overwrite").parquet(f"{self.folder}/last/batch={number}")
        self.states.commit(state)
        self.held.clean(before, state)
        for name in self.states.files.names(f"{self.folder}/last"):
            if int(name.removeprefix("batch=")) < min(before.number, number):
                self.states.files.remove(f"{self.folder}/last/{name}")

    def finish(self) -> None:
        """Takes what still waits, as if nothing more came. Later batches go on from the state before."""
        self.apply(self.spark.createDataFrame([], _LAST), self.states.before(ended=False).number + 1, all_=True)

    def closed(self) -> DataFrame:
        rows = self.spark.read.schema(f"{GAPS}, batch int").parquet(f"{self.folder}/gaps")
        return rows.filter(F.col("batch") <= self.states.before().number).drop("batch")

    def silent_now(self) -> DataFrame:
        """Feeds whose last message is more than the limit behind the clock; they have no end yet."""
        state = self.states.before()
        clock = F.timestamp_micros(F.lit(state.applied if state.applied is not None else 0))
        gap = seconds_between(clock, F.col("at"))
        return self._last(state.number).filter(gap > self.limit_s).select(
            "feed", F.col("at").alias("silent_from"), F.lit(None).cast("timestamp").alias("silent_to"), gap.alias("gap_s"))
