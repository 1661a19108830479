"""Tables by key that a stream keeps up to date, one committed state per micro-batch.

Rows live in units: a day (where the key holds one) and a hash bucket of the key. A batch writes the units it
touches under its own number, and a small state file then says which batch wrote each unit; the other units stay
where they are. The state file is the commit: a batch that failed before it left nothing that is read, a batch that
runs again starts from the state before its number and overwrites its own folders. Files that neither of the two
newest states names are removed, so a reader of the state before keeps its files and storage does not grow with
the number of batches.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from punctual.plans.files import Files

DAY, BUCKET = "part_day", "part_bucket"
NO_DAY = "none"


@dataclass(frozen=True)
class State:
    """What a batch left: the newest event time seen, the one up to which rows were applied (microseconds), the
    batch that wrote each unit, and whether rows that should have waited were applied as the last ones."""

    number: int = -1
    clock: int | None = None
    applied: int | None = None
    units: dict[str, int] = field(default_factory=dict)
    last: bool = False


class States:
    """State files ``<folder>/state/<number>.json``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.files, self.folder = Files(spark, folder), f"{folder}/state"

    def numbers(self) -> list[int]:
        return sorted(int(n.split(".")[0]) for n in self.files.names(self.folder) if n.endswith(".json"))

    def before(self, number: int | None = None, ended: bool = True) -> State:
        """The newest state, or the newest one before batch ``number``; without ``ended`` the newest that a
        stream can go on from. A file that was not written to its end is no state."""
        for n in reversed(self.numbers()):
            if number is None or n < number:
                try:
                    state = State(**json.loads(self.files.read(f"{self.folder}/{n:010d}.json")))
                except json.JSONDecodeError:
                    continue
                if ended or not state.last:
                    return state
        return State()

    def commit(self, state: State, keep: int = 2) -> None:
        self.files.write(f"{self.folder}/{state.number:010d}.json", json.dumps(asdict(state)))
        for n in [n for n in self.numbers() if n < state.number][: -(keep - 1) or None]:
            self.files.remove(f"{self.folder}/{n:010d}.json")


class KeyedTable:
    """Rows by ``keys`` in units; ``day`` is the key column that dates a row, if there is one."""

    def __init__(self, spark: SparkSession, folder: str, schema: str, keys: Iterable[str], day: str | None = None, buckets: int = 16):
        self.spark, self.folder, self.keys, self.day, self.buckets = spark, folder, list(keys), day, buckets
        self.schema = StructType.fromDDL(schema)
        self.files = Files(spark, folder)

    def _unit(self) -> list[Column]:
        day = F.coalesce(F.col(self.day).cast("string"), F.lit(NO_DAY)) if self.day else F.lit(NO_DAY)
        return [day.alias(DAY), F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int").alias(BUCKET)]

    def units(self, rows: DataFrame) -> set[str]:
        """Units the rows belong to: at most days x buckets names, whatever the number of rows."""
        return {f"{DAY}={r[0]}/{BUCKET}={r[1]}" for r in rows.select(*self._unit()).distinct().collect()}

    def read(self, units: dict[str, int]) -> DataFrame:
        if not units:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.folder}/batch={n}/{u}" for u, n in sorted(units.items())])

    def write(self, rows: DataFrame, number: int) -> dict[str, int]:
        """Writes the rows as batch ``number`` and names the units that have any."""
        columns = [F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema]
        place = f"{self.folder}/batch={number}"
        (
            rows.select(*columns, *self._unit())
            .repartition(DAY, BUCKET)
            .write.mode("overwrite")
            .partitionBy(DAY, BUCKET)
            .parquet(place)
        )
        days = [d for d in self.files.names(place) if d.startswith(f"{DAY}=")]
        return {f"{d}/{b}": number for d in days for b in self.files.names(f"{place}/{d}") if b.startswith(f"{BUCKET}=")}

    def clean(self, *states: State) -> None:
        """Removes the units that none of the states names, and what batches left that came to nothing."""
        named = {(n, u) for s in states for u, n in s.units.items()}
        whole = {n for n, _ in named}
        newest = max(s.number for s in states)
        for name in self.files.names(self.folder):
            n = int(name.removeprefix("batch="))
            if n > newest:
                continue
            if n not in whole:
                self.files.remove(f"{self.folder}/{name}")
                continue
            for d in self.files.names(f"{self.folder}/{name}"):
                for b in self.files.names(f"{self.folder}/{name}/{d}") if d.startswith(f"{DAY}=") else []:
                    if (n, f"{d}/{b}") not in named:
                        self.files.remove(f"{self.folder}/{name}/{d}/{b}")


class HeldBack:
    """Arrived rows that wait until event time has passed them by ``late`` seconds, so that batches apply rows in
    event-time order though they arrive out of it. Each batch stores what it got and what was still waiting."""

    def __init__(self, spark: SparkSession, folder: str, schema: str, time: str, late: float | None):
        self.spark, self.folder, self.schema, self.time, self.late = spark, f"{folder}/arrived", schema, time, late
        self.files = Files(spark, folder)

    def take(self, rows: DataFrame, state: State, number: int, unique: Callable[[DataFrame], DataFrame], all_: bool = False) -> tuple[DataFrame, State]:
        """Rows to apply now, one for each thing ``unique`` tells apart, and the state with the new times.
        ``all_``: nothing more comes, so no row waits."""
        names = [f.name for f in StructType.fromDDL(self.schema)]
        if state.number >= 0 and self.late is not None:
            waiting = self.spark.read.schema(self.schema).parquet(f"{self.folder}/batch={state.number}")
            rows = rows.select(*names).unionByName(waiting.filter(F.unix_micros(self.time) > state.applied))
        place = f"{self.folder}/batch={number}"
        unique(rows.select(*names)).write.mode("overwrite").parquet(place)
        stored = self.spark.read.schema(self.schema).parquet(place)
        newest = stored.agg(F.max(F.unix_micros(self.time))).first()[0]
        clock = max((t for t in (newest, state.clock) if t is not None), default=0)
        applied = max(clock - (0 if all_ or self.late is None else int(self.late * 1e6)), state.applied or -(1 << 62))
        now = stored if self.late is None else stored.filter(F.unix_micros(self.time) <= applied)
        return now, State(number, clock, applied, state.units, all_)

    def clean(self, *states: State) -> None:
        for name in self.files.names(self.folder):
            if int(name.removeprefix("batch=")) < min(s.number for s in states):
                self.files.remove(f"{self.folder}/{name}")


def run_batches(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Everything there is, batch by batch; a later run goes on from the checkpoint."""
    query = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
