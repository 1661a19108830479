"""Ordered work over long groups, split by time.

``lag`` or a running maximum over (feed) or (trip, day) puts a whole group in one task. Here a group
is cut into chunks of its ordering column: the window runs inside (group, chunk), and only one
summary row per chunk travels on to a second, small window that carries the value across the cut.
The summaries are a partial aggregation, so no task ever sees a whole group's rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = "__chunk"


def time_chunk(ts: Column, width_s: int) -> Column:
    return F.floor(F.unix_seconds(ts) / F.lit(width_s)).cast("long")


def number_chunk(order: Column, width: int) -> Column:
    return F.floor(order / F.lit(width)).cast("long")


def with_previous(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    chunk: Column,
    columns: Sequence[str],
    out: str = "prev",
    following: bool = False,
) -> DataFrame:
    """Adds struct ``out`` holding ``columns`` of the previous row of the group (the next one with
    ``following``); null on the first. ``order`` must be total within a group."""
    columns = list(columns)
    rows = df.withColumn(CHUNK, chunk)
    inner = Window.partitionBy(*keys, CHUNK).orderBy(*order)
    outer = Window.partitionBy(*keys).orderBy(CHUNK)
    step = F.lead if following else F.lag
    edge = F.min_by if following else F.max_by
    packed = F.struct(*columns)
    local = rows.withColumn("__near", step(packed).over(inner))
    edges = (
        rows.groupBy(*keys, CHUNK)
        .agg(edge(packed, F.struct(*order)).alias("__edge"))
        .withColumn("__carry", step("__edge").over(outer))
        .drop("__edge")
    )
    return (
        local.join(edges, [*keys, CHUNK], "left")
        .withColumn(out, F.coalesce("__near", "__carry"))
        .drop("__near", "__carry", CHUNK)
    )


def with_running_max(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    chunk: Column,
    value: str,
    out: str,
    before_only: bool = False,
) -> DataFrame:
    """Adds the maximum of ``value`` over the rows up to here (strictly before with
    ``before_only``)."""
    rows = df.withColumn(CHUNK, chunk)
    last = -1 if before_only else 0
    inner = Window.partitionBy(*keys, CHUNK).orderBy(*order).rowsBetween(Window.unboundedPreceding, last)
    outer = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    local = rows.withColumn("__near", F.max(value).over(inner))
    tops = (
        rows.groupBy(*keys, CHUNK)
        .agg(F.max(value).alias("__top"))
        .withColumn("__carry", F.max("__top").over(outer))
        .drop("__top")
    )
    return (
        local.join(tops, [*keys, CHUNK], "left")
        .withColumn(out, F.greatest("__near", "__carry"))
        .drop("__near", "__carry", CHUNK)
    )


def with_running_sum(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column, value: str, out: str
) -> DataFrame:
    """Adds the sum of ``value`` over the rows up to and including this one. With no keys the second
    window runs over one row per chunk of the whole table."""
    rows = df.withColumn(CHUNK, chunk)
    upto = (Window.unboundedPreceding, 0)
    inner = Window.partitionBy(*keys, CHUNK).orderBy(*order).rowsBetween(*upto)
    outer = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    local = rows.withColumn("__near", F.sum(value).over(inner))
    sums = (
        rows.groupBy(*keys, CHUNK)
        .agg(F.sum(value).alias("__sum"))
        .withColumn("__carry", F.sum("__sum").over(outer))
        .drop("__sum")
    )
    return (
        local.join(sums, [*keys, CHUNK], "left")
        .withColumn(out, F.col("__near") + F.coalesce("__carry", F.lit(0)))
        .drop("__near", "__carry", CHUNK)
    )
