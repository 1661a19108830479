"""Bands and day filters shared by the marts and the serving queries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from punctual.functions.timeutil import isodow

# fixed values: upper ends of the horizon bands, in minutes; anything further out is the last one
HORIZON_BANDS = (1, 3, 6, 10, 15, 20)
HORIZON_LAST = 30
# fixed values: first hour that no longer belongs to each part of the day
DAY_PARTS = (("morning", 9), ("midday", 15), ("afternoon", 19))
DAY_PART_LAST = "evening"


def horizon_band(minutes: Column) -> Column:
    out = F.when(minutes <= HORIZON_BANDS[0], HORIZON_BANDS[0])
    for bound in HORIZON_BANDS[1:]:
        out = out.when(minutes <= bound, bound)
    return out.otherwise(HORIZON_LAST)


def day_part(hour: Column) -> Column:
    (name, bound), *others = DAY_PARTS
    out = F.when(hour < bound, name)
    for name, bound in others:
        out = out.when(hour < bound, name)
    return out.otherwise(DAY_PART_LAST)


def live_status(delay_s: Column, cfg) -> Column:
    """The four bands of the live map (the fact table knows three)."""
    return (
        F.when(delay_s.isNull(), "unknown")
        .when(delay_s < -cfg.early_s, "early")
        .when(delay_s > cfg.very_late_s, "very_late")
        .when(delay_s > cfg.late_s, "late")
        .otherwise("on_time")
    )


def day_kind(kind: str | None, day: Column) -> Column:
    """Filter for the kind of day asked for: None (all), weekday, saturday, sunday or dow1..dow5."""
    if kind in (None, "all"):
        return F.lit(True)
    if kind.startswith("dow"):
        return isodow(day) == int(kind.removeprefix("dow").removeprefix(":"))
    if kind == "saturday":
        return isodow(day) == 6
    if kind == "sunday":
        return isodow(day) == 7
    if kind == "weekday":
        return isodow(day) <= 5
    raise ValueError(f"unknown day kind {kind!r}")


def scope(route_id=None, stop_id=None, direction_id=None) -> Column:
    """Filter for a choice of route, stop and direction; None means all of them."""
    out = F.lit(True)
    for column, wanted in (("route_id", route_id), ("stop_id", stop_id), ("direction_id", direction_id)):
        if wanted is not None:
            out = out & (F.col(column) == F.lit(wanted))
    return out


def service_hour_key(hour: Column) -> Column:
    """Hours in service order: 4 am first, the hours after midnight last."""
    return F.pmod(hour - 4, F.lit(24))
