"""Time helpers. The session runs in UTC; local time only ever appears through the zone given.

Nothing here reads the clock: "now" is always an ``as_of`` passed in by the caller.
"""

from __future__ import annotations

from datetime import date, datetime, timedelta, timezone
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_utc(as_of: datetime) -> datetime:
    return as_of.replace(tzinfo=timezone.utc) if as_of.tzinfo is None else as_of.astimezone(timezone.utc)


def lit_ts(as_of: datetime) -> Column:
    """A moment as a literal that does not depend on any session time zone."""
    moment = as_utc(as_of)
    micros = int(moment.replace(microsecond=0).timestamp()) * 1_000_000 + moment.microsecond
    return F.timestamp_micros(F.lit(micros))


# --- the three meanings of "today" ---------------------------------------------------------


def utc_date(as_of: datetime) -> date:
    return as_utc(as_of).date()


def local_date(as_of: datetime, tz: str) -> date:
    return as_utc(as_of).astimezone(ZoneInfo(tz)).date()


def service_date(as_of: datetime, tz: str, rollover_hours: int = 3) -> date:
    wall = as_utc(as_of).astimezone(ZoneInfo(tz)).replace(tzinfo=None)
    return (wall - timedelta(hours=rollover_hours)).date()


def local_midnight(day: date, tz: str) -> datetime:
    return datetime(day.year, day.month, day.day, tzinfo=ZoneInfo(tz)).astimezone(timezone.utc)


# --- column forms ---------------------------------------------------------------------------


def seconds(ts: Column) -> Column:
    """A moment as seconds since 1970 (double)."""
    return F.unix_micros(ts) / F.lit(1e6)


def seconds_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(1e6)


def micros_between(later: Column, earlier: Column) -> Column:
    """Whole microseconds; for filters and bands that need no fractions of a second."""
    return F.unix_micros(later) - F.unix_micros(earlier)


def whole_seconds_between(later: Column, earlier: Column) -> Column:
    """:func:`seconds_between` to the nearest whole second, halves away from zero, in whole numbers throughout."""
    us = micros_between(later, earlier)
    return F.call_function("div", us + F.when(us < 0, -500_000).otherwise(500_000), F.lit(1_000_000)).cast("int")


def plus_seconds(ts: Column, secs: Column | float | int) -> Column:
    """``ts`` moved by a number of seconds, which may be a fractional column."""
    if isinstance(secs, Column):
        delta = F.round(secs * F.lit(1e6)).cast("long")
    else:
        delta = F.lit(round(secs * 1_000_000)).cast("long")
    return F.timestamp_micros(F.unix_micros(ts) + delta)


def round_int(x: Column) -> Column:
    """Nearest whole number, halves away from zero."""
    return F.round(x).cast("int")


def floor_int(x: Column) -> Column:
    return F.floor(x).cast("int")


def to_local(ts: Column, tz: str) -> Column:
    return F.from_utc_timestamp(ts, tz)


def local_hour(ts: Column, tz: str) -> Column:
    return F.hour(to_local(ts, tz))


def local_day(ts: Column, tz: str) -> Column:
    return F.to_date(to_local(ts, tz))


def service_day(ts: Column, tz: str, rollover_hours: int = 3) -> Column:
    return F.to_date(to_local(ts, tz) - F.expr(f"interval {rollover_hours} hours"))


def isodow(day: Column) -> Column:
    """1 = Monday ... 7 = Sunday."""
    return F.weekday(day) + 1


def weekday_type(day: Column) -> Column:
    return (
        F.when(F.weekday(day) == 5, "saturday").when(F.weekday(day) == 6, "sunday").otherwise("weekday")
    )


def service_moment(day: Column, secs: Column, tz: str) -> Column:
    """Schedule seconds of a service day as a moment. They count from noon minus twelve hours, which
    is midnight except on the two days a year the clocks change."""
    noon = F.to_utc_timestamp(day.cast("timestamp") + F.expr("interval 12 hours"), tz)
    return F.timestamp_micros(
        F.unix_micros(noon) + (secs.cast("long") - F.lit(43_200)) * F.lit(1_000_000)
    )
