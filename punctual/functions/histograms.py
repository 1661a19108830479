"""Error histograms that add up: running counts below fixed thresholds.

A percentile cannot be merged from day to day; a count of arrivals "no later than t" can. The marts
keep those counts, and a percentile for any period, route or stop is read off their sums.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: seconds off, early or late alike
ABS_THRESHOLDS = (15, 30, 45, 60, 90, 120, 150, 180, 240, 300, 360, 480, 600, 900)
# fixed values: seconds early (negative) or late
SIGNED_THRESHOLDS = tuple(-t for t in reversed(ABS_THRESHOLDS)) + (0,) + ABS_THRESHOLDS


def abs_name(t: int) -> str:
    return f"n_le_{t}s"


def signed_name(t: int) -> str:
    return f"n_sle_m{-t}s" if t < 0 else f"n_sle_{t}s"


ABS_NAMES = [abs_name(t) for t in ABS_THRESHOLDS]
SIGNED_NAMES = [signed_name(t) for t in SIGNED_THRESHOLDS]


def threshold_counts(error_s: Column) -> list[Column]:
    """All 14 + 29 counts as plain conditional counts, so they aggregate partially map-side."""
    return [F.count_if(F.abs(error_s) <= t).alias(abs_name(t)) for t in ABS_THRESHOLDS] + [
        F.count_if(error_s <= t).alias(signed_name(t)) for t in SIGNED_THRESHOLDS
    ]


def summed_counts(when: Column | None = None, names=None) -> list[Column]:
    """The counts of several rows added up, optionally only over rows matching ``when``."""
    pick = (lambda c: F.col(c)) if when is None else (lambda c: F.when(when, F.col(c)))
    return [F.sum(pick(c)).alias(c) for c in (names or ABS_NAMES + SIGNED_NAMES)]


def _read_off(share: float, n: Column, points: list[tuple[float, Column]], floor, ceiling: float) -> Column:
    """Straight line between neighbouring thresholds at the first one that reaches the share.

    The counts are one array; an index into it and its neighbour are all that the expression needs, so its
    size does not go with the number of thresholds."""
    want = F.lit(float(share)) * n.cast("double")
    times = F.array(*[F.lit(float(t)) for t, _ in points])
    counts = F.array(*[F.coalesce(c.cast("double"), F.lit(0.0)) for _, c in points])

    def value(first: Column) -> Column:
        here, t = F.get(counts, first), F.get(times, first)
        before = F.when(first > 0, F.get(counts, first - 1)).otherwise(F.lit(0.0))
        t0 = F.when(first > 0, F.get(times, first - 1)).otherwise(F.lit(float(floor[0] if floor else 0)))
        line = F.when(here == before, t if floor is None else t0).otherwise(t0 + (want - before) / (here - before) * (t - t0))
        return line if floor else F.when(first == 0, t).otherwise(line)

    reached = F.filter(F.transform(counts, lambda c, i: F.when(c >= want, i)), lambda i: i.isNotNull())
    # computed once, then used at several places
    read = F.transform(F.array(F.get(reached, F.lit(0))), value)
    return F.when(F.size(reached) > 0, F.get(read, F.lit(0))).otherwise(F.lit(float(ceiling)))


def signed_percentile(share: float, n: Column | None = None, get=F.col) -> Column:
    """Seconds (negative = earlier) below which ``share`` of the arrivals came; clamped to the
    outermost thresholds; null where there are no arrivals or no counts."""
    total = F.col("n") if n is None else n
    points = [(t, get(signed_name(t))) for t in SIGNED_THRESHOLDS]
    value = _read_off(share, total, points, None, SIGNED_THRESHOLDS[-1])
    return F.when(total.isNotNull() & (total != 0) & points[0][1].isNotNull(), value)


def abs_percentile_minutes(share: float, n: Column | None = None, get=F.col) -> Column:
    """Minutes off that ``share`` of the arrivals came within; the last threshold when more than
    that are further off."""
    total = F.col("n") if n is None else n
    points = [(t, get(abs_name(t))) for t in ABS_THRESHOLDS]
    value = _read_off(share, total, points, (0, F.lit(0.0)), ABS_THRESHOLDS[-1]) / F.lit(60.0)
    complete = F.lit(True)
    for _, count in points:
        complete = complete & count.isNotNull()
    return F.when(total.isNotNull() & (total != 0) & complete, value)
