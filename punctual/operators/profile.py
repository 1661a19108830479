"""Pre-aggregated delay profiles.

Exact percentiles over many groups are cheap once the rows are a histogram: errors are whole
seconds, so (group, second) -> count is a plain hash aggregation with a map-side combine, bounded by
the number of distinct seconds, and everything after it (grouping sets, percentiles, shares) works
on the histogram. A group that holds a third of all rows is a few thousand histogram rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def histogram(df: DataFrame, keys: Sequence[str], value: str, **extra: Column) -> DataFrame:
    """(keys, value) -> n, plus any extra partial aggregates."""
    return df.groupBy(*keys, value).agg(
        F.count(F.lit(1)).alias("n"), *[c.alias(k) for k, c in extra.items()]
    )


def percentiles(value: Column, shares: Sequence[float], weight: Column | None = None) -> Column:
    """One array with several exact interpolated percentiles, read in a single pass."""
    wanted = F.array(*[F.lit(float(s)) for s in shares])
    if weight is None:
        return F.percentile(value, wanted)
    return F.percentile(value, wanted, weight)


def unpacked(df: DataFrame, packed: str, names: Sequence[str]) -> DataFrame:
    """Spread the array of ``percentiles`` over named columns."""
    kept = [c for c in df.columns if c != packed]
    return df.select(*kept, *[F.col(packed)[i].alias(name) for i, name in enumerate(names)])


def weighted_mean(value: Column, weight: Column) -> Column:
    return F.sum(value * weight) / F.sum(weight)


def grouping_sets(df: DataFrame, sets: Sequence[Sequence[str]], cols: Sequence[str], *aggs: Column) -> DataFrame:
    """``GROUP BY GROUPING SETS``; ``cols`` lists every grouping column once."""
    return df.groupingSets(
        [[F.col(c) for c in s] for s in sets], *[F.col(c) for c in cols]
    ).agg(*aggs)


def pct(part: Column, whole: Column, digits: int = 0) -> Column:
    """A share in per cent, rounded half away from zero; null for an empty whole."""
    return F.round(F.lit(100.0) * part / F.nullif(whole, F.lit(0)), digits)


def exact_percentiles(
    df: DataFrame, keys: Sequence[str], value: str, wanted: dict[str, float], width: float = 1.0
) -> DataFrame:
    """Exact interpolated percentiles of a continuous value per group: (keys, n, one column each).

    ``percentile`` would hold every distinct value of a group in one task. Here equal values are
    counted first, so that one value with most of the rows is one row. A histogram of ``width``-wide
    cells then finds which cells hold the ranks asked for, and only those cells' distinct values get
    a running count. The cells of a group are spread over tasks."""
    keys = list(keys)
    rows = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__n"))
    rows = rows.withColumn("__cell", F.floor(F.col(value) / F.lit(width)))
    group = Window.partitionBy(*keys)
    cells = (
        rows.groupBy(*keys, "__cell")
        .agg(F.sum("__n").alias("__in"))
        .withColumn("__upto", F.sum("__in").over(group.orderBy("__cell").rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("n", F.sum("__in").over(group))
    )
    before = F.col("__upto") - F.col("__in")
    spot = {name: F.lit(float(share)) * (F.col("n") - 1) for name, share in wanted.items()}
    holds = F.lit(False)
    for pos in spot.values():
        for rank in (F.floor(pos), F.ceil(pos)):
            holds = holds | ((before <= rank) & (rank < F.col("__upto")))
    needed = cells.filter(holds).withColumn("__before", before).drop("__in", "__upto")
    on = [F.col(f"r.{k}").eqNullSafe(F.col(f"c.{k}")) for k in [*keys, "__cell"]]
    upto = Window.partitionBy(*keys, "__cell").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    ranked = (
        rows.alias("r")
        .join(needed.alias("c"), on)
        .select("r.*", "c.n", "c.__before")
        .withColumn("__end", F.col("__before") + F.sum("__n").over(upto))
    )
    at = lambda rank: F.when((F.col("__end") - F.col("__n") <= rank) & (rank < F.col("__end")), F.col(value))
    aggs = []
    for name, pos in spot.items():
        aggs += [F.max(at(F.floor(pos))).alias(f"__{name}_lo"), F.max(at(F.ceil(pos))).alias(f"__{name}_hi")]
    picked = ranked.groupBy(*keys, "n").agg(*aggs)
    out = []
    for name, pos in spot.items():
        lo, hi = F.col(f"__{name}_lo"), F.col(f"__{name}_hi")
        out.append((lo + (hi - lo) * (pos - F.floor(pos))).alias(name))
    return picked.select(*keys, "n", *out)
