"""Lines as columns: places along a polyline by running length, found by binary search in the JVM.

A line is an array of points ``struct(lon, lat, x, y, cum_m)`` in order, ``cum_m`` the length up to the point
(``operators.geometry.shape_lines``). Fractions are of its whole length. A line of no length has its one
place at every fraction.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def total_m(line: Column) -> Column:
    return F.get(line, F.size(line) - 1)["cum_m"]


def last_before(line: Column, metres: Column) -> Column:
    """Index (from 0) of the last point at or before a distance along the line; 0 before the line."""
    halvings = F.greatest(F.lit(1), F.ceil(F.log2(F.size(line))).cast("int"))
    whole = F.struct(F.lit(0).alias("lo"), (F.size(line) - 1).alias("hi"))

    def halve(span: Column, _: Column) -> Column:
        middle = F.shiftright(span["lo"] + span["hi"] + 1, 1)
        here = F.get(line, middle)["cum_m"] <= metres
        return F.struct(
            F.when(here, middle).otherwise(span["lo"]).alias("lo"),
            F.when(here, span["hi"]).otherwise(F.greatest(middle - 1, span["lo"])).alias("hi"),
        )

    return F.aggregate(F.sequence(F.lit(1), halvings), whole, halve)["lo"]


def point_at(line: Column, metres: Column, fields: tuple[str, ...] = ("lon", "lat")) -> Column:
    """Struct of ``fields`` at a distance along the line, straight between its points."""
    i = F.least(last_before(line, metres), F.greatest(F.size(line) - 2, F.lit(0)))
    a, b = F.get(line, i), F.coalesce(F.get(line, i + 1), F.get(line, i))
    share = F.coalesce((metres - a["cum_m"]) / F.nullif(b["cum_m"] - a["cum_m"], F.lit(0.0)), F.lit(0.0))
    share = F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0))
    return F.struct(*[(a[f] + share * (b[f] - a[f])).alias(f) for f in fields])


def let(body: Callable[[Column], Column], **values: Column) -> Column:
    """``body`` of a struct of values, each of which is worked out once a row, however often ``body`` uses it."""
    return F.get(F.transform(F.array(F.struct(*[c.alias(n) for n, c in values.items()])), body), F.lit(0))


def _approaches(line: Column, v: Column) -> Column:
    """For the segments of the stretch between the distances ``v.a`` and ``v.b``, cut to it: how close they come to
    (``v.x``, ``v.y``), and where."""

    def of(i: Column) -> Column:
        return let(lambda s: let(lambda u: off(s, u["at"], i), at=spot(s)), p=F.get(line, i), q=F.get(line, i + 1))

    def spot(s: Column) -> Column:
        p, q = s["p"], s["q"]
        toward = (v["x"] - p["x"]) * (q["x"] - p["x"]) + (v["y"] - p["y"]) * (q["y"] - p["y"])
        along = F.coalesce(toward / F.nullif(q["cum_m"] - p["cum_m"], F.lit(0.0)), F.lit(0.0))
        return F.least(F.greatest(p["cum_m"] + along, v["a"], p["cum_m"]), v["b"], q["cum_m"])

    def off(s: Column, at: Column, i: Column) -> Column:
        p, q = s["p"], s["q"]
        share = F.coalesce((at - p["cum_m"]) / F.nullif(q["cum_m"] - p["cum_m"], F.lit(0.0)), F.lit(0.0))
        return let(
            lambda u: F.struct(
                F.hypot(p["x"] + u["share"] * (q["x"] - p["x"]) - v["x"], p["y"] + u["share"] * (q["y"] - p["y"]) - v["y"]).alias("off"),
                i.alias("i"),
                at.alias("at"),
            ),
            share=share,
        )

    return F.transform(F.sequence(last_before(line, v["a"]), F.least(last_before(line, v["b"]), F.size(line) - 2)), of)


def nearest_fraction(line: Column, x: Column, y: Column, lo: Column, hi: Column) -> Column:
    """Fraction of the place between two fractions that is closest to (x, y), the first of equal ones. Only the
    segments of the stretch are looked at."""

    def found(v: Column) -> Column:
        at = F.array_min(_approaches(line, v))["at"]
        return F.when((F.size(line) < 2) | (v["total"] == 0), F.greatest(lo, F.lit(0.0))).otherwise(at / v["total"])

    total = total_m(line)
    a, b = F.greatest(lo, F.lit(0.0)) * total, F.least(F.greatest(hi, lo + F.lit(1e-6)), F.lit(1.0)) * total
    return let(found, x=x, y=y, a=a, b=b, total=total)


def first_pass(line: Column, x: Column, y: Column, lo: Column, hi: Column, tolerance_m: float = 25.0) -> Column:
    """Struct (frac, dist_m) of the place on the first pass between two fractions: of the first unbroken run of
    segments within ``tolerance_m`` of the closest approach, the nearest."""

    def run(v: Column) -> Column:
        near = F.filter(v["met"], lambda m: m["off"] <= v["limit"])
        return let(lambda u: until_broken(v, u["first"]), first=F.array_min(F.transform(near, lambda m: m["i"])))

    def until_broken(v: Column, first: Column) -> Column:
        away = F.filter(v["met"], lambda m: (m["off"] > v["limit"]) & (m["i"] > first))
        inside = lambda end: F.filter(v["met"], lambda m: (m["i"] >= first) & (end.isNull() | (m["i"] < end)))
        return let(lambda u: F.array_min(inside(u["end"])), end=F.array_min(F.transform(away, lambda m: m["i"])))

    def found(v: Column) -> Column:
        spot = point_at(line, v["a"], ("x", "y"))
        plain = F.struct(v["lo"].alias("frac"), F.hypot(spot["x"] - v["x"], spot["y"] - v["y"]).alias("dist_m"))
        limit = lambda w: F.array_min(F.transform(w["met"], lambda m: m["off"])) + tolerance_m
        best = let(lambda w: let(run, met=w["met"], limit=limit(w)), met=_approaches(line, v))
        told = let(lambda w: F.struct(F.least(w["best"]["at"] / v["total"], F.lit(1.0)).alias("frac"), w["best"]["off"].alias("dist_m")), best=best)
        return F.when((F.size(line) < 2) | (v["total"] == 0) | (v["hi"] - v["lo"] < 1e-9), plain).otherwise(told)

    total = total_m(line)
    lo, hi = (F.least(F.greatest(f, F.lit(0.0)), F.lit(1.0)) for f in (lo, hi))
    return let(found, x=x, y=y, lo=lo, hi=hi, a=lo * total, b=hi * total, total=total)


def piece(line: Column, lo: Column, hi: Column) -> Column:
    """The points of the line between two fractions, both ends cut: array of ``struct(lon, lat)``. Null where a
    fraction is; both ends at one place where ``hi`` is not behind ``lo``."""
    total = total_m(line)
    a = F.least(F.greatest(lo, F.lit(0.0)), F.lit(1.0)) * total
    b = F.greatest(F.least(F.greatest(hi, F.lit(0.0)), F.lit(1.0)) * total, a)
    first, last = last_before(line, a), last_before(line, b)
    between = F.filter(F.slice(line, first + 2, F.greatest(last - first, F.lit(0))), lambda p: p["cum_m"] < b)
    inner = F.transform(between, lambda p: F.struct(p["lon"].alias("lon"), p["lat"].alias("lat")))
    cut = F.concat(F.array(point_at(line, a)), inner, F.array(point_at(line, b)))
    return F.when(lo.isNotNull() & hi.isNotNull(), cut)


def geojson(path: Column) -> Column:
    """A path as the text of a GeoJSON line."""
    pairs = F.transform(path, lambda p: F.array(p["lon"], p["lat"]))
    text = F.to_json(F.struct(F.lit("LineString").alias("type"), pairs.alias("coordinates")))
    return F.when(path.isNotNull(), text)
