"""Projection, distance and the walk along shapes that pass a street twice."""

from __future__ import annotations

import math
import random

from pyspark.sql import functions as F

from punctual.functions import geo
from punctual.functions.shapewalk import Line, Walker, first_pass
from punctual.operators import geometry

OUT_AND_BACK = Line([0, 250, 500, 750, 1000, 750, 500, 250, 0], [0, 0, 0, 0, 5, 10, 10, 10, 10])
LOOP = Line([0, 1000, 1000, 0, 0], [0, 0, 1000, 1000, 0])


def meridian_arc(degrees):
    """Distance from the equator along a meridian, by the series in the eccentricity."""
    a, f, p = geo.WGS84_A, geo.WGS84_F, math.radians(degrees)
    e = f * (2 - f)
    return a * (
        (1 - e / 4 - 3 * e**2 / 64 - 5 * e**3 / 256) * p
        - (3 * e / 8 + 3 * e**2 / 32 + 45 * e**3 / 1024) * math.sin(2 * p)
        + (15 * e**2 / 256 + 45 * e**3 / 1024) * math.sin(4 * p)
        - 35 * e**3 / 3072 * math.sin(6 * p)
    )


def test_utm_known_points(spark):
    df = spark.createDataFrame([(-123.0, 0.0), (-123.0, 44.0), (-123.0930, 44.0525)], "lon double, lat double")
    x, y = geo.utm(F.col("lon"), F.col("lat"))
    got = df.select(x.alias("x"), y.alias("y")).collect()
    assert abs(got[0]["x"] - 500000) < 1e-3 and abs(got[0]["y"]) < 1e-3
    assert abs(got[1]["x"] - 500000) < 1e-3 and abs(got[1]["y"] - 0.9996 * meridian_arc(44)) < 1e-3
    assert 492_400 < got[2]["x"] < 492_700 and 4_877_500 < got[2]["y"] < 4_878_000


def test_distance_between_fixture_stops(spark):
    df = spark.range(1).select(geo.distance_m(F.lit(-123.0930), F.lit(44.0525), F.lit(-123.0900), F.lit(44.0560)).alias("m"))
    assert 300 < df.first()["m"] < 600


def test_first_pass_takes_the_way_out(spark):
    frac, off = first_pass(OUT_AND_BACK, 500, 8, 0, 1)
    assert abs(frac - 0.25) < 0.01 and abs(off - 8) < 0.1  # the way back is nearer, but second
    back, _ = first_pass(OUT_AND_BACK, 500, 8, 0.5, 1)
    assert abs(back - 0.75) < 0.01


def test_first_pass_clamps_and_collapses():
    assert first_pass(LOOP, 0, 0, -3, -1)[0] == 0
    assert first_pass(LOOP, 0, 0, 2, 3)[0] == 1
    assert first_pass(Line([5, 5], [5, 5]), 8, 9, 0, 1) == (0, 5.0)


def test_walk_out_and_back_advances():
    w = Walker()
    w.begin(OUT_AND_BACK)
    path = [(0, 0), (400, 2), (900, 1), (990, 5), (600, 7), (100, 9)]
    fracs = [w.place(i * 30.0, x, y)[0] for i, (x, y) in enumerate(path)]
    assert fracs == sorted(fracs) and fracs[-1] > 0.9 and 0.4 < fracs[2] < 0.5


def test_off_route_points_do_not_advance():
    w = Walker()
    w.begin(LOOP)
    w.place(0, 100, 0)
    before = w.furthest
    w.place(30, 500, 500)
    assert w.furthest == before


def test_long_gap_searches_the_rest():
    w = Walker()
    w.begin(Line([0, 20000], [0, 0]))
    w.place(0, 0, 0)
    assert abs(w.place(1, 15000, 0)[0] - 0.75) < 1e-9


def slow_first_pass(points, px, py, lo, hi):
    """The same rule, one segment at a time."""
    seg = list(zip(points, points[1:]))
    total = sum(math.dist(a, b) for a, b in seg)
    cut, at = [], 0.0
    for a, b in seg:
        length = math.dist(a, b)
        s, e = max(lo * total, at), min(hi * total, at + length)
        if length and e > s:
            pt = lambda m: tuple(a[i] + (b[i] - a[i]) * (m - at) / length for i in (0, 1))
            cut.append((s, pt(s), pt(e)))
        at += length
    best = []
    for s, a, b in cut:
        d2 = math.dist(a, b) ** 2
        k = 0 if d2 == 0 else min(1, max(0, ((px - a[0]) * (b[0] - a[0]) + (py - a[1]) * (b[1] - a[1])) / d2))
        best.append((math.dist((a[0] + k * (b[0] - a[0]), a[1] + k * (b[1] - a[1])), (px, py)), s + k * math.sqrt(d2)))
    limit = min(d for d, _ in best) + 25
    start = next(i for i, (d, _) in enumerate(best) if d <= limit)
    stop = next((i for i in range(start, len(best)) if best[i][0] > limit), len(best))
    d, m = min(best[start:stop], key=lambda x: x[0])
    return m / total, d


def test_first_pass_equals_the_slow_rule():
    rnd = random.Random(5)
    for _ in range(200):
        pts = [(rnd.uniform(0, 500), rnd.uniform(0, 500)) for _ in range(rnd.randint(3, 12))]
        lo = rnd.uniform(0, 0.7)
        hi = lo + rnd.uniform(0.05, 0.3)
        p = (rnd.uniform(0, 500), rnd.uniform(0, 500))
        frac, off = first_pass(Line(*zip(*pts)), *p, lo, hi)
        slow, slow_off = slow_first_pass(pts, *p, lo, hi)
        assert abs(off - slow_off) < 1e-6 and abs(frac - slow) < 1e-6


def test_walk_on_spark_equals_the_walker_across_batches(spark):
    """One long trip in many Arrow batches, others around it, one without a line."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rnd = random.Random(1)
        data = [(f"T{k}", i, i * 30.0, i * 20.0 + rnd.uniform(-9, 9), rnd.uniform(-9, 9)) for k in range(4) for i in range(60 if k == 0 else 5)]
        points = spark.createDataFrame(data, "trip string, i int, at_s double, x double, y double")
        lines = spark.createDataFrame([(f"T{k}", [0.0, 700.0, 1500.0], [0.0, 0.0, 0.0]) for k in range(3)], "trip string, xs array<double>, ys array<double>")
        got = {(r["trip"], r["i"]): (r["frac"], r["dist_m"]) for r in geometry.shape_walk(points, lines, ["trip"], ["i"]).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    assert len(got) == 70  # T3 has no line
    w = Walker()
    w.begin(Line([0, 700, 1500], [0, 0, 0]))
    for trip, i, at, x, y in data[:60]:
        assert got[(trip, i)] == w.place(at, x, y)
