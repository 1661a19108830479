"""Lines as columns against plain Python, and many trips walked together against one by one."""

from __future__ import annotations

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from punctual.config import DEFAULT
from punctual.functions import geo, lines, shapewalk
from punctual.functions.shapewalk import Line, Lines, Walker, walk_together

BENT = [(0, 0), (400, 0), (400, 300), (700, 300)]
LOOP = [(0, 0), (1000, 0), (1000, 1000), (0, 1000), (0, 0)]
OUT_AND_BACK = [(0, 0), (600, 0), (1200, 0), (1200, 12), (600, 12), (0, 12)]
DOUBLED = [(0, 0), (300, 0), (300, 0), (300, 200)]
SHAPES = {"bent": BENT, "loop": LOOP, "back": OUT_AND_BACK, "doubled": DOUBLED, "dot": [(5, 5), (5, 5)], "one": [(7, 8)]}
LINE = "name string, line array<struct<lon: double, lat: double, x: double, y: double, cum_m: double>>"


def told(points):
    at, out = 0.0, []
    for i, p in enumerate(points):
        at += math.dist(points[i - 1], p) if i else 0
        out.append((float(p[0]), float(p[1]), float(p[0]), float(p[1]), at))
    return out


@pytest.fixture(scope="module")
def shapes(spark):
    return spark.createDataFrame([(n, told(p)) for n, p in SHAPES.items()], LINE)


def plain_point(points, metres):
    left = metres
    for a, b in zip(points, points[1:]):
        d = math.dist(a, b)
        if left <= d and d > 0:
            return tuple(a[i] + (b[i] - a[i]) * left / d for i in (0, 1))
        left -= d
    return tuple(map(float, points[-1]))


def length(points):
    return sum(math.dist(a, b) for a, b in zip(points, points[1:]))


def test_point_at(shapes):
    got = shapes.withColumn("f", F.explode(F.sequence(F.lit(0), F.lit(20)))).select(
        "name", "f", lines.point_at(F.col("line"), F.col("f") / 20 * lines.total_m(F.col("line"))).alias("p")
    )
    for r in got.collect():
        points = SHAPES[r["name"]]
        expected = plain_point(points, r["f"] / 20 * length(points))
        assert math.dist((r["p"]["lon"], r["p"]["lat"]), expected) < 1e-6, r


def test_last_before_everywhere(spark):
    at = [0.0, 1.0, 1.0, 4.0, 9.0]
    df = spark.createDataFrame([("l", [(0.0, 0.0, 0.0, 0.0, a) for a in at])], LINE)
    for m, i in ((-1.0, 0), (0.0, 0), (0.5, 0), (1.0, 2), (3.9, 2), (4.0, 3), (8.0, 3), (9.0, 4), (99.0, 4)):
        assert df.select(lines.last_before(F.col("line"), F.lit(m))).first()[0] == i, m


def plain_nearest(points, px, py, lo, hi, steps=4000):
    total = length(points)
    hi = max(hi, lo + 1e-6)
    at = [lo + (min(hi, 1) - lo) * k / steps for k in range(steps + 1)]
    return min(math.dist(plain_point(points, f * total), (px, py)) for f in at)


def test_nearest_fraction(spark, shapes):
    rnd = random.Random(4)
    cases = []
    for name in ("bent", "loop", "back", "doubled"):
        for _ in range(12):
            lo = rnd.choice([0.0, rnd.random()])
            cases.append((name, rnd.uniform(-100, 1100), rnd.uniform(-100, 400), lo, min(1.0, lo + rnd.choice([0.0, 0.2, 1.0]))))
    df = spark.createDataFrame(cases, "name string, x double, y double, lo double, hi double").join(shapes, "name")
    f = lines.nearest_fraction(*map(F.col, ("line", "x", "y", "lo", "hi")))
    for r in df.withColumn("f", f).collect():
        points = SHAPES[r["name"]]
        assert r["lo"] - 1e-9 <= r["f"] <= max(r["hi"], r["lo"] + 1e-6) + 1e-9
        off = math.dist(plain_point(points, r["f"] * length(points)), (r["x"], r["y"]))
        assert off <= plain_nearest(points, r["x"], r["y"], r["lo"], r["hi"]) + 1e-6
    # of two passes of one street the first, within the stretch that is given
    both = shapes.filter("name = 'back'").select(
        lines.nearest_fraction(F.col("line"), F.lit(600.0), F.lit(6.0), F.lit(0.0), F.lit(1.0)).alias("a"),
        lines.nearest_fraction(F.col("line"), F.lit(600.0), F.lit(6.0), F.lit(0.5), F.lit(1.0)).alias("b"),
    ).first()
    assert both["a"] < 0.3 and both["b"] > 0.7
    dots = shapes.filter("name in ('dot', 'one')").select(lines.nearest_fraction(F.col("line"), F.lit(0.0), F.lit(0.0), F.lit(0.25), F.lit(1.0)))
    assert [r[0] for r in dots.collect()] == [0.25, 0.25]


def test_first_pass_equals_the_plain_one(spark, shapes):
    rnd = random.Random(6)
    cases = []
    for name in SHAPES:
        for _ in range(15 if name != "one" else 1):
            lo = rnd.choice([0.0, rnd.random(), 1.0])
            cases.append((name, rnd.uniform(-100, 1100), rnd.uniform(-100, 400), lo, lo + rnd.choice([0.0, 0.2, 1.0])))
    df = spark.createDataFrame(cases, "name string, x double, y double, lo double, hi double").join(shapes, "name")
    for r in df.withColumn("p", lines.first_pass(*map(F.col, ("line", "x", "y", "lo", "hi")))).collect():
        frac, off = shapewalk.first_pass(Line(*zip(*SHAPES[r["name"]])), r["x"], r["y"], r["lo"], r["hi"])
        assert abs(r["p"]["frac"] - frac) < 1e-9 and abs(r["p"]["dist_m"] - off) < 1e-6, r


def test_pieces(spark, shapes):
    cuts = [(0.0, 1.0), (0.1, 0.9), (0.3, 0.3), (0.8, 0.2), (-1.0, 2.0), (0.4, 0.41)]
    df = shapes.crossJoin(spark.createDataFrame(cuts, "lo double, hi double"))
    for r in df.withColumn("p", lines.piece(F.col("line"), F.col("lo"), F.col("hi"))).collect():
        points = SHAPES[r["name"]]
        total = length(points)
        a = min(max(r["lo"], 0), 1) * total
        b = max(min(max(r["hi"], 0), 1) * total, a)
        path = [(p["lon"], p["lat"]) for p in r["p"]]
        assert math.dist(path[0], plain_point(points, a)) < 1e-6 and math.dist(path[-1], plain_point(points, b)) < 1e-6
        assert abs(length(path) - (b - a)) < 1e-6
    bent = shapes.filter("name = 'bent'").select(lines.piece(F.col("line"), F.lit(0.1), F.lit(0.9)).alias("p")).first()["p"]
    assert [(p["lon"], p["lat"]) for p in bent] == [(100.0, 0.0), (400.0, 0.0), (400.0, 300.0), (600.0, 300.0)]
    nothing = shapes.select(lines.piece(F.col("line"), F.lit(None).cast("double"), F.lit(0.5)).alias("p"))
    assert {r["p"] for r in nothing.collect()} == {None} and nothing.select(lines.geojson(F.col("p"))).first()[0] is None


def test_geojson(shapes):
    text = shapes.filter("name = 'bent'").select(lines.geojson(lines.piece(F.col("line"), F.lit(0.0), F.lit(0.4)))).first()[0]
    assert json.loads(text) == {"type": "LineString", "coordinates": [[0.0, 0.0], [400.0, 0.0]]}


def test_no_python_in_the_plan(shapes):
    df = shapes.select(lines.nearest_fraction(F.col("line"), F.lit(1.0), F.lit(1.0), F.lit(0.0), F.lit(1.0)))
    assert "Python" not in df._jdf.queryExecution().toString()


def test_distance_of_nothing_is_nothing(spark):
    d = geo.distance_m(F.lit(None).cast("double"), F.lit(44.0), F.lit(-123.0), F.lit(44.0))
    assert spark.range(1).select(d).first()[0] is None


# --- many trips together -------------------------------------------------------------------


def random_trip(rnd, points, n):
    """Points along a line with noise, jumps back, places off the route and gaps in time."""
    total, at, out = length(points), 0.0, []
    now = rnd.uniform(0, 50)
    for _ in range(n):
        now += rnd.choice([15, 30, 30, 600]) if rnd.random() < 0.9 else 0
        at = min(at + rnd.uniform(0, 2.2 * total / n), total)
        x, y = plain_point(points, max(at - (rnd.uniform(0, 150) if rnd.random() < 0.2 else 0), 0))
        far = 400 if rnd.random() < 0.08 else 12
        out.append((now, x + rnd.uniform(-far, far), y + rnd.uniform(-far, far)))
    return out


@pytest.mark.parametrize("piece,few,places", [(64, 4, 2_000_000), (5, 1, 40), (1, 3, 2_000_000), (7, 10_000, 2_000_000)])
def test_walking_together_equals_one_by_one(monkeypatch, piece, few, places):
    for name, value in (("PIECE", piece), ("FEW", few), ("PLACES", places)):
        monkeypatch.setattr(shapewalk, name, value)
    rnd = random.Random(piece)
    shapes = [BENT, LOOP, OUT_AND_BACK, DOUBLED, [(5, 5), (5, 5)]]
    shapes += [[(rnd.uniform(0, 900), rnd.uniform(0, 900)) for _ in range(rnd.randint(2, 14))] for _ in range(20)]
    trips = [(s, random_trip(rnd, s, rnd.choice([1, 2, 9, 40, 300 if i < 3 else 20]))) for i, s in enumerate(shapes * 2)]
    made = [Line(*zip(*s)) for s, _ in trips]
    flat = np.array([p for _, t in trips for p in t])
    ends = np.cumsum([len(t) for _, t in trips])
    starts = ends - [len(t) for _, t in trips]
    none = np.full(len(trips), np.nan)
    frac, off, reached = walk_together(Lines(made), np.arange(len(trips)), starts, ends, flat[:, 0], flat[:, 1], flat[:, 2], none, np.zeros(len(trips)), DEFAULT)
    for line, s, e in zip(made, starts, ends, strict=True):
        w = Walker(DEFAULT)
        w.begin(line)
        for i in range(s, e):
            assert (frac[i], off[i]) == w.place(*flat[i])
            assert reached[i] == w.furthest or (w.furthest is None and np.isnan(reached[i]))


def test_a_trip_goes_on_where_the_batch_before_ended():
    rnd = random.Random(8)
    trip = np.array(random_trip(rnd, OUT_AND_BACK, 120))
    line = Line(*zip(*OUT_AND_BACK))
    one = lambda rows, f, t: walk_together(Lines([line]), np.array([0]), np.array([0]), np.array([len(rows)]), *rows.T, np.array([f]), np.array([t]))
    whole = one(trip, np.nan, 0.0)
    first = one(trip[:50], np.nan, 0.0)
    second = one(trip[50:], first[2][-1], trip[49, 0])
    for a, b, c in zip(whole, first, second, strict=True):
        np.testing.assert_array_equal(a, np.concatenate([b, c]))
