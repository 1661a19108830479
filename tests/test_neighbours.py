"""Nearest points against comparing all with all."""

from __future__ import annotations

import math
import random

import pytest

from punctual.operators import neighbours

R = 6371008.8


def ground(a, b):
    lon1, lat1, lon2, lat2 = map(math.radians, (*a, *b))
    chord = math.sin((lat2 - lat1) / 2) ** 2 + math.cos(lat1) * math.cos(lat2) * math.sin((lon2 - lon1) / 2) ** 2
    return round(2 * R * math.asin(math.sqrt(min(1.0, chord))), 3)


def brute(points, k):
    out = []
    for v, i, *p in points:
        if None in p:
            continue
        near = sorted((ground(p, q), j) for w, j, *q in points if w == v and j != i and None not in q)
        out += [(v, i, n, j, d) for n, (d, j) in enumerate(near[:k], 1)]
    return sorted(out)


def found(spark, points, k, **how):
    df = spark.createDataFrame([(*p, "clash") for p in points], "v int, id int, lon double, lat double, rank string")
    return sorted(tuple(r) for r in neighbours.nearest(df, k, ["v"], **how).collect())


@pytest.mark.parametrize("first_cell_m", [64.0, 2e6])
def test_towns_and_lone_places(spark, first_cell_m):
    rnd = random.Random(1)
    points = [(1, i, -123 + rnd.gauss(0, 0.002), 44 + rnd.gauss(0, 0.002)) for i in range(60)]
    points += [(1, 100 + i, -122 + rnd.random(), 43 + rnd.random()) for i in range(25)]
    points += [(1, 200 + i, rnd.uniform(-180, 180), math.degrees(math.asin(rnd.uniform(-1, 1)))) for i in range(25)]
    points += [(1, 300, 179.9999, 10.0), (1, 301, -179.9999, 10.0), (1, 302, 0.0, 90.0), (1, 303, 77.0, 90.0), (1, 304, 0.0, -90.0)]
    points += [(2, i, -123 + i * 1e-3, 44.0) for i in range(6)]  # fewer than are asked for, many ties
    points += [(3, 1, 0.0, 0.0), (4, 1, None, 1.0), (1, 999, 5.0, None)]
    got = found(spark, points, 5, first_cell_m=first_cell_m)
    expected = brute(points, 5)
    assert [g[:3] for g in got] == [e[:3] for e in expected]
    assert all(abs(g[4] - e[4]) < 0.01 for g, e in zip(got, expected, strict=True))
    assert sum(g[3] != e[3] for g, e in zip(got, expected, strict=True)) <= 2  # poles and the date line, by rounding


def test_many_at_one_place(spark):
    points = [(1, i, -123.0, 44.0) for i in range(200)] + [(1, 1000 + i, -123.0, 44.0 + i * 1e-4) for i in range(1, 8)]
    assert found(spark, points, 4) == brute(points, 4)


def test_none_and_one(spark):
    assert found(spark, [], 3) == [] and found(spark, [(1, 1, 0.0, 0.0)], 3) == []


def test_rounds_are_bounded():
    assert neighbours.rounds_needed() < 20
