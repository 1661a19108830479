"""The nearest points of every point on the ground, without comparing all with all.

Points stand on the sphere, in cells of a cube grid. A round compares the points still open with those of their own
and the adjoining cells; whatever lies elsewhere is further away than a cell is long, so a point whose k-th
nearest is closer than that is done. The others go on with cells twice as long. Where many points lie together a
small cell is enough; a point that needs a large cell has few others near it, so few points look into any
one large cell.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from punctual.functions.geo import EARTH_RADIUS_M, distance_m
from punctual.session import shared_folder

_AXES = ("x", "y", "z")
#: Distances are told, and compared, by the millimetre; ties go to the smaller id.
_DIGITS, _SLACK = 3, 0.01


def _on_sphere() -> list[Column]:
    lon, lat = F.radians("lon"), F.radians("lat")
    r = F.lit(EARTH_RADIUS_M)
    return [(r * F.cos(lat) * F.cos(lon)).alias("x"), (r * F.cos(lat) * F.sin(lon)).alias("y"), (r * F.sin(lat)).alias("z")]


def _cells(size: float) -> list[Column]:
    return [F.floor(F.col(a) / size).alias(f"c{a}") for a in _AXES]


def nearest(points: DataFrame, k: int, by: Sequence[str] = (), first_cell_m: float = 64.0) -> DataFrame:
    """``points(*by, id, lon, lat)`` -> ``(*by, id, rank, near_id, distance_m)``: the k nearest others of the same ``by``
    (all, where there are fewer), ties to the smaller id. Points without a place take no part; ids are unique
    within ``by``.

    Points at one place are one place with their k + 1 smallest ids: no other of them can be among anybody's
    nearest. Each round's open places and answers are written tables."""
    by = list(by)
    spark = points.sparkSession
    folder = f"{shared_folder(spark)}/neighbours-{uuid.uuid4().hex}"

    def stored(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    points = points.filter("lon is not null and lat is not null").select(*by, "id", "lon", "lat")
    place = [*by, "lon", "lat"]
    first_ids = Window.partitionBy(*place).orderBy("id")
    known = points.withColumn("n", F.row_number().over(first_ids)).filter(F.col("n") <= k + 1)
    known = stored(known.select(*by, "lon", "lat", F.col("id").alias("near_id"), *_on_sphere()), "known")
    open_ = stored(known.select(*place, *_AXES).distinct(), "open")
    answers: list[DataFrame] = []
    size, round_ = first_cell_m, 0
    # a cell as long as the globe's diameter: the adjoining ones hold every point
    while True:
        last = size >= 2 * EARTH_RADIUS_M
        asked = open_
        for a in _AXES:  # one axis after another: a generator each
            asked = asked.withColumn(f"c{a}", F.explode(F.array(*[F.floor(F.col(a) / size) + s for s in (-1, 0, 1)])))
        asked = asked.select(*by, F.col("lon").alias("lon0"), F.col("lat").alias("lat0"), *[f"c{a}" for a in _AXES])
        there = known.select(*by, "lon", "lat", "near_id", *_cells(size))
        d = F.round(distance_m(F.col("lon0"), F.col("lat0"), F.col("lon"), F.col("lat")), _DIGITS)
        near = Window.partitionBy(*by, "lon0", "lat0").orderBy("d", "near_id")
        met = (
            asked.join(there, [*by, *[f"c{a}" for a in _AXES]])
            .select(*by, F.col("lon0"), F.col("lat0"), "near_id", d.alias("d"))
            .withColumn("rank", F.row_number().over(near))
            .filter(F.col("rank") <= k + 1)
        )
        told = met.groupBy(*by, F.col("lon0").alias("lon"), F.col("lat0").alias("lat")).agg(
            F.array_sort(F.collect_list(F.struct("d", "near_id"))).alias("near")  # k + 1 at most
        )
        sure = F.lit(last) | ((F.size("near") > k) & (F.get("near", F.lit(k))["d"] <= size - _SLACK))
        told = stored(told.withColumn("sure", sure), f"round={round_}")
        answers.append(told.filter("sure").drop("sure"))
        left = open_.join(told.filter("not sure").select(*place), place, "left_semi")
        open_ = stored(left, f"open={round_}")
        if last or open_.isEmpty():
            break
        size, round_ = min(size * 2, 2 * EARTH_RADIUS_M), round_ + 1
    lists = answers[0]
    for a in answers[1:]:
        lists = lists.unionByName(a)
    others = F.slice(F.filter("near", lambda p: p["near_id"] != F.col("id")), 1, k)
    return (
        points.join(lists, place)
        .select(*by, "id", F.posexplode(others).alias("i", "p"))
        .select(*by, "id", (F.col("i") + 1).alias("rank"), "p.near_id", F.col("p.d").alias("distance_m"))
    )


def rounds_needed(first_cell_m: float = 64.0) -> int:
    """Most rounds there can be, whatever the points."""
    return 1 + math.ceil(math.log2(2 * EARTH_RADIUS_M / first_cell_m))
