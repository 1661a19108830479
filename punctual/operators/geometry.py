"""Route shapes and the places of stops and buses along them."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from punctual.config import DEFAULT, Config
from punctual.functions.geo import distance_m, utm
from punctual.functions.lines import nearest_fraction
from punctual.functions.shapewalk import Line, Lines, walk_together
from punctual.functions.timeutil import seconds

Tables = Mapping[str, DataFrame]


def shape_lines(t: Tables) -> DataFrame:
    """One row per route shape: its points in order with metres and running length, and the length
    on the ground. A shape is one street map line (hundreds of points, not data-sized)."""
    pts = t["shapes"].select(
        "feed_version_id",
        "shape_id",
        F.col("shape_pt_sequence").alias("seq"),
        F.col("shape_pt_lon").alias("lon"),
        F.col("shape_pt_lat").alias("lat"),
    )
    x, y = utm(F.col("lon"), F.col("lat"))
    shape = Window.partitionBy("feed_version_id", "shape_id").orderBy("seq")
    stepped = (
        pts.withColumn("x", x)
        .withColumn("y", y)
        .withColumn("before", F.lag(F.struct("lon", "lat", "x", "y")).over(shape))
        .withColumn(
            "step_m",
            F.coalesce(
                F.hypot(F.col("x") - F.col("before.x"), F.col("y") - F.col("before.y")), F.lit(0.0)
            ),
        )
        .withColumn(
            "ground_m",
            F.coalesce(
                distance_m(F.col("before.lon"), F.col("before.lat"), F.col("lon"), F.col("lat")), F.lit(0.0)
            ),
        )
        .withColumn("cum_m", F.sum("step_m").over(shape.rowsBetween(Window.unboundedPreceding, 0)))
    )
    return stepped.groupBy("feed_version_id", "shape_id").agg(
        F.array_sort(F.collect_list(F.struct("seq", "lon", "lat", "x", "y", "cum_m"))).alias("line"),
        F.count(F.lit(1)).alias("n_points"),
        F.sum("ground_m").alias("length_m"),
    )


_LINE = "__line"


def shape_walk(
    points: DataFrame,
    lines: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    cfg: Config = DEFAULT,
) -> DataFrame:
    """Adds (frac, dist_m) to ``points`` (which needs columns x, y, at_s), walking each group's
    points in order along the group's line (``lines``: keys, xs, ys). Groups without a line drop out.

    Each group's line is sent as one row sorted ahead of its points, and the task streams over the
    sorted rows; between Arrow batches it keeps only the last line and the furthest place reached. So a
    line is shipped once per group instead of once per point, and a group of any length needs constant
    memory. Inside a batch all groups, and the pieces of long ones, advance together."""
    keys, order = list(keys), list(order)
    fields = [f for f in points.schema.fields]
    array = "array<double>"
    point_rows = points.select(
        *[f.name for f in fields],
        F.lit(1).alias("__rank"),
        F.lit(None).cast(array).alias("__xs"),
        F.lit(None).cast(array).alias("__ys"),
    )
    line_rows = lines.select(
        *[F.col(f.name) if f.name in keys else F.lit(None).cast(f.dataType).alias(f.name) for f in fields],
        F.lit(0).alias("__rank"),
        F.col("xs").alias("__xs"),
        F.col("ys").alias("__ys"),
    )
    rows = (
        line_rows.unionByName(point_rows)
        .withColumn(_LINE, F.concat_ws("\x1f", *[F.col(k).cast("string") for k in keys]))
        .repartition(*keys)
        .sortWithinPartitions(*keys, "__rank", *order)
    )
    out_schema = T.StructType(
        fields + [T.StructField("frac", T.DoubleType()), T.StructField("dist_m", T.DoubleType())]
    )
    names = [f.name for f in fields]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, line, furthest, last_s = None, None, np.nan, 0.0
        for batch in batches:
            if batch.num_rows == 0:
                continue
            group = batch.column(_LINE).dictionary_encode()
            codes = group.indices.to_numpy(zero_copy_only=False)
            is_line = np.asarray(batch.column("__rank").to_numpy(zero_copy_only=False)) == 0
            xs, ys = batch.column("__xs"), batch.column("__ys")
            px, py, at = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("x", "y", "at_s"))
            bounds = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1], True])
            trips: list[tuple] = []
            for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
                name = group.dictionary[int(codes[lo])].as_py()
                if name != current:
                    current, line, furthest, last_s = name, None, np.nan, 0.0
                while lo < hi and is_line[lo]:
                    line = Line(xs[int(lo)].values.to_numpy(), ys[int(lo)].values.to_numpy())
                    lo += 1
                if line is not None and lo < hi:
                    trips.append((line, lo, hi, furthest, last_s))
            if not trips:
                continue
            shapes, starts, ends, reached, times = zip(*trips, strict=True)
            starts, ends = np.array(starts), np.array(ends)
            frac, off, far = walk_together(
                Lines(list(shapes)), np.arange(len(trips)), starts, ends, at, px, py, np.array(reached), np.array(times), cfg
            )
            if bounds[-1] == ends[-1]:  # the next batch may go on with the last trip
                furthest, last_s = far[ends[-1] - 1], at[ends[-1] - 1]
            keep = np.zeros(batch.num_rows, dtype=bool)
            for lo, hi in zip(starts, ends, strict=True):
                keep[lo:hi] = True
            kept = batch.filter(pa.array(keep))
            yield pa.RecordBatch.from_arrays(
                [kept.column(n) for n in names] + [pa.array(frac[keep]), pa.array(off[keep])],
                names=[*names, "frac", "dist_m"],
            )

    return rows.mapInArrow(walk, out_schema)


def _coordinates(lines: DataFrame) -> DataFrame:
    return lines.withColumn("xs", F.transform("line", lambda p: p["x"])).withColumn(
        "ys", F.transform("line", lambda p: p["y"])
    )


def stop_shape_fractions(
    t: Tables, lines: DataFrame | None = None, filled: DataFrame | None = None, cfg: Config = DEFAULT
) -> DataFrame:
    """Where along its trip's shape each stop lies. Scheduled times only set how far ahead the next
    stop may be. Stops out of order or too far off are not usable."""
    lines = shape_lines(t) if lines is None else lines
    filled = t["stop_times_filled"] if filled is None else filled
    key = ["feed_version_id", "trip_id"]
    stops = t["stops"].filter(F.col("location_type") == 0)
    x, y = utm(F.col("stop_lon"), F.col("stop_lat"))
    trips = t["trips"].select("feed_version_id", "trip_id", "shape_id")
    points = (
        filled.join(stops.select("feed_version_id", "stop_id", "stop_lon", "stop_lat"), ["feed_version_id", "stop_id"])
        .join(trips, key)
        .select(
            *key,
            "stop_sequence",
            "stop_id",
            "shape_id",
            x.alias("x"),
            y.alias("y"),
            F.coalesce(F.col("arrival_seconds"), F.lit(0)).cast("double").alias("at_s"),
        )
    )
    per_trip = trips.join(_coordinates(lines), ["feed_version_id", "shape_id"]).select(*key, "xs", "ys")
    walked = shape_walk(points, per_trip, key, ["stop_sequence"], cfg)
    earlier = Window.partitionBy(*key).orderBy("stop_sequence").rowsBetween(Window.unboundedPreceding, -1)
    reached = F.max("frac").over(earlier)
    return walked.withColumn("__reached", reached).select(
        *key,
        "stop_sequence",
        "stop_id",
        "shape_id",
        "frac",
        F.col("dist_m").alias("dist_to_shape_m"),
        (
            (F.col("__reached").isNull() | (F.col("frac") > F.col("__reached")))
            & (F.col("dist_m") < cfg.stop_usable_m)
        ).alias("is_usable"),
    )


def positions_along_shape(
    t: Tables, lines: DataFrame | None = None, versions: DataFrame | None = None, cfg: Config = DEFAULT
) -> DataFrame:
    """Each bus report placed along its trip's shape, by the schedule version of its day. Only lines
    of trips that reported are shipped."""
    lines = shape_lines(t) if lines is None else lines
    versions = t["feed_version_by_date"] if versions is None else versions
    key = ["trip_id", "service_date"]
    x, y = utm(F.col("longitude"), F.col("latitude"))
    points = (
        t["vehicle_position"]
        .filter(F.col("trip_id").isNotNull() & F.col("start_date").isNotNull())
        .select(
            "trip_id",
            F.col("start_date").alias("service_date"),
            "vehicle_id",
            F.col("position_timestamp").alias("ts"),
            x.alias("x"),
            y.alias("y"),
            seconds(F.col("position_timestamp")).alias("at_s"),
        )
    )
    per_trip = (
        points.select(*key)
        .distinct()
        .join(versions, "service_date")
        .join(t["trips"].select("feed_version_id", "trip_id", "shape_id"), ["feed_version_id", "trip_id"])
        .join(_coordinates(lines), ["feed_version_id", "shape_id"])
        .select(*key, "xs", "ys")
    )
    return shape_walk(points, per_trip, key, ["ts", "vehicle_id"], cfg).select(
        *key, "vehicle_id", "ts", "frac", F.col("dist_m").alias("off_route_m")
    )


def place_on_stretch(buses: DataFrame) -> DataFrame:
    """Adds bus_frac: the nearest point of a bus between two fractions of its line (columns x, y,
    line, lo, hi)."""
    return buses.withColumn("bus_frac", nearest_fraction(*map(F.col, ("line", "x", "y", "lo", "hi"))))
