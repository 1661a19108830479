"""Points as columns: projection to metres and distance on the sphere."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: WGS84 ellipsoid, mean radius, and the UTM grid
WGS84_A = 6378137.0
WGS84_F = 1 / 298.257223563
EARTH_RADIUS_M = 6371008.8
UTM_SCALE = 0.9996
UTM_FALSE_EASTING = 500000.0


def utm(lon: Column, lat: Column, zone: int = 10) -> tuple[Column, Column]:
    """Longitude and latitude (degrees) to northern UTM easting and northing in metres: the
    transverse Mercator series in the third flattening, to third order (millimetres)."""
    n = WGS84_F / (2 - WGS84_F)
    radius = WGS84_A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (
        n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16,
        13 * n**2 / 48 - 3 * n**3 / 5,
        61 * n**3 / 240,
    )
    ecc = 2 * math.sqrt(n) / (1 + n)
    central = math.radians(zone * 6 - 183)

    sin_lat = F.sin(F.radians(lat))
    conformal = F.sinh(F.atanh(sin_lat) - F.lit(ecc) * F.atanh(F.lit(ecc) * sin_lat))
    off = F.radians(lon) - F.lit(central)
    xi = F.atan2(conformal, F.cos(off))
    eta = F.atanh(F.sin(off) / F.sqrt(F.lit(1.0) + conformal * conformal))
    east, north = eta, xi
    for j, a in enumerate(alpha, start=1):
        east = east + F.lit(a) * F.cos(F.lit(2.0 * j) * xi) * F.sinh(F.lit(2.0 * j) * eta)
        north = north + F.lit(a) * F.sin(F.lit(2.0 * j) * xi) * F.cosh(F.lit(2.0 * j) * eta)
    grid = F.lit(UTM_SCALE * radius)
    return F.lit(UTM_FALSE_EASTING) + grid * east, grid * north


def distance_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle metres; within 0.5 % of the ellipsoid. Null where a coordinate is."""
    dlat = F.radians(lat2 - lat1) / 2
    dlon = F.radians(lon2 - lon1) / 2
    chord = F.pow(F.sin(dlat), F.lit(2.0)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(
        F.sin(dlon), F.lit(2.0)
    )
    # rounding can take the chord just over 1; ``least`` would take 1 for a null as well
    return F.lit(2 * EARTH_RADIUS_M) * F.asin(F.sqrt(F.when(chord > 1, F.lit(1.0)).otherwise(chord)))
