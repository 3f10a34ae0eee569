"""Closed-form map projections as column expressions: WGS84 degrees, UTM zones 32 and 33, web mercator."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

A, INVERSE_FLATTENING, SCALE, EAST = 6378137.0, 298.257223563, 0.9996, 500000.0
N = 1 / (2 * INVERSE_FLATTENING - 1)
RADIUS = A / (1 + N) * (1 + N**2 / 4 + N**4 / 64)
# Series of the transverse mercator projection to the third order.
ALPHA = [N / 2 - 2 * N**2 / 3 + 5 * N**3 / 16, 13 * N**2 / 48 - 3 * N**3 / 5, 61 * N**3 / 240]
BETA = [N / 2 - 2 * N**2 / 3 + 37 * N**3 / 96, N**2 / 48 + N**3 / 15, 17 * N**3 / 480]
DELTA = [2 * N - 2 * N**2 / 3 - 2 * N**3, 7 * N**2 / 3 - 8 * N**3 / 5, 56 * N**3 / 15]
ZONES = {"EPSG:25832": 9.0, "EPSG:25833": 15.0}
#: Plausible coordinate windows (xmin, xmax, ymin, ymax), in order of preference. Fixed values.
WINDOWS = {
    "EPSG:4326": (5.0, 20.0, 45.0, 60.0),
    "EPSG:3857": (5.0 * 111320, 20.0 * 111320, 45.0 * 110540, 60.0 * 110540),
    "EPSG:25832": (200000.0, 700000.0, 5200000.0, 6150000.0),
    "EPSG:25833": (200000.0, 900000.0, 5200000.0, 6200000.0),
}


def to_utm(lon: Column, lat: Column, crs: str) -> Column:
    k = 2 * math.sqrt(N) / (1 + N)
    phi, lam = F.radians(lat), F.radians(lon - ZONES[crs])
    t = F.sinh(F.atanh(F.sin(phi)) - k * F.atanh(k * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    x = eta + sum((a * F.cos(2 * j * xi) * F.sinh(2 * j * eta) for j, a in enumerate(ALPHA, 1)), F.lit(0.0))
    y = xi + sum((a * F.sin(2 * j * xi) * F.cosh(2 * j * eta) for j, a in enumerate(ALPHA, 1)), F.lit(0.0))
    return F.struct((EAST + SCALE * RADIUS * x).alias("x"), (SCALE * RADIUS * y).alias("y"))


def from_utm(x: Column, y: Column, crs: str) -> Column:
    xi, eta = y / (SCALE * RADIUS), (x - EAST) / (SCALE * RADIUS)
    xi1 = xi - sum((b * F.sin(2 * j * xi) * F.cosh(2 * j * eta) for j, b in enumerate(BETA, 1)), F.lit(0.0))
    eta1 = eta - sum((b * F.cos(2 * j * xi) * F.sinh(2 * j * eta) for j, b in enumerate(BETA, 1)), F.lit(0.0))
    chi = F.asin(F.sin(xi1) / F.cosh(eta1))
    phi = chi + sum((d * F.sin(2 * j * chi) for j, d in enumerate(DELTA, 1)), F.lit(0.0))
    return F.struct((F.degrees(F.atan2(F.sinh(eta1), F.cos(xi1))) + ZONES[crs]).alias("x"), F.degrees(phi).alias("y"))


def reprojected(x: Column, y: Column, source: str, target: str) -> Column:
    """Struct x, y in the target system; source and target may be any of WINDOWS."""
    if source == target:
        return F.struct(x.alias("x"), y.alias("y"))
    if source in ZONES:
        p = from_utm(x, y, source)
        x, y = p["x"], p["y"]
    elif source == "EPSG:3857":
        x, y = F.degrees(x / A), F.degrees(2 * F.atan(F.exp(y / A)) - math.pi / 2)
    if target in ZONES:
        return to_utm(x, y, target)
    if target == "EPSG:3857":
        return F.struct((F.radians(x) * A).alias("x"), (F.log(F.tan(F.radians(y) / 2 + math.pi / 4)) * A).alias("y"))
    return F.struct(x.alias("x"), y.alias("y"))


def guessed(xmin: Column, xmax: Column, ymin: Column, ymax: Column) -> Column:
    """The first system whose window holds the extent, or null."""
    out = F.lit(None).cast("string")
    for name, (a, b, c, d) in reversed(WINDOWS.items()):
        out = F.when((xmin >= a) & (xmax <= b) & (xmax >= a) & (xmin <= b) & (ymin >= c) & (ymax <= d) & (ymax >= c) & (ymin <= d), name).otherwise(out)
    return out


def valid_degrees(x: Column, y: Column) -> Column:
    x, y = x.try_cast("double"), y.try_cast("double")
    return F.coalesce(x.between(-180, 180) & y.between(-90, 90), F.lit(False))


def or_placeholder(x: Column, y: Column) -> Column:
    """Rows without a place get one far in the north."""
    return F.struct(F.coalesce(x, F.lit(0.0)).alias("x"), F.coalesce(y, F.lit(85.0)).alias("y"))
