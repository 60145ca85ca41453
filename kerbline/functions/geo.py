"""Distances on the sphere and in a flat frame, as plain column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6371008.8
METRES_PER_DEGREE = EARTH_RADIUS_M * 3.141592653589793 / 180.0

# The longitude / latitude range that Great Britain lies in.
GB_LON = (-9.0, 2.5)
GB_LAT = (49.5, 61.5)


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def haversine_m(lon1, lat1, lon2, lat2) -> Column:
    lon1, lat1, lon2, lat2 = map(_col, (lon1, lat1, lon2, lat2))
    s1 = F.sin(F.radians(lat2 - lat1) / 2)
    s2 = F.sin(F.radians(lon2 - lon1) / 2)
    h = s1 * s1 + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * s2 * s2
    return 2 * EARTH_RADIUS_M * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def lonlat(a) -> Column:
    """``[lon, lat]`` array to a struct."""
    a = _col(a)
    return F.struct(F.get(a, F.lit(0)).alias("lon"), F.get(a, F.lit(1)).alias("lat"))


def in_gb(lon, lat) -> Column:
    return _col(lon).between(*GB_LON) & _col(lat).between(*GB_LAT)


def lon_scale(lat) -> Column:
    """Metres per degree of longitude at a latitude; worth a column of its own before a join."""
    return F.cos(F.radians(_col(lat))) * METRES_PER_DEGREE


def _leg_frame(plon, plat, alon, alat, blon, blat, scale):
    """Vector from leg start to point and from leg start to leg end, in metres, in a flat frame.

    The scale is taken at the point, so cutting a leg into pieces changes no distance.
    """
    plon, plat, alon, alat, blon, blat = map(_col, (plon, plat, alon, alat, blon, blat))
    kx = lon_scale(plat) if scale is None else _col(scale)
    bx, by = (blon - alon) * kx, (blat - alat) * METRES_PER_DEGREE
    px, py = (plon - alon) * kx, (plat - alat) * METRES_PER_DEGREE
    return px, py, bx, by


def leg_fraction(plon, plat, alon, alat, blon, blat, scale=None) -> Column:
    """Where on the leg the nearest point lies, 0 to 1; 0 for a leg of no length."""
    px, py, bx, by = _leg_frame(plon, plat, alon, alat, blon, blat, scale)
    along, n = px * bx + py * by, bx * bx + by * by
    return F.when(along <= 0, 0.0).when(along >= n, 1.0).otherwise(along / n)


def point_leg_m(plon, plat, alon, alat, blon, blat, scale=None) -> Column:
    """Distance from a point to a leg; cheap arithmetic only, as it is used as a join condition."""
    px, py, bx, by = _leg_frame(plon, plat, alon, alat, blon, blat, scale)
    along, n, cross = px * bx + py * by, bx * bx + by * by, px * by - py * bx
    qx, qy = px - bx, py - by
    return F.sqrt(F.when(along <= 0, px * px + py * py).when(along >= n, qx * qx + qy * qy).otherwise(cross * cross / n))


def polyline_m(path) -> Column:
    """Length of an ``array<struct<lon,lat>>``; 0 for fewer than two points."""
    path = _col(path)
    n = F.coalesce(F.size(path), F.lit(0))
    legs = F.when(n >= 2, F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>"))

    def add(acc, i):
        a, b = F.get(path, i - 1), F.get(path, i)
        return acc + haversine_m(a["lon"], a["lat"], b["lon"], b["lat"])

    return F.aggregate(legs, F.lit(0.0), add)
