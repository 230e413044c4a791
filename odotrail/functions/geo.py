"""Geodesic and planar column functions (degrees in, metres and degrees out)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Metres, fixed values: mean radius for distances, equatorial radius for inertial positions.
MEAN_RADIUS = 6371000.0
EQUATORIAL_RADIUS = 6378137.0
DEGREE = math.pi / 180


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(float(x))


def haversine_m(lat1, lon1, lat2, lon2, radius: float = MEAN_RADIUS) -> Column:
    """Great-circle distance; the haversine is clipped to [0, 1] so that rounding gives no NaN."""
    lat1, lon1, lat2, lon2 = map(_c, (lat1, lon1, lat2, lon2))
    a = F.pow(F.sin((lat2 - lat1) * DEGREE / 2), 2) + F.cos(lat1 * DEGREE) * F.cos(lat2 * DEGREE) * F.pow(F.sin((lon2 - lon1) * DEGREE / 2), 2)
    clipped = F.when(a > 1, 1.0).when(a < 0, 0.0).otherwise(a)
    return 2 * radius * F.asin(F.sqrt(clipped))


def normalize_heading(x) -> Column:
    """Degrees in [0, 360)."""
    return F.pmod(_c(x), F.lit(360.0))


def initial_bearing_deg(lat1, lon1, lat2, lon2) -> Column:
    lat1, lon1, lat2, lon2 = map(_c, (lat1, lon1, lat2, lon2))
    turn = (lon2 - lon1) * DEGREE
    y = F.sin(turn) * F.cos(lat2 * DEGREE)
    x = F.cos(lat1 * DEGREE) * F.sin(lat2 * DEGREE) - F.sin(lat1 * DEGREE) * F.cos(lat2 * DEGREE) * F.cos(turn)
    return normalize_heading(F.degrees(F.atan2(y, x)))


def destination_point(lat, lon, bearing, distance, radius: float = MEAN_RADIUS) -> Column:
    """struct(lat, lon) of the point ``distance`` metres from (lat, lon) along ``bearing``."""
    lat, lon, bearing, distance = map(_c, (lat, lon, bearing, distance))
    arc, way, phi = distance / radius, bearing * DEGREE, lat * DEGREE
    phi2 = F.asin(F.sin(phi) * F.cos(arc) + F.cos(phi) * F.sin(arc) * F.cos(way))
    turn = F.atan2(F.sin(way) * F.sin(arc) * F.cos(phi), F.cos(arc) - F.sin(phi) * F.sin(phi2))
    return F.struct(F.degrees(phi2).alias("lat"), (F.pmod(lon + F.degrees(turn) + 540.0, F.lit(360.0)) - 180.0).alias("lon"))


def angular_diff_deg(a, b) -> Column:
    """Smallest difference of two bearings, 0 to 180."""
    d = F.abs(_c(a) - _c(b)) % 360.0
    return F.when(d <= 180, d).otherwise(360.0 - d)


curvature_deg = angular_diff_deg


def signed_turn_deg(x) -> Column:
    """An angle brought to [-180, 180)."""
    return F.pmod(_c(x) + 180.0, F.lit(360.0)) - 180.0


def _nearest_on_segment(px: Column, py: Column, bx: Column, by: Column) -> Column:
    """Share (0 to 1) along (0,0)-(bx,by) of the point nearest to (px,py); 0 for a segment without length."""
    square = bx * bx + by * by
    t = (px * bx + py * by) / F.when(square == 0, None).otherwise(square)
    return F.coalesce(F.when(t < 0, 0.0).when(t > 1, 1.0).otherwise(t), F.lit(0.0))


def point_to_segment_m(lat, lon, lat1, lon1, lat2, lon2, method: str = "ellipsoid") -> Column:
    """Distance of a point from a segment. ``ellipsoid``: metres per degree at the segment's middle latitude;
    ``equirectangular``: a sphere's, at the segment's start."""
    lat, lon, lat1, lon1, lat2, lon2 = map(_c, (lat, lon, lat1, lon1, lat2, lon2))
    if method == "ellipsoid":
        middle = (lat1 + lat2) / 2 * DEGREE
        per_lat, per_lon = 111132.92 - 559.82 * F.cos(2 * middle), 111412.84 * F.cos(middle)
        px, py, bx, by = (lon - lon1) * per_lon, (lat - lat1) * per_lat, (lon2 - lon1) * per_lon, (lat2 - lat1) * per_lat
    else:
        p, b = project(lat, lon, lat1, lon1), project(lat2, lon2, lat1, lon1)
        px, py, bx, by = p["x"], p["y"], b["x"], b["y"]
    t = _nearest_on_segment(px, py, bx, by)
    return F.sqrt(F.pow(px - t * bx, 2) + F.pow(py - t * by, 2))


def project(lat, lon, lat0, lon0, radius: float = MEAN_RADIUS) -> Column:
    """struct(x, y): metres east and north of (lat0, lon0)."""
    lat, lon, lat0, lon0 = map(_c, (lat, lon, lat0, lon0))
    return F.struct(((lon - lon0) * DEGREE * F.cos(lat0 * DEGREE) * radius).alias("x"), ((lat - lat0) * DEGREE * radius).alias("y"))


def inverse_project(x, y, lat0, lon0, radius: float = MEAN_RADIUS) -> Column:
    """struct(lat, lon) of a point ``x`` metres east and ``y`` metres north of (lat0, lon0)."""
    x, y, lat0, lon0 = map(_c, (x, y, lat0, lon0))
    return F.struct((lat0 + F.degrees(y / radius)).alias("lat"), (lon0 + F.degrees(x / (radius * F.cos(lat0 * DEGREE)))).alias("lon"))


def snap_to_segment(lat, lon, lat1, lon1, lat2, lon2) -> Column:
    """struct(lat, lon): the nearest point of the segment."""
    p, b = project(lat, lon, lat1, lon1), project(lat2, lon2, lat1, lon1)
    t = _nearest_on_segment(p["x"], p["y"], b["x"], b["y"])
    return inverse_project(t * b["x"], t * b["y"], lat1, lon1)
