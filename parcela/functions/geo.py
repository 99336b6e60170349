"""Geometry of latitude and longitude columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH = 6_371_000.0


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres between two points."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH * F.asin(F.sqrt(F.least(F.lit(1.0), F.greatest(F.lit(0.0), a))))


def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> tuple[Column, Column]:
    """Sine and cosine of the direction from the first point to the second."""
    p1, p2, d = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    angle = F.atan2(F.sin(d) * F.cos(p2), F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(d))
    return F.sin(angle), F.cos(angle)


def polyline_distance(lat: Column, lon: Column, points: list[tuple[float, float]]) -> Column:
    """Metres to the nearest vertex or middle of a segment."""
    middles = [((a[0] + b[0]) / 2, (a[1] + b[1]) / 2) for a, b in zip(points, points[1:])]  # noqa: B905
    each = [haversine(lat, lon, F.lit(a), F.lit(b)) for a, b in (*points, *middles)]
    return F.least(*each) if len(each) > 1 else each[0]


def access(distance: Column, scale: float) -> Column:
    """A score of 1 at no distance that falls with it."""
    return F.exp(-distance / F.lit(scale))


def utm35(lat: Column, lon: Column) -> tuple[Column, Column]:
    """Metres east and north in UTM zone 35 north, by the usual series."""
    k, a, e = 0.9996, 6378137.0, 0.00669437999014  # scale, radius and squared eccentricity of WGS 84
    p = F.radians(lat)
    n = a / F.sqrt(1 - e * F.pow(F.sin(p), 2))
    t, c, d = F.pow(F.tan(p), 2), e / (1 - e) * F.pow(F.cos(p), 2), (F.radians(lon) - math.radians(27.0)) * F.cos(p)
    arc = a * ((1 - e / 4 - 3 * e**2 / 64) * p - (3 * e / 8 + 3 * e**2 / 32) * F.sin(2 * p) + (15 * e**2 / 256) * F.sin(4 * p))
    east = k * n * (d + (1 - t + c) * F.pow(d, 3) / 6) + 500000.0
    return east, k * (arc + n * F.tan(p) * (F.pow(d, 2) / 2 + (5 - t + 9 * c + 4 * c * c) * F.pow(d, 4) / 24))


def coast_inverse(distance: Column) -> Column:
    """1 at the coast, a half a kilometre from it; an unknown distance counts as five."""
    return 1.0 / (1.0 + F.coalesce(distance, F.lit(5000.0)) / 1000.0)


def inside(lat: Column, lon: Column, bounds: tuple[float, float, float, float]) -> Column:
    """Whether a point lies in (south, north, west, east); null coordinates do not."""
    south, north, west, east = bounds
    return F.coalesce(lat.between(south, north) & lon.between(west, east), F.lit(False))
