"""Distances and grid arithmetic as Column expressions (WGS84 degrees in, JVM-side math only).

Three metrics are supported. ``haversine`` gives kilometres on a sphere. ``planar_rad`` treats
latitude and longitude in radians as a plane and scales by the Earth radius, so it ignores the
shrinking of longitude. ``planar_deg`` is the plain Euclidean distance in degrees.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

EARTH_RADIUS_KM = 6371.0
KM_PER_DEGREE = 111.0
TWO_MILES_KM = 3.218
TWO_MILES_EXACT_KM = 3.218688
CELL_DEGREES = 0.02
METRICS = ("haversine", "planar_rad", "planar_deg")

_PAD = 1.0 + 1e-6


def _check(metric: str) -> None:
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}; expected one of {METRICS}")


def _sin2(x: Column) -> Column:
    s = F.sin(x / 2.0)
    return s * s


def central_angle_term(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """The haversine of the central angle between two points."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    return _sin2(p2 - p1) + F.cos(p1) * F.cos(p2) * _sin2(F.radians(lon2) - F.radians(lon1))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = central_angle_term(lat1, lon1, lat2, lon2)
    return F.lit(2.0 * EARTH_RADIUS_KM) * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def distance(metric: str, lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    _check(metric)
    if metric == "haversine":
        return haversine_km(lat1, lon1, lat2, lon2)
    dlat, dlon = lat2 - lat1, lon2 - lon1
    flat = F.sqrt(dlat * dlat + dlon * dlon)
    return flat * (EARTH_RADIUS_KM * math.pi / 180.0) if metric == "planar_rad" else flat


def cell_index(x: Column, size: float = CELL_DEGREES) -> Column:
    """Nearest grid line by round-half-even, kept as an integer so that keys compare exactly."""
    return F.rint(x / F.lit(size)).cast("bigint")


def bounding_box(lat: float, lon: float, radius: float, metric: str = "haversine"):
    """``(lat_min, lat_max, lon_min, lon_max)`` of everything within ``radius`` of a point."""
    _check(metric)
    if metric == "planar_deg":
        dlat = dlon = radius * _PAD
    else:
        delta = radius / EARTH_RADIUS_KM
        dlat = dlon = math.degrees(delta) * _PAD
        if metric == "haversine":
            ratio = math.sin(min(delta, math.pi / 2)) / max(math.cos(math.radians(lat)), 1e-12)
            dlon = math.degrees(math.asin(ratio)) * _PAD if ratio < 1.0 else 360.0
    return lat - dlat, lat + dlat, lon - dlon, lon + dlon


# --- buckets for the radius join -------------------------------------------------------------
# The plane is cut into latitude bands as high as the radius. Every band has its own longitude
# width, wide enough at the band's highest latitude, so no global latitude bound is needed and
# the number of candidate buckets per point stays at two or three per band.


def _band_height(radius: float, metric: str) -> float:
    _check(metric)
    if metric == "planar_deg":
        return radius * _PAD
    return math.degrees(radius / EARTH_RADIUS_KM) * _PAD


def _band(lat: Column, height: float) -> Column:
    return F.floor((lat + 90.0) / height)


def _ring(band: Column, height: float, metric: str) -> Column:
    """Slots of a haversine band: as many of the least width as fill the circle, so that it closes."""
    top = F.greatest(F.abs(band * height - 90.0), F.abs((band + 1) * height - 90.0))
    shrink = F.greatest(F.cos(F.radians(F.least(top, F.lit(90.0)))), F.lit(1e-6))
    return F.greatest(F.lit(1), F.floor(360.0 / (F.lit(height) / shrink)))


def bucket_of(lat: Column, lon: Column, radius: float, metric: str = "haversine") -> Column:
    """The bucket holding a point, as ``struct(band, slot)``."""
    height = _band_height(radius, metric)
    band = _band(lat, height)
    if metric != "haversine":
        slot = F.floor((lon + 180.0) / height)
    else:
        ring = _ring(band, height, metric)
        slot = F.pmod(F.floor((lon + 180.0) / (360.0 / ring)), ring)
    return F.struct(band.alias("band"), slot.alias("slot"))


def buckets_near(lat: Column, lon: Column, radius: float, metric: str = "haversine") -> Column:
    """Every bucket that can hold a point within ``radius``, as an array of ``struct(band, slot)``."""
    height = _band_height(radius, metric)
    if metric == "haversine":
        ratio = F.sin(F.lit(radius / EARTH_RADIUS_KM)) / F.greatest(
            F.cos(F.radians(lat)), F.lit(1e-12)
        )
        reach = F.when(ratio < 1.0, F.degrees(F.asin(ratio)) * _PAD).otherwise(F.lit(360.0))
    else:
        reach = F.lit(height)

    def slots(step: int) -> Column:
        band = _band(lat, height) + step
        if metric != "haversine":
            first, last = (F.floor((lon + d + 180.0) / height) for d in (-reach, reach))
            every = F.sequence(first, last)
        else:
            ring = _ring(band, height, metric)
            first, last = (F.floor((lon + d + 180.0) / (360.0 / ring)) for d in (-reach, reach))
            # once around at most
            every = F.transform(F.sequence(first, F.least(last, first + ring - 1)), lambda s: F.pmod(s, ring))
        return F.transform(every, lambda s: F.struct(band.alias("band"), s.alias("slot")))

    return F.concat(slots(-1), slots(0), slots(1))


# --- bounds between two rectangles, for the nearest join ---------------------------------------


def box_bounds(metric: str, a, b):
    """Lower and upper bound of the distance between any two points of two boxes.

    A box is ``(lat0, lat1, lon0, lon1)`` of Columns. For the haversine metric the bounds are in
    terms of the haversine of the central angle, which grows with the distance.
    """
    _check(metric)
    alat0, alat1, alon0, alon1 = a
    blat0, blat1, blon0, blon1 = b
    zero = F.lit(0.0)
    gap_lat = F.greatest(zero, alat0 - blat1, blat0 - alat1)
    gap_lon = F.greatest(zero, alon0 - blon1, blon0 - alon1)
    far_lat = F.greatest(alat1 - blat0, blat1 - alat0)
    far_lon = F.greatest(alon1 - blon0, blon1 - alon0)
    if metric != "haversine":
        return gap_lat * gap_lat + gap_lon * gap_lon, far_lat * far_lat + far_lon * far_lon

    def cosines(lat0: Column, lat1: Column):
        low = F.cos(F.radians(F.least(F.lit(90.0), F.greatest(F.abs(lat0), F.abs(lat1)))))
        spans = (lat0 <= 0.0) & (lat1 >= 0.0)
        high = F.when(spans, F.lit(1.0)).otherwise(
            F.cos(F.radians(F.least(F.abs(lat0), F.abs(lat1))))
        )
        return F.greatest(zero, low), F.greatest(zero, high)

    alow, ahigh = cosines(alat0, alat1)
    blow, bhigh = cosines(blat0, blat1)
    # Longitudes are a circle: differences from gap_lon to far_lon, beyond half a turn shorter again.
    half_turn, whole_turn = F.lit(180.0), F.lit(360.0)
    gap_back, far_back = F.greatest(zero, whole_turn - far_lon), F.greatest(whole_turn - gap_lon, far_lon - whole_turn)
    far_lon = F.when(gap_lon > half_turn, far_back).otherwise(far_lon)
    gap_lon = F.least(gap_lon, gap_back)
    low = _sin2(F.radians(F.least(half_turn, gap_lat))) + alow * blow * _sin2(
        F.radians(F.least(half_turn, gap_lon))
    )
    high = _sin2(F.radians(F.least(half_turn, far_lat))) + ahigh * bhigh * _sin2(
        F.radians(F.least(half_turn, far_lon))
    )
    return low, high
