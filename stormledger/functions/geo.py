"""Spherical and planar geometry as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stormledger.functions.numeric import dbl

EARTH_RADIUS_KM = 6371.0
METRES_PER_DEGREE_LON = 111_320.0
METRES_PER_DEGREE_LAT = 110_540.0


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half_lat = F.sin(F.radians(lat2 - lat1) / F.lit(2.0))
    half_lon = F.sin(F.radians(lon2 - lon1) / F.lit(2.0))
    a = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    return F.lit(2.0 * EARTH_RADIUS_KM) * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    return haversine_km(lat1, lon1, lat2, lon2) * F.lit(1000.0)


def wrap_360(degrees: Column) -> Column:
    turned = degrees - F.floor(degrees / F.lit(360.0)).cast("double") * F.lit(360.0)
    return F.when(turned >= 360.0, F.lit(0.0)).otherwise(turned)


def forward_azimuth(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial great-circle bearing in degrees, [0, 360)."""
    p1, p2, dl = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    east = F.sin(dl) * F.cos(p2)
    north = F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(dl)
    return wrap_360(F.degrees(F.atan2(east, north)))


def planar_bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Bearing in degree space (not geodesic), [0, 360): what the wind asymmetry is defined on."""
    return wrap_360(F.degrees(F.atan2(lon2 - lon1, lat2 - lat1)))


def to_metres(lon: Column, lat: Column, lat0: float) -> tuple[Column, Column]:
    """Local equirectangular projection around latitude `lat0`."""
    import math

    kx = METRES_PER_DEGREE_LON * math.cos(math.radians(lat0))
    return dbl(lon) * F.lit(kx), dbl(lat) * F.lit(METRES_PER_DEGREE_LAT)


def grid_key(x: Column, size: float) -> Column:
    return F.floor(dbl(x) / F.lit(size)).cast("long")
