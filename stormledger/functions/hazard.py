"""Hazard intensities and severities as Columns over (cell, fix) rows."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from stormledger.functions.geo import haversine_km, planar_bearing
from stormledger.functions.numeric import band, clip, clip01, piecewise_linear, round_to

# Physical constants of the wind profile.
AMBIENT_HPA = 1010.0
AIR_DENSITY = 1.15
EARTH_ROTATION = 7.292115e-5
SHAPE_MIN, SHAPE_MAX = 1.0, 2.5
FRICTION_COAST, FRICTION_INLAND, INLAND_KM = 0.90, 0.82, 20.0
WIND_CAP, WIND_FLOOR, TAIL_EXPONENT, ASYMMETRY = 65.0, 6.0, 0.4, 0.18

# The surge formula.
SURGE_AMBIENT_HPA, SURGE_PER_HPA = 1012.0, 0.010
SETUP_WIND, SETUP_EXPONENT, SETUP_COEFFICIENT = 20.0, 2.2, 0.85
SHELF_FACTOR, SURGE_DECAY_KM, SURGE_RELIEF = 1.10, 35.0, 0.25
SURGE_RAMP_KM, SURGE_CUTOFF_KM, SURGE_CAP = 300.0, 600.0, 6.0

# The static susceptibility index. Weights add up to 1.
FLOOD_WEIGHTS = {
    "elevation": 0.30, "slope": 0.15, "depression": 0.10,
    "water": 0.20, "rain": 0.10, "cover": 0.15,
}
FLOOD_ELEVATION, FLOOD_SLOPE, FLOOD_WATER_KM, FLOOD_DEPRESSION = 6.0, 0.0010, 28.0, 0.50

# Severity breakpoints (intensity, severity) and wind classes (km/h, name).
WIND_SEVERITY = [(0.0, 0.0), (10.0, 0.20), (17.0, 0.35), (24.0, 0.55), (33.0, 0.75), (48.0, 1.0)]
SURGE_SEVERITY = [(0.0, 0.0), (0.30, 0.15), (1.0, 0.40), (2.5, 0.75), (4.0, 1.0)]
FLOOD_SEVERITY = [(0.0, 0.0), (1.0, 1.0)]
WIND_CLASSES = [
    (31.0, "Depression"), (50.0, "Deep Depression"), (62.0, "Cyclonic Storm"),
    (89.0, "Severe Cyclonic Storm"), (118.0, "Very Severe Cyclonic Storm"),
    (166.0, "Extremely Severe Cyclonic Storm"), (221.0, "Super Cyclonic Storm"),
]
UNITS = {"wind": "m/s", "surge": "m", "flood": "index"}
KNOT_MS, NAUTICAL_KM, MS_KMH = 0.514444, 1.852, 3.6


def shape_b(pressure: Column, max_wind: Column) -> Column:
    """Peakedness of the radial profile; the deficit is floored at 1 hPa."""
    deficit = F.greatest(F.lit(1.0), F.lit(AMBIENT_HPA) - pressure) * F.lit(100.0)
    return clip(F.lit(AIR_DENSITY * math.e) * max_wind * max_wind / deficit, SHAPE_MIN, SHAPE_MAX)


def wind_speed(
    lat: Column, lon: Column, coast_km: Column, fix_lat: Column, fix_lon: Column,
    pressure: Column, max_wind: Column, radius_km: Column, heading: Column,
) -> Column:
    """Surface wind in m/s to 0.1: the stronger of core profile and power-law tail."""
    km = F.greatest(F.lit(0.1), haversine_km(lat, lon, fix_lat, fix_lon))
    deficit = F.greatest(F.lit(1.0), F.lit(AMBIENT_HPA) - pressure) * F.lit(100.0)
    b = shape_b(pressure, max_wind)
    scaled = F.pow(radius_km / km, b)
    turning = km * F.lit(1000.0) * F.lit(EARTH_ROTATION) * F.sin(F.radians(lat))
    core = F.sqrt(
        b / F.lit(AIR_DENSITY) * deficit * scaled * F.exp(-F.least(scaled, F.lit(50.0)))
        + turning * turning
    ) - turning
    tail = max_wind * F.pow(F.least(F.lit(1.0), radius_km / km), F.lit(TAIL_EXPONENT))
    side = F.radians(planar_bearing(fix_lat, fix_lon, lat, lon) - heading)
    friction = F.when(coast_km > INLAND_KM, F.lit(FRICTION_INLAND)).otherwise(FRICTION_COAST)
    speed = F.greatest(core, tail) * (F.lit(1.0) + F.lit(ASYMMETRY) * F.sin(side)) * friction
    return F.least(F.lit(WIND_CAP), round_to(F.greatest(speed, F.lit(WIND_FLOOR)), 1))


def surge_depth(
    wind: Column, lat: Column, lon: Column, coast_km: Column, elevation: Column,
    fix_lat: Column, fix_lon: Column, pressure: Column,
) -> Column:
    """Depth above ground in metres to 0.01, from the rounded surface wind."""
    km = haversine_km(lat, lon, fix_lat, fix_lon)
    barometer = F.greatest(F.lit(0.0), F.lit(SURGE_AMBIENT_HPA) - pressure) * F.lit(SURGE_PER_HPA)
    setup = F.pow(wind / F.lit(SETUP_WIND), F.lit(SETUP_EXPONENT)) * F.lit(SETUP_COEFFICIENT)
    decay = F.exp(-F.greatest(F.lit(0.0), coast_km) / F.lit(SURGE_DECAY_KM))
    reach = clip01((F.lit(SURGE_CUTOFF_KM) - km) / F.lit(SURGE_CUTOFF_KM - SURGE_RAMP_KM))
    depth = (
        (barometer + setup) * F.lit(SHELF_FACTOR) * decay - F.lit(SURGE_RELIEF) * elevation
    ) * reach
    return round_to(clip(depth, 0.0, SURGE_CAP), 2)


def flood_index(
    lat: Column, lon: Column, coast_km: Column, elevation: Column, slope: Column, depression: Column,
    south: float = 21.5, west: float = 88.0,
) -> Column:
    """Static susceptibility, [0.05, 0.98] to 0.01. `depression` = mean neighbour minus own height."""
    rain_mm = F.lit(80.0) * clip01(F.lit(1.0) - (lat - F.lit(south)) / F.lit(1.2)) + F.lit(
        40.0
    ) * clip01((lon - F.lit(west)) / F.lit(1.1))
    factors = {
        "elevation": clip01(F.lit(1.0) - elevation / F.lit(FLOOD_ELEVATION)),
        "slope": F.exp(-slope / F.lit(FLOOD_SLOPE)),
        "depression": clip01(
            F.lit(0.5) + F.lit(0.5) * (F.coalesce(depression, F.lit(0.0)) / F.lit(FLOOD_DEPRESSION))
        ),
        "water": F.exp(-F.greatest(F.lit(0.0), coast_km) / F.lit(FLOOD_WATER_KM)),
        "rain": clip01(rain_mm / F.lit(140.0)),
        # Land-cover bands by latitude offset from the southern edge of the area.
        "cover": F.when(lat < south + 0.35, F.lit(0.95))
        .when(lat <= south + 0.65, F.lit(0.85) - F.lit(0.15) * ((lat - F.lit(south + 0.35)) / F.lit(0.30)))
        .otherwise(F.lit(0.70) - F.lit(0.35) * ((lat - F.lit(south + 0.65)) / F.lit(0.55))),
    }
    total = None
    for name, weight in FLOOD_WEIGHTS.items():
        part = F.lit(weight) * factors[name]
        total = part if total is None else total + part
    return clip(round_to(total, 2), 0.05, 0.98)


def wind_severity(value: Column) -> Column:
    return piecewise_linear(value, WIND_SEVERITY, 3)


def surge_severity(value: Column) -> Column:
    return piecewise_linear(value, SURGE_SEVERITY, 3)


def flood_severity(value: Column) -> Column:
    return round_to(clip01(value), 2)


def wind_class(kmh: Column) -> Column:
    """Named class by lower bound; null below the first."""
    return band(kmh, WIND_CLASSES)


def unit_of(hazard: Column) -> Column:
    pairs = [x for name, unit in UNITS.items() for x in (F.lit(name), F.lit(unit))]
    return F.create_map(*pairs)[hazard]


def layer_id(hazard: Column, cell: Column, stamp: Column) -> Column:
    return F.concat_ws("__", hazard, cell, stamp)
