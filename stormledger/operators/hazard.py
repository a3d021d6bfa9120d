"""Hazard layers: cells scored against the fixes of their event."""

from __future__ import annotations



from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stormledger.functions import hazard as H
from stormledger.functions.grid import around, at, scatter
from stormledger.operators.joins import measured_join

METRES_PER_DEGREE = (111_000.0, 111_320.0)  # latitude, longitude at the equator


def score_cells(cells: DataFrame, fixes: DataFrame, event: str = "event") -> DataFrame:
    """Wind and surge of every cell at every fix of its own event.

    An equi-join on the event. The fixes of an event are its time axis (tens to hundreds of rows):
    they are broadcast once their number has been measured, and the cells stay where they are.
    """
    f = fixes.select(
        event, "step", F.col("lat").alias("fix_lat"), F.col("lon").alias("fix_lon"),
        "pressure", "max_wind", "radius_km", "heading",
    )
    wind = H.wind_speed(
        F.col("lat"), F.col("lon"), F.col("coast_km"), F.col("fix_lat"), F.col("fix_lon"),
        F.col("pressure"), F.col("max_wind"), F.col("radius_km"), F.col("heading"),
    )
    surge = H.surge_depth(
        F.col("wind"), F.col("lat"), F.col("lon"), F.col("coast_km"), F.col("elevation"),
        F.col("fix_lat"), F.col("fix_lon"), F.col("pressure"),
    )
    return (
        measured_join(cells, f, [event], "cell_id")
        .withColumn("wind", wind)
        .withColumn("surge", surge)
        .drop("fix_lat", "fix_lon", "pressure", "max_wind", "radius_km", "heading")
    )


def terrain(cells: DataFrame, size_deg: float = 0.05, keys: list[str] | None = None) -> DataFrame:
    """slope (centred difference, clamped at the edge) and depression (mean of the neighbours
    that exist, minus own height) per cell."""
    keys = keys or []
    sent = scatter(cells, keys, "r", "c", ["elevation", "lat", "lon", "coast_km", "cell_id"])
    own = F.col("own")
    dx = F.greatest(
        F.lit(100.0),
        F.lit(2.0 * size_deg * METRES_PER_DEGREE[1]) * F.cos(F.radians(F.col("lat"))),
    )
    dy = F.lit(max(100.0, 2.0 * size_deg * METRES_PER_DEGREE[0]))
    sx = F.abs(F.coalesce("east", own) - F.coalesce("west", own)) / dx
    sy = F.abs(F.coalesce("north", own) - F.coalesce("south", own)) / dy
    return (
        sent.groupBy(*keys, "r", "c")
        .agg(
            at(0, 0, "cell_id").alias("cell_id"),
            at(0, 0, "elevation").alias("own"),
            at(0, 0, "lat").alias("lat"),
            at(0, 0, "lon").alias("lon"),
            at(0, 0, "coast_km").alias("coast_km"),
            at(0, 1, "elevation").alias("east"),
            at(0, -1, "elevation").alias("west"),
            at(1, 0, "elevation").alias("north"),
            at(-1, 0, "elevation").alias("south"),
            around("elevation", F.avg).alias("mean_near"),
        )
        .filter(own.isNotNull())
        .withColumn("slope", F.sqrt(sx * sx + sy * sy))
        .withColumn("depression", F.col("mean_near") - own)
        .select(
            *keys, "cell_id", "r", "c", "lat", "lon", "coast_km",
            own.alias("elevation"), "slope", "depression",
        )
    )


def slope_mask(cells: DataFrame, max_degrees: float = 5.0) -> DataFrame:
    """Cells flat enough to be kept in a flood mask."""
    return cells.withColumn(
        "flat", F.degrees(F.atan(F.col("slope"))) <= F.lit(max_degrees)
    )


def flood_layer(cells: DataFrame, south: float, west: float) -> DataFrame:
    return terrain(cells).withColumn(
        "flood",
        H.flood_index(
            F.col("lat"), F.col("lon"), F.col("coast_km"), F.col("elevation"),
            F.col("slope"), F.col("depression"), south, west,
        ),
    )


def regular_grid(
    spark, rows: int, cols: int, west: float, south: float, east: float, north: float,
    elevation: DataFrame | None = None,
) -> DataFrame:
    """The cells of a box, ids cRRCC; heights from a table where it has the cell, else a formula."""
    dx, dy = (east - west) / cols, (north - south) / rows
    n = F.col("id")
    from stormledger.functions.geo import haversine_km
    from stormledger.functions.numeric import round_to

    base = spark.range(rows * cols).select(
        F.floor(n / F.lit(cols)).cast("int").alias("r"), (n % F.lit(cols)).cast("int").alias("c")
    )
    lon, lat = F.col("lon"), F.col("lat")
    formula = F.greatest(
        F.lit(0.5),
        round_to(
            F.lit(1.0) + (lat - F.lit(south)) / F.lit(north - south) * F.lit(4.5)
            + F.lit(0.3) * F.sin(lon * F.lit(10.0)), 2,
        ),
    )
    grid = (
        base.withColumn("cell_id", F.format_string("c%02d%02d", "r", "c"))
        .withColumn("min_lon", round_to(F.lit(west) + F.col("c") * F.lit(dx), 5))
        .withColumn("min_lat", round_to(F.lit(south) + F.col("r") * F.lit(dy), 5))
        .withColumn("max_lon", round_to(F.col("min_lon") + F.lit(dx), 5))
        .withColumn("max_lat", round_to(F.col("min_lat") + F.lit(dy), 5))
        .withColumn("lon", round_to((F.col("min_lon") + F.col("max_lon")) / F.lit(2.0), 5))
        .withColumn("lat", round_to((F.col("min_lat") + F.col("max_lat")) / F.lit(2.0), 5))
        .withColumn("coast_km", round_to(haversine_km(lat, lon, F.lit(south + 0.05), lon), 2))
        .withColumn("fallback_elevation", formula)
    )
    if elevation is None:
        return grid.withColumnRenamed("fallback_elevation", "elevation")
    known = elevation.select("cell_id", F.col("elevation").alias("measured"))
    return (
        grid.join(known, "cell_id", "left")
        .withColumn("elevation", F.coalesce("measured", "fallback_elevation"))
        .drop("measured", "fallback_elevation")
    )


def tall(wide: DataFrame, keys: list[str]) -> DataFrame:
    """wind and surge side by side to one row per hazard, with unit and severity."""
    hazard, value = F.col("hazard"), F.col("value")
    return (
        wide.select(
            *keys,
            F.explode(
                F.array(
                    F.struct(F.lit("wind").alias("hazard"), F.col("wind").alias("value")),
                    F.struct(F.lit("surge").alias("hazard"), F.col("surge").alias("value")),
                )
            ).alias("x"),
        )
        .select(*keys, "x.hazard", "x.value")
        .withColumn("unit", H.unit_of(hazard))
        .withColumn(
            "severity",
            F.when(hazard == "wind", H.wind_severity(value)).otherwise(H.surge_severity(value)),
        )
    )


def side_by_side(tall_df: DataFrame, keys: list[str]) -> DataFrame:
    """One row per cell with each hazard's value, null where missing."""
    return tall_df.groupBy(*keys).pivot("hazard", ["wind", "surge", "flood"]).agg(F.max("value"))


