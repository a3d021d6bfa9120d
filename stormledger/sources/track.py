"""Best-track CSV files: reading, filtering, resampling to steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stormledger.functions.clock import step_of
from stormledger.functions.hazard import KNOT_MS, NAUTICAL_KM
from stormledger.functions.numeric import round_to

# The columns used, and the defaults where every agency is silent.
COLUMNS = [
    "SID", "NAME", "ISO_TIME", "LAT", "LON", "NEWDELHI_LAT", "NEWDELHI_LON", "USA_LAT", "USA_LON",
    "WMO_WIND", "NEWDELHI_WIND", "USA_WIND", "WMO_PRES", "NEWDELHI_PRES", "USA_PRES", "USA_RMW",
]
DEFAULT_WIND_KT, DEFAULT_HPA, DEFAULT_RMW_NM = 65.0, 950.0, 16.0


def read_track(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """All columns as text; the units row under the header has no time and is dropped."""
    schema = ", ".join(f"`{c}` string" for c in (columns or COLUMNS))
    raw = spark.read.csv(path, header=True, schema=schema)
    at = F.try_to_timestamp(F.trim("ISO_TIME"), F.lit("yyyy-MM-dd HH:mm:ss"))
    return raw.withColumn("ts", at.cast("timestamp_ntz")).filter(F.col("ts").isNotNull())


def of_storm(track: DataFrame, name: str, ids: list[str]) -> DataFrame:
    return track.filter((F.col("NAME") == name) | F.col("SID").isin(ids))


def keep_lines(spark: SparkSession, path: str, tokens: list[str]) -> DataFrame:
    """Lines of a large text file that hold any of the tokens (headers: read separately)."""
    hit = None
    for t in tokens:
        one = F.col("value").contains(t)
        hit = one if hit is None else hit | one
    return spark.read.text(path).filter(hit)


def first_of(*names: str) -> Column:
    """The first non-empty agency value."""
    return F.coalesce(*[F.nullif(F.trim(n), F.lit("")) for n in names]).cast("double")


def resample(track: DataFrame, key: str = "NAME") -> DataFrame:
    """One fix per step in model units; fixes off the step grid are left out."""
    fix = track.filter(F.second("ts") + F.minute("ts") == 0).filter(F.hour("ts") % 3 == 0)
    return fix.select(
        F.col(key).alias("event"), step_of(F.col("ts")).alias("step"),
        round_to(first_of("LAT", "NEWDELHI_LAT", "USA_LAT"), 4).alias("lat"),
        round_to(first_of("LON", "NEWDELHI_LON", "USA_LON"), 4).alias("lon"),
        round_to(F.coalesce(first_of("WMO_WIND", "NEWDELHI_WIND", "USA_WIND"), F.lit(DEFAULT_WIND_KT)) * KNOT_MS, 2).alias("max_wind"),
        round_to(F.coalesce(first_of("WMO_PRES", "NEWDELHI_PRES", "USA_PRES"), F.lit(DEFAULT_HPA)), 1).alias("pressure"),
        round_to(F.coalesce(first_of("USA_RMW"), F.lit(DEFAULT_RMW_NM)) * NAUTICAL_KM, 1).alias("radius_km"),
    )


def lookup(axis: DataFrame, stored: DataFrame, default: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """The axis with stored fixes, built-in ones where the stored table has none."""
    s = stored.select(*keys, *[F.col(v).alias(f"{v}__s") for v in values])
    d = default.select(*keys, *[F.col(v).alias(f"{v}__d") for v in values])
    return axis.join(s, keys, "left").join(d, keys, "left").select(
        *keys, *[F.coalesce(f"{v}__s", f"{v}__d").alias(v) for v in values]
    )
