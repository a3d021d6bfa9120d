"""Steps, horizons and time labels.

Times are TIMESTAMP_NTZ in UTC; a step is the number of whole step lengths since 1970.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STEP_HOURS = 3
HORIZON_HOURS = 24
EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"


def epoch_seconds(ts: Column) -> Column:
    return F.timestamp_diff("SECOND", F.expr(EPOCH), ts.cast("timestamp_ntz"))


def step_of(ts: Column, hours: int = STEP_HOURS) -> Column:
    return F.floor(epoch_seconds(ts) / F.lit(hours * 3600)).cast("long")


def step_time(step: Column, hours: int = STEP_HOURS) -> Column:
    return F.timestamp_add("SECOND", (step * F.lit(hours * 3600)).cast("int"), F.expr(EPOCH))


def compact(ts: Column) -> Column:
    """20240101T0300Z, the key form of a time."""
    return F.date_format(ts.cast("timestamp_ntz"), "yyyyMMdd'T'HHmm'Z'")


def from_compact(text: Column) -> Column:
    return F.to_timestamp_ntz(text, F.lit("yyyyMMdd'T'HHmm'Z'"))


def iso(ts: Column) -> Column:
    return F.date_format(ts.cast("timestamp_ntz"), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def offset_iso(ts: Column, hours: int = 5, minutes: int = 30) -> Column:
    """Local wall time with its numeric offset, the form alert messages carry."""
    local = F.timestamp_add("MINUTE", F.lit(hours * 60 + minutes), ts.cast("timestamp_ntz"))
    return F.concat(
        F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss"), F.lit(f"+{hours:02d}:{minutes:02d}")
    )


def hours_between(start: Column, end: Column) -> Column:
    """Whole hours, rounded half up."""
    seconds = F.timestamp_diff("SECOND", start.cast("timestamp_ntz"), end.cast("timestamp_ntz"))
    return F.floor(seconds / F.lit(3600.0) + F.lit(0.5)).cast("long")


def lead_label(hours: Column) -> Column:
    return F.concat(F.lit("T-"), hours.cast("string"))


def axis(df: DataFrame, keys: list[str], step: str) -> DataFrame:
    """Every step between each key's first and last, one row each."""
    bounds = df.groupBy(*keys).agg(F.min(step).alias("lo"), F.max(step).alias("hi"))
    return bounds.select(*keys, F.explode(F.sequence("lo", "hi")).alias(step))


def off_axis(df: DataFrame, valid: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose step is not on the axis."""
    return df.join(valid.select(*on).distinct(), on, "left_anti")
