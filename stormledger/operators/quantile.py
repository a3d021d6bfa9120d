"""Exact order statistics per group, safe for groups of any size.

Values are first reduced to (group, value, count) with map-side combining. Only that histogram is
ordered: its length per group is the number of distinct values (readings are rounded: a wind to
0.1 m/s up to 65 gives at most 651), whatever the number of rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _cumulative(df: DataFrame, keys: list[str], value: str, weight: str | None = None) -> DataFrame:
    known = df.filter(F.col(value).isNotNull())
    if weight is None:
        h = known.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    else:  # already one row per distinct value
        h = known.withColumnRenamed(weight, "_n")
    w = Window.partitionBy(*keys)
    return h.withColumn("_total", F.sum("_n").over(w)).withColumn(
        "_upto", F.sum("_n").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    )


def lower_percentile(
    df: DataFrame, keys: list[str], value: str, num: int = 9, den: int = 10, alias: str = "reading",
    weight: str | None = None,
) -> DataFrame:
    """The ((n-1)*num div den + 1)-th smallest: with two or more rows never the lone highest.

    `weight` names a count column where df is already a histogram (one row per distinct value).
    """
    rank = F.floor((F.col("_total") - 1) * num / F.lit(den)) + 1
    return (
        _cumulative(df, keys, value, weight)
        .groupBy(*keys)
        .agg(F.min(F.when(F.col("_upto") >= rank, F.col(value))).alias(alias))
    )


def exact_median(df: DataFrame, keys: list[str], value: str, alias: str = "median") -> DataFrame:
    """The median with infinities allowed; the mean of the middle two for an even count."""
    low = F.floor((F.col("_total") + 1) / F.lit(2))
    high = F.floor((F.col("_total") + 2) / F.lit(2))
    return (
        _cumulative(df, keys, value)
        .groupBy(*keys)
        .agg(
            F.min(F.when(F.col("_upto") >= low, F.col(value))).alias("_low"),
            F.min(F.when(F.col("_upto") >= high, F.col(value))).alias("_high"),
        )
        .select(*keys, ((F.col("_low") + F.col("_high")) / F.lit(2.0)).alias(alias))
    )
