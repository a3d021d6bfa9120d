"""Neighbourhoods on a regular grid of rows, without joins.

A cell sends its values to the cells around it and each target aggregates what arrived: one
shuffle, at most (2k+1)^2 rows per cell, partial aggregation before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def scatter(
    df: DataFrame, keys: list[str], row: str, col: str, values: list[str], reach: int = 1
) -> DataFrame:
    """(keys, row, col of the target; dr, dc of the sender seen from the target; values)."""
    steps = F.sequence(F.lit(-reach), F.lit(reach))
    return (
        df.select(*keys, row, col, *values)
        .withColumn("dr", F.explode(steps))
        .withColumn("dc", F.explode(steps))
        .select(
            *keys,
            (F.col(row) - F.col("dr")).alias(row),
            (F.col(col) - F.col("dc")).alias(col),
            "dr", "dc", *values,
        )
    )


def at(dr: int, dc: int, value: str):
    """The sender's value at one offset (an aggregate over scattered rows)."""
    return F.max(F.when((F.col("dr") == dr) & (F.col("dc") == dc), F.col(value)))


def around(value: str, agg):
    """An aggregate over the neighbours, the cell itself left out."""
    return agg(F.when((F.col("dr") != 0) | (F.col("dc") != 0), F.col(value)))
