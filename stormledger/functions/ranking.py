"""Row numbers over a total order without gathering the rows, or a group of them, in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stormledger.session import materialise

_POSITION_BITS = (1 << 33) - 1  # the within-partition part of monotonically_increasing_id


def global_row_number(df: DataFrame, order: list, name: str = "row_no") -> DataFrame:
    """1.. over the whole table: range partitions sorted in parallel, then shifted by the sizes of
    the partitions before them (a table of one row per partition). `order` must be total."""
    placed = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_pos", F.monotonically_increasing_id().bitwiseAND(F.lit(_POSITION_BITS)))
    )
    placed = materialise(placed, "rank")
    w = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = (
        placed.groupBy("_part")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0)))
        .select("_part", "_before")
    )
    # One row per partition of the sort, so small enough to send to every task.
    return placed.join(F.broadcast(before), "_part").withColumn(
        name, F.col("_before") + F.col("_pos") + 1
    ).drop("_part", "_pos", "_before")


def grouped_row_number(df: DataFrame, keys: list[str], order: list, name: str = "row_no") -> DataFrame:
    """row_number() per key, for keys of any size: the global number minus the key's first."""
    numbered = global_row_number(df, [F.col(k) for k in keys] + list(order), "_global")
    first = numbered.groupBy(*keys).agg(F.min("_global").alias("_first"))
    return numbered.join(first, keys).withColumn(
        name, F.col("_global") - F.col("_first") + 1
    ).drop("_global", "_first")
