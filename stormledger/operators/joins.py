"""Joins whose small side is broadcast only after its size has been measured."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stormledger.session import WorkTables

MAX_BROADCAST_ROWS = 500_000
MAX_BROADCAST_BYTES = 16 << 20  # as stored; rows may hold rings or texts
MAX_BROADCAST_NUMBERS = 2_000_000  # rows of one or two longs


def measured_join(
    big: DataFrame, small: DataFrame, on: list[str], salt_by: str, max_rows: int = MAX_BROADCAST_ROWS,
    max_bytes: int = MAX_BROADCAST_BYTES,
) -> DataFrame:
    """Inner join of a large table with one that is expected to be small.

    `small` is written once and counted in the same job. Within max_rows and max_bytes it is
    broadcast, and the large side keeps its partitioning. Beyond, both sides are shuffled on the key and a salt, so
    that a key with a large share of the rows is spread over all partitions.
    """
    session = big.sparkSession
    work = WorkTables(session, "small-side")
    saved, n = work.save_counting(small.withColumn("_row", F.lit(True)), "_row")
    saved = saved.drop("_row")
    if n <= max_rows and work.stored_bytes() <= max_bytes:
        return big.join(F.broadcast(saved), on)
    salts = int(session.conf.get("spark.sql.shuffle.partitions"))
    salted = big.withColumn("_salt", F.pmod(F.xxhash64(salt_by), F.lit(salts)))
    copies = saved.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return salted.join(copies, [*on, "_salt"]).drop("_salt")


def join_numbers(big: DataFrame, small: DataFrame, on: str, how: str, work: WorkTables, max_rows: int = MAX_BROADCAST_NUMBERS) -> DataFrame:
    """big joined with rows of one or two longs, each `on` once; within max_rows big is not shuffled. Stores small in work."""
    saved, n = work.save_counting(small.withColumn("_one", F.lit(True)), "_one")
    saved = saved.drop("_one")
    return big.join(F.broadcast(saved) if n <= max_rows else saved, on, how)
