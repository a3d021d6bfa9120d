"""A reproducible shuffle of all rows, and from it shards whose row counts differ by one at most.

Rows are numbered 0 .. N-1 in a total order, and the numbers go through a keyed permutation of
[0, N): position p lies in shard p mod S at slot p div S, so either can be computed from a row
number alone, and a row number from a shard and slot.

The permutation is an alternating Feistel network on Z_a x Z_b with a * b >= N and a, b near
sqrt(N). Numbers it sends to [N, a * b) walk on along their cycle until they are back below N.
Only M = a * b - N numbers lie outside, so a walk ends after M + 1 applications at most; a and b
are picked among the factors near sqrt(N) for the least M.
"""

from __future__ import annotations

from math import isqrt
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stormledger.functions.ranking import global_row_number

PRIME = (1 << 31) - 1
ROUNDS = 6
SEARCHED = 4096  # candidate factors, which bound the walks and not the rows
MULTIPLIERS = (1103515245, 69069, 1664525, 22695477, 134775813, 214013)
INCREMENTS = (12345, 362437, 1013904223, 2531011, 7654321, 1099087573)


class Domain(NamedTuple):
    """[0, rows) inside Z_a x Z_b; walks is the most applications that any number can need."""

    rows: int
    a: int
    b: int
    walks: int


def domain(rows: int) -> Domain:
    if rows <= 0:
        return Domain(0, 1, 1, 1)
    root = isqrt(rows - 1) + 1
    sides = range(root, min(2 * root, root + SEARCHED - 1) + 1)
    a = min(sides, key=lambda side: (side * -(-rows // side), side))
    b = -(-rows // a)
    return Domain(rows, a, b, a * b - rows + 1)


def _mix(value: Column, k: int, seed: int) -> Column:
    """A number below PRIME from one below it; the square keeps a round from being linear."""
    t = (value * F.lit(MULTIPLIERS[k]) + F.lit((INCREMENTS[k] + seed) % PRIME)) % F.lit(PRIME)
    return (t * t + value) % F.lit(PRIME)


def _round(left: Column, right: Column, k: int, d: Domain, seed: int) -> tuple[Column, Column]:
    if k % 2 == 0:
        return (left + _mix(right, k, seed)) % F.lit(d.a), right
    return left, (right + _mix(left, k, seed)) % F.lit(d.b)


def _again(x: Column, d: Domain, seed: int) -> Column:
    """One more application inside an expression; a lambda per round keeps it from growing."""
    state = F.array(F.struct((x / F.lit(d.b)).cast("long").alias("l"), (x % F.lit(d.b)).alias("r")))

    def round_of(k: int):
        def step(s: Column) -> Column:
            left, right = _round(s["l"], s["r"], k, d, seed)
            return F.struct(left.alias("l"), right.alias("r"))

        return step

    for k in range(ROUNDS):
        state = F.transform(state, round_of(k))
    return state[0]["l"] * F.lit(d.b) + state[0]["r"]


def permute(df: DataFrame, number: str, name: str, d: Domain, seed: int = 0) -> DataFrame:
    """Adds `name`: the place of `number` (0 <= number < d.rows) in the shuffle."""
    out = df.withColumns({
        "_l": F.floor(F.col(number) / F.lit(d.b)).cast("long"),
        "_r": (F.col(number) % F.lit(d.b)).cast("long"),
    })
    for k in range(ROUNDS):
        left, right = _round(F.col("_l"), F.col("_r"), k, d, seed)
        out = out.withColumn("_l" if k % 2 == 0 else "_r", left if k % 2 == 0 else right)
    out = out.withColumn(name, F.col("_l") * F.lit(d.b) + F.col("_r")).drop("_l", "_r")
    if d.walks > 1:
        walked = F.aggregate(
            F.sequence(F.lit(2), F.lit(d.walks)), F.col(name),
            lambda at, _: F.when(at < F.lit(d.rows), at).otherwise(_again(at, d, seed)),
        )
        out = out.withColumn(name, F.when(F.col(name) < F.lit(d.rows), F.col(name)).otherwise(walked))
    return out


def shard_rows(df: DataFrame, order: list[str], shards: int, seed: int = 0) -> DataFrame:
    """df with row_number, position, shard and slot (all long but shard, int).

    Rows are numbered in ascending order of `order`, nulls first. Rows that tie in all columns of
    `order` are told apart by a hash of the whole row; rows equal in everything are
    interchangeable, and each still gets its own number. Null and empty values are values like any
    other. An empty table gives an empty one. Existing columns of the four names are replaced.
    """
    kept = df.drop("row_number", "position", "shard", "slot")
    tie = F.xxhash64(*[F.col(f"`{c}`").cast("string") for c in kept.columns])
    numbered = global_row_number(
        kept.withColumn("_tie", tie), [F.col(c).asc_nulls_first() for c in order] + [F.col("_tie").asc()], "row_number",
    ).drop("_tie").withColumn("row_number", F.col("row_number") - 1)
    d = domain(kept.count())
    placed = permute(numbered, "row_number", "position", d, seed)
    return placed.withColumns({
        "shard": (F.col("position") % F.lit(shards)).cast("int"),
        "slot": F.floor(F.col("position") / F.lit(shards)).cast("long"),
    })
