"""Operator inputs derived from the star-schema tables, in Spark and as SQL common table expressions.

Derivations are integer-based so that both engines agree to the bit. Every derivation covers the
whole source table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stormledger.functions.clock import axis, step_of

EVENTS = ["click", "error", "purchase", "signup", "view"]
SOUTH, WEST = 20.0, 86.0


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def spread(df: DataFrame, *keys: str, per_task: int | None = None) -> DataFrame:
    """Spread a scan that has fewer splits than the session has cores, before it is expanded.

    With keys, the rows are placed by hash, so later windows and joins on those keys find the
    expanded rows where they need them instead of shuffling them. With per_task the rows are counted,
    and there are as many parts as it takes for so many rows in each.
    """
    session = df.sparkSession
    cores = session.sparkContext.defaultParallelism
    if keys:
        parts = max(cores, int(session.conf.get("spark.sql.shuffle.partitions")))
        return df.repartition(max(parts, -(-df.count() // per_task)) if per_task else parts, *keys)
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def cents(x: Column) -> Column:
    return F.round(x * F.lit(100.0)).cast("long")


def event_buckets(spark: SparkSession, sf: str) -> DataFrame:
    return (
        table(spark, sf, "events")
        .groupBy(F.col("event_type").alias("event"), step_of(F.col("ts")).alias("step"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum(cents(F.col("value"))).alias("v"))
    )


def fixes(spark: SparkSession, sf: str) -> DataFrame:
    """One storm fix per event and 3-hour step; steps without events take the default fix."""
    b = event_buckets(spark, sf)
    v = F.col("v")

    def measured(expr: Column, default: float) -> Column:
        return F.when(F.col("n").isNull(), F.lit(default)).otherwise(expr.cast("double"))

    return (
        axis(b, ["event"], "step")
        .join(b, ["event", "step"], "left")
        .select(
            "event", "step",
            measured(F.lit(15.0) + (v % 800) / F.lit(100.0), 18.0).alias("lat"),
            measured(F.lit(84.0) + (F.floor(v / 7) % 500) / F.lit(100.0), 88.0).alias("lon"),
            measured(F.lit(940.0) + v % 61, 1000.0).alias("pressure"),
            measured(F.lit(20.0) + v % 36, 17.0).alias("max_wind"),
            measured(F.lit(20.0) + F.col("n") % 30, 40.0).alias("radius_km"),
            measured((v % 360).cast("double"), 0.0).alias("heading"),
        )
    )


def cells(spark: SparkSession, sf: str, per_task: int | None = None) -> DataFrame:
    """One grid cell per customer: 40 rows, as many columns as it takes. per_task: see spread."""
    k = F.col("c_custkey")
    col = F.floor(k / 40).cast("long")
    names = F.array(*[F.lit(e) for e in EVENTS])
    return spread(table(spark, sf, "customer"), "c_custkey", per_task=per_task).select(
        k.alias("cell_id"), (k % 40).alias("r"), col.alias("c"),
        (F.lit(20.025) + (k % 40) * F.lit(0.05)).alias("lat"),
        (F.lit(86.025) + (col % 80) * F.lit(0.05)).alias("lon"),
        (F.pmod(cents(F.col("c_acctbal")), F.lit(800)) / F.lit(100.0)).alias("elevation"),
        ((k % 40) * F.lit(2.5)).alias("coast_km"),
        F.col("c_nationkey").cast("long").alias("zone_id"),
        F.element_at(names, (F.col("c_nationkey") % 5 + 1).cast("int")).alias("event"),
    )


def overlap(spark: SparkSession, sf: str) -> DataFrame:
    """Inhabited overlap of zones with cells: every cell in its own zone, a third in the next too."""
    k = F.col("cell_id")
    own = F.struct(
        F.col("zone_id").alias("zone_id"),
        (F.lit(500_000) + (k * 7919 % 30) * 100_000).alias("area_m2"),
    )
    other = F.struct(
        ((F.col("zone_id") + 1) % 25).alias("zone_id"), (k % 20 * 100_000).alias("area_m2")
    )
    pieces = F.when(k % 3 == 0, F.array(own, other)).otherwise(F.array(own))
    return (
        cells(spark, sf)
        .select("cell_id", "event", F.explode(pieces).alias("p"))
        .select("cell_id", "event", "p.zone_id", "p.area_m2")
        .filter("area_m2 > 0")
    )


def zones(spark: SparkSession, sf: str) -> DataFrame:
    """Zone dimension: name, population, inhabited area (a tenth more than the cells cover)."""
    o = overlap(spark, sf).groupBy("zone_id").agg(
        F.sum("area_m2").alias("covered"), F.count(F.lit(1)).alias("n")
    )
    n = table(spark, sf, "nation").select(
        F.col("n_nationkey").cast("long").alias("zone_id"), F.col("n_name").alias("zone_name")
    )
    return n.join(o, "zone_id", "left").select(
        "zone_id", "zone_name",
        (F.coalesce("n", F.lit(0)) * 1370 + F.col("zone_id") * 11).alias("population"),
        F.floor(F.coalesce("covered", F.lit(0)) * 11 / 10).cast("long").alias("inhabited_m2"),
    )


def zone_steps(spark: SparkSession, sf: str) -> DataFrame:
    """Every zone with its own event, and with those of cells it shares, at every step of the event."""
    own = table(spark, sf, "nation").select(
        F.col("n_nationkey").cast("long").alias("zone_id"),
        F.element_at(F.array(*[F.lit(e) for e in EVENTS]), (F.col("n_nationkey") % 5 + 1).cast("int")).alias("event"),
    )
    pairs = own.unionByName(overlap(spark, sf).select("zone_id", "event")).distinct()
    return pairs.join(fixes(spark, sf).select("event", "step"), "event").select("zone_id", "event", "step")


# --- The same derivations as SQL -----------------------------------------------------------------

_NAMES = "[" + ",".join(f"'{e}'" for e in EVENTS) + "]"
CTE: dict[str, tuple[str, list[str]]] = {
    "buckets": (
        """SELECT event_type AS event,
             date_diff('second', TIMESTAMP '1970-01-01 00:00:00', ts) // 10800 AS step,
             count(*)::BIGINT AS n, sum(round(value * 100e0)::BIGINT)::BIGINT AS v
           FROM events GROUP BY 1, 2""",
        [],
    ),
    "fixes": (
        """SELECT a.event, a.step,
             CASE WHEN n IS NULL THEN 18e0 ELSE 15e0 + (v % 800) / 100e0 END AS lat,
             CASE WHEN n IS NULL THEN 88e0 ELSE 84e0 + ((v // 7) % 500) / 100e0 END AS lon,
             CASE WHEN n IS NULL THEN 1000e0 ELSE 940e0 + v % 61 END AS pressure,
             CASE WHEN n IS NULL THEN 17e0 ELSE 20e0 + v % 36 END AS max_wind,
             CASE WHEN n IS NULL THEN 40e0 ELSE 20e0 + n % 30 END AS radius_km,
             CASE WHEN n IS NULL THEN 0e0 ELSE (v % 360)::DOUBLE END AS heading
           FROM (SELECT event, unnest(generate_series(min(step), max(step))) AS step
                 FROM buckets GROUP BY event) a
           LEFT JOIN buckets b ON a.event = b.event AND a.step = b.step""",
        ["buckets"],
    ),
    "cells": (
        f"""SELECT c_custkey AS cell_id, c_custkey % 40 AS r, c_custkey // 40 AS c,
             20.025e0 + (c_custkey % 40) * 0.05e0 AS lat,
             86.025e0 + ((c_custkey // 40) % 80) * 0.05e0 AS lon,
             ((round(c_acctbal * 100e0)::BIGINT % 800 + 800) % 800) / 100e0 AS elevation,
             (c_custkey % 40) * 2.5e0 AS coast_km,
             c_nationkey::BIGINT AS zone_id,
             ({_NAMES})[c_nationkey % 5 + 1] AS event
           FROM customer""",
        [],
    ),
    "overlap": (
        """SELECT cell_id, event, zone_id, 500000 + (cell_id * 7919 % 30) * 100000 AS area_m2
             FROM cells
           UNION ALL
           SELECT cell_id, event, (zone_id + 1) % 25, cell_id % 20 * 100000 FROM cells
             WHERE cell_id % 3 = 0 AND cell_id % 20 > 0""",
        ["cells"],
    ),
    "zone_steps": (
        f"""SELECT p.zone_id, p.event, f.step FROM (
              SELECT n_nationkey::BIGINT AS zone_id, ({_NAMES})[n_nationkey % 5 + 1] AS event FROM nation
              UNION SELECT zone_id, event FROM overlap) p JOIN fixes f ON f.event = p.event""",
        ["overlap", "fixes"],
    ),
    "zones": (
        """SELECT n_nationkey::BIGINT AS zone_id, n_name AS zone_name,
             coalesce(n, 0) * 1370 + n_nationkey * 11 AS population,
             (coalesce(covered, 0) * 11 // 10)::BIGINT AS inhabited_m2
           FROM nation LEFT JOIN (
             SELECT zone_id, sum(area_m2)::BIGINT AS covered, count(*)::BIGINT AS n
             FROM overlap GROUP BY 1) o ON o.zone_id = n_nationkey""",
        ["overlap"],
    ),
}


def with_ctes(*names: str, recursive: bool = False) -> str:
    """A WITH clause holding `names` and all they depend on, in order (ends without a comma)."""
    done: list[str] = []

    def add(name: str) -> None:
        if name in done:
            return
        for dep in CTE[name][1]:
            add(dep)
        done.append(name)

    for name in names:
        add(name)
    head = "WITH RECURSIVE " if recursive else "WITH "
    return head + ", ".join(f"{n} AS ({CTE[n][0]})" for n in done)


def r_sql(expr: str, digits: int) -> str:
    """The half-up rounding rule as SQL."""
    scale = f"{10**digits}e0"
    return f"(floor(({expr}) * {scale} + 0.5e0) / {scale})"


def piecewise_sql(expr: str, points: list[tuple[float, float]], digits: int | None = None) -> str:
    parts = [f"WHEN ({expr}) <= {points[0][0]!r}e0 THEN {points[0][1]!r}e0"]
    for (x0, y0), (x1, y1) in zip(points, points[1:], strict=False):
        parts.append(
            f"WHEN ({expr}) <= {x1!r}e0 THEN "
            f"{y0!r}e0 + ((({expr}) - {x0!r}e0) / {x1 - x0!r}e0) * {y1 - y0!r}e0"
        )
    out = f"CASE {' '.join(parts)} ELSE {points[-1][1]!r}e0 END"
    return r_sql(out, digits) if digits is not None else out
