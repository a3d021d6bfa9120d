"""Rule checks as data: every rule is a boolean Column, every failure a (rule, key) row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LIMITS = {"wind": 65.0, "surge": 6.0, "flood": 1.0}
# Allowed moves of an advisory.
TRANSITIONS = [
    (None, "created"), ("created", "edited"), ("edited", "edited"), ("created", "approved"), ("edited", "approved"),
    ("created", "rejected"), ("edited", "rejected"), ("approved", "sent"), ("sent", "sent"),
]


def violations(df: DataFrame, key: Column, rules: dict[str, Column]) -> DataFrame:
    """(rule, key) for every rule a row breaks; a null outcome counts as broken. One pass."""
    broken = F.array(
        *[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]
    )
    return df.select(key.alias("key"), F.explode(F.filter(broken, lambda x: x.isNotNull())).alias("rule")).select("rule", "key")


def layer_rules(valid_units: dict[str, str], max_step: Column | None = None) -> dict[str, Column]:
    unit = F.create_map(*[x for k, v in valid_units.items() for x in (F.lit(k), F.lit(v))])
    cap = F.create_map(*[x for k, v in LIMITS.items() for x in (F.lit(k), F.lit(v))])
    h, v = F.col("hazard"), F.col("value")
    return {
        "hazard_type": h.isin(list(valid_units)),
        "unit": F.col("unit") == F.element_at(unit, h),
        "severity": F.col("severity").between(0.0, 1.0),
        "value": (v >= 0) & (v <= F.element_at(cap, h)),
    }


def ring_rules(ring: str, box: tuple[float, float, float, float], tolerance: float = 1e-4) -> dict[str, Column]:
    x0, y0, x1, y1 = box
    r = F.col(ring)
    inside = F.forall(
        r, lambda p: p["x"].between(x0 - tolerance, x1 + tolerance) & p["y"].between(y0 - tolerance, y1 + tolerance)
    )
    return {"ring_size": F.size(r) >= 4, "ring_closed": F.element_at(r, 1) == F.element_at(r, -1), "in_box": inside}


def collection_checks(layers: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """Per (keys) layer: row count against the expected one, unique ids, one unit, id suffix."""
    per = layers.groupBy(*keys, "id").agg(
        F.count(F.lit(1)).alias("copies"), F.bool_and(F.col("id").endswith(F.col("suffix"))).alias("suffix_ok"),
        F.min("unit").alias("lo"), F.max("unit").alias("hi"),
    )
    a = per.groupBy(*keys).agg(
        F.sum("copies").alias("rows"), F.count_if(F.col("copies") > 1).alias("duplicates"),
        F.bool_and("suffix_ok").alias("suffix_ok"), F.min("lo").alias("lo"), F.max("hi").alias("hi"),
    )
    return a.join(expected, keys, "full_outer").select(
        *keys, F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("duplicates", F.lit(0)).alias("duplicates"),
        (
            F.coalesce(F.col("rows") == F.col("expected"), F.lit(False)) & (F.coalesce("duplicates", F.lit(0)) == 0)
            & F.coalesce("suffix_ok", F.lit(False)) & F.coalesce(F.col("lo") == F.col("hi"), F.lit(False))
        ).alias("valid"),
    )


def consistency(layers: DataFrame, keys: list[str], hazards: list[str]) -> DataFrame:
    """Cells that some hazard has and another lacks, per (keys)."""
    seen = layers.groupBy(*keys, "cell_id").agg(*[F.bool_or(F.col("hazard") == h).alias(f"has_{h}") for h in hazards])
    return seen.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("cells"), *[F.count_if(~F.col(f"has_{h}")).alias(f"missing_{h}") for h in hazards]
    )


def missing_layers(axis: DataFrame, hazards: DataFrame, present: DataFrame, on: list[str]) -> DataFrame:
    """(hazard, step) combinations of the axis without any row. hazards carries the axis' event key."""
    return axis.join(hazards, "event").select(*on).join(present.select(*on).distinct(), on, "left_anti")


def monotone(points: DataFrame, group: str, x: str, y: str) -> DataFrame:
    """Per breakpoint table whether y never falls and stays in [0, 1]."""
    w = Window.partitionBy(group).orderBy(x)
    step = points.withColumn("prev", F.lag(y).over(w))
    return step.groupBy(group).agg(
        F.bool_and(F.coalesce(F.col("prev") <= F.col(y), F.lit(True))).alias("monotone"),
        F.bool_and(F.col(y).between(0.0, 1.0)).alias("bounded"), F.count(F.lit(1)).alias("points"),
    )


def track_checks(track: DataFrame, axis: DataFrame, key: str, lat: tuple[float, float], lon: tuple[float, float]) -> DataFrame:
    """Per track: fixes, steps off or missing from the axis, bounds, and net northward motion."""
    t = track.join(axis.withColumn("on_axis", F.lit(True)), [key, "step"], "full_outer")
    a = t.groupBy(key).agg(
        F.count("lat").alias("fixes"), F.count_if(F.col("lat").isNull()).alias("missing"),
        F.count_if(F.col("on_axis").isNull()).alias("off_axis"),
        F.bool_and(F.col("lat").between(*lat) & F.col("lon").between(*lon)).alias("in_bounds"),
        F.min_by("lat", F.when(F.col("lat").isNotNull(), F.col("step"))).alias("first"),
        F.max_by("lat", F.when(F.col("lat").isNotNull(), F.col("step"))).alias("last"),
    )
    return a.select(key, "fixes", "missing", "off_axis", "in_bounds", (F.col("last") > F.col("first")).alias("northward"))


def chunked_lag(df: DataFrame, keys: list[str], order: str, value: str, chunk: int, name: str = "prev") -> DataFrame:
    """lag(value) per key where one key may hold any share of the rows.

    Rows are cut into runs of `chunk` order values; each run is a window of its own and takes its
    first value from the last row of the run before, of which there is one per run.
    """
    part = df.withColumn("_run", F.floor(F.col(order) / chunk).cast("long"))
    w = Window.partitionBy(*keys, "_run").orderBy(order)
    ends = part.groupBy(*keys, "_run").agg(F.max_by(value, order).alias("_end"))
    over = Window.partitionBy(*keys).orderBy("_run")
    carried = ends.withColumn("_carry", F.lag("_end").over(over)).select(*keys, "_run", "_carry")
    first = F.row_number().over(w) == 1
    inner = part.withColumn("_in", F.lag(value).over(w)).withColumn("_first", first)
    return (
        inner.join(carried, [*keys, "_run"])
        .withColumn(name, F.when(F.col("_first"), F.col("_carry")).otherwise(F.col("_in")))
        .drop("_run", "_in", "_first", "_carry")
    )


def illegal_moves(log: DataFrame, keys: list[str], order: str, action: str, transitions: DataFrame, chunk: int = 100_000) -> DataFrame:
    """Log rows whose (previous action, action) is not an allowed move."""
    moved = chunked_lag(log, keys, order, action, chunk)
    t = transitions.select(F.coalesce("before", F.lit("")).alias("b"), F.col("after").alias("a"))
    cond = (F.coalesce(moved["prev"], F.lit("")) == t["b"]) & (moved[action] == t["a"])
    return moved.join(t, cond, "left_anti")


def latest_state(log: DataFrame, keys: list[str], order: str, state: str) -> DataFrame:
    return log.groupBy(*keys).agg(F.max_by(state, order).alias("state"), F.max(order).alias("at"), F.count(F.lit(1)).alias("events"))


def payout_rules() -> dict[str, Column]:
    tier, c = F.col("tier"), F.col
    return {
        "unit": c("unit") == F.when(c("metric") == "surge_depth", F.lit("m")).otherwise(F.lit("m/s")),
        "triggered": (c("triggered") == (tier > 0)) & (c("triggered") == (c("observed") >= c("threshold"))),
        "payout": F.abs(c("payout") - c("fraction") * c("sum_insured")) <= 1,
        "released": (c("released_tier") >= tier) & (c("released_payout") >= c("payout")),
    }


def result_rules() -> dict[str, Column]:
    """A clean result has no pathway; an approved advisory names its approver."""
    return {
        "ok_without_pathway": (F.col("status") != "ok") | (F.size("pathway") == 0),
        "approver_named": ~F.col("status").isin("approved", "sent") | F.col("approved_by").isNotNull(),
    }


def falling_totals(totals: DataFrame, keys: list[str], step: str, value: str) -> DataFrame:
    """Steps at which a total that may only grow falls."""
    w = Window.partitionBy(*keys).orderBy(step)
    return totals.withColumn("before", F.lag(value).over(w)).filter(F.col(value) < F.col("before"))


def listing(log: DataFrame, key: str, value, order: str) -> DataFrame:
    return log.filter(F.col(key) == value).orderBy(order)
