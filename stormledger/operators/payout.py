"""Parametric payouts: readings, tiers, the ratchet, and the summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stormledger.operators.quantile import lower_percentile
from stormledger.operators.timeseries import ratchet

# Illustrative terms. (threshold, share of the sum insured) per tier.
WIND_TIERS = [(33.0, 0.25), (46.0, 0.50), (62.0, 1.00)]
SURGE_TIERS = [(1.0, 0.25), (2.0, 0.50), (3.0, 1.00)]
MIN_OVERLAP_M2 = 1_000_000
INSURED_PER_RESIDENT = 1000


def tier_of(value: Column, tiers: list[tuple[float, float]]) -> Column:
    """struct(tier, threshold, fraction): the highest reached, else tier 0 at the first threshold."""

    def entry(i: int, t: float, f: float) -> Column:
        return F.struct(F.lit(i).alias("tier"), F.lit(t).alias("threshold"), F.lit(f).alias("fraction"))

    out = None
    for i, (t, f) in reversed(list(enumerate(tiers, 1))):
        hit = value >= F.lit(t)
        out = F.when(hit, entry(i, t, f)) if out is None else out.when(hit, entry(i, t, f))
    return out.otherwise(entry(0, tiers[0][0], 0.0))


def readings(
    hazard: DataFrame, overlap: DataFrame, zones: DataFrame, keys: list[str], calendar: DataFrame, zone: str = "zone_id"
) -> DataFrame:
    """One row per row of calendar (zone, keys..) and horizon: both readings, the governing metric,
    tier and payout. A zone without a cell that counts reads 0.

    hazard(cell_id, keys.., wind, surge, wind_ahead, surge_ahead); overlap(cell_id, zone_id,
    area_m2). Only pairs covering at least a square kilometre count. The four readings share one
    join and one aggregation: grouping sets give each its own histogram of rounded values, and only
    those are ordered. A hazard without the columns of the next 24 hours gives horizon 0 only.
    """
    ahead = "wind_ahead" in hazard.columns
    values = ["wind", "surge", "wind_ahead", "surge_ahead"][:4 if ahead else 2]
    by = [zone, *keys]
    pairs = overlap.filter(F.col("area_m2") >= MIN_OVERLAP_M2).select("cell_id", zone)
    joined = hazard.select("cell_id", *keys, *values).join(pairs, "cell_id")
    hist = (
        joined.groupingSets([[*by, v] for v in values], *by, *values)
        .agg(F.grouping_id().alias("which"), F.count(F.lit(1)).alias("n"))
        .select(*by, "which", F.coalesce(*values).alias("value"), "n")
    )
    read = lower_percentile(hist, [*by, "which"], "value", weight="n")
    # grouping_id sets a bit per column left out; the value columns are its last bits.
    n = len(values)
    mask = {v: (1 << n) - 1 ^ (1 << n - 1 - i) for i, v in enumerate(values)}
    wide = read.groupBy(*by).agg(
        *[F.coalesce(F.max(F.when(F.col("which") == m, F.col("reading"))), F.lit(0.0)).alias(v) for v, m in mask.items()]
    )
    wide = calendar.select(*by).join(wide, by, "left").na.fill(0.0, values)
    pair = lambda h, w, s: F.struct(F.lit(h).alias("horizon_h"), F.col(w).alias("wind_ms"), F.col(s).alias("surge_m"))
    both = [pair(0, "wind", "surge"), *([pair(24, "wind_ahead", "surge_ahead")] if ahead else [])]
    rows = wide.select(*by, F.explode(F.array(*both)).alias("x")).select(*by, "x.*")
    return govern(rows).join(zones.select(zone, "zone_name", "population"), zone).withColumn(
        "sum_insured", (F.col("population") * INSURED_PER_RESIDENT).cast("decimal(18,2)")
    ).withColumn(
        "payout",
        (F.col("sum_insured") * F.col("fraction").cast("decimal(3,2)")).cast("decimal(18,2)"),
    )


def govern(read: DataFrame) -> DataFrame:
    """The metric that sets the payout: higher tier, then further past its threshold, then wind."""
    r = read.withColumn("w", tier_of(F.col("wind_ms"), WIND_TIERS)).withColumn(
        "s", tier_of(F.col("surge_m"), SURGE_TIERS)
    )
    surge_first = (F.col("s.tier") > F.col("w.tier")) | (
        (F.col("s.tier") == F.col("w.tier"))
        & (F.col("surge_m") / F.col("s.threshold") > F.col("wind_ms") / F.col("w.threshold"))
    )
    pick = F.when(surge_first, F.col("s")).otherwise(F.col("w"))
    return (
        r.withColumn("metric", F.when(surge_first, F.lit("surge_depth")).otherwise(F.lit("wind_speed")))
        .withColumn("observed", F.when(surge_first, F.col("surge_m")).otherwise(F.col("wind_ms")))
        .withColumn("p", pick)
        .select(
            *[c for c in read.columns], "metric", "observed",
            F.col("p.tier").alias("tier"), F.col("p.threshold").alias("threshold"),
            F.col("p.fraction").alias("fraction"),
        )
        .withColumn("triggered", F.col("tier") > 0)
    )


def triggers(read: DataFrame, keys: list[str], step: str = "step") -> DataFrame:
    """Current, released and expected tiers side by side, one row per zone and step.

    Both horizons are folded into one row by an aggregation, so the readings are computed once.
    """
    values = [c for c in read.columns if c not in (*keys, step, "horizon_h")]
    now = F.col("horizon_h") == 0
    wide = read.groupBy(*keys, step).agg(
        F.max(F.when(now, F.struct(*values))).alias("now"),
        F.max(F.when(~now, F.col("tier"))).alias("later"),
    )
    rows = wide.filter("now IS NOT NULL").select(
        *keys, step, "now.*", F.coalesce("later", F.lit(0)).alias("expected_tier_24h")
    )
    return ratchet(rows, keys, step, "tier", "payout")


def district_totals(released: DataFrame, keys: list[str]) -> DataFrame:
    return released.groupBy(*keys).agg(
        F.sum("released_payout").alias("released_payout"),
        F.count_if(F.col("tier") > 0).alias("triggered_zones"),
        F.count_if(F.col("released_tier") > 0).alias("released_zones"),
    )


def zone_summary(released: DataFrame, keys: list[str], landfall_step: str, step_h: int = 3) -> DataFrame:
    """First trigger (step, hours before landfall, metric, tier, payout) and the final release."""
    hit = F.col("tier") > 0
    first = F.min_by(
        F.when(hit, F.struct("step", "metric", "tier", "payout", landfall_step)),
        F.when(hit, F.col("step")),
    )
    last = F.max_by(F.struct("released_tier", "released_payout"), F.col("step"))
    return (
        released.groupBy(*keys)
        .agg(first.alias("f"), last.alias("l"), F.max("sum_insured").alias("sum_insured"))
        .select(
            *keys,
            F.col("f.step").alias("first_step"),
            ((F.col(f"f.{landfall_step}") - F.col("f.step")) * step_h).alias("hours_before_landfall"),
            F.col("f.metric").alias("first_metric"),
            F.coalesce("f.tier", F.lit(0)).alias("first_tier"),
            F.coalesce("f.payout", F.lit(0).cast("decimal(18,2)")).alias("first_payout"),
            F.col("l.released_tier").alias("final_tier"),
            F.col("l.released_payout").alias("final_payout"),
            "sum_insured",
        )
    )


def paying_rows(released: DataFrame, summary: DataFrame, keys: list[str]) -> DataFrame:
    """Zones with money released, largest first, with whether a higher tier was kept or topped up."""
    first = summary.select(*keys, "first_payout")
    return (
        released.filter("released_tier > 0")
        .join(first, keys, "left")
        .withColumn("kept_higher", F.col("tier") < F.col("released_tier"))
        .withColumn("topped_up", F.coalesce(F.col("released_payout") > F.col("first_payout"), F.lit(False)))
        .orderBy(F.desc("released_payout"), *keys)
    )


def total_mismatch(parts: DataFrame, totals: DataFrame, keys: list[str], value: str, tolerance: float = 1.0) -> DataFrame:
    """Keys whose parts do not add up to the stated total."""
    summed = parts.groupBy(*keys).agg(F.sum(value).alias("parts_total"))
    return summed.join(totals, keys, "full_outer").filter(
        F.abs(F.coalesce("parts_total", F.lit(0)) - F.coalesce("total", F.lit(0))) > tolerance
    )


def largest_expected(triggers: DataFrame, keys: list[str]) -> DataFrame:
    """keys, zone_id, expected_tier: of the zones without a release yet, the one with the largest expected
    tier (then payout, then the lower id). triggers: keys, zone_id, released_tier, expected_tier, payout."""
    open_rows = triggers.filter((F.col("released_tier") == 0) & (F.col("expected_tier") > 0))
    best = F.max_by(F.struct("zone_id", "expected_tier"), F.struct("expected_tier", "payout", (-F.col("zone_id")).alias("z"))).alias("x")
    return open_rows.groupBy(*keys).agg(best).select(*keys, "x.*")
