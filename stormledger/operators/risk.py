"""Zone risk: hazard, exposure and vulnerability parts, the composite score and its driver."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stormledger.functions.numeric import clip01, ratio, round_to
from stormledger.operators.quantile import exact_median

# Weights and scales of the score.
W_EXPOSURE, W_VULNERABILITY, W_FLOOD = 0.6, 0.4, 0.1
EXPOSURE_WEIGHTS = {"isolated_facilities": 0.5, "cut_roads": 0.35, "cut_substations": 0.15}
VULNERABILITY_WEIGHTS = {
    "population_density": 0.375, "hospital_access": 0.5, "low_literacy": 0.0, "mapped_shelters": 0.125,
}
SURGE_LAND_M, WIND_LOW, WIND_HIGH = 0.3, 17.0, 60.0
DENSITY_PER_KM2, ACCESS_S, SHELTERS_PER_10K, SUBSTATIONS_CAP = 2000.0, 7200.0, 2.0, 2
SUGGEST_SCORE = 0.25
HORIZONS = {0: "", 24: "_ahead"}  # suffix of the columns of each horizon


def wind_part(speed: Column) -> Column:
    return clip01((speed - F.lit(WIND_LOW)) / F.lit(WIND_HIGH - WIND_LOW))


def density_part(population: Column, area_m2: Column) -> Column:
    km2 = area_m2 / F.lit(1e6)
    return F.when(area_m2 > 0, clip01(population / km2 / F.lit(DENSITY_PER_KM2))).otherwise(1.0)


def access_part(seconds: Column) -> Column:
    return clip01(seconds / F.lit(ACCESS_S))


def shelters_part(shelters: Column, population: Column) -> Column:
    return F.lit(1.0) - clip01(ratio(shelters * F.lit(10000.0), population) / F.lit(SHELTERS_PER_10K))


def _exact_sum(value: Column) -> Column:
    """The sum of values rounded to six digits, exact in any order: counted in millionths, whose upper
    and lower 32 bits are added up as longs by themselves and put together once per group.

    Holds for values below 2^43 and 2^31 rows a group."""
    units = F.floor(value * F.lit(1e6) + F.lit(0.5))
    upper = F.sum(F.shiftright(units, 32)).cast("decimal(20,0)")
    lower = F.sum(units.bitwiseAND(F.lit(0xFFFFFFFF))).cast("decimal(20,0)")
    return ((upper * F.lit(Decimal(1 << 32)) + lower) * F.lit(Decimal("0.000001"))).cast("double")


def hazard_sums(
    hazard: DataFrame, overlap: DataFrame, keys: list[str], horizons: dict[int, str] | None = None,
) -> DataFrame:
    """Flooded area, wind and flood products, and the peaks on land per (zone_id, keys..). overlap may
    bring flood_severity with it, so that the expanded rows of hazard are joined once.

    Products are summed in whole square millimetres (see _exact_sum), so the order of rows does not
    show in the result and no cell is too small to count.
    Cells do not overlap, so flooded land is a plain conditional sum. One join on the cell, one
    partial aggregation down to (zone, keys). horizons maps each horizon to the suffix of its
    columns; all are summed in the same pass.
    """
    area = F.col("area_m2")
    beside = [c for c in overlap.columns if c == "flood_severity"]
    return hazard.join(overlap.select("cell_id", "zone_id", "area_m2", *beside), "cell_id").groupBy("zone_id", *keys).agg(
        _exact_sum(area * F.col("flood_severity")).alias("flood_area"),
        *[
            e
            for h, s in (horizons or HORIZONS).items()
            for e in (
                F.sum(F.when(F.col(f"surge{s}") >= SURGE_LAND_M, area).otherwise(0)).alias(f"flooded_{h}"),
                _exact_sum(area * wind_part(F.col(f"wind{s}"))).alias(f"wind_{h}"),
            )
        ],
        *[F.max(F.when(area > 0, F.col(v))).alias(f"peak_{v}") for v in ("surge", "wind")],
    )


def hazard_parts(
    hazard: DataFrame, overlap: DataFrame, zones: DataFrame, keys: list[str], calendar: DataFrame,
    horizons: dict[int, str] | None = None,
) -> DataFrame:
    """Surge share, wind part and flood severity per row of calendar (zone_id, keys..), over the
    whole inhabited area; a zone without a cell has none of them. See hazard_sums."""
    return parts_of_sums(hazard_sums(hazard, overlap, keys, horizons), zones, keys, calendar, horizons)


def parts_of_sums(
    sums: DataFrame, zones: DataFrame, keys: list[str], calendar: DataFrame, horizons: dict[int, str] | None = None,
) -> DataFrame:
    """hazard_parts from the sums, which hold one row per (zone_id, keys..) and are unfolded here."""
    sums = calendar.select("zone_id", *keys).join(sums, ["zone_id", *keys], "left").na.fill(0)
    rows = F.array(*[
        F.struct(F.lit(h).alias("horizon_h"), F.col(f"flooded_{h}").alias("flooded_m2"), F.col(f"wind_{h}").alias("wind_area"))
        for h in horizons or HORIZONS
    ])
    land = F.col("inhabited_m2")
    return (
        sums.select("zone_id", *keys, "flood_area", F.explode(rows).alias("x")).select("zone_id", *keys, "flood_area", "x.*")
        .join(zones, "zone_id")
        .select(
            "zone_id", *keys, "horizon_h",
            clip01(ratio(F.col("flooded_m2"), land)).alias("surge"),
            clip01(ratio(F.col("wind_area"), land)).alias("wind"),
            clip01(ratio(F.col("flood_area"), land)).alias("flood"),
        )
    )


def impact_counts(impacts: DataFrame, keys: list[str]) -> DataFrame:
    """Isolated facilities in all and by kind, cut road length and cut substations per (zone_id, keys..).

    impacts: one row per (infra, keys) with zone_id, infra_type, status name and length_m (the
    road length inside the zone).
    """
    isolated, cut = F.col("status") == "isolated", F.col("status") == "cut"
    of = lambda kind: F.col("infra_type") == kind
    return impacts.groupBy("zone_id", *keys).agg(
        F.count_if(isolated).alias("isolated"),
        F.count_if(isolated & of("hospital")).alias("isolated_hospitals"),
        F.count_if(isolated & of("shelter")).alias("isolated_shelters"),
        F.sum(F.when(of("road") & cut, F.col("length_m")).otherwise(0)).alias("cut_m"),
        F.count_if(of("substation") & cut).alias("substations"),
    )


def exposure_parts(counts: DataFrame, capacity: DataFrame, keys: list[str]) -> DataFrame:
    """Isolated share, cut road share and capped cut substations per zone.

    counts: see impact_counts. capacity: zone_id, eligible, road_m.
    """
    return counts.join(capacity, "zone_id").select(
        "zone_id", *keys,
        clip01(ratio(F.col("isolated"), F.col("eligible"))).alias("isolated_facilities"),
        clip01(ratio(F.col("cut_m"), F.col("road_m"))).alias("cut_roads"),
        clip01(F.col("substations") / F.lit(float(SUBSTATIONS_CAP))).alias("cut_substations"),
    )


def capacity(infra: DataFrame) -> DataFrame:
    """Per zone: facilities that can be isolated at all, road length, shelters."""
    facility = F.col("infra_type").isin("hospital", "shelter")
    return infra.groupBy("zone_id").agg(
        F.count_if(facility & F.col("in_main") & ~F.col("too_far")).alias("eligible"),
        F.sum(F.when(F.col("infra_type") == "road", F.col("length_m")).otherwise(0)).alias("road_m"),
        F.count_if(F.col("infra_type") == "shelter").alias("shelters"),
    )


def access_median(nodes: DataFrame, zone: str = "zone_id", seconds: str = "seconds") -> DataFrame:
    """Median access time over a zone's nodes, unreachable nodes counting as infinite."""
    t = nodes.withColumn(seconds, F.coalesce(F.col(seconds).cast("double"), F.lit(float("inf"))))
    return exact_median(t, [zone], seconds, "median_s")


def vulnerability_parts(zones: DataFrame, medians: DataFrame, shelters: DataFrame) -> DataFrame:
    z = zones.join(medians, "zone_id", "left").join(shelters.select("zone_id", "shelters"), "zone_id", "left")
    return z.select(
        "zone_id",
        density_part(F.col("population"), F.col("inhabited_m2")).alias("population_density"),
        access_part(F.coalesce("median_s", F.lit(float("inf")))).alias("hospital_access"),
        F.lit(0.0).alias("low_literacy"),
        shelters_part(F.coalesce("shelters", F.lit(0)), F.col("population")).alias("mapped_shelters"),
    )


def _weighted(weights: dict[str, float]) -> Column:
    total = None
    for name, w in weights.items():
        term = F.lit(w) * F.col(name)
        total = term if total is None else total + term
    return total


def composite(parts: DataFrame) -> DataFrame:
    """hazard, exposure, vulnerability, reach, score and top driver from the ten parts."""
    hazard = clip01(F.greatest("surge", "wind") + F.lit(W_FLOOD) * F.col("flood"))
    scored = (
        parts.withColumn("hazard", hazard)
        .withColumn("exposure", _weighted(EXPOSURE_WEIGHTS))
        .withColumn("vulnerability", _weighted(VULNERABILITY_WEIGHTS))
        .withColumn("reach", F.when(F.col("hazard") >= F.col("exposure"), F.lit("direct")).otherwise(F.lit("cut_off")))
        .withColumn(
            "score",
            F.greatest("hazard", "exposure")
            * (F.lit(W_EXPOSURE) * F.col("exposure") + F.lit(W_VULNERABILITY) * F.col("vulnerability")),
        )
    )
    return scored.withColumn("top_driver", top_driver())


def _first_largest(terms: list[tuple[str, Column]]) -> tuple[Column, Column]:
    best = F.greatest(*[c for _, c in terms])
    name = None
    for n, c in terms:
        name = F.when(c == best, F.lit(n)) if name is None else name.when(c == best, F.lit(n))
    return name, best


def top_driver() -> Column:
    """The largest weighted part, earlier parts winning ties; hazard parts only where no other
    part counts; null for a zero score."""
    terms = [(n, F.lit(W_EXPOSURE * w) * F.col(n)) for n, w in EXPOSURE_WEIGHTS.items()]
    terms += [(n, F.lit(W_VULNERABILITY * w) * F.col(n)) for n, w in VULNERABILITY_WEIGHTS.items() if w > 0]
    name, best = _first_largest(terms)
    fallback, _ = _first_largest(
        [("surge", F.col("surge")), ("wind", F.col("wind")), ("flood", F.lit(W_FLOOD) * F.col("flood"))]
    )
    return F.when(F.col("score") > 0, F.when(best > 0, name).otherwise(fallback))


def surge_population(df: DataFrame) -> DataFrame:
    """People on flooded land, the population spread evenly over it."""
    return df.withColumn(
        "surge_population", F.floor(F.col("population") * F.col("surge") + F.lit(0.5)).cast("long")
    )


def rounded(df: DataFrame, columns: list[str], digits: int = 4) -> DataFrame:
    return df.withColumns({c: round_to(F.col(c), digits) for c in columns})


def peak_on_land(hazard: DataFrame, overlap: DataFrame, zones: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Highest value over the cells a zone truly overlaps, 0 where there are none."""
    peak = (
        hazard.join(overlap.filter("area_m2 > 0").select("cell_id", "zone_id"), "cell_id")
        .groupBy("zone_id", *keys)
        .agg(F.max(value).alias("peak"))
    )
    return zones.select("zone_id").join(peak, "zone_id", "left").withColumn(
        "peak", F.coalesce("peak", F.lit(0.0))
    )


def suggestions(scores: DataFrame, expected: DataFrame, threshold: float = SUGGEST_SCORE) -> DataFrame:
    """Zones to alert: score at or above the threshold, or facilities expected to be cut off.

    expected(zone_id, facilities): counts per zone; the reasons themselves stay rows
    (`suggestion_reasons`), so no group is gathered.
    """
    s = scores.join(expected, "zone_id", "left").withColumn("facilities", F.coalesce("facilities", F.lit(0)))
    by_risk = F.col("score") >= threshold
    return (
        s.filter(by_risk | (F.col("facilities") > 0))
        .withColumn("by_risk", by_risk)
        .orderBy(F.desc("score"), "zone_name")
    )


def suggestion_reasons(scores: DataFrame, facilities: DataFrame, threshold: float = SUGGEST_SCORE) -> DataFrame:
    """One row per reason: the risk score first (ord 0), then facilities by name (ord 1)."""
    risk = scores.filter(F.col("score") >= threshold).select(
        "zone_id", F.lit(0).alias("ord"), F.lit("risk").alias("kind"),
        F.format_string("risk %.2f", round_to(F.col("score"), 2)).alias("label"),
        F.lit(None).cast("long").alias("infra_id"),
    )
    cut = facilities.select(
        "zone_id", F.lit(1).alias("ord"), F.lit("expected_cut_off").alias("kind"),
        F.concat("label", F.lit(" expected to be cut off")).alias("label"), "infra_id",
    )
    return risk.unionByName(cut)
