"""Payouts, zone risk, grading and series queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from stormledger.functions import clock as T
from stormledger.functions.numeric import round_to
from stormledger.operators import grading as G
from stormledger.operators import payout as P
from stormledger.operators import quantile as Q
from stormledger.operators import risk as R
from stormledger.operators import timeseries as TS
from stormledger.plans import inputs as I
from stormledger.plans.hazard_queries import flood_cells, hazard_ahead, hazard_cells, hazard_wide
from stormledger.plans.inputs import CTE, r_sql, with_ctes
from stormledger.plans.registry import query
from stormledger.session import materialise

# --- Payouts -------------------------------------------------------------------------------------

_TIER = "CASE WHEN {v} >= {c} THEN 3 WHEN {v} >= {b} THEN 2 WHEN {v} >= {a} THEN 1 ELSE 0 END"
_LIMIT = "CASE WHEN {v} >= {c} THEN {c} WHEN {v} >= {b} THEN {b} ELSE {a} END"
_W = {"v": "wind_ms", "a": "33e0", "b": "46e0", "c": "62e0"}
_S = {"v": "surge_m", "a": "1e0", "b": "2e0", "c": "3e0"}
CTE["ranked"] = (
    """SELECT o.zone_id, h.event, h.step, h.horizon_h, wind, surge,
         row_number() OVER (PARTITION BY o.zone_id, h.event, h.step, h.horizon_h ORDER BY wind) AS rw,
         row_number() OVER (PARTITION BY o.zone_id, h.event, h.step, h.horizon_h ORDER BY surge) AS rs,
         count(*) OVER (PARTITION BY o.zone_id, h.event, h.step, h.horizon_h) AS n
       FROM hazard_ahead h JOIN overlap o ON o.cell_id = h.cell_id AND o.area_m2 >= 1000000""",
    ["hazard_ahead", "overlap"],
)
CTE["readings"] = (
    f"""SELECT r.*, z.zone_name, z.population, z.population * 1000.00::DECIMAL(18,2) AS sum_insured,
          CASE WHEN surge_first THEN 'surge_depth' ELSE 'wind_speed' END AS metric,
          CASE WHEN surge_first THEN surge_m ELSE wind_ms END AS observed,
          CASE WHEN surge_first THEN st ELSE wt END AS tier,
          CASE WHEN surge_first THEN sl ELSE wl END AS threshold,
          (z.population * 1000 * CASE CASE WHEN surge_first THEN st ELSE wt END
             WHEN 3 THEN 100 WHEN 2 THEN 50 WHEN 1 THEN 25 ELSE 0 END) // 100 AS payout
        FROM (SELECT *, st > wt OR (st = wt AND surge_m / sl > wind_ms / wl) AS surge_first FROM (
          SELECT *, {_TIER.format(**_W)} AS wt, {_LIMIT.format(**_W)} AS wl,
            {_TIER.format(**_S)} AS st, {_LIMIT.format(**_S)} AS sl FROM (
            SELECT zone_id, event, step, horizon_h, coalesce(wind_ms, 0e0) AS wind_ms, coalesce(surge_m, 0e0) AS surge_m
            FROM zone_steps CROSS JOIN (VALUES (0), (24)) h(horizon_h) LEFT JOIN (
              SELECT zone_id, event, step, horizon_h,
                max(wind) FILTER (rw = (n - 1) * 9 // 10 + 1) AS wind_ms,
                max(surge) FILTER (rs = (n - 1) * 9 // 10 + 1) AS surge_m
              FROM ranked GROUP BY 1, 2, 3, 4) USING (zone_id, event, step, horizon_h)))) r JOIN zones z ON z.zone_id = r.zone_id""",
    ["ranked", "zones", "zone_steps"],
)
CTE["released"] = (
    """SELECT *, max(tier) OVER w AS released_tier,
         arg_max(payout, tier * 10000000 - step) OVER w AS released_payout
       FROM readings WHERE horizon_h = 0
       WINDOW w AS (PARTITION BY zone_id, event ORDER BY step ROWS UNBOUNDED PRECEDING)""",
    ["readings"],
)


def zone_readings(spark, sf):
    return P.readings(
        hazard_wide(spark, sf), I.overlap(spark, sf).drop("event"), I.zones(spark, sf), ["event", "step"],
        I.zone_steps(spark, sf),
    )


def _released(spark, sf):
    now = P.readings(
        hazard_cells(spark, sf), I.overlap(spark, sf).drop("event"), I.zones(spark, sf), ["event", "step"], I.zone_steps(spark, sf),
    )
    return TS.ratchet(now, ["zone_id", "event"], "step", "tier", "payout")


@query(
    "payout_readings",
    with_ctes("readings")
    + "SELECT zone_id, event, step, horizon_h, wind_ms, surge_m, metric, observed, tier, threshold, payout::DOUBLE AS payout FROM readings",
)
def payout_readings(spark, sf):
    return zone_readings(spark, sf).select(
        "zone_id", "event", "step", "horizon_h", "wind_ms", "surge_m", "metric", "observed", "tier",
        "threshold", F.col("payout").cast("double").alias("payout"),
    )


@query(
    "payout_triggers",
    with_ctes("released")
    + """SELECT r.zone_id, r.event, r.step, r.tier, r.tier > 0 AS triggered, r.released_tier,
        r.released_payout::DOUBLE AS released_payout, coalesce(e.tier, 0) AS expected_tier_24h
        FROM released r LEFT JOIN readings e ON e.zone_id = r.zone_id AND e.event = r.event
          AND e.step = r.step AND e.horizon_h = 24""",
)
def payout_triggers(spark, sf):
    return P.triggers(zone_readings(spark, sf), ["zone_id", "event"]).select(
        "zone_id", "event", "step", "tier", "triggered", "released_tier",
        F.col("released_payout").cast("double").alias("released_payout"), "expected_tier_24h",
    )


@query(
    "payout_district",
    with_ctes("released")
    + """SELECT event, step, sum(released_payout)::DOUBLE AS released_payout,
        count_if(tier > 0)::BIGINT AS triggered_zones, count_if(released_tier > 0)::BIGINT AS released_zones
        FROM released GROUP BY 1, 2""",
)
def payout_district(spark, sf):
    return P.district_totals(_released(spark, sf), ["event", "step"]).withColumn(
        "released_payout", F.col("released_payout").cast("double")
    )


@query(
    "payout_summary",
    with_ctes("released")
    + """, last AS (SELECT event, max(step) AS landfall FROM released GROUP BY 1),
        f AS (SELECT zone_id, event, min(step) FILTER (tier > 0) AS s0, max(step) AS s1 FROM released GROUP BY 1, 2)
        SELECT f.zone_id, f.event, f.s0 AS first_step, (landfall - f.s0) * 3 AS hours_before_landfall,
          a.metric AS first_metric, coalesce(a.tier, 0) AS first_tier, coalesce(a.payout, 0)::DOUBLE AS first_payout,
          b.released_tier AS final_tier, b.released_payout::DOUBLE AS final_payout, b.sum_insured::DOUBLE AS sum_insured
        FROM f JOIN last ON last.event = f.event
        LEFT JOIN released a ON a.zone_id = f.zone_id AND a.event = f.event AND a.step = f.s0
        JOIN released b ON b.zone_id = f.zone_id AND b.event = f.event AND b.step = f.s1""",
)
def payout_summary(spark, sf):
    rel = _released(spark, sf)
    last = I.event_buckets(spark, sf).groupBy("event").agg(F.max("step").alias("landfall"))
    s = P.zone_summary(rel.join(last, "event"), ["zone_id", "event"], "landfall")
    return s.withColumns({c: F.col(c).cast("double") for c in ("first_payout", "final_payout", "sum_insured")})


@query(
    "payout_paying_rows",
    with_ctes("released")
    + """, f AS (SELECT zone_id, event, arg_min(payout, step) FILTER (tier > 0) AS first_payout FROM released GROUP BY 1, 2)
        SELECT r.zone_id, r.event, r.step, r.released_payout::DOUBLE AS released_payout, r.tier < r.released_tier AS kept_higher,
          coalesce(r.released_payout > f.first_payout, false) AS topped_up
        FROM released r LEFT JOIN f ON f.zone_id = r.zone_id AND f.event = r.event WHERE r.released_tier > 0""",
)
def payout_paying_rows(spark, sf):
    rel = materialise(_released(spark, sf), "released")
    first = rel.groupBy("zone_id", "event").agg(
        F.min_by(F.when(F.col("tier") > 0, F.col("payout")), F.when(F.col("tier") > 0, F.col("step"))).alias("first_payout")
    )
    return P.paying_rows(rel, first, ["zone_id", "event"]).select(
        "zone_id", "event", "step", F.col("released_payout").cast("double").alias("released_payout"),
        "kept_higher", "topped_up",
    )


# --- Zone risk -----------------------------------------------------------------------------------

_KIND = """CASE p_type WHEN 'ECONOMY' THEN 'road' WHEN 'LARGE' THEN 'road' WHEN 'SMALL' THEN 'substation'
  WHEN 'MEDIUM' THEN 'power_line' WHEN 'PROMO' THEN 'hospital' ELSE 'shelter' END"""
CTE["infra"] = (
    f"""SELECT p_partkey AS infra_id, {_KIND} AS infra_type, p_type = 'LARGE' AS ferry, p_name AS name,
          p_brand AS brand, c.cell_id, c.zone_id, c.event, 200 + p_size * 37 AS length_m,
          p_partkey % 17 = 0 AS too_far, p_partkey % 19 <> 0 AS in_main
        FROM part JOIN cells c ON c.cell_id = p_partkey * 3 // 4""",
    ["cells"],
)
CTE["infra_hazard"] = (
    """SELECT i.*, h.step, h.horizon_h, h.wind, h.surge,
         CASE WHEN infra_type IN ('hospital', 'shelter') THEN
                CASE WHEN h.surge >= 0.3e0 AND in_main AND NOT too_far THEN 'isolated'
                     WHEN h.surge >= 0.15e0 OR h.wind >= 33 THEN 'at_risk' ELSE 'ok' END
              WHEN ferry THEN CASE WHEN h.wind >= 17 THEN 'cut' WHEN h.wind >= 12 THEN 'at_risk' ELSE 'ok' END
              WHEN infra_type = 'road' THEN CASE WHEN h.surge >= 0.3e0 THEN 'cut' WHEN h.surge >= 0.15e0 THEN 'at_risk' ELSE 'ok' END
              WHEN infra_type = 'substation' THEN CASE WHEN h.surge >= 0.5e0 THEN 'cut' WHEN h.wind >= 33 THEN 'at_risk' ELSE 'ok' END
              ELSE CASE WHEN h.wind >= 33 THEN 'at_risk' ELSE 'ok' END END AS status
       FROM infra i JOIN hazard_ahead h ON h.cell_id = i.cell_id""",
    ["infra", "hazard_ahead"],
)
CTE["capacity"] = (
    """SELECT zone_id, count_if(infra_type IN ('hospital', 'shelter') AND in_main AND NOT too_far)::BIGINT AS eligible,
         sum(CASE WHEN infra_type = 'road' THEN length_m ELSE 0 END)::BIGINT AS road_m,
         count_if(infra_type = 'shelter')::BIGINT AS shelters FROM infra GROUP BY 1""",
    ["infra"],
)
_C01 = "least(1e0, greatest(0e0, {}))"
CTE["hazard_parts"] = (
    f"""SELECT s.zone_id, s.event, s.step, e.horizon_h,
          {_C01.format("CASE WHEN inhabited_m2 > 0 THEN coalesce(flooded, 0) / inhabited_m2::DOUBLE ELSE 0 END")} AS surge,
          {_C01.format("CASE WHEN inhabited_m2 > 0 THEN coalesce(wind_area, 0) / inhabited_m2 ELSE 0 END")} AS wind,
          {_C01.format("CASE WHEN inhabited_m2 > 0 THEN coalesce(flood_area, 0) / inhabited_m2 ELSE 0 END")} AS flood
        FROM zone_steps s CROSS JOIN (VALUES (0), (24)) e(horizon_h) LEFT JOIN (SELECT o.zone_id, a.event, a.step, a.horizon_h,
            sum(CASE WHEN surge >= 0.3e0 THEN area_m2 ELSE 0 END)::BIGINT AS flooded,
            sum({r_sql('area_m2 * least(1e0, greatest(0e0, (wind - 17e0) / 43e0))', 6)}::DECIMAL(24,6))::DOUBLE AS wind_area,
            sum({r_sql(f"area_m2 * {r_sql('f.flood', 2)}", 6)}::DECIMAL(24,6))::DOUBLE AS flood_area
          FROM hazard_ahead a JOIN flood f ON f.cell_id = a.cell_id JOIN overlap o ON o.cell_id = a.cell_id
          GROUP BY 1, 2, 3, 4) h ON h.zone_id = s.zone_id AND h.event = s.event AND h.step = s.step AND h.horizon_h = e.horizon_h
        JOIN zones z ON z.zone_id = s.zone_id""",
    ["hazard_ahead", "flood", "overlap", "zones", "zone_steps"],
)
CTE["exposure_parts"] = (
    f"""SELECT i.zone_id, i.event, i.step, i.horizon_h,
          {_C01.format("CASE WHEN eligible > 0 THEN isolated / eligible::DOUBLE ELSE 0 END")} AS isolated_facilities,
          {_C01.format("CASE WHEN road_m > 0 THEN cut_m / road_m::DOUBLE ELSE 0 END")} AS cut_roads,
          {_C01.format("substations / 2e0")} AS cut_substations
        FROM (SELECT zone_id, event, step, horizon_h, count_if(status = 'isolated') AS isolated,
            sum(CASE WHEN infra_type = 'road' AND status = 'cut' THEN length_m ELSE 0 END)::BIGINT AS cut_m,
            count_if(infra_type = 'substation' AND status = 'cut') AS substations
          FROM infra_hazard GROUP BY 1, 2, 3, 4) i JOIN capacity c ON c.zone_id = i.zone_id""",
    ["infra_hazard", "capacity"],
)
CTE["access"] = (
    """SELECT zone_id, median(CASE WHEN cell_id % 11 = 0 THEN 'infinity'::DOUBLE ELSE (cell_id * 7919 % 9000)::DOUBLE END) AS median_s
       FROM cells GROUP BY 1""",
    ["cells"],
)
CTE["vulnerability_parts"] = (
    f"""SELECT z.zone_id,
          CASE WHEN inhabited_m2 > 0 THEN {_C01.format("population / (inhabited_m2 / 1e6) / 2000e0")} ELSE 1e0 END AS population_density,
          {_C01.format("coalesce(median_s, 'infinity'::DOUBLE) / 7200e0")} AS hospital_access, 0e0 AS low_literacy,
          1e0 - {_C01.format("(CASE WHEN population > 0 THEN coalesce(shelters, 0) * 10000e0 / population ELSE 0 END) / 2e0")} AS mapped_shelters
        FROM zones z LEFT JOIN access a ON a.zone_id = z.zone_id LEFT JOIN capacity c ON c.zone_id = z.zone_id""",
    ["zones", "access", "capacity"],
)
_DRIVERS = [
    ("isolated_facilities", 0.6 * 0.5), ("cut_roads", 0.6 * 0.35), ("cut_substations", 0.6 * 0.15),
    ("population_density", 0.4 * 0.375), ("hospital_access", 0.4 * 0.5), ("mapped_shelters", 0.4 * 0.125),
]
_BEST = "greatest(" + ", ".join(f"{w!r}e0 * {n}" for n, w in _DRIVERS) + ")"
_PICK = " ".join(f"WHEN {w!r}e0 * {n} = {_BEST} THEN '{n}'" for n, w in _DRIVERS)
CTE["scores"] = (
    f"""SELECT *, CASE WHEN score > 0 THEN CASE WHEN {_BEST} > 0 THEN CASE {_PICK} END
            WHEN surge = greatest(surge, wind, 0.1e0 * flood) THEN 'surge'
            WHEN wind = greatest(surge, wind, 0.1e0 * flood) THEN 'wind' ELSE 'flood' END END AS top_driver
        FROM (SELECT *, CASE WHEN hazard >= exposure THEN 'direct' ELSE 'cut_off' END AS reach,
            greatest(hazard, exposure) * (0.6e0 * exposure + 0.4e0 * vulnerability) AS score
          FROM (SELECT h.*, coalesce(e.isolated_facilities, 0e0) AS isolated_facilities, coalesce(e.cut_roads, 0e0) AS cut_roads,
              coalesce(e.cut_substations, 0e0) AS cut_substations,
              v.population_density, v.hospital_access, v.low_literacy, v.mapped_shelters,
              z.zone_name, z.population,
              {_C01.format("greatest(h.surge, h.wind) + 0.1e0 * h.flood")} AS hazard,
              0.5e0 * coalesce(e.isolated_facilities, 0e0) + 0.35e0 * coalesce(e.cut_roads, 0e0)
                + 0.15e0 * coalesce(e.cut_substations, 0e0) AS exposure,
              0.375e0 * population_density + 0.5e0 * hospital_access + 0e0 * low_literacy + 0.125e0 * mapped_shelters AS vulnerability
            FROM hazard_parts h LEFT JOIN exposure_parts e ON e.zone_id = h.zone_id AND e.event = h.event
              AND e.step = h.step AND e.horizon_h = h.horizon_h
            JOIN vulnerability_parts v ON v.zone_id = h.zone_id JOIN zones z ON z.zone_id = h.zone_id))""",
    ["hazard_parts", "exposure_parts", "vulnerability_parts"],
)


def infra(spark, sf):
    kind = F.expr(_KIND)
    k = F.col("p_partkey")
    p = I.table(spark, sf, "part").select(
        k.alias("infra_id"), kind.alias("infra_type"), (F.col("p_type") == "LARGE").alias("ferry"),
        F.col("p_name").alias("name"), F.col("p_brand").alias("brand"),
        F.floor(k * 3 / 4).cast("long").alias("cell_id"), (F.lit(200) + F.col("p_size") * 37).alias("length_m"),
        (k % 17 == 0).alias("too_far"), (k % 19 != 0).alias("in_main"),
    )
    return p.join(I.cells(spark, sf).select("cell_id", "zone_id", "event"), "cell_id")


def infra_status(spark, sf, hazard):
    """Status of each feature per step and horizon from the hazard of its cell.

    hazard has a row per horizon, or wind_ahead and surge_ahead, which are unfolded after the join.
    """
    i = infra(spark, sf)
    wide = "wind_ahead" in hazard.columns
    h = hazard.select("cell_id", "step", "wind", "surge", *(["wind_ahead", "surge_ahead"] if wide else ["horizon_h"]))
    surge, wind = F.col("surge"), F.col("wind")
    never = F.lit(None).cast("double")

    def worst(*grades):
        return F.greatest(*grades) if len(grades) > 1 else grades[0]

    kind = G.link_kind(F.col("ferry"), F.lit(False))
    road = G.grade(surge, F.lit(0.15), F.lit(0.3))
    code = (
        F.when(
            F.col("infra_type").isin("hospital", "shelter"),
            F.when((surge >= 0.3) & F.col("in_main") & ~F.col("too_far"), F.lit(G.ISOLATED)).otherwise(
                worst(G.grade(surge, F.lit(0.15), never), G.grade(wind, F.lit(33.0), never))
            ),
        )
        .when((F.col("infra_type") == "road") & (kind == "ferry"), G.grade(wind, F.lit(12.0), F.lit(17.0)))
        .when(F.col("infra_type") == "road", road)
        .when(
            F.col("infra_type") == "substation",
            worst(G.grade(surge, never, F.lit(0.5)), G.grade(wind, F.lit(33.0), never)),
        )
        .otherwise(G.grade(wind, F.lit(33.0), never))
    )
    met = i.join(h, "cell_id")
    met = TS.unfold_horizons(met, ["wind", "surge"]) if wide else met
    return met.withColumn("status", G.status_name(code))


_AT = ["event", "step"]


def zone_sums(spark, sf):
    """(sums and peaks of the hazard per zone and step, counts of impacts per zone, step and horizon), stored.

    The layer, a row per cell and step, is worked out for each of the two where its cells lie, and only
    joined with rows placed by cell as they are: it is neither written nor shuffled.
    """
    wide = hazard_wide(spark, sf).drop("zone_id")
    flood = flood_cells(spark, sf).select("cell_id", round_to(F.col("flood"), 2).alias("flood_severity"))
    land = I.overlap(spark, sf).drop("event").join(flood, "cell_id", "left")
    sums = R.hazard_sums(wide, land, _AT)
    counts = R.impact_counts(infra_status(spark, sf, wide), [*_AT, "horizon_h"])
    return materialise(sums, "zone-sums"), materialise(counts, "zone-impacts")


def zone_scores(spark, sf, sums_and_counts=None):
    """All parts, components and scores per (zone, event, step, horizon)."""
    keys = [*_AT, "horizon_h"]
    z, cap = I.zones(spark, sf), R.capacity(infra(spark, sf))
    sums, counts = sums_and_counts or zone_sums(spark, sf)
    parts = (
        R.parts_of_sums(sums, z, _AT, I.zone_steps(spark, sf))
        .join(R.exposure_parts(counts, cap, keys), ["zone_id", *keys], "left")
        .na.fill(0.0, list(R.EXPOSURE_WEIGHTS))
        .join(R.vulnerability_parts(z, medians(spark, sf), cap), "zone_id")
        .join(z.select("zone_id", "zone_name", "population"), "zone_id")
    )
    return R.surge_population(R.composite(parts))


def medians(spark, sf):
    k = F.col("cell_id")
    nodes = I.cells(spark, sf).select("zone_id", F.when(k % 11 != 0, k * 7919 % 9000).alias("seconds"))
    return R.access_median(nodes)


_PARTS = [
    "surge", "wind", "flood", "isolated_facilities", "cut_roads", "cut_substations",
    "population_density", "hospital_access", "mapped_shelters",
]
_COMPONENTS = ["score", "hazard", "exposure", "vulnerability"]


@query(
    "zone_score",
    with_ctes("scores")
    + f"""SELECT zone_id, zone_name, event, step, horizon_h, reach, top_driver,
        floor(population * surge + 0.5e0)::BIGINT AS surge_population,
        {', '.join(f'{r_sql(c, 4)} AS {c}' for c in _COMPONENTS)} FROM scores""",
)
def zone_score(spark, sf):
    """Flagship: which zones will be at risk, when, and why."""
    return R.rounded(
        zone_scores(spark, sf).select(
            "zone_id", "zone_name", "event", "step", "horizon_h", "reach", "top_driver",
            "surge_population", *_COMPONENTS,
        ),
        _COMPONENTS,
    )


@query(
    "zone_breakdown",
    with_ctes("scores")
    + f"""SELECT zone_id, event, step, horizon_h, {', '.join(f'{r_sql(c, 4)} AS {c}' for c in _PARTS)} FROM scores""",
)
def zone_breakdown(spark, sf):
    return R.rounded(zone_scores(spark, sf).select("zone_id", "event", "step", "horizon_h", *_PARTS), _PARTS)


@query(
    "zone_people",
    with_ctes("hazard_parts")
    + """SELECT event, step, horizon_h, sum(floor(population * surge + 0.5e0)::BIGINT)::BIGINT AS surge_population
        FROM hazard_parts h JOIN zones z ON z.zone_id = h.zone_id GROUP BY 1, 2, 3""",
)
def zone_people(spark, sf):
    z = I.zones(spark, sf)
    wide = hazard_wide(spark, sf).drop("zone_id")
    flood = flood_cells(spark, sf).select("cell_id", round_to(F.col("flood"), 2).alias("flood_severity"))
    parts = R.hazard_parts(wide.join(flood, "cell_id"), I.overlap(spark, sf).drop("event"), z, ["event", "step"], I.zone_steps(spark, sf))
    return (
        R.surge_population(parts.join(z.select("zone_id", "population"), "zone_id"))
        .groupBy("event", "step", "horizon_h")
        .agg(F.sum("surge_population").alias("surge_population"))
    )


@query("zone_access_median", with_ctes("access") + "SELECT zone_id, median_s FROM access")
def zone_access_median(spark, sf):
    return medians(spark, sf)


@query(
    "peak_on_land",
    with_ctes("hazard", "zones")
    + """SELECT z.zone_id, coalesce(max(h.surge), 0e0) AS peak FROM zones z LEFT JOIN overlap o ON o.zone_id = z.zone_id
        LEFT JOIN hazard h ON h.cell_id = o.cell_id GROUP BY 1""",
)
def peak_on_land(spark, sf):
    h = TS.whole_event_max(hazard_cells(spark, sf), ["cell_id"], ["surge"])
    return R.peak_on_land(h, I.overlap(spark, sf), I.zones(spark, sf), [], "surge")


CTE["mid"] = ("SELECT event, max(step) // 2 + min(step) // 2 AS step FROM fixes GROUP BY event", ["fixes"])


def _mid(spark, sf):
    return I.fixes(spark, sf).groupBy("event").agg(
        (F.floor(F.max("step") / 2) + F.floor(F.min("step") / 2)).cast("long").alias("step")
    )


@query(
    "alert_suggestions",
    with_ctes("scores", "mid")
    + f""", now AS (SELECT s.* FROM scores s JOIN mid m ON m.event = s.event AND m.step = s.step WHERE horizon_h = 24),
        x AS (SELECT i.zone_id, i.event, count(DISTINCT i.infra_id)::BIGINT AS facilities FROM infra_hazard i
          JOIN mid m ON m.event = i.event AND m.step = i.step
          WHERE horizon_h = 24 AND status = 'isolated' AND NOT regexp_matches(name, 'small|old') GROUP BY 1, 2)
        SELECT n.zone_id, n.event, n.zone_name, {r_sql('score', 4)} AS score, coalesce(facilities, 0) AS facilities,
          score >= 0.25e0 AS by_risk FROM now n LEFT JOIN x ON x.zone_id = n.zone_id AND x.event = n.event
        WHERE score >= 0.25e0 OR facilities > 0""",
)
def alert_suggestions(spark, sf):
    mid = _mid(spark, sf)
    now = zone_scores(spark, sf).filter("horizon_h = 24").join(mid, ["event", "step"])
    ahead = hazard_ahead(spark, sf).filter("horizon_h = 24").join(mid, ["event", "step"]).drop("zone_id", "event")
    out = (
        infra_status(spark, sf, ahead)
        .filter((F.col("status") == "isolated") & ~F.col("name").rlike("small|old"))
        .groupBy("zone_id", "event")
        .agg(F.count_distinct("infra_id").alias("facilities"))
    )
    # One row per (zone, event): the pair stands in for the zone key of the operator.
    pair = F.concat_ws("/", "zone_id", "event")
    s = R.suggestions(
        now.withColumn("zone", F.col("zone_id")).withColumn("zone_id", pair),
        out.withColumn("zone_id", pair).drop("event"),
    )
    return s.select(
        F.col("zone").alias("zone_id"), "event", "zone_name", round_to(F.col("score"), 4).alias("score"),
        "facilities", "by_risk",
    )


# --- Grading -------------------------------------------------------------------------------------

_GK = "['road', 'ferry', 'substation', 'power_line', 'hospital', 'shelter', 'connector']"
CTE["graded"] = (
    f"""SELECT *, CASE WHEN kind = 'road' AND hazard = 'surge' THEN CASE WHEN value >= 0.3e0 THEN 2 WHEN value >= 0.15e0 THEN 1 ELSE 0 END
          WHEN kind = 'ferry' AND hazard = 'wind' THEN CASE WHEN value >= 17 THEN 2 WHEN value >= 12 THEN 1 ELSE 0 END
          WHEN kind = 'substation' AND hazard = 'surge' THEN CASE WHEN value >= 0.5e0 THEN 2 ELSE 0 END
          WHEN kind IN ('road', 'substation', 'hospital', 'shelter') AND hazard = 'flood' THEN CASE WHEN severity >= 0.7e0 THEN 1 ELSE 0 END
          WHEN kind IN ('substation', 'power_line', 'hospital', 'shelter') AND hazard = 'wind' THEN CASE WHEN value >= 33 THEN 1 ELSE 0 END
          WHEN kind IN ('hospital', 'shelter') AND hazard = 'surge' THEN CASE WHEN value >= 0.15e0 THEN 1 ELSE 0 END
          ELSE 0 END AS status
        FROM (SELECT *, CASE WHEN hazard = 'flood' THEN value / 50e0 ELSE 0e0 END AS severity FROM (
          SELECT l_orderkey, l_partkey, l_suppkey, ({_GK})[l_partkey % 7 + 1] AS kind,
            (['surge', 'wind', 'flood'])[l_linenumber % 3 + 1] AS hazard,
            CASE WHEN l_linenumber % 3 = 0 THEN l_quantity / 100e0 ELSE l_quantity END AS value FROM lineitem))""",
    [],
)


def graded(spark, sf):
    kinds = F.array(*[F.lit(k) for k in ["road", "ferry", "substation", "power_line", "hospital", "shelter", "connector"]])
    hazards = F.array(F.lit("surge"), F.lit("wind"), F.lit("flood"))
    li = I.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey",
        F.element_at(kinds, (F.col("l_partkey") % 7 + 1).cast("int")).alias("kind"),
        F.element_at(hazards, (F.col("l_linenumber") % 3 + 1).cast("int")).alias("hazard"),
        F.when(F.col("l_linenumber") % 3 == 0, F.col("l_quantity") / 100.0).otherwise(F.col("l_quantity")).alias("value"),
    ).withColumn("severity", F.when(F.col("hazard") == "flood", F.col("value") / 50.0).otherwise(0.0))
    return G.grade_by_rules(li, G.rule_table(spark))


@query("grade_by_rules", with_ctes("graded") + "SELECT l_partkey, kind, hazard, max(status) AS status, max(value) AS value FROM graded GROUP BY 1, 2, 3")
def grade_by_rules(spark, sf):
    return G.way_status(graded(spark, sf), ["l_partkey", "kind", "hazard"])


@query("status_counts", with_ctes("graded") + "SELECT kind, hazard, (['ok', 'at_risk', 'cut'])[status + 1] AS status, count(*) AS n FROM graded GROUP BY 1, 2, 3")
def status_counts(spark, sf):
    return graded(spark, sf).groupBy("kind", "hazard", G.status_name(F.col("status")).alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "affected_features",
    with_ctes("graded")
    + """SELECT l_partkey, max(status) AS worst, arg_min(hazard, (-status)::VARCHAR || hazard) AS worst_hazard, count(*) AS hazards
        FROM (SELECT l_partkey, hazard, max(status) AS status FROM graded GROUP BY 1, 2) WHERE status > 0 GROUP BY 1""".replace("(-status)::VARCHAR || hazard", "(9 - status)::VARCHAR || hazard"),
)
def affected_features(spark, sf):
    return G.affected(G.way_status(graded(spark, sf), ["l_partkey", "hazard"]), ["l_partkey"])


@query(
    "link_masks",
    with_ctes("graded")
    + """, s AS (SELECT l_partkey, hazard, max(status) AS status FROM graded GROUP BY 1, 2)
        SELECT l_partkey, bool_or(status = 2) AS cut, bool_or(status = 1) AND NOT bool_or(status = 2) AS at_risk,
          CASE WHEN bool_or(status = 2 AND hazard = 'surge') THEN 'surge' WHEN bool_or(status = 2) THEN 'wind' END AS cut_by
        FROM s WHERE hazard <> 'flood' GROUP BY 1""",
)
def link_masks(spark, sf):
    s = G.way_status(graded(spark, sf), ["l_partkey", "hazard"])
    return G.link_masks(s, ["l_partkey"], G.attribution_table(spark))


@query(
    "edge_status_fallback",
    with_ctes("graded")
    + """, w AS (SELECT l_partkey AS k, max(status) AS status, max(value) AS value FROM graded WHERE kind = 'road' GROUP BY 1)
        SELECT p_partkey AS k, coalesce(w.status, CASE WHEN p_size / 100e0 >= 0.3e0 THEN 2 WHEN p_size / 100e0 >= 0.15e0 THEN 1 ELSE 0 END) AS status,
          coalesce(w.value, p_size / 100e0) AS value FROM part LEFT JOIN w ON w.k = p_partkey""",
)
def edge_status_fallback(spark, sf):
    ways = G.way_status(graded(spark, sf).filter("kind = 'road'"), ["l_partkey"]).withColumnRenamed("l_partkey", "k")
    own = I.table(spark, sf, "part").select(F.col("p_partkey").alias("k"), (F.col("p_size") / 100.0).alias("value"))
    return G.with_edge_status(own.withColumn("status", G.grade(F.col("value"), F.lit(0.15), F.lit(0.3))), ways, ["k"])


# --- Series over (customer, month) ---------------------------------------------------------------

CTE["months"] = (
    """SELECT o_custkey AS k, (year(o_orderdate) - 1995) * 12 + month(o_orderdate) AS step,
         bool_or(o_orderstatus = 'F') AS isolated, count(*)::BIGINT AS n FROM orders GROUP BY 1, 2""",
    [],
)


def months(spark, sf):
    d = F.col("o_orderdate")
    return (
        I.table(spark, sf, "orders")
        .groupBy(F.col("o_custkey").alias("k"), ((F.year(d) - 1995) * 12 + F.month(d)).cast("long").alias("step"))
        .agg(F.bool_or(F.col("o_orderstatus") == "F").alias("isolated"), F.count(F.lit(1)).alias("n"))
    )


@query(
    "run_since",
    with_ctes("months")
    + """, r AS (SELECT k, step, step - row_number() OVER (PARTITION BY k ORDER BY step) AS run FROM months WHERE isolated)
        SELECT k, step, min(step) OVER (PARTITION BY k, run) AS since FROM r""",
)
def run_since(spark, sf):
    m = months(spark, sf)
    return TS.running_since(m, ["k"], "step", "isolated", "step").select("k", "step", "since")


@query(
    "next_occurrence",
    with_ctes("months")
    + """SELECT k, step, min(CASE WHEN isolated THEN step END) OVER (PARTITION BY k ORDER BY step
          ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_ts,
          coalesce(min(CASE WHEN isolated THEN step END) OVER (PARTITION BY k ORDER BY step
          RANGE BETWEEN 1 FOLLOWING AND 8 FOLLOWING) - step, 8) AS within_8 FROM months""",
)
def next_occurrence(spark, sf):
    m = months(spark, sf)
    far = TS.next_time(m, ["k"], "step", "isolated", "step").withColumnRenamed("next_ts", "far")
    both = TS.next_time(far, ["k"], "step", "isolated", "step", within=8)
    return both.select("k", "step", F.col("far").alias("next_ts"), F.coalesce(F.col("next_ts") - F.col("step"), F.lit(8)).alias("within_8"))


@query(
    "first_moment",
    """WITH x AS (SELECT o_orderpriority AS kind, date_diff('day', DATE '1995-01-01', o_orderdate::DATE) AS step, o_custkey FROM orders WHERE o_orderstatus = 'F'),
       f AS (SELECT kind, min(step) AS step FROM x GROUP BY 1)
       SELECT k.kind, f.step::BIGINT AS step, count(DISTINCT x.o_custkey) AS names, min(x.o_custkey) AS first_name
       FROM (SELECT DISTINCT o_orderpriority AS kind FROM orders) k LEFT JOIN f ON f.kind = k.kind
       LEFT JOIN x ON x.kind = f.kind AND x.step = f.step GROUP BY 1, 2""",
)
def first_moment(spark, sf):
    o = I.table(spark, sf, "orders").withColumnRenamed("o_orderpriority", "kind")
    x = o.filter("o_orderstatus = 'F'").select(
        "kind", F.date_diff(F.col("o_orderdate").cast("date"), F.lit("1995-01-01").cast("date")).cast("long").alias("step"), "o_custkey"
    )
    return TS.first_moments(x, o.select("kind").distinct(), "kind", "step", "o_custkey")


@query(
    "deadline_step",
    with_ctes("months")
    + """SELECT k, max(step) FILTER (closed IS NULL OR step < closed) AS deadline, closed IS NULL AS stays_open
        FROM months JOIN (SELECT k, min(step) FILTER (isolated) AS closed FROM months GROUP BY 1) USING (k) GROUP BY k, closed""",
)
def deadline_step(spark, sf):
    return TS.deadlines(months(spark, sf).withColumn("open", ~F.col("isolated")), ["k"], "step", "open")


@query(
    "step_delta",
    with_ctes("months")
    + """, c AS (SELECT step, count_if(isolated)::BIGINT AS cut FROM months GROUP BY 1),
        d AS (SELECT step, cut, cut - lag(cut) OVER (ORDER BY step) AS diff, lag(cut) OVER (ORDER BY step) AS prev FROM c)
        SELECT step, cut, CASE WHEN diff <> 0 AND prev <> 0 THEN diff END AS delta FROM d""",
)
def step_delta(spark, sf):
    c = months(spark, sf).groupBy("step").agg(F.count_if("isolated").alias("cut")).withColumn("series", F.lit(0))
    return TS.step_change(c, ["series"], "step", "cut").drop("series")


@query(
    "series_peak",
    with_ctes("months")
    + """, b AS (SELECT k, unnest(generate_series(min(step), max(step))) AS step FROM months GROUP BY k),
        s AS (SELECT b.k, b.step, m.n FROM b LEFT JOIN months m ON m.k = b.k AND m.step = b.step)
        SELECT k, max(n) AS peak, min(step) FILTER (n = top) AS peak_step, count_if(n IS NULL)::BIGINT AS gaps
        FROM (SELECT *, max(n) OVER (PARTITION BY k) AS top FROM s) GROUP BY k""",
)
def series_peak(spark, sf):
    m = months(spark, sf).select("k", "step", "n")
    s = TS.on_axis(m, T.axis(m, ["k"], "step"), ["k"], "step")
    gaps = s.groupBy("k").agg(F.count_if(F.col("n").isNull()).alias("gaps"))
    return TS.series_peak(s, ["k"], "step", "n").join(gaps, "k")


@query(
    "lower_percentile",
    """SELECT l_partkey, min(l_quantity) FILTER (rn = (n - 1) * 9 // 10 + 1) AS reading, count(*) AS n FROM (
         SELECT l_partkey, l_quantity, row_number() OVER (PARTITION BY l_partkey ORDER BY l_quantity) AS rn,
           count(*) OVER (PARTITION BY l_partkey) AS n FROM lineitem) GROUP BY 1""",
)
def lower_percentile(spark, sf):
    li = I.table(spark, sf, "lineitem")
    n = li.groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"))
    return Q.lower_percentile(li, ["l_partkey"], "l_quantity").join(n, "l_partkey")
