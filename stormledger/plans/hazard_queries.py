"""Hazard layers, severities, horizons and track queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from stormledger.functions import clock as T
from stormledger.functions import hazard as H
from stormledger.functions.numeric import round_to
from stormledger.operators import hazard as OH
from stormledger.operators import timeseries as TS
from stormledger.plans import inputs as I
from stormledger.plans.inputs import CTE, piecewise_sql, r_sql, with_ctes
from stormledger.plans.registry import query

_HAV = (
    "2e0 * 6371e0 * asin(sqrt(least(1e0, sin(radians({lat2} - {lat1}) / 2e0) * sin(radians({lat2} - {lat1}) / 2e0)"
    " + cos(radians({lat1})) * cos(radians({lat2})) * sin(radians({lon2} - {lon1}) / 2e0) * sin(radians({lon2} - {lon1}) / 2e0))))"
)


def hav_sql(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    return _HAV.format(lat1=lat1, lon1=lon1, lat2=lat2, lon2=lon2)


def wrap_sql(x: str) -> str:
    return f"(({x}) - floor(({x}) / 360e0) * 360e0)"


CTE["raw_hazard"] = (
    f"""SELECT *, pow(radius_km / km0, b) AS scaled,
          km0 * 1000e0 * 7.292115e-5 * sin(radians(lat)) AS turning FROM (
        SELECT c.cell_id, c.zone_id, c.event, f.step, c.lat, c.lon, c.coast_km, c.elevation,
          f.lat AS flat, f.lon AS flon, f.pressure, f.max_wind, f.radius_km, f.heading,
          {hav_sql('c.lat', 'c.lon', 'f.lat', 'f.lon')} AS km,
          greatest(0.1e0, {hav_sql('c.lat', 'c.lon', 'f.lat', 'f.lon')}) AS km0,
          greatest(1e0, 1010e0 - f.pressure) * 100e0 AS deficit,
          least(2.5e0, greatest(1e0, {1.15 * 2.718281828459045!r}e0 * f.max_wind * f.max_wind
            / (greatest(1e0, 1010e0 - f.pressure) * 100e0))) AS b
        FROM cells c JOIN fixes f ON c.event = f.event)""",
    ["cells", "fixes"],
)
CTE["winds"] = (
    f"""SELECT *, least(65e0, {r_sql('''greatest(6e0, greatest(
            sqrt(b / 1.15e0 * deficit * scaled * exp(-least(scaled, 50e0)) + turning * turning) - turning,
            max_wind * pow(least(1e0, radius_km / km0), 0.4e0))
          * (1e0 + 0.18e0 * sin(radians(''' + wrap_sql('degrees(atan2(lon - flon, lat - flat))') + ''' - heading)))
          * CASE WHEN coast_km > 20 THEN 0.82e0 ELSE 0.9e0 END)''', 1)}) AS wind FROM raw_hazard""",
    ["raw_hazard"],
)
CTE["hazard"] = (
    f"""SELECT cell_id, zone_id, event, step, wind, {r_sql('''least(6e0, greatest(0e0,
          ((greatest(0e0, 1012e0 - pressure) * 0.01e0 + pow(wind / 20e0, 2.2e0) * 0.85e0) * 1.1e0
            * exp(-coast_km / 35e0) - 0.25e0 * elevation)
          * least(1e0, greatest(0e0, (600e0 - km) / 300e0))))''', 2)} AS surge FROM winds""",
    ["winds"],
)
CTE["hazard_ahead"] = (
    """SELECT cell_id, zone_id, event, step, 0 AS horizon_h, wind, surge FROM hazard UNION ALL
       SELECT cell_id, zone_id, event, step, 24, max(wind) OVER w, max(surge) OVER w FROM hazard
       WINDOW w AS (PARTITION BY cell_id, event ORDER BY step RANGE BETWEEN CURRENT ROW AND 8 FOLLOWING)""",
    ["hazard"],
)
CTE["terrain"] = (
    """SELECT a.cell_id, any_value(a.lat) AS lat, any_value(a.lon) AS lon,
         any_value(a.coast_km) AS coast_km, any_value(a.elevation) AS elevation,
         avg(b.elevation) FILTER (b.cell_id <> a.cell_id) AS mean_near,
         abs(coalesce(max(b.elevation) FILTER (b.r = a.r AND b.c = a.c + 1), any_value(a.elevation))
           - coalesce(max(b.elevation) FILTER (b.r = a.r AND b.c = a.c - 1), any_value(a.elevation)))
           / greatest(100e0, 11132e0 * cos(radians(any_value(a.lat)))) AS sx,
         abs(coalesce(max(b.elevation) FILTER (b.c = a.c AND b.r = a.r + 1), any_value(a.elevation))
           - coalesce(max(b.elevation) FILTER (b.c = a.c AND b.r = a.r - 1), any_value(a.elevation)))
           / 11100e0 AS sy
       FROM cells a JOIN (SELECT *, unnest([-1, 0, 1]) AS dr FROM cells) b ON a.r = b.r + b.dr
         AND abs(a.c - b.c) <= 1
       GROUP BY a.cell_id""",
    ["cells"],
)
CTE["flood"] = (
    f"""SELECT cell_id, slope, least(0.98e0, greatest(0.05e0, {r_sql(f'''
          0.3e0 * least(1e0, greatest(0e0, 1e0 - elevation / 6e0)) + 0.15e0 * exp(-slope / 0.001e0)
          + 0.1e0 * least(1e0, greatest(0e0, 0.5e0 + 0.5e0 * (coalesce(mean_near - elevation, 0e0) / 0.5e0)))
          + 0.2e0 * exp(-greatest(0e0, coast_km) / 28e0)
          + 0.1e0 * least(1e0, greatest(0e0, (80e0 * least(1e0, greatest(0e0, 1e0 - (lat - 20e0) / 1.2e0))
             + 40e0 * least(1e0, greatest(0e0, (lon - 86e0) / 1.1e0))) / 140e0))
          + 0.15e0 * CASE WHEN lat < {20 + 0.35!r}e0 THEN 0.95e0
             WHEN lat <= {20 + 0.65!r}e0 THEN 0.85e0 - 0.15e0 * ((lat - {20 + 0.35!r}e0) / 0.3e0)
             ELSE 0.7e0 - 0.35e0 * ((lat - {20 + 0.65!r}e0) / 0.55e0) END''', 2)})) AS flood
        FROM (SELECT *, sqrt(sx * sx + sy * sy) AS slope FROM terrain)""",
    ["terrain"],
)


CELLS_PER_TASK = 10_000  # with 240 steps each, 2.4 million rows to sort


def hazard_cells(spark, sf, per_task=None):
    return OH.score_cells(I.cells(spark, sf, per_task), I.fixes(spark, sf)).select(
        "cell_id", "zone_id", "event", "step", "wind", "surge"
    )


def hazard_wide(spark, sf):
    """wind, surge and their 24 h maxima per cell and step.

    The window sorts a task's rows, so a task gets a bounded number of cells: what it keeps, or spills
    where memory is short, does not grow with the table.
    """
    return TS.ahead_columns(hazard_cells(spark, sf, CELLS_PER_TASK), ["cell_id", "event"], "step", ["wind", "surge"])


def hazard_ahead(spark, sf):
    return TS.expected_max(hazard_cells(spark, sf), ["cell_id", "event"], "step", ["wind", "surge"])


def flood_cells(spark, sf):
    return OH.flood_layer(I.cells(spark, sf), I.SOUTH, I.WEST)


@query("hazard_wind_surge", with_ctes("hazard") + "SELECT cell_id, event, step, wind, surge FROM hazard")
def hazard_wind_surge(spark, sf):
    return hazard_cells(spark, sf).drop("zone_id")


_STAMP = "strftime(make_timestamp(step * 10800 * 1000000), '%Y%m%dT%H%MZ')"


@query(
    "hazard_layers",
    with_ctes("hazard")
    + f""", x AS (SELECT step, 'wind' AS hazard, 'm/s' AS unit, 'wind__' || cell_id || '__' || {_STAMP} AS layer_id,
          wind AS value, {piecewise_sql('wind', H.WIND_SEVERITY, 3)} AS severity FROM hazard
        UNION ALL SELECT step, 'surge', 'm', 'surge__' || cell_id || '__' || {_STAMP},
          surge, {piecewise_sql('surge', H.SURGE_SEVERITY, 3)} FROM hazard)
        SELECT step, hazard, unit, count(*) AS cells, min(layer_id) AS first_id, max(layer_id) AS last_id,
          max(severity) AS worst, sum(round(severity * 1000e0)::BIGINT)::BIGINT AS severity_milli
        FROM x GROUP BY 1, 2, 3""",
)
def hazard_layers(spark, sf):
    t = OH.tall(hazard_cells(spark, sf), ["cell_id", "step"])
    key = H.layer_id(F.col("hazard"), F.col("cell_id").cast("string"), T.compact(T.step_time(F.col("step"))))
    return t.withColumn("layer_id", key).groupBy("step", "hazard", "unit").agg(
        F.count(F.lit(1)).alias("cells"), F.min("layer_id").alias("first_id"), F.max("layer_id").alias("last_id"),
        F.max("severity").alias("worst"), F.sum(F.round(F.col("severity") * 1000.0).cast("long")).alias("severity_milli"),
    )


@query(
    "severity_piecewise",
    f"""SELECT l_orderkey, l_linenumber, l_partkey, {piecewise_sql('l_quantity', H.WIND_SEVERITY, 3)} AS wind_severity,
          {piecewise_sql('l_quantity / 10e0', H.SURGE_SEVERITY, 3)} AS surge_severity,
          {r_sql('least(1e0, greatest(0e0, l_discount * 10e0))', 2)} AS flood_severity,
          CASE WHEN l_quantity * 5e0 >= 221 THEN 'Super Cyclonic Storm' WHEN l_quantity * 5e0 >= 166 THEN 'Extremely Severe Cyclonic Storm'
            WHEN l_quantity * 5e0 >= 118 THEN 'Very Severe Cyclonic Storm' WHEN l_quantity * 5e0 >= 89 THEN 'Severe Cyclonic Storm'
            WHEN l_quantity * 5e0 >= 62 THEN 'Cyclonic Storm' WHEN l_quantity * 5e0 >= 50 THEN 'Deep Depression'
            WHEN l_quantity * 5e0 >= 31 THEN 'Depression' END AS wind_class FROM lineitem""",
)
def severity_piecewise(spark, sf):
    q = F.col("l_quantity")
    return I.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey",
        H.wind_severity(q).alias("wind_severity"),
        H.surge_severity(q / F.lit(10.0)).alias("surge_severity"),
        H.flood_severity(F.col("l_discount") * F.lit(10.0)).alias("flood_severity"),
        H.wind_class(q * F.lit(5.0)).alias("wind_class"),
    )


@query(
    "static_index_neighbours",
    with_ctes("flood") + f"SELECT cell_id, {r_sql('slope * 1000e0', 6)} AS slope_permille, flood, {r_sql('flood', 2)} AS severity, degrees(atan(slope)) <= 0.0015e0 AS flat FROM flood",
)
def static_index_neighbours(spark, sf):
    return OH.slope_mask(flood_cells(spark, sf), 0.0015).select(
        "cell_id", round_to(F.col("slope") * F.lit(1000.0), 6).alias("slope_permille"),
        "flood", H.flood_severity(F.col("flood")).alias("severity"), "flat",
    )


@query(
    "expected_24h_max",
    """WITH b AS (SELECT user_id, date_diff('second', TIMESTAMP '1970-01-01', ts) // 10800 AS step,
          max(value) AS value, max(round(value * 3e0)) AS severity FROM events GROUP BY 1, 2)
       SELECT user_id, step, 0 AS horizon_h, value, severity FROM b UNION ALL
       SELECT user_id, step, 24, max(value) OVER w, max(severity) OVER w FROM b
       WINDOW w AS (PARTITION BY user_id ORDER BY step RANGE BETWEEN CURRENT ROW AND 8 FOLLOWING)""",
)
def expected_24h_max(spark, sf):
    b = (
        I.table(spark, sf, "events")
        .groupBy("user_id", T.step_of(F.col("ts")).alias("step"))
        .agg(F.max("value").alias("value"), F.max(F.round(F.col("value") * F.lit(3.0))).alias("severity"))
    )
    return TS.expected_max(b, ["user_id"], "step", ["value", "severity"])


@query(
    "whole_event_max",
    with_ctes("hazard") + "SELECT cell_id, event, max(wind) AS wind, max(surge) AS surge FROM hazard GROUP BY 1, 2",
)
def whole_event_max(spark, sf):
    return TS.whole_event_max(hazard_cells(spark, sf), ["cell_id", "event"], ["wind", "surge"])


@query(
    "minmax_by_step",
    with_ctes("hazard")
    + """SELECT event, step, min(wind) AS min_wind, max(wind) AS max_wind, min(surge) AS min_surge,
        max(surge) AS max_surge, count(*) AS cells FROM hazard GROUP BY ROLLUP (event, step)""",
)
def minmax_by_step(spark, sf):
    return hazard_cells(spark, sf).rollup("event", "step").agg(
        F.min("wind").alias("min_wind"), F.max("wind").alias("max_wind"),
        F.min("surge").alias("min_surge"), F.max("surge").alias("max_surge"),
        F.count(F.lit(1)).alias("cells"),
    )


_AZ = (
    "degrees(atan2(sin(radians(lon2 - lon)) * cos(radians(lat2)),"
    " cos(radians(lat)) * sin(radians(lat2)) - sin(radians(lat)) * cos(radians(lat2)) * cos(radians(lon2 - lon))))"
)


@query(
    "track_motion",
    with_ctes("fixes")
    + f""", n AS (SELECT event, step, lat, lon, lead(lat) OVER w AS lat2, lead(lon) OVER w AS lon2 FROM fixes
           WINDOW w AS (PARTITION BY event ORDER BY step)),
        m AS (SELECT event, step, {r_sql(hav_sql('lat', 'lon', 'lat2', 'lon2') + ' * 1000e0 / 10800e0', 2)} AS s,
           {r_sql(wrap_sql(_AZ), 2)} AS h FROM n)
        SELECT event, step, coalesce(s, lag(s) OVER w) AS forward_speed, coalesce(h, lag(h) OVER w) AS heading
        FROM m WINDOW w AS (PARTITION BY event ORDER BY step)""",
)
def track_motion(spark, sf):
    track = I.fixes(spark, sf).select("event", "step", "lat", "lon")
    return TS.motion(track, ["event"], "step").select("event", "step", "forward_speed", "heading")


@query(
    "step_smoothness",
    with_ctes("hazard")
    + f""", x AS (SELECT cell_id, event, wind / lag(wind) OVER (PARTITION BY cell_id, event ORDER BY step) AS ratio FROM hazard)
        SELECT cell_id, event, {r_sql('max(ratio)', 6)} AS max_ratio FROM x GROUP BY 1, 2""",
)
def step_smoothness(spark, sf):
    return TS.step_ratio(hazard_cells(spark, sf), ["cell_id", "event"], "step", "wind").select(
        "cell_id", "event", round_to(F.col("max_ratio"), 6).alias("max_ratio")
    )


@query(
    "hazard_side_by_side",
    with_ctes("hazard", "flood")
    + """SELECT h.cell_id, max(h.wind) AS wind, max(h.surge) AS surge, any_value(f.flood) AS flood FROM hazard h
        LEFT JOIN (SELECT cell_id, flood FROM flood WHERE flood >= 0.3e0) f ON f.cell_id = h.cell_id GROUP BY 1""",
)
def hazard_side_by_side(spark, sf):
    peak = TS.whole_event_max(hazard_cells(spark, sf), ["cell_id"], ["wind", "surge"])
    flood = flood_cells(spark, sf).filter("flood >= 0.3").select(
        "cell_id", F.lit("flood").alias("hazard"), F.col("flood").alias("value")
    )
    layers = OH.tall(peak, ["cell_id"]).select("cell_id", "hazard", "value")
    return OH.side_by_side(layers.unionByName(flood), ["cell_id"])


@query(
    "track_parts",
    with_ctes("fixes")
    + """, mid AS (SELECT event, (min(step) + max(step)) // 2 AS now FROM fixes GROUP BY 1)
        SELECT f.event, f.step, CASE WHEN f.step <= now THEN 'past' WHEN f.step <= now + 8 THEN 'next' ELSE 'later' END AS part,
          strftime(make_timestamp(f.step * 10800 * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS iso,
          strftime(make_timestamp((f.step * 10800 + 19800) * 1000000), '%Y-%m-%dT%H:%M:%S+05:30') AS local_iso,
          'T-' || ((max(f.step) OVER (PARTITION BY f.event) - f.step) * 3) AS label
        FROM fixes f JOIN mid ON mid.event = f.event""",
)
def track_parts(spark, sf):
    f = I.fixes(spark, sf).select("event", "step")
    span = f.groupBy("event").agg(
        F.floor((F.min("step") + F.max("step")) / 2).alias("now"), F.max("step").alias("last")
    )
    at = T.step_time(F.col("step"))
    return f.join(span, "event").select(
        "event", "step", TS.track_part(F.col("step"), F.col("now")).alias("part"),
        T.iso(at).alias("iso"), T.offset_iso(at).alias("local_iso"),
        T.lead_label(T.hours_between(at, T.step_time(F.col("last")))).alias("label"),
    )
