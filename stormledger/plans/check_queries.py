"""Raster, validation, data-quality and windowed-count queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from stormledger.functions import clock as T
from stormledger.functions.numeric import round_to
from stormledger.operators import payout as P
from stormledger.operators import quality as Q
from stormledger.operators import raster as RA
from stormledger.operators import validation as V
from stormledger.plans import inputs as I
from stormledger.plans.inputs import CTE, r_sql, with_ctes
from stormledger.plans.registry import query

# --- Raster --------------------------------------------------------------------------------------

CTE["px"] = (
    """SELECT 'scene' AS scene, vec_id AS row, i AS col, embedding[i + 1]::DOUBLE AS e, embedding[64 - i]::DOUBLE AS m, label
       FROM (SELECT *, unnest(range(64)) AS i FROM embeddings)""",
    [],
)


def pixels(spark, sf):
    """The embedding table as one raster: a row per vector, a column per position."""
    e = I.spread(I.table(spark, sf, "embeddings"))
    return e.select(
        F.lit("scene").alias("scene"), F.col("vec_id").alias("row"), "label", "embedding", F.posexplode("embedding").alias("col", "x")
    ).select(
        "scene", "row", F.col("col").cast("long").alias("col"), F.col("x").cast("double").alias("e"),
        F.element_at("embedding", F.lit(64) - F.col("col")).cast("double").alias("m"), "label",
    )


def _db(px, name, base):
    return px.withColumn("db", F.lit(base) + F.lit(20.0) * F.col(name))


@query(
    "pixel_change_mask",
    with_ctes("px")
    + """SELECT row, col, (-14e0 + 20e0 * m) - (-12e0 + 20e0 * e) <= -2.5e0 AND -14e0 + 20e0 * m <= -15.5e0 AND (row * 7 + col * 3) % 25 < 20 AS flooded FROM px""",
)
def pixel_change_mask(spark, sf):
    px = pixels(spark, sf)
    water = px.select("scene", "row", "col", ((F.col("row") * 7 + F.col("col") * 3) % 25).alias("occurrence"))
    return RA.change_mask(_db(px, "e", -12.0), _db(px, "m", -14.0), water, ["scene"]).drop("scene")


@query(
    "noise_mask",
    with_ctes("px") + "SELECT row, count(*) AS n, count(CASE WHEN -28e0 + 20e0 * e >= -30 THEN 1 END) AS kept FROM px GROUP BY 1",
)
def noise_mask(spark, sf):
    return RA.mask_noise(_db(pixels(spark, sf), "e", -28.0)).groupBy("row").agg(
        F.count(F.lit(1)).alias("n"), F.count("db").alias("kept")
    )


@query(
    "pixel_opening",
    with_ctes("px")
    + """, w AS (SELECT row, col FROM px WHERE e > -0.1e0), o AS (SELECT a.d AS dr, b.d AS dc FROM (SELECT unnest([-1, 0, 1]) AS d) a, (SELECT unnest([-1, 0, 1]) AS d) b),
        er AS (SELECT row + dr AS row, col + dc AS col FROM w, o GROUP BY 1, 2 HAVING count(*) = 9),
        gr AS (SELECT DISTINCT row + dr AS row, col + dc AS col FROM er, o)
        SELECT row, col FROM gr WHERE row > (SELECT min(row) FROM px) AND row < (SELECT max(row) FROM px) AND col > 0 AND col < 63""",
)
def pixel_opening(spark, sf):
    mask = pixels(spark, sf).withColumn("flooded", F.col("e") > -0.1)
    return RA.opening(mask, ["scene"]).drop("scene")


@query(
    "pixel_clusters",
    "WITH RECURSIVE " + with_ctes("px").removeprefix("WITH ")
    + """, w AS (SELECT row, col, row * 64 + col AS id FROM px WHERE e > 0.12e0),
        n AS (SELECT a.id AS a, b.id AS b FROM w a JOIN (SELECT row + d AS nr, row, col, id FROM w, (SELECT unnest([-1, 0, 1]) AS d)) b ON b.nr = a.row AND abs(a.col - b.col) <= 1 AND a.id <> b.id),
        f(id, lab) USING KEY (id) AS (SELECT id, id FROM w UNION SELECT n.b, min(f.lab) FROM f JOIN n ON n.a = f.id JOIN recurring.f r ON r.id = n.b WHERE f.lab < r.lab GROUP BY n.b),
        big AS (SELECT lab FROM f GROUP BY 1 HAVING count(*) >= 4)
        SELECT w.row, w.col FROM w JOIN f ON f.id = w.id JOIN big ON big.lab = f.lab""",
)
def pixel_clusters(spark, sf):
    return RA.drop_small(pixels(spark, sf).filter("e > 0.12"), "scene", 4).drop("scene")


_NEAR = """, s AS (SELECT max(row) AS hr FROM px), o AS (SELECT a.d AS dr, b.d AS dc FROM (SELECT unnest([-1, 0, 1]) AS d) a, (SELECT unnest([-1, 0, 1]) AS d) b),
  k AS (SELECT p.row, p.col, q.e FROM px p CROSS JOIN o CROSS JOIN s JOIN px q ON q.row = CASE WHEN p.row + dr < 0 THEN -(p.row + dr) WHEN p.row + dr > hr THEN 2 * hr - (p.row + dr) ELSE p.row + dr END
    AND q.col = CASE WHEN p.col + dc < 0 THEN -(p.col + dc) WHEN p.col + dc > 63 THEN 126 - (p.col + dc) ELSE p.col + dc END)"""


@query(
    "pixel_focal",
    with_ctes("px") + _NEAR
    + """, z AS (SELECT row, col, median(pow(10e0, (-12e0 + 20e0 * e) / 10e0)) AS md, avg(pow(10e0, (-12e0 + 20e0 * e) / 10e0)) AS mean, var_pop(pow(10e0, (-12e0 + 20e0 * e) / 10e0)) AS var FROM k GROUP BY 1, 2)
        SELECT z.row, z.col, floor(10e0 * log10(greatest(1e-5, md)) * 1e4 + 0.5e0) / 1e4 AS median_db, floor(10e0 * log10(greatest(1e-5, mean)) * 1e4 + 0.5e0) / 1e4 AS boxcar_db,
          floor(10e0 * log10(greatest(1e-5, mean + least(1e0, greatest(0e0, greatest(0e0, var - mean * mean / 4.4e0) / greatest(1e-6, var * (1e0 + 1e0 / 4.4e0)))) * (pow(10e0, (-12e0 + 20e0 * p.e) / 10e0) - mean))) * 1e4 + 0.5e0) / 1e4 AS lee_db
        FROM z JOIN px p ON p.row = z.row AND p.col = z.col""",
)
def pixel_focal(spark, sf):
    px = _db(pixels(spark, sf), "e", -12.0).select("scene", "row", "col", "db")
    out = None
    for method in ("median", "boxcar", "lee"):
        one = RA.focal(px, ["scene"], method, 3, 32).select(
            "scene", "row", "col", round_to(F.col("db"), 4).alias(f"{method}_db")
        )
        out = one if out is None else out.join(one, ["scene", "row", "col"])
    return out.drop("scene")


@query(
    "zonal_mean",
    with_ctes("px")
    + f"""SELECT row // 8 AS cell_r, col // 8 AS cell_c, {r_sql('avg(CASE WHEN e > 0.15e0 THEN 1e0 ELSE 0e0 END)', 6)} AS mean, avg(CASE WHEN e > 0.15e0 THEN 1e0 ELSE 0e0 END) >= 0.1e0 AS observed FROM px GROUP BY 1, 2""",
)
def zonal_mean(spark, sf):
    z = RA.zonal(pixels(spark, sf).withColumn("wet", F.col("e") > 0.15), [], 8, "wet")
    return z.withColumn("mean", round_to(F.col("mean"), 6))


@query(
    "flooded_area",
    with_ctes("px") + f"SELECT label, count_if(e > 0.1e0) * 100e0 / 1e6 AS km2, {r_sql('avg(sqrt(e * e + m * m))', 6)} AS mean_speed FROM px GROUP BY 1",
)
def flooded_area(spark, sf):
    px = pixels(spark, sf).withColumn("flooded", F.col("e") > 0.1)
    speed = RA.vector_mean(px, ["label"], "e", "m").withColumn("mean_speed", round_to(F.col("mean_speed"), 6))
    return RA.area_km2(px, ["label"], 100.0).join(speed, "label")


_SAMPLE = """, g AS (SELECT max(r) AS hr, max(c) AS hc FROM cells),
  t AS (SELECT DISTINCT c1.r + a.d AS r, c1.c + b.d AS c FROM cells c1, (SELECT unnest([-1, 0, 1]) AS d) a, (SELECT unnest([-1, 0, 1]) AS d) b),
  s AS (SELECT t.r * 8 + i AS row, t.c * 8 + j AS col, least(greatest(t.r + (i + 0.5e0) / 8e0 - 0.5e0, 0e0), hr) AS y, least(greatest(t.c + (j + 0.5e0) / 8e0 - 0.5e0, 0e0), hc) AS x, hr, hc
    FROM t, g, (SELECT unnest(range(8)) AS i) ii, (SELECT unnest(range(8)) AS j) jj WHERE t.r BETWEEN 0 AND hr AND t.c BETWEEN 0 AND hc)"""


@query(
    "bilinear",
    with_ctes("cells") + _SAMPLE
    + f"""SELECT s.row, s.col, {r_sql('''(coalesce(a.elevation, 0e0) * (1e0 - (x - floor(x))) + coalesce(b.elevation, 0e0) * (x - floor(x))) * (1e0 - (y - floor(y)))
          + (coalesce(c.elevation, 0e0) * (1e0 - (x - floor(x))) + coalesce(d.elevation, 0e0) * (x - floor(x))) * (y - floor(y))''', 6)} AS elevation FROM s
        LEFT JOIN cells a ON a.r = floor(y)::BIGINT AND a.c = floor(x)::BIGINT LEFT JOIN cells b ON b.r = floor(y)::BIGINT AND b.c = least(floor(x) + 1, hc)::BIGINT
        LEFT JOIN cells c ON c.r = least(floor(y) + 1, hr)::BIGINT AND c.c = floor(x)::BIGINT LEFT JOIN cells d ON d.r = least(floor(y) + 1, hr)::BIGINT AND d.c = least(floor(x) + 1, hc)::BIGINT""",
)
def bilinear(spark, sf):
    b = RA.bilinear(I.cells(spark, sf).withColumn("layer", F.lit("elevation")), ["layer"], "elevation", 8)
    return b.select("row", "col", round_to(F.col("elevation"), 6).alias("elevation"))


@query(
    "isoline_segments",
    with_ctes("cells")
    + f""", q AS (SELECT a.r, a.c, a.elevation AS sw, b.elevation AS se, d.elevation AS ne, e.elevation AS nw, unnest([2e0, 4e0, 6e0]) AS l FROM cells a JOIN cells b ON b.r = a.r AND b.c = a.c + 1
          JOIN cells d ON d.r = a.r + 1 AND d.c = a.c + 1 JOIN cells e ON e.r = a.r + 1 AND e.c = a.c),
        p AS (SELECT *, (sw >= l) <> (se >= l) AS s, (se >= l) <> (ne >= l) AS e, (nw >= l) <> (ne >= l) AS n, (sw >= l) <> (nw >= l) AS w FROM q)
        SELECT r, c, l AS level, (s::INT + e::INT + n::INT + w::INT) // 2::BIGINT AS segments,
          {r_sql('CASE WHEN s THEN c + (l - sw) / (se - sw) ELSE 0 END + CASE WHEN e THEN c + 1 ELSE 0 END + CASE WHEN n THEN c + (l - nw) / (ne - nw) ELSE 0 END + CASE WHEN w THEN c ELSE 0 END', 6)} AS sum_x,
          {r_sql('CASE WHEN s THEN r ELSE 0 END + CASE WHEN e THEN r + (l - se) / (ne - se) ELSE 0 END + CASE WHEN n THEN r + 1 ELSE 0 END + CASE WHEN w THEN r + (l - sw) / (nw - sw) ELSE 0 END', 6)} AS sum_y
        FROM p WHERE s OR e OR n OR w""".replace("// 2::BIGINT AS segments", "// 2 AS segments"),
)
def isoline_segments(spark, sf):
    s = RA.isolines(I.cells(spark, sf), [], "elevation", [2.0, 4.0, 6.0])
    return s.groupBy("r", "c", "level").agg(
        F.count(F.lit(1)).cast("int").alias("segments"), round_to(F.sum(F.col("x0") + F.col("x1")), 6).alias("sum_x"),
        round_to(F.sum(F.col("y0") + F.col("y1")), 6).alias("sum_y"),
    )


@query(
    "burned_cells",
    """WITH w AS (SELECT p_brand AS b, p_partkey AS ord, p_partkey % 40 AS p0, p_partkey * 7 % 40 AS q0, p_size % 6 AS n FROM part),
       x AS (SELECT b, ord, p0 + i AS row, q0 + j AS col FROM (SELECT *, unnest(range(n + 1)) AS i FROM w), (SELECT unnest(range(3)) AS j))
       SELECT b AS brand, row, col, max(ord) AS label FROM x GROUP BY 1, 2, 3""",
)
def burned_cells(spark, sf):
    k = F.col("p_partkey")
    c = I.table(spark, sf, "part").select(
        F.col("p_brand").alias("brand"), k.alias("ord"), k.alias("label"), (k % 40).alias("p0"), (k % 40 + F.col("p_size") % 6).alias("p1"),
        (k * 7 % 40).alias("q0"), (k * 7 % 40 + 2).alias("q1"),
    )
    return RA.burn(c, ["brand"], "label")


_POWER = "10e0 * log10(greatest(1e-5, avg(pow(10e0, ({} + 20e0 * {}) / 10e0))))"


@query(
    "flood_pipeline",
    "WITH RECURSIVE " + with_ctes("px").removeprefix("WITH ") + _NEAR.replace("q.e FROM", "q.e, q.m FROM")
    + f""", z AS (SELECT row, col, {_POWER.format("-12e0", "e")} AS was, {_POWER.format("-16e0", "m")} AS now FROM k GROUP BY 1, 2),
        wet AS (SELECT row, col FROM z WHERE now - was <= -2.5e0 AND now <= -15.5e0 AND (row // 16 * 3 + col // 16 * 5) % 9 <= 5 AND row // 8 % 6 < 5),
        er AS (SELECT row + dr AS row, col + dc AS col FROM wet, o GROUP BY 1, 2 HAVING count(*) = 9),
        w AS (SELECT DISTINCT row + dr AS row, col + dc AS col, (row + dr) * 64 + col + dc AS id FROM er, o
              WHERE row + dr > (SELECT min(row) FROM px) AND row + dr < (SELECT max(row) FROM px) AND col + dc > 0 AND col + dc < 63),
        n AS (SELECT a.id AS a, b.id AS b FROM w a JOIN (SELECT row + d AS nr, row, col, id FROM w, (SELECT unnest([-1, 0, 1]) AS d)) b ON b.nr = a.row AND abs(a.col - b.col) <= 1 AND a.id <> b.id),
        f(id, lab) USING KEY (id) AS (SELECT id, id FROM w UNION SELECT n.b, min(f.lab) FROM f JOIN n ON n.a = f.id JOIN recurring.f r ON r.id = n.b WHERE f.lab < r.lab GROUP BY n.b),
        big AS (SELECT lab FROM f GROUP BY 1 HAVING count(*) >= 12)
        SELECT w.row, w.col FROM w JOIN f ON f.id = w.id JOIN big ON big.lab = f.lab""",
)
def flood_pipeline(spark, sf):
    """The whole chain with slopes and standing water by blocks of pixels; clusters of 12 pixels and more."""
    px = pixels(spark, sf)
    a, b = _db(px, "e", -12.0), _db(px, "m", -16.0)
    block = lambda c, n: F.floor(F.col(c) / n).cast("long")
    at = ["scene", "row", "col"]
    slope = px.select(*at, ((block("row", 16) * 3 + block("col", 16) * 5) % 9).cast("double").alias("slope"))
    water = px.select(*at, F.when(block("row", 8) % 6 < 5, 0).otherwise(30).alias("occurrence"))
    return RA.flood_pipeline(a, b, water, ["scene"], 3, "boxcar", 128, slope, 5.0, 12).drop("scene")


@query(
    "permanent_water",
    "SELECT vec_id AS k, coalesce(label * 10 >= 20, false) AS permanent FROM embeddings",
)
def permanent_water(spark, sf):
    """Positions seen under water in a fifth of the images or more."""
    e = I.table(spark, sf, "embeddings").select(F.col("vec_id").alias("k"), (F.col("label") * 10).alias("occurrence"))
    return RA.permanent_water(e).drop("occurrence")


@query(
    "scene_catalogue",
    """SELECT o_orderkey AS scene FROM orders WHERE o_custkey % 90 + 5 >= 20 AND o_custkey % 90 <= 60 AND o_orderkey % 50 + 5 >= 10 AND o_orderkey % 50 <= 40
       AND o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1998-01-02' AND o_orderkey % 3 = 1 AND o_orderstatus IN ('F', 'P') AND o_orderkey % 2 = 0""",
)
def scene_catalogue(spark, sf):
    import datetime as dt

    k, c = F.col("o_orderkey"), F.col("o_custkey")
    cat = I.table(spark, sf, "orders").select(
        k.alias("scene"), (c % 90).alias("min_x"), (c % 90 + 5).alias("max_x"), (k % 50).alias("min_y"), (k % 50 + 5).alias("max_y"),
        F.col("o_orderdate").alias("ts"), F.when(k % 3 == 1, F.lit("IW")).otherwise(F.lit("EW")).alias("mode"),
        F.when(F.col("o_orderstatus").isin("F", "P"), F.array(F.lit("VV"), F.lit("VH"))).otherwise(F.array(F.lit("HH"))).alias("polarisations"),
        F.when(k % 2 == 0, F.lit("ASCENDING")).otherwise(F.lit("DESCENDING")).alias("orbit_pass"), (k % 12).alias("orbit"),
    )
    start, end = F.lit(dt.datetime(1996, 1, 1)).cast("timestamp_ntz"), F.lit(dt.datetime(1998, 1, 1)).cast("timestamp_ntz")
    return RA.scenes(cat, (20, 10, 60, 40), start, end, "IW", "VV", "ASCENDING").select("scene")


# --- Validation ----------------------------------------------------------------------------------

CTE["judged"] = (
    "SELECT d.lang AS zone_id, n_chars >= 1500 AS predicted, quality = 1 AS observed FROM documents d JOIN labels l ON l.doc_id = d.doc_id", [],
)
CTE["conf"] = (
    """SELECT zone_id, count_if(predicted AND observed)::BIGINT AS tp, count_if(predicted AND NOT observed)::BIGINT AS fp, count_if(NOT predicted AND observed)::BIGINT AS fn,
         count_if(NOT predicted AND NOT observed)::BIGINT AS tn, (ascii(zone_id) * 10)::DOUBLE / count(*) AS each FROM judged GROUP BY 1""",
    ["judged"],
)
_RATE = "CASE WHEN {d} > 0 THEN ({n}) / ({d}) ELSE 0e0 END"
CTE["rates"] = (
    f"""SELECT zone_id, {r_sql(_RATE.format(n='tp', d='tp + fp + fn'), 4)} AS iou, {r_sql(_RATE.format(n='tp', d='tp + fp'), 4)} AS precision, {r_sql(_RATE.format(n='tp', d='tp + fn'), 4)} AS recall,
          {r_sql(_RATE.format(n='2e0 * tp', d='2e0 * tp + fp + fn'), 4)} AS f1_score, {r_sql('acc', 4)} AS accuracy, {r_sql(_RATE.format(n='tn', d='tn + fp'), 4)} AS specificity,
          {r_sql('CASE WHEN 1e0 - pe > 1e-6 THEN (acc - pe) / (1e0 - pe) ELSE 0e0 END', 4)} AS kappa, {r_sql('greatest(0e0, 1e0 - abs(fn - fp) / greatest(tp + fn, tp + fp, 1e-6))', 4)} AS area_agreement
        FROM (SELECT *, (tp + tn) / total AS acc, (tp + fp) / total * ((tp + fn) / total) + (tn + fn) / total * ((tn + fp) / total) AS pe FROM (
          SELECT *, tp + fp + fn + tn AS total FROM (SELECT zone_id, tp * each AS tp, fp * each AS fp, fn * each AS fn, tn * each AS tn FROM conf)))""",
    ["conf"],
)
_METRICS = ["iou", "precision", "recall", "f1_score", "accuracy", "specificity", "kappa", "area_agreement"]


def _confusion(spark, sf):
    d = I.table(spark, sf, "documents").select("doc_id", F.col("lang").alias("zone_id"), (F.col("n_chars") >= 1500).alias("predicted"))
    cells = d.join(I.table(spark, sf, "labels").select("doc_id", (F.col("quality") == 1).alias("observed")), "doc_id")
    zones = d.select("zone_id").distinct().withColumn("area_km2", (F.ascii("zone_id") * 10).cast("double"))
    return V.confusion(cells, zones)


@query("confusion_counts", with_ctes("conf") + f"SELECT zone_id, tp, fp, fn, tn, {', '.join(f'{r_sql(x + ' * each', 4)} AS {x}_km2' for x in ('tp', 'fp', 'fn', 'tn'))} FROM conf")
def confusion_counts(spark, sf):
    return _confusion(spark, sf).withColumns({f"{x}_km2": round_to(F.col(f"{x}_km2"), 4) for x in ("tp", "fp", "fn", "tn")})


@query("confusion_metrics", with_ctes("rates") + "SELECT * FROM rates")
def confusion_metrics(spark, sf):
    return V.metrics(_confusion(spark, sf))


@query("macro_metrics", with_ctes("rates") + f"SELECT {', '.join(f'{r_sql(f'avg({m})', 6)} AS mean_{m}' for m in _METRICS)}, count(*) AS zones FROM rates")
def macro_metrics(spark, sf):
    m = V.macro(V.metrics(_confusion(spark, sf)), _METRICS)
    return m.withColumns({f"mean_{x}": round_to(F.col(f"mean_{x}"), 6) for x in _METRICS})


@query(
    "metric_overview",
    with_ctes("rates") + "SELECT l.lang AS zone_id, coalesce(r.iou, 0e0) AS iou, coalesce(r.kappa, 0e0) AS kappa FROM (SELECT DISTINCT lang FROM documents) l LEFT JOIN rates r ON r.zone_id = l.lang AND r.zone_id <> 'fr'",
)
def metric_overview(spark, sf):
    zones = I.table(spark, sf, "documents").select(F.col("lang").alias("zone_id")).distinct()
    m = V.metrics(_confusion(spark, sf)).filter("zone_id <> 'fr'")
    maps = m.select("zone_id", F.create_map(F.lit("iou"), F.col("iou"), F.lit("kappa"), F.col("kappa")).alias("metrics"))
    return V.overview(zones, maps, ["iou", "kappa"])


@query(
    "benchmark_report",
    with_ctes("rates")
    + """, m AS (SELECT 3 AS ord, zone_id AS sub, '| ' || zone_id || ' | ' || printf('%.4f', iou) || ' | ' || printf('%.4f', accuracy) || ' |' AS line FROM rates)
        SELECT 0 AS ord, '' AS sub, '# Flood validation' AS line UNION ALL SELECT 1, '', '| zone | iou | accuracy |' UNION ALL SELECT 2, '', '|---|---|---|' UNION ALL SELECT * FROM m
        UNION ALL SELECT 4, '', '| mean | ' || printf('%.4f', avg(iou)) || ' | ' || printf('%.4f', avg(accuracy)) || ' |' FROM rates""",
)
def benchmark_report(spark, sf):
    return V.report(V.metrics(_confusion(spark, sf)), "zone_id", ["iou", "accuracy"], "Flood validation")


@query(
    "as_of_scenes",
    """WITH e AS (SELECT c_custkey AS area, TIMESTAMP '1997-06-01' + to_days((c_custkey % 500)::INTEGER) AS t0 FROM customer),
       c AS (SELECT o_custkey AS area, o_orderkey AS scene, o_orderdate AS ts, o_orderkey % 12 AS orbit, o_orderkey % 2 AS pass FROM orders),
       n AS (SELECT c.*, e.t0 FROM c JOIN e ON e.area = c.area),
       p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY area ORDER BY ts, scene) AS rn FROM n WHERE ts >= t0 AND ts < t0 + INTERVAL 200 DAY) WHERE rn = 1),
       b AS (SELECT n.*, n.orbit = p.orbit AS same, row_number() OVER (PARTITION BY n.area ORDER BY (n.orbit = p.orbit) DESC, n.ts DESC, n.scene DESC) AS rn FROM n JOIN p ON p.area = n.area AND p.pass = n.pass WHERE n.ts < n.t0 AND n.ts >= n.t0 - INTERVAL 400 DAY)
       SELECT p.area, p.scene AS post_scene, b.scene AS pre_scene, coalesce(b.same, false) AS same_orbit FROM p LEFT JOIN b ON b.area = p.area AND b.rn = 1""",
)
def as_of_scenes(spark, sf):
    k = F.col("o_orderkey")
    cat = I.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("area"), k.alias("scene"), F.col("o_orderdate").alias("ts"), (k % 12).alias("orbit"), (k % 2).alias("orbit_pass")
    )
    ev = I.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("area"),
        F.timestamp_add("DAY", (F.col("c_custkey") % 500).cast("int"), F.expr("timestamp_ntz'1997-06-01 00:00:00'")).alias("at"),
    )
    return V.scene_pair(cat, ev, 400, 200)


@query(
    "two_source_check",
    """SELECT l_suppkey AS k, sum(round(l_extendedprice * 100e0)::BIGINT)::BIGINT AS a, sum(round(l_extendedprice * (100e0 - l_discount * 10e0))::BIGINT)::BIGINT AS b,
         abs((a - b) / b::DOUBLE) <= 0.005e0 AS verified FROM lineitem GROUP BY 1""",
)
def two_source_check(spark, sf):
    l = I.table(spark, sf, "lineitem")
    p = F.col("l_extendedprice")
    a = l.groupBy(F.col("l_suppkey").alias("k")).agg(F.sum(I.cents(p)).alias("a"))
    b = l.groupBy(F.col("l_suppkey").alias("k")).agg(
        F.sum(F.round(p * (F.lit(100.0) - F.col("l_discount") * F.lit(10.0))).cast("long")).alias("b")
    )
    return V.two_source_check(a, b, "k")


@query(
    "reconcile_totals",
    """WITH p AS (SELECT l_partkey % 100 AS k, sum(l_quantity)::BIGINT AS parts_total FROM lineitem GROUP BY 1), t AS (SELECT l_partkey % 100 AS k, sum(l_quantity + CASE WHEN l_linenumber = 7 AND l_partkey % 5 = 0 THEN 1 ELSE 0 END)::BIGINT AS total FROM lineitem GROUP BY 1)
       SELECT p.k, parts_total, total FROM p JOIN t ON t.k = p.k WHERE abs(parts_total - total) > 1""",
)
def reconcile_totals(spark, sf):
    l = I.table(spark, sf, "lineitem").withColumn("k", F.col("l_partkey") % 100).withColumn("q", F.col("l_quantity").cast("long"))
    extra = F.when((F.col("l_linenumber") == 7) & (F.col("l_partkey") % 5 == 0), 1).otherwise(0)
    totals = l.groupBy("k").agg(F.sum(F.col("q") + extra).alias("total"))
    return P.total_mismatch(l, totals, ["k"], "q")


@query(
    "zone_lookup",
    """WITH a AS (SELECT n_nationkey::BIGINT AS zone_id, unnest(list_distinct([n_nationkey::VARCHAR, lpad(n_nationkey::VARCHAR, 5, '0'), lower(n_name)])) AS alias FROM nation),
       q AS (SELECT c_custkey, (['NATION_' || c_nationkey, lpad(c_nationkey::VARCHAR, 5, '0'), ' Nation ' || c_nationkey || ' ', 'x'])[c_custkey % 4 + 1] AS asked FROM customer)
       SELECT q.c_custkey, a.zone_id FROM q LEFT JOIN a ON a.alias = lower(replace(trim(q.asked), ' ', '_'))""",
)
def zone_lookup(spark, sf):
    k, n = F.col("c_custkey"), F.col("c_nationkey").cast("string")
    options = F.array(F.concat(F.lit("NATION_"), n), F.lpad(n, 5, "0"), F.concat(F.lit(" Nation "), n, F.lit(" ")), F.lit("x"))
    asked = F.element_at(options, (k % 4 + 1).cast("int"))
    q = I.table(spark, sf, "customer").select("c_custkey", F.lower(F.replace(F.trim(asked), F.lit(" "), F.lit("_"))).alias("alias"))
    zones = I.table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("zone_id"), F.col("n_name").alias("zone_name"))
    return q.join(V.zone_alias(zones), "alias", "left").select("c_custkey", "zone_id")


# --- Data quality --------------------------------------------------------------------------------

CTE["layer_rows"] = (
    """SELECT l_orderkey * 10 + l_linenumber AS k, l_orderkey, l_partkey, (['wind', 'surge', 'flood', 'fire'])[l_linenumber % 4 + 1] AS hazard,
         (['m/s', 'm', 'index'])[l_suppkey % 3 + 1] AS unit, l_quantity / 10e0 AS value, l_discount * 12e0 AS severity FROM lineitem""",
    [],
)


def layer_rows(spark, sf):
    pick = lambda xs, i: F.element_at(F.array(*[F.lit(x) for x in xs]), (i + 1).cast("int"))
    return I.table(spark, sf, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k"), "l_orderkey", "l_partkey",
        pick(["wind", "surge", "flood", "fire"], F.col("l_linenumber") % 4).alias("hazard"),
        pick(["m/s", "m", "index"], F.col("l_suppkey") % 3).alias("unit"),
        (F.col("l_quantity") / 10.0).alias("value"), (F.col("l_discount") * 12.0).alias("severity"),
    )


@query(
    "dq_rows",
    with_ctes("layer_rows")
    + """SELECT rule, key, count(*) AS n FROM (
          SELECT 'hazard_type' AS rule, k AS key FROM layer_rows WHERE hazard = 'fire'
          UNION ALL SELECT 'unit', k FROM layer_rows WHERE coalesce(unit <> CASE hazard WHEN 'wind' THEN 'm/s' WHEN 'surge' THEN 'm' WHEN 'flood' THEN 'index' END, true)
          UNION ALL SELECT 'severity', k FROM layer_rows WHERE NOT severity BETWEEN 0 AND 1
          UNION ALL SELECT 'value', k FROM layer_rows WHERE coalesce(value > CASE hazard WHEN 'wind' THEN 65 WHEN 'surge' THEN 6 WHEN 'flood' THEN 1 END, true)) GROUP BY 1, 2""",
)
def dq_rows(spark, sf):
    from stormledger.functions.hazard import UNITS

    v = Q.violations(layer_rows(spark, sf), F.col("k"), Q.layer_rules(UNITS))
    return v.groupBy("rule", "key").agg(F.count(F.lit(1)).alias("n"))


@query(
    "dq_collections",
    """WITH x AS (SELECT event_type AS hazard, date_diff('day', DATE '2024-01-01', ts::DATE)::BIGINT AS step, user_id || '__' || date_diff('day', DATE '2024-01-01', ts::DATE) AS id FROM events),
       c AS (SELECT hazard, step, id, count(*) AS n FROM x GROUP BY 1, 2, 3), a AS (SELECT hazard, step, sum(n)::BIGINT AS rows, count_if(n > 1)::BIGINT AS duplicates FROM c GROUP BY 1, 2)
       SELECT hazard, step, rows, duplicates, rows = duplicates % 3 + 60 AND duplicates = 0 AS valid FROM a""",
)
def dq_collections(spark, sf):
    day = F.date_diff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).cast("long")
    e = I.table(spark, sf, "events").select(F.col("event_type").alias("hazard"), day.alias("step"), "user_id")
    rows = e.withColumn("suffix", F.concat(F.lit("__"), F.col("step").cast("string"))).withColumn(
        "id", F.concat(F.col("user_id").cast("string"), F.col("suffix"))
    ).withColumn("unit", F.col("hazard"))
    expected = e.select("hazard", "step").distinct().withColumn("expected", F.lit(60).cast("long"))
    return Q.collection_checks(rows, expected, ["hazard", "step"])


@query(
    "dq_consistency",
    """WITH x AS (SELECT user_id AS cell, date_diff('day', DATE '2024-01-01', ts::DATE)::BIGINT AS step, bool_or(event_type = 'click') AS a, bool_or(event_type = 'view') AS b, bool_or(event_type = 'error') AS c FROM events GROUP BY 1, 2)
       SELECT step, count(*) AS cells, count_if(NOT a)::BIGINT AS missing_click, count_if(NOT b)::BIGINT AS missing_view, count_if(NOT c)::BIGINT AS missing_error FROM x GROUP BY 1""",
)
def dq_consistency(spark, sf):
    day = F.date_diff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).cast("long")
    e = I.table(spark, sf, "events").select(F.col("user_id").alias("cell_id"), day.alias("step"), F.col("event_type").alias("hazard"))
    return Q.consistency(e, ["step"], ["click", "view", "error"])


@query(
    "dq_missing_layers",
    with_ctes("buckets")
    + """, a AS (SELECT unnest(generate_series(min(step), max(step))) AS step FROM buckets), h AS (SELECT DISTINCT event FROM buckets)
        SELECT h.event AS hazard, a.step FROM a CROSS JOIN h LEFT JOIN (SELECT event, step FROM buckets WHERE n >= 5) b ON b.event = h.event AND b.step = a.step WHERE b.step IS NULL""",
)
def dq_missing_layers(spark, sf):
    b = I.event_buckets(spark, sf).withColumn("all", F.lit("all"))
    steps = T.axis(b, ["all"], "step").withColumnRenamed("all", "event")
    hazards = b.select(F.col("event").alias("hazard"), F.lit("all").alias("event")).distinct()
    present = b.filter("n >= 5").select(F.col("event").alias("hazard"), "step")
    return Q.missing_layers(steps, hazards, present, ["hazard", "step"])


@query(
    "dq_breakpoints",
    """WITH p AS (SELECT p_brand AS g, p_size AS x, avg(p_retailprice) / 2000e0 AS y FROM part GROUP BY 1, 2), l AS (SELECT *, lag(y) OVER (PARTITION BY g ORDER BY x) AS prev FROM p)
       SELECT g, bool_and(coalesce(prev <= y, true)) AS monotone, bool_and(y BETWEEN 0 AND 1) AS bounded, count(*) AS points FROM l GROUP BY 1""",
)
def dq_breakpoints(spark, sf):
    p = I.table(spark, sf, "part").groupBy(F.col("p_brand").alias("g"), F.col("p_size").alias("x")).agg((F.avg("p_retailprice") / 2000.0).alias("y"))
    return Q.monotone(p, "g", "x", "y")


@query(
    "dq_track",
    with_ctes("fixes")
    + """, t AS (SELECT * FROM fixes WHERE step % 41 <> 0)
        SELECT f.event, count(t.lat) AS fixes, count_if(t.lat IS NULL)::BIGINT AS missing, 0::BIGINT AS off_axis, bool_and(t.lat BETWEEN 10 AND 23 AND t.lon BETWEEN 85 AND 90) AS in_bounds,
          arg_max(t.lat, t.step) > arg_min(t.lat, t.step) AS northward FROM fixes f LEFT JOIN t ON t.event = f.event AND t.step = f.step GROUP BY 1""",
)
def dq_track(spark, sf):
    f = I.fixes(spark, sf).select("event", "step", "lat", "lon")
    return Q.track_checks(f.filter("step % 41 <> 0"), f.select("event", "step"), "event", (10.0, 23.0), (85.0, 90.0))


@query(
    "state_machine",
    """WITH l AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM conversations)
       SELECT conv_id, turn, role, prev FROM l WHERE NOT (coalesce(prev, '-') || role IN ('-system', '-user', 'systemuser', 'userassistant'))""",
)
def state_machine(spark, sf):
    log = I.table(spark, sf, "conversations").select("conv_id", "turn", "role")
    moves = spark.createDataFrame([(None, "system"), (None, "user"), ("system", "user"), ("user", "assistant")], "before string, after string")
    return Q.illegal_moves(log, ["conv_id"], "turn", "role", moves, chunk=3)


@query(
    "latest_state",
    "SELECT conv_id, arg_max(role, turn) AS state, max(turn) AS at, count(*) AS events FROM conversations GROUP BY 1",
)
def latest_state(spark, sf):
    return Q.latest_state(I.table(spark, sf, "conversations"), ["conv_id"], "turn", "role")


@query(
    "audit_listing",
    "SELECT conv_id, turn, role FROM conversations WHERE role = 'user'",
)
def audit_listing(spark, sf):
    return Q.listing(I.table(spark, sf, "conversations"), "role", "user", "conv_id").select("conv_id", "turn", "role")


@query(
    "dq_payout_rules",
    with_ctes("released")
    + """SELECT 'payout' AS rule, zone_id || '/' || event || '/' || step AS key FROM released WHERE step % 50 = 0 AND payout > 0
        UNION ALL SELECT 'released', zone_id || '/' || event || '/' || step FROM released WHERE step % 50 = 0 AND payout > 0 AND NOT released_payout >= payout + 500""",
)
def dq_payout_rules(spark, sf):
    """Rule violations after adding 500 to every fiftieth step's payout."""
    from stormledger.plans.risk_queries import _released

    unit = F.when(F.col("metric") == "surge_depth", F.lit("m")).otherwise(F.lit("m/s"))
    wrong = F.when((F.col("step") % 50 == 0) & (F.col("payout") > 0), 500).otherwise(0)
    r = _released(spark, sf).withColumn("unit", unit).withColumn("payout", F.col("payout") + wrong)
    return Q.violations(r, F.concat_ws("/", "zone_id", "event", "step"), Q.payout_rules())


@query(
    "rate_window",
    """SELECT event_id, user_id, (SELECT count(*) FROM events b WHERE b.user_id = a.user_id AND b.ts > a.ts - INTERVAL 1 HOUR AND b.ts <= a.ts) AS in_hour,
         (SELECT count(*) FROM events b WHERE b.user_id = a.user_id AND b.ts > a.ts - INTERVAL 1 HOUR AND b.ts <= a.ts) > 1 AS limited FROM events a""",
)
def rate_window(spark, sf):
    from stormledger.streaming.streams import trailing_count

    return trailing_count(I.table(spark, sf, "events"), "user_id", "ts", "event_id", 3600).select(
        "event_id", "user_id", "in_hour", (F.col("in_hour") > 1).alias("limited")
    )


@query(
    "dq_falling_totals",
    """SELECT o_custkey, o_orderkey, o_totalprice, before FROM (
         SELECT o_custkey, o_orderkey, o_totalprice, lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before FROM orders)
       WHERE o_totalprice < before""",
)
def dq_falling_totals(spark, sf):
    """Orders that cost less than the customer's one before."""
    orders = I.table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return Q.falling_totals(orders, ["o_custkey"], "o_orderkey", "o_totalprice")


@query(
    "dq_results",
    """SELECT 'ok_without_pathway' AS rule, o_orderkey AS key FROM orders WHERE o_orderstatus = 'F' AND o_custkey % 3 > 0
       UNION ALL SELECT 'approver_named', o_orderkey FROM orders WHERE o_orderstatus <> 'F' AND o_custkey % 4 = 0""",
)
def dq_results(spark, sf):
    """Clean results with a pathway, and advisories sent without an approver."""
    k = F.col("o_custkey")
    results = I.table(spark, sf, "orders").select(
        "o_orderkey", F.when(F.col("o_orderstatus") == "F", "ok").when(F.col("o_orderstatus") == "O", "approved").otherwise("sent").alias("status"),
        F.slice(F.array(F.lit("bridge"), F.lit("ferry")), F.lit(1), (k % 3).cast("int")).alias("pathway"),
        F.when(k % 4 != 0, F.col("o_orderpriority")).alias("approved_by"),
    )
    return Q.violations(results, F.col("o_orderkey"), Q.result_rules())
