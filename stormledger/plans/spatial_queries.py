"""Spatial queries over positions derived from keys, in whole metres.

Zones are diamonds or boxes whose containment, area and length have closed forms in SQL; slanted
shapes are covered by unit tests.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from stormledger.functions.numeric import round_to
from stormledger.operators import spatial as S
from stormledger.plans import inputs as I
from stormledger.plans.inputs import CTE, with_ctes
from stormledger.plans.registry import query

CTE["spots"] = ("SELECT c_custkey AS pid, c_custkey * 7919 % 40000 AS x, c_custkey * 104729 % 40000 AS y FROM customer", [])
CTE["sites"] = ("SELECT p_partkey AS pid, p_partkey * 6151 % 40000 AS x, p_partkey * 3079 % 40000 AS y, p_size FROM part", [])
CTE["diamonds"] = (
    "SELECT n_nationkey AS zone_id, (n_nationkey % 5) * 8000 + 4000.5e0 AS cx, (n_nationkey // 5) * 8000 + 4000.5e0 AS cy, 5000.25e0 AS h FROM nation", [],
)
CTE["boxes"] = (
    "SELECT n_nationkey AS zone_id, (n_nationkey % 5) * 8000 + 250e0 AS x0, (n_nationkey // 5) * 8000 + 250e0 AS y0, (n_nationkey % 5) * 8000 + 6500e0 AS x1, (n_nationkey // 5) * 8000 + 5000e0 AS y1 FROM nation", [],
)
_IN = "abs(p.x - d.cx) + abs(p.y - d.cy) < d.h"


def spots(spark, sf):
    k = F.col("c_custkey")
    return I.spread(I.table(spark, sf, "customer").select(
        k.alias("pid"), (k * 7919 % 40000).cast("double").alias("x"), (k * 104729 % 40000).cast("double").alias("y")
    ))


def sites(spark, sf):
    k = F.col("p_partkey")
    return I.spread(I.table(spark, sf, "part").select(
        k.alias("pid"), (k * 6151 % 40000).cast("double").alias("x"), (k * 3079 % 40000).cast("double").alias("y"), "p_size"
    ))


def _pt(x, y):
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def _cx(k):
    return (k % 5) * 8000


def _cy(k):
    return F.floor(k / 5) * 8000


def diamonds(spark, sf):
    k = F.col("n_nationkey")
    cx, cy, h = _cx(k) + F.lit(4000.5), _cy(k) + F.lit(4000.5), F.lit(5000.25)
    ring = F.array(_pt(cx - h, cy), _pt(cx, cy + h), _pt(cx + h, cy), _pt(cx, cy - h))
    return I.table(spark, sf, "nation").select(k.alias("zone_id"), k.alias("ord"), ring.alias("ring"))


def boxes(spark, sf):
    k = F.col("n_nationkey")
    x0, y0, x1, y1 = _cx(k) + 250, _cy(k) + 250, _cx(k) + 6500, _cy(k) + 5000
    ring = F.array(_pt(x0, y0), _pt(x1, y0), _pt(x1, y1), _pt(x0, y1))
    return I.table(spark, sf, "nation").select(k.alias("zone_id"), k.alias("ord"), ring.alias("ring"))


def density(spark, sf, size=500.0):
    """A hazard-like layer on 500 m cells: customers per cell."""
    s = spots(spark, sf)
    return s.groupBy(F.floor(s.x / size).cast("long").alias("tx"), F.floor(s.y / size).cast("long").alias("ty")).agg(
        F.count(F.lit(1)).cast("double").alias("value")
    )


@query(
    "point_in_zone",
    with_ctes("spots", "diamonds") + f"SELECT p.pid, min(d.zone_id) AS zone_id FROM spots p LEFT JOIN diamonds d ON {_IN} GROUP BY 1",
)
def point_in_zone(spark, sf):
    return S.first_zone(spots(spark, sf), diamonds(spark, sf), 2000.0)


@query(
    "points_outside",
    with_ctes("spots", "diamonds") + f"SELECT p.pid FROM spots p WHERE NOT EXISTS (SELECT 1 FROM diamonds d WHERE {_IN})",
)
def points_outside(spark, sf):
    return S.outside(spots(spark, sf), diamonds(spark, sf), 2000.0).select("pid")


CTE["density"] = ("SELECT x // 500 AS tx, y // 500 AS ty, count(*)::DOUBLE AS value FROM spots GROUP BY 1, 2", ["spots"])


@query(
    "hazard_at_feature",
    with_ctes("sites", "density")
    + """, t AS (SELECT pid, unnest(generate_series(CASE WHEN x % 500 = 0 THEN x // 500 - 1 ELSE x // 500 END, (x + p_size * 100) // 500)) AS tx,
          CASE WHEN y % 500 = 0 THEN y // 500 - 1 ELSE y // 500 END AS ty0, y // 500 AS ty1 FROM sites)
        SELECT s.pid AS fid, coalesce(max(d.value), 0e0) AS value FROM sites s LEFT JOIN t ON t.pid = s.pid
        LEFT JOIN density d ON d.tx = t.tx AND d.ty BETWEEN t.ty0 AND t.ty1 GROUP BY 1""",
)
def hazard_at_feature(spark, sf):
    seg = sites(spark, sf).select(
        F.col("pid").alias("fid"), F.col("x").alias("ax"), F.col("y").alias("ay"),
        (F.col("x") + F.col("p_size") * 100).alias("bx"), F.col("y").alias("by"),
    )
    return S.sample_max(seg, density(spark, sf), 500.0, "value")


@query(
    "overlap_area",
    with_ctes("boxes", "density")
    + """, o AS (SELECT zone_id, tx * 1000000 + ty AS cell_id, (least(x1, (tx + 1) * 500) - greatest(x0, tx * 500)) AS w, (least(y1, (ty + 1) * 500) - greatest(y0, ty * 500)) AS h FROM boxes, density)
        SELECT zone_id, cell_id, w * h AS area_m2, w * h >= 100000 AS counts FROM o WHERE w > 0 AND h > 0""",
)
def overlap_area(spark, sf):
    cells = density(spark, sf).withColumn("cell_id", F.col("tx") * 1_000_000 + F.col("ty"))
    return S.overlap(boxes(spark, sf), cells, 500.0).withColumn("counts", F.col("area_m2") >= 100000)


@query(
    "line_in_zone",
    with_ctes("sites", "boxes")
    + """, l AS (SELECT pid, y, least(x, x + p_size * 100) AS lo, greatest(x, x + p_size * 100) AS hi FROM sites)
        SELECT pid AS fid, zone_id, least(hi, x1) - greatest(lo, x0) AS length_m FROM l, boxes
        WHERE y > y0 AND y < y1 AND least(hi, x1) > greatest(lo, x0)""",
)
def line_in_zone(spark, sf):
    seg = sites(spark, sf).select(
        F.col("pid").alias("fid"), F.col("x").alias("ax"), F.col("y").alias("ay"),
        (F.col("x") + F.col("p_size") * 100).alias("bx"), F.col("y").alias("by"),
    )
    return S.line_lengths(seg, boxes(spark, sf), 2000.0).withColumn("length_m", round_to(F.col("length_m"), 6))


@query(
    "clipped_lines",
    with_ctes("sites", "boxes")
    + """, l AS (SELECT pid, y, 0::BIGINT AS seq, x AS ax, x + p_size * 50 AS bx FROM sites
                 UNION ALL SELECT pid, y, 1, x + p_size * 50, x + p_size * 100 FROM sites),
        c AS (SELECT pid AS fid, zone_id, seq, y, ax <= bx AS ahead, greatest(least(ax, bx), x0) AS lo, least(greatest(ax, bx), x1) AS hi FROM l, boxes WHERE y > y0 AND y < y1)
        SELECT fid, zone_id, 1::BIGINT AS piece, seq, CASE WHEN ahead THEN lo ELSE hi END::DOUBLE AS ax, CASE WHEN ahead THEN hi ELSE lo END::DOUBLE AS bx, y::DOUBLE AS y FROM c WHERE hi > lo""",
)
def clipped_lines(spark, sf):
    """Lines of two legs cut to boxes; slanted lines and rings with several pieces are covered by unit tests."""
    x, y, half = F.col("x"), F.col("y"), F.col("p_size") * 50
    leg = lambda seq, a, b: F.struct(F.lit(seq).cast("long").alias("seq"), a.alias("ax"), y.alias("ay"), b.alias("bx"), y.alias("by"))
    lines = sites(spark, sf).select(F.col("pid").alias("fid"), F.inline(F.array(leg(0, x, x + half), leg(1, x + half, x + 2 * half))))
    return S.clip_lines(lines, boxes(spark, sf), 2000.0).select(
        "fid", "zone_id", "piece", "seq", round_to(F.col("ax"), 6).alias("ax"), round_to(F.col("bx"), 6).alias("bx"), F.col("ay").alias("y"))


@query("shape_area", "SELECT p_partkey AS k, p_size * (p_size + 3.5e0) * 1.5e0 AS area_m2 FROM part")
def shape_area(spark, sf):
    """Parallelograms of base p_size + 3.5 and height 1.5 p_size, slanted by the key."""
    k, s = F.col("p_partkey") % 13, F.col("p_size")
    h, w = s * F.lit(1.5), s + F.lit(3.5)
    ring = F.array(_pt(k * 0, k * 0), _pt(w, k * 0), _pt(w + k, h), _pt(k, h))
    return I.table(spark, sf, "part").select(F.col("p_partkey").alias("k"), round_to(S.ring_area(ring), 6).alias("area_m2"))


CTE["towers"] = ("SELECT s_suppkey AS tid, s_suppkey * 7561 % 40000 AS tx, s_suppkey * 4409 % 40000 AS ty FROM supplier", [])
_NEAREST = """SELECT pid, arg_min(tid, (d2, tid)) AS node, floor(sqrt(min(d2)) * 1e6 + 0.5e0) / 1e6 AS distance_m FROM (
  SELECT pid, tid, ((x - tx) * (x - tx) + (y - ty) * (y - ty))::DOUBLE AS d2 FROM sites, towers) GROUP BY 1"""


def towers(spark, sf):
    k = F.col("s_suppkey")
    return I.table(spark, sf, "supplier").select(
        k.alias("tid"), (k * 7561 % 40000).cast("double").alias("tx"), (k * 4409 % 40000).cast("double").alias("ty")
    )


@query("snap_to_node", with_ctes("sites", "towers") + f"SELECT pid, node, distance_m, distance_m > 2000 AS too_far FROM ({_NEAREST})")
def snap_to_node(spark, sf):
    s = S.snap(sites(spark, sf).drop("p_size"), towers(spark, sf), 1000.0)
    return s.withColumn("distance_m", round_to(F.col("distance_m"), 6))


@query("nearest_within", with_ctes("sites", "towers") + f"SELECT pid, node, distance_m FROM ({_NEAREST}) WHERE distance_m <= 1500")
def nearest_within(spark, sf):
    s = S.nearest(sites(spark, sf).drop("p_size"), towers(spark, sf), 1500.0, max_m=1500.0)
    return s.select("pid", F.col("tid").alias("node"), round_to(F.col("distance_m"), 6).alias("distance_m"))


@query(
    "dedupe_named",
    """WITH RECURSIVE p AS (SELECT c_custkey AS id, c_mktsegment AS k, c_custkey * 7919 % 4000 AS x, c_custkey * 104729 % 4000 AS y,
           row_number() OVER (PARTITION BY c_mktsegment ORDER BY (c_custkey * 613) % 1009, c_custkey) AS i FROM customer),
       g AS (SELECT k, 0::BIGINT AS i, [{'id': -1::BIGINT, 'x': -1000000::BIGINT, 'y': 0::BIGINT}] AS kept FROM p GROUP BY k UNION ALL
         SELECT g.k, p.i, CASE WHEN len(list_filter(g.kept, lambda q: (q.x - p.x) * (q.x - p.x) + (q.y - p.y) * (q.y - p.y) <= 10000)) > 0
           THEN g.kept ELSE list_append(g.kept, {'id': p.id, 'x': p.x, 'y': p.y}) END FROM g JOIN p ON p.k = g.k AND p.i = g.i + 1),
       last AS (SELECT k, arg_max(kept, i) AS kept FROM g GROUP BY k)
       SELECT p.id, list_filter(last.kept, lambda q: (q.x - p.x) * (q.x - p.x) + (q.y - p.y) * (q.y - p.y) <= 10000)[1].id AS keeper
       FROM p JOIN last ON last.k = p.k""",
)
def dedupe_named(spark, sf):
    k = F.col("c_custkey")
    df = I.table(spark, sf, "customer").select(
        k.alias("id"), F.col("c_mktsegment").alias("name_key"), F.struct((k * 613) % 1009, k).alias("priority"),
        (k * 7919 % 4000).cast("double").alias("x"), (k * 104729 % 4000).cast("double").alias("y"),
    )
    return S.greedy_dedupe(df, "name_key", "priority", 100.0)


@query(
    "blocks_along",
    with_ctes("sites", "diamonds")
    + """, q AS (SELECT pid, p_size * 2 AS n, unnest(generate_series(0, greatest(p_size * 2, 1))) AS i, x, y, p_size FROM sites),
        p AS (SELECT pid, i, x + i * 50e0 AS x, y, greatest(n, 1) + 1 AS total FROM q),
        c AS (SELECT p.pid AS fid, d.zone_id, min(p.i) AS first_i, count(*) AS n, any_value(total) AS total FROM p JOIN diamonds d ON """ + _IN + """ GROUP BY 1, 2),
        lone AS (SELECT pid AS fid, x + greatest(p_size, 0) * 50 AS x, y FROM sites WHERE pid NOT IN (SELECT fid FROM c)),
        corner AS (SELECT zone_id, unnest([0, 1, 2, 3]) AS k, cx, cy, h FROM diamonds),
        side AS (SELECT zone_id, cx + h * ([-1, 0, 1, 0])[k + 1] AS ax, cy + h * ([0, 1, 0, -1])[k + 1] AS ay,
                 cx + h * ([-1, 0, 1, 0])[(k + 1) % 4 + 1] AS ex, cy + h * ([0, 1, 0, -1])[(k + 1) % 4 + 1] AS ey FROM corner),
        seen AS (SELECT fid, zone_id, x, y, ax, ay, ex - ax AS dx, ey - ay AS dy, least(greatest(((x - ax) * (ex - ax) + (y - ay) * (ey - ay)) / ((ex - ax) * (ex - ax) + (ey - ay) * (ey - ay)), 0e0), 1e0) AS t FROM lone, side),
        away AS (SELECT fid, zone_id, min(round(sqrt((ax + t * dx - x) * (ax + t * dx - x) + (ay + t * dy - y) * (ay + t * dy - y)), 6)) AS d FROM seen GROUP BY 1, 2),
        inside AS (SELECT p.fid, min(d.zone_id) AS zone_id FROM lone p JOIN diamonds d ON """ + _IN + """ GROUP BY 1),
        nearest AS (SELECT a.fid, coalesce(any_value(i.zone_id), arg_min(a.zone_id, (a.d, a.zone_id))) AS zone_id FROM away a LEFT JOIN inside i ON i.fid = a.fid GROUP BY 1)
        SELECT fid, zone_id, NULL::BIGINT AS first_i, 0e0 AS share FROM nearest UNION ALL
        SELECT fid, zone_id, first_i, floor(n / total::DOUBLE * 1e6 + 0.5e0) / 1e6 AS share FROM (SELECT *, row_number() OVER (PARTITION BY fid ORDER BY n DESC, zone_id DESC) AS best, max(n) OVER (PARTITION BY fid) AS most FROM c) WHERE n / total::DOUBLE >= 0.05e0 OR (most < total * 0.05e0 AND best = 1)""",
)
def blocks_along(spark, sf):
    seg = sites(spark, sf).select(
        F.col("pid").alias("fid"), F.lit(0).alias("seq"), F.col("x").alias("ax"), F.col("y").alias("ay"),
        (F.col("x") + F.greatest(F.col("p_size"), F.lit(0)) * 100).alias("bx"), F.col("y").alias("by"),
    )
    out = S.blocks_along(seg, diamonds(spark, sf), 50.0, 2000.0)
    return out.select("fid", "zone_id", F.col("first_pos.i").cast("long").alias("first_i"), round_to(F.col("share"), 6).alias("share"))


# Land: cells with a customer; zones: cells of the diamonds' customers; protected: cells of suppliers.
CTE["land"] = ("SELECT DISTINCT x // 500 AS tx, y // 500 AS ty FROM spots", ["spots"])
CTE["zoned"] = (f"SELECT DISTINCT d.zone_id, p.x // 500 AS tx, p.y // 500 AS ty FROM sites p JOIN diamonds d ON {_IN}", ["sites", "diamonds"])
CTE["guarded"] = ("SELECT DISTINCT tx // 500 AS tx, ty // 500 AS ty FROM towers", ["towers"])


def _tile(df, x="x", y="y"):
    return df.withColumn("tx", F.floor(F.col(x) / 500).cast("long")).withColumn("ty", F.floor(F.col(y) / 500).cast("long"))


def _zoned(spark, sf):
    hit = S.containing(sites(spark, sf).drop("p_size"), diamonds(spark, sf), 2000.0)
    return _tile(hit).select("zone_id", "tx", "ty").distinct()


@query(
    "zone_land_areas",
    with_ctes("land", "zoned", "guarded")
    + """SELECT zone_id, count_if(l.tx IS NOT NULL) * 250000e0 AS land_m2, count_if(l.tx IS NULL) * 250000e0 AS water_m2,
          count_if(l.tx IS NOT NULL AND g.tx IS NULL) * 250000e0 AS inhabited_m2
        FROM zoned z LEFT JOIN land l ON l.tx = z.tx AND l.ty = z.ty LEFT JOIN guarded g ON g.tx = z.tx AND g.ty = z.ty GROUP BY 1""",
)
def zone_land_areas(spark, sf):
    guarded = _tile(towers(spark, sf).select(F.col("tx").alias("x"), F.col("ty").alias("y"))).select("tx", "ty")
    return S.zone_areas(_tile(spots(spark, sf)).select("tx", "ty"), _zoned(spark, sf), guarded, 250000.0)


@query(
    "unscored_land",
    "WITH RECURSIVE " + with_ctes("land", "zoned").removeprefix("WITH ")
    + """, c AS (SELECT tx, ty, (tx + 1073741824) * 2147483648 + ty + 1073741824 AS id FROM land l WHERE NOT EXISTS (SELECT 1 FROM zoned z WHERE z.tx = l.tx AND z.ty = l.ty)),
        f(id, lab) USING KEY (id) AS (SELECT id, id FROM c UNION SELECT b.id, min(f.lab) FROM f JOIN c a ON a.id = f.id JOIN c b ON abs(a.tx - b.tx) + abs(a.ty - b.ty) = 1
          JOIN recurring.f r ON r.id = b.id WHERE f.lab < r.lab GROUP BY b.id)
        SELECT lab AS piece, count(*) * 250000e0 AS area_m2 FROM f GROUP BY 1 HAVING count(*) >= 2""",
)
def unscored_land(spark, sf):
    return S.unscored_pieces(_tile(spots(spark, sf)).select("tx", "ty"), _zoned(spark, sf), 250000.0, 500000.0)


@query(
    "closed_gaps",
    with_ctes("land")
    + """, s AS (SELECT unnest([-1, 0, 1]) AS d), g AS (SELECT DISTINCT tx + a.d AS tx, ty + b.d AS ty FROM land, s a, s b)
        SELECT tx + a.d AS tx, ty + b.d AS ty FROM g, s a, s b GROUP BY 1, 2 HAVING count(*) = 9""",
)
def closed_gaps(spark, sf):
    return S.closing(_tile(spots(spark, sf)).select("tx", "ty").distinct())


@query(
    "unnamed_merge",
)
def unnamed_merge(spark, sf):
    """Unnamed outlines (part squares of p_size metres) to the nearest named one within 120 m."""
    s = sites(spark, sf)
    x, y, w = F.col("x") % 8000, F.col("y") % 8000, F.col("p_size")
    corner = [(x, y), (x + w, y), (x + w, y + w), (x, y + w)]
    legs = F.array(*[
        F.struct(
            F.lit(i).alias("seq"), corner[i][0].alias("ax"), corner[i][1].alias("ay"),
            corner[(i + 1) % 4][0].alias("bx"), corner[(i + 1) % 4][1].alias("by"),
        )
        for i in range(4)
    ])
    lines = s.select(F.col("pid").alias("fid"), F.explode(legs).alias("l")).select("fid", "l.*")
    return S.nearest_outline(lines.filter("fid % 3 = 0"), lines.filter("fid % 3 <> 0"), 120.0)


@query(
    "stand_in_filter",
    with_ctes("sites", "diamonds")
    + f"""SELECT p.pid, p.pid % 2 = 0 AS stand_in, EXISTS (SELECT 1 FROM diamonds d WHERE {_IN} AND d.zone_id % 2 = 0) AND p.pid % 2 = 0 AS dropped FROM sites p""",
)
def stand_in_filter(spark, sf):
    """Stand-ins inside protected shapes are dropped; both sides are returned."""
    s = sites(spark, sf).drop("p_size")
    inside = S.containing(s, diamonds(spark, sf).filter("zone_id % 2 = 0"), 2000.0, boundary=True).select("pid").distinct()
    marked = s.select("pid").join(inside.withColumn("covered", F.lit(True)), "pid", "left")
    stand_in = F.col("pid") % 2 == 0
    return marked.select("pid", stand_in.alias("stand_in"), (F.coalesce("covered", F.lit(False)) & stand_in).alias("dropped"))


@query(
    "zone_cells",
    with_ctes("overlap", "spots", "boxes")
    + """, got AS (SELECT DISTINCT zone_id, cell_id FROM overlap WHERE zone_id % 5 <> 0)
        SELECT zone_id, cell_id FROM got UNION ALL
        SELECT b.zone_id::BIGINT, s.pid FROM boxes b JOIN spots s ON s.x BETWEEN x0 AND x1 AND s.y BETWEEN y0 AND y1
        WHERE b.zone_id NOT IN (SELECT zone_id FROM got)""",
)
def zone_cells(spark, sf):
    """Cells of a zone by overlap; zones without any take those whose centre lies in their box."""
    k = F.col("n_nationkey")
    zones = I.table(spark, sf, "nation").select(
        k.cast("long").alias("zone_id"), ((k % 5) * 8000 + 250.0).alias("bx0"), (F.floor(k / 5) * 8000 + 250.0).alias("by0"),
        ((k % 5) * 8000 + 6500.0).alias("bx1"), (F.floor(k / 5) * 8000 + 5000.0).alias("by1"),
    )
    c = F.col("c_custkey")
    cells = I.table(spark, sf, "customer").select(c.alias("cell_id"), (c * 7919 % 40000).alias("x"), (c * 104729 % 40000).alias("y"))
    return S.zone_cells(I.overlap(spark, sf).filter("zone_id % 5 <> 0"), zones, cells, 2000.0)
