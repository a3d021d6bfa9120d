"""Slanted shapes, crowded spots and copies, against direct computation."""

import math
import random

from pyspark.sql import functions as F

from stormledger.operators import spatial as S


def ring(spark, pts, zone=1):
    return spark.createDataFrame([(zone, zone, [{"x": float(x), "y": float(y)} for x, y in pts])], "zone_id int, ord int, ring array<struct<x: double, y: double>>")


def test_overlap_of_a_slanted_ring_adds_up(spark):
    shape = ring(spark, [(10, 5), (95, 30), (70, 90), (30, 60)])
    cells = spark.range(100).select(F.col("id").alias("cell_id"), F.floor(F.col("id") / 10).cast("long").alias("tx"), (F.col("id") % 10).alias("ty"))
    total = S.overlap(shape, cells, 10.0).agg(F.sum("area_m2")).first()[0]
    area = shape.select(S.ring_area(F.col("ring"))).first()[0]
    assert abs(total - area) < 1e-6


def test_overlap_of_a_concave_ring(spark):
    shape = ring(spark, [(0, 0), (10, 0), (10, 10), (8, 10), (8, 2), (2, 2), (2, 10), (0, 10)])
    cells = spark.createDataFrame([(1, 0, 1)], "cell_id long, tx long, ty long")  # x 0..5, y 5..10
    assert abs(S.overlap(shape, cells, 5.0).first().area_m2 - 10.0) < 1e-9


def test_length_inside_a_concave_ring(spark):
    shape = ring(spark, [(0, 0), (10, 0), (10, 10), (8, 10), (8, 2), (2, 2), (2, 10), (0, 10)])
    seg = spark.createDataFrame([(1, -5.0, 5.0, 15.0, 5.0), (2, -1.0, -1.0, 11.0, 11.0)], "fid int, ax double, ay double, bx double, by double")
    got = {r.fid: r.length_m for r in S.line_lengths(seg, shape, 4.0).collect()}
    assert abs(got[1] - 4.0) < 1e-9
    # The diagonal is inside for 0..2 and again where x is in 8..10.
    assert abs(got[2] - 4.0 * math.sqrt(2)) < 1e-9


def test_boundary_switch_and_holes(spark):
    pts = spark.createDataFrame([(1, 0.0, 5.0), (2, 5.0, 5.0), (3, 1.0, 1.0), (4, 11.0, 5.0)], "pid long, x double, y double")
    box = ring(spark, [(0, 0), (10, 0), (10, 10), (0, 10)])
    get = lambda s, b: {r.pid for r in S.containing(pts, s, 4.0, b).collect()}
    assert get(box, False) == {2, 3} and get(box, True) == {1, 2, 3}
    hole = box.withColumn("holes", F.array(F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in [(4, 4), (6, 4), (6, 6), (4, 6)]])))
    assert get(hole, False) == {3}


def test_touching_an_edge_counts_on_both_sides(spark):
    seg = spark.createDataFrame([(1, 10.0, 10.0, 10.0, 10.0), (2, 5.0, 5.0, 5.0, 5.0), (3, 2.0, 2.0, 38.0, 38.0)], "fid int, ax double, ay double, bx double, by double")
    got = {}
    for r in S.cells_touched(seg, 10.0).collect():
        got.setdefault(r.fid, set()).add((r.tx, r.ty))
    assert got[1] == {(0, 0), (0, 1), (1, 0), (1, 1)} and got[2] == {(0, 0)}
    # A diagonal through cell corners touches the cells beside each corner too.
    assert got[3] == {(i, j) for i in range(4) for j in range(4) if abs(i - j) <= 1}


def test_nearest_around_a_crowded_spot(spark):
    r = random.Random(5)
    crowd = [(i, 500 + r.random() * 3, 500 + r.random() * 3) for i in range(300)]
    targets = crowd + [(1000 + i, r.random() * 5000, r.random() * 5000) for i in range(40)]
    targets += [(5000, *targets[0][1:])]  # a second target at one place: the lower id wins
    points = [(i, 498 + r.random() * 8, 498 + r.random() * 8) for i in range(60)] + [(100 + i, r.random() * 9000, r.random() * 9000) for i in range(60)]
    p = spark.createDataFrame(points, "pid long, x double, y double")
    t = spark.createDataFrame(targets, "tid long, tx double, ty double")
    got = {x.pid: (x.tid, round(x.distance_m, 6)) for x in S.nearest(p, t, 50.0, dense=16).collect()}
    for i, x, y in points:
        d, tid = min((math.hypot(x - a, y - b), k) for k, a, b in targets)
        assert got[i] == (tid, round(d, 6))


def test_dedupe_equals_the_walk_in_priority_order(spark):
    r = random.Random(6)
    rows = [(i, "same" if i % 3 else f"n{i % 5}", r.random() * 600, r.random() * 600) for i in range(240)]
    rows += [(1000 + i, "same", 300.0, 300.0) for i in range(120)]  # a third of all at one spot
    order = {i: (i * 7919) % 1361 for i, *_ in rows}
    df = spark.createDataFrame([(i, k, order[i] * 10000 + i, x, y) for i, k, x, y in rows], "id long, name string, p long, x double, y double")
    got = {x.id: x.keeper for x in S.greedy_dedupe(df, "name", "p", 100.0).collect()}
    want, kept = {}, []
    for i, k, x, y in sorted(rows, key=lambda q: (order[q[0]] * 10000 + q[0])):
        near = [j for j, kk, a, b in kept if kk == k and math.hypot(x - a, y - b) <= 100.0]
        want[i] = near[0] if near else i
        if not near:
            kept.append((i, k, x, y))
    assert got == want


def test_nearest_outline(spark):
    leg = "fid long, seq int, ax double, ay double, bx double, by double"
    unnamed = spark.createDataFrame([(1, 0, 0.0, 0.0, 50.0, 0.0), (2, 0, 5000.0, 0.0, 5000.0, 0.0)], leg)
    named = spark.createDataFrame([(10, 0, 150.0, 0.0, 150.0, 40.0), (11, 0, 25.0, 110.0, 25.0, 110.0)], leg)
    got = [(r.fid, r.kept, round(r.distance_m, 3)) for r in S.nearest_outline(unnamed, named, 120.0).collect()]
    assert got == [(1, 10, 100.0)]


def test_unscored_land_pieces(spark):
    land = spark.createDataFrame([(x, y) for x in range(6) for y in range(2)], "tx long, ty long")
    zone = spark.createDataFrame([(1, 3, y) for y in range(2)], "zone_id int, tx long, ty long")
    got = [r.area_m2 for r in S.unscored_pieces(land, zone, 1.0, 1.0).collect()]
    assert got == [6.0, 4.0]


def even_odd(x, y, pts):
    inside = False
    for (ax, ay), (bx, by) in zip(pts, pts[1:] + pts[:1]):
        if (ay > y) != (by > y) and x < ax + (y - ay) * (bx - ax) / (by - ay):
            inside = not inside
    return inside


STAR = [(50, 5), (60, 40), (95, 45), (62, 58), (70, 95), (50, 65), (25, 92), (38, 55), (4, 40), (42, 38)]


def test_crowded_tiles_are_dealt_evenly(spark):
    """Nine tenths of the points in one tile, a third of them on one spot."""
    r = random.Random(2)
    pts = [(40 + r.random() * 9, 40 + r.random() * 9) for _ in range(2400)] + [(45.5, 44.25)] * 1200 + [(r.random() * 100, r.random() * 100) for _ in range(400)]
    rows = [(k, x, y) for k, (x, y) in enumerate(pts)]
    df = spark.createDataFrame(rows, "pid long, x double, y double").repartition(4)
    zones = ring(spark, STAR, 1).unionByName(ring(spark, [(41, 41), (47, 41), (47, 47), (41, 47)], 2))
    got = {(p.pid, p.zone_id) for p in S.containing(df, zones, 10.0, most=50).collect()}
    want = {(k, z) for k, x, y in rows for z, shape in ((1, STAR), (2, [(41, 41), (47, 41), (47, 47), (41, 47)])) if even_odd(x, y, shape)}
    assert got == want
    dealt, splits, parts = S.deal_points(df, 10.0, 50)
    assert splits.count() >= 1 and parts.count() >= 1 and dealt.count() == len(rows)
    keys = dealt.groupBy("depth", "tx", "ty", "part").count().collect()
    assert max(k["count"] for k in keys) <= 2 * 50
    tasks = [r["count"] for r in dealt.repartition(8, "depth", "tx", "ty", "part").groupBy(F.spark_partition_id()).count().collect()]
    assert max(tasks) <= 3 * sorted(tasks)[len(tasks) // 2]


def test_containing_is_the_same_for_any_tiles(spark):
    r = random.Random(8)
    rows = [(k, r.randrange(0, 101) * 1.0, r.randrange(0, 101) * 1.0) for k in range(600)]
    df, zone = spark.createDataFrame(rows, "pid long, x double, y double"), ring(spark, STAR)
    whole = {p.pid for p in df.join(zone, F.lit(True)).filter(S.in_ring(F.col("x"), F.col("y"), F.col("ring"), True)).collect()}
    for tile, most in ((7.0, 1000), (25.0, 20), (1000.0, 5)):
        assert {p.pid for p in S.containing(df, zone, tile, True, most).collect()} == whole


def clip_by_hand(a, b, pts):
    """Shares of a segment inside a ring, by crossing every edge."""
    (ax, ay), (bx, by) = a, b
    stops = {0.0, 1.0}
    for (px, py), (qx, qy) in zip(pts, pts[1:] + pts[:1]):
        den = (bx - ax) * (qy - py) - (by - ay) * (qx - px)
        if den:
            t = ((px - ax) * (qy - py) - (py - ay) * (qx - px)) / den
            u = ((px - ax) * (by - ay) - (py - ay) * (bx - ax)) / den
            if 0 <= u <= 1 and 0 < t < 1:
                stops.add(t)
    stops = sorted(stops)
    return [(s, e) for s, e in zip(stops, stops[1:]) if even_odd(ax + (s + e) / 2 * (bx - ax), ay + (s + e) / 2 * (by - ay), pts)]


def test_lines_cut_to_a_star(spark):
    r = random.Random(4)
    lines = [(f, [(r.random() * 100, r.random() * 100) for _ in range(5)]) for f in range(30)]
    legs = [(f, k, *a, *b) for f, pts in lines for k, (a, b) in enumerate(zip(pts, pts[1:]))]
    df = spark.createDataFrame(legs, "fid long, seq long, ax double, ay double, bx double, by double").repartition(3)
    got = {}
    for p in S.clip_lines(df, ring(spark, STAR), 15.0).orderBy("fid", "seq", "piece", "ax").collect():
        got.setdefault(p.fid, []).append((p.piece, p.seq, p.ax, p.ay, p.bx, p.by))
    for f, pts in lines:
        spans = [(k, s, e) for k, (a, b) in enumerate(zip(pts, pts[1:])) for s, e in clip_by_hand(a, b, STAR)]
        rows = sorted(got.get(f, []), key=lambda x: x[0])
        assert len(rows) == len(spans)
        n_pieces = sum(1 for i, (k, s, e) in enumerate(spans) if i == 0 or not (
            spans[i - 1][0] == k and spans[i - 1][2] == s or spans[i - 1][0] == k - 1 and spans[i - 1][2] == 1 and s == 0))
        assert not rows or (rows[-1][0] == n_pieces and [x[0] for x in rows] == sorted(x[0] for x in rows))
        length = sum(math.hypot(x[4] - x[2], x[5] - x[3]) for x in rows)
        want = sum((e - s) * math.dist(pts[k], pts[k + 1]) for k, s, e in spans)
        assert abs(length - want) < 1e-9
    total = {p.fid: p.length_m for p in S.line_lengths(df.drop("seq"), ring(spark, STAR), 15.0).collect()}
    assert all(abs(total[f] - sum(math.hypot(x[4] - x[2], x[5] - x[3]) for x in rows)) < 1e-9 for f, rows in got.items())


def test_lines_through_no_zone_take_the_nearest(spark):
    zones = ring(spark, [(0, 0), (10, 0), (10, 10), (0, 10)], 1).unionByName(ring(spark, [(500, 0), (510, 0), (510, 10), (500, 10)], 2))
    legs = [(1, 0, 200.0, 5.0, 220.0, 5.0), (2, 0, 300.0, 5.0, 420.0, 5.0), (3, 0, 2.0, 2.0, 8.0, 2.0), (4, 0, 255.0, 5.0, 255.0, 5.0), (5, 0, -3.0, 5.0, 13.0, 5.0)]
    df = spark.createDataFrame(legs, "fid long, seq long, ax double, ay double, bx double, by double")
    got = {r.fid: (r.zone_id, r.share > 0) for r in S.blocks_along(df, zones, 100.0, 20.0).collect()}
    assert got == {1: (1, False), 2: (2, False), 3: (1, True), 4: (1, False), 5: (1, False)}
    pts = spark.createDataFrame([(1, 210.0, 5.0), (2, 5.0, 5.0), (3, 13.0, 14.0)], "pid long, x double, y double")
    near = {r.pid: (r.zone_id, r.distance_m) for r in S.nearest_zone(pts, zones, 20.0).collect()}
    assert near == {1: (1, 200.0), 2: (1, 0.0), 3: (1, 5.0)}
    nobody = S.blocks_along(df.limit(0), zones, 100.0, 20.0)
    assert nobody.count() == 0


def _searched(monkeypatch, run):
    """How many points each search of `run` was asked for."""
    asked, search = [], S._search
    monkeypatch.setattr(S, "_search", lambda work, points, *rest: asked.append(points.count()) or search(work, points, *rest))
    return asked, run()


def test_points_of_one_spot_are_searched_once(spark, monkeypatch):
    points = spark.createDataFrame([(i, float(i % 3), 0.0) for i in range(300)], "pid long, x double, y double")
    targets = spark.createDataFrame([(7, 0.0, 1.0), (5, 0.0, 1.0), (9, 2.0, 0.5)], "tid long, tx double, ty double")
    asked, got = _searched(monkeypatch, lambda: S.nearest(points, targets, 10.0))
    assert asked == [3]
    want = {0: (5, 1.0), 1: (9, 1.25**0.5), 2: (9, 0.5)}
    assert {r["pid"]: (r["tid"], r["distance_m"]) for r in got.collect()} == {i: want[i % 3] for i in range(300)}


def test_copies_of_an_outline_add_no_points(spark, monkeypatch):
    def square(fid, x, size):
        corner = [(x, 0.0), (x + size, 0.0), (x + size, size), (x, size)]
        return [(fid, i, *corner[i], *corner[(i + 1) % 4]) for i in range(4)]

    kind = "fid long, seq int, ax double, ay double, bx double, by double"
    one = spark.createDataFrame(square(1, 0.0, 20.0), kind)
    copies = spark.createDataFrame([leg for i in range(1, 8) for leg in square(i, 0.0, 20.0)], kind)
    named = spark.createDataFrame([leg for i in (12, 11) for leg in square(i, 30.0, 20.0)], kind)
    few, _ = _searched(monkeypatch, lambda: S.nearest_outline(one, named, 50.0))
    monkeypatch.undo()
    many, got = _searched(monkeypatch, lambda: S.nearest_outline(copies, named, 50.0))
    assert few == many
    assert sorted(map(tuple, got.collect())) == [(i, 11, 10.0) for i in range(1, 8)]


def test_sites_are_spread_over_the_cores(spark):
    from conftest import SF

    from stormledger.plans.spatial_queries import sites, spots

    cores = spark.sparkContext.defaultParallelism
    assert sites(spark, SF).rdd.getNumPartitions() >= cores
    assert spots(spark, SF).rdd.getNumPartitions() >= cores


def test_highest_value_needs_no_distinct_cells(spark):
    segments = spark.createDataFrame([(1, 0.0, 5.0, 35.0, 5.0), (2, 95.0, 95.0, 95.0, 95.0)], "fid long, ax double, ay double, bx double, by double")
    cells = spark.createDataFrame([(0, 0, 1.0), (2, 0, 4.0)], "tx long, ty long, value double")
    got = S.sample_max(segments, cells, 10.0, "value")
    assert sorted(map(tuple, got.collect())) == [(1, 4.0), (2, 0.0)]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1 and "LeftOuter" not in plan
