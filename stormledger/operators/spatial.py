"""Spatial joins on a grid key: containment, overlap, lengths, nearest, proximity dedupe.

Coordinates are planar metres (functions.geo.to_metres). A shape is first unfolded into the grid
tiles of its box; the equi-join on the tile gives candidates and an exact predicate decides. Tiles
that hold many points are cut into quarters by their counts, and what stays crowded is dealt over
parts, so no key of the join grows with the data. All predicates are Column expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stormledger.functions.geo import grid_key
from stormledger.operators.joins import measured_join
from stormledger.session import WorkTables

POINT = "struct<x:double,y:double>"
MOST_POINTS, MAX_DEPTH = 50_000, 12  # points of a tile that meet its shapes in one task


# --- Tiles ---------------------------------------------------------------------------------------


def tiles_of_box(df: DataFrame, x0: str, y0: str, x1: str, y1: str, size: float) -> DataFrame:
    """A row per tile the closed box touches: tx, ty. A box edge on a tile edge touches both."""

    def span(low: str, high: str) -> Column:
        first = F.ceil(F.col(low) / F.lit(size)).cast("long") - 1
        return F.sequence(first, grid_key(F.col(high), size))

    return df.withColumn("tx", F.explode(span(x0, x1))).withColumn("ty", F.explode(span(y0, y1)))


def ring_box(ring: Column) -> tuple[Column, Column, Column, Column]:
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)


# --- Containment ---------------------------------------------------------------------------------


def _edges(ring: Column) -> Column:
    n = F.size(ring)
    return F.transform(
        F.sequence(F.lit(1), n),
        lambda i: F.struct(
            F.element_at(ring, i).alias("a"),
            F.element_at(ring, F.when(i == n, F.lit(1)).otherwise(i + 1)).alias("b"),
        ),
    )


def _within(x: Column, y: Column, edges: Column, boundary: bool = False) -> Column:
    """Even-odd containment from the edges that a ray from (x, y) towards larger x can meet."""

    def crosses(e: Column) -> Column:
        ax, ay, bx, by = e["a"]["x"], e["a"]["y"], e["b"]["x"], e["b"]["y"]
        spans = (ay > y) != (by > y)
        at = ax + (y - ay) * (bx - ax) / F.when(spans, by - ay).otherwise(F.lit(1.0))
        return spans & (x < at)

    def on(e: Column) -> Column:
        ax, ay, bx, by = e["a"]["x"], e["a"]["y"], e["b"]["x"], e["b"]["y"]
        flat = (bx - ax) * (y - ay) == (by - ay) * (x - ax)
        return (
            flat & (x >= F.least(ax, bx)) & (x <= F.greatest(ax, bx))
            & (y >= F.least(ay, by)) & (y <= F.greatest(ay, by))
        )

    odd = F.size(F.filter(edges, crosses)) % 2 == 1
    edge = F.exists(edges, on)
    return (odd | edge) if boundary else (odd & ~edge)


def in_ring(x: Column, y: Column, ring: Column, boundary: bool = False) -> Column:
    """Even-odd containment; `boundary` says whether points on the outline count."""
    return _within(x, y, _edges(ring), boundary)


def deal_points(points: DataFrame, tile: float, most: int = MOST_POINTS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(points with depth, tx, ty, part; splits: tx, ty, depth; parts: depth, tx, ty, parts).

    Tiles with more than `most` points are cut into quarters as often as their count asks for
    (depth); the quarters that are still too full, as where points share one spot, are dealt over
    parts. Both tables have a row per `most` points at most, so their size is bounded by the count.
    """
    work = WorkTables(points.sparkSession, "tiles")
    at = points.withColumn("tx", grid_key(F.col("x"), tile)).withColumn("ty", grid_key(F.col("y"), tile))
    full = at.groupBy("tx", "ty").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most)
    depth = F.least(F.lit(MAX_DEPTH), F.ceil(F.log2(F.col("n") / F.lit(most)) / 2)).cast("int")
    splits, n = work.save_counting(full.select("tx", "ty", depth.alias("depth"), F.lit(True).alias("full")), "full")
    splits = splits.drop("full")
    if not n:
        none = points.sparkSession.createDataFrame([], "depth int, tx long, ty long, parts long")
        return at.withColumn("depth", F.lit(0)).withColumn("part", F.lit(0).cast("long")), splits, none
    size = F.lit(tile) / F.pow(F.lit(2.0), F.col("depth"))
    fine = at.join(F.broadcast(splits), ["tx", "ty"], "left").withColumn("depth", F.coalesce("depth", F.lit(0))).withColumns({
        "tx": grid_key(F.col("x"), size), "ty": grid_key(F.col("y"), size)})
    crowded = fine.filter("depth > 0").groupBy("depth", "tx", "ty").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most)
    parts = work.save(crowded.select("depth", "tx", "ty", F.ceil(F.col("n") / F.lit(most)).cast("long").alias("parts")))
    dealt = fine.join(F.broadcast(parts), ["depth", "tx", "ty"], "left").withColumn(
        "part", F.pmod(F.xxhash64("pid"), F.coalesce("parts", F.lit(1).cast("long")))).drop("parts")
    return dealt, splits, parts


def containing(
    points: DataFrame, shapes: DataFrame, tile: float, boundary: bool = False, most: int = MOST_POINTS
) -> DataFrame:
    """All (point, shape) pairs with the point inside. points: pid, x, y; shapes: zone_id, ord,
    ring, and optionally holes (array of rings).

    Of a ring a tile gets the edges beside or to the right of it, which is all that a ray from
    within it can meet. A tile that no edge touches lies wholly inside or outside: one test of its
    middle settles it, and its points are not tested.
    """
    dealt, splits, parts = deal_points(points, tile, most)
    x0, y0, x1, y1 = ring_box(F.col("ring"))
    boxed = shapes.withColumns({"bx0": x0, "by0": y0, "bx1": x1, "by1": y1})
    tiled = tiles_of_box(boxed, "bx0", "by0", "bx1", "by1", tile).join(F.broadcast(splits), ["tx", "ty"], "left")
    tiled = tiled.withColumn("depth", F.coalesce("depth", F.lit(0)))
    fold = F.pow(F.lit(2.0), F.col("depth")).cast("long")
    size = F.lit(tile) / fold

    def within_tile(key: str, low: str, high: str) -> Column:
        first = F.greatest(F.col(key) * fold, grid_key(F.col(low), size))
        last = F.least(F.col(key) * fold + fold - 1, grid_key(F.col(high), size))
        return F.when(F.col("depth") == 0, F.array(F.col(key))).when(first <= last, F.sequence(first, last))

    tiled = (
        tiled.withColumn("sx", within_tile("tx", "bx0", "bx1")).withColumn("sy", within_tile("ty", "by0", "by1"))
        .withColumn("tx", F.explode("sx")).withColumn("ty", F.explode("sy")).drop("sx", "sy")
    )
    pad = size * F.lit(1e-9)
    left, low, right, high = F.col("tx") * size - pad, F.col("ty") * size - pad, (F.col("tx") + 1) * size + pad, (F.col("ty") + 1) * size + pad
    met = lambda e: (
        (F.greatest(e["a"]["y"], e["b"]["y"]) >= low) & (F.least(e["a"]["y"], e["b"]["y"]) <= high)
        & (F.greatest(e["a"]["x"], e["b"]["x"]) >= left))
    near = lambda e: segment_meets_box(e["a"]["x"], e["a"]["y"], e["b"]["x"], e["b"]["y"], left, low, right, high)
    tiled = (
        tiled.withColumn("edges", F.filter(_edges(F.col("ring")), met))
        .withColumn("settled", ~F.exists("edges", near))
        .withColumn("inside", F.col("settled") & _within((F.col("tx") + 0.5) * size, (F.col("ty") + 0.5) * size, F.col("edges")))
        .filter("inside OR NOT settled")
        .withColumn("edges", F.when(~F.col("settled"), F.col("edges"))).drop("ring", "inside", "settled")
        .join(F.broadcast(parts), ["depth", "tx", "ty"], "left")
        .withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1).cast("long")) - 1))).drop("parts")
    )
    x, y = F.col("x"), F.col("y")
    hit = dealt.join(tiled, ["depth", "tx", "ty", "part"]).filter(
        x.between(F.col("bx0"), F.col("bx1")) & y.between(F.col("by0"), F.col("by1"))
    ).filter(F.col("edges").isNull() | _within(x, y, F.col("edges"), boundary))
    if "holes" in shapes.columns:
        hit = hit.filter(~F.exists("holes", lambda h: in_ring(x, y, h)))
    return hit.drop("depth", "tx", "ty", "part", "bx0", "by0", "bx1", "by1", "edges", "holes")


def first_zone(points: DataFrame, shapes: DataFrame, tile: float, boundary: bool = False) -> DataFrame:
    """pid, zone_id: the first (lowest ord) shape holding each point; null outside all."""
    hit = containing(points, shapes, tile, boundary).groupBy("pid").agg(F.min_by("zone_id", "ord").alias("zone_id"))
    return points.select("pid").join(hit, "pid", "left")


def outside(points: DataFrame, shapes: DataFrame, tile: float, boundary: bool = True) -> DataFrame:
    """Points no shape covers."""
    return points.join(containing(points, shapes, tile, boundary).select("pid").distinct(), "pid", "left_anti")


def line_anchor(coords: Column) -> Column:
    """A representative point of a line: its middle vertex."""
    return F.element_at(coords, F.floor(F.size(coords) / 2).cast("int") + 1)


# --- Features against cells ----------------------------------------------------------------------


def segment_meets_box(ax, ay, bx, by, x0, y0, x1, y1) -> Column:
    """Whether a segment touches a closed box: their boxes meet and the corners are not all
    strictly on one side of the segment's line."""
    side = lambda x, y: (bx - ax) * (y - ay) - (by - ay) * (x - ax)
    s = [side(x, y) for x in (x0, x1) for y in (y0, y1)]
    boxes = (
        (F.greatest(ax, bx) >= x0) & (F.least(ax, bx) <= x1)
        & (F.greatest(ay, by) >= y0) & (F.least(ay, by) <= y1)
    )
    return boxes & ~((F.least(*s) > 0) | (F.greatest(*s) < 0))


def _cells_met(segments: DataFrame, size: float) -> DataFrame:
    """fid, tx, ty for every grid cell a feature's segments touch (a point is a zero segment); a cell may come twice.

    Long segments are first cut into pieces no longer than a cell, so a slanted line unfolds into
    the cells along it, not into its whole box.
    """
    ax, ay, bx, by = F.col("ax"), F.col("ay"), F.col("bx"), F.col("by")
    reach = F.greatest(F.abs(bx - ax), F.abs(by - ay))
    n = F.greatest(F.lit(1), F.ceil(reach / F.lit(size)).cast("int"))
    pieces = (
        segments.withColumn("n", n)
        .withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
        .select(
            "fid",
            (ax + (bx - ax) * F.col("i") / F.col("n")).alias("px"), (ay + (by - ay) * F.col("i") / F.col("n")).alias("py"),
            F.when(F.col("i") == F.col("n") - 1, bx).otherwise(ax + (bx - ax) * (F.col("i") + 1) / F.col("n")).alias("qx"),
            F.when(F.col("i") == F.col("n") - 1, by).otherwise(ay + (by - ay) * (F.col("i") + 1) / F.col("n")).alias("qy"),
        )
        .withColumns({
            "lx": F.least("px", "qx"), "ly": F.least("py", "qy"),
            "hx": F.greatest("px", "qx"), "hy": F.greatest("py", "qy"),
        })
    )
    s = F.lit(size)
    return (
        tiles_of_box(pieces, "lx", "ly", "hx", "hy", size)
        .filter(
            segment_meets_box(
                F.col("px"), F.col("py"), F.col("qx"), F.col("qy"),
                F.col("tx") * s, F.col("ty") * s, (F.col("tx") + 1) * s, (F.col("ty") + 1) * s,
            )
        )
        .select("fid", "tx", "ty")
    )


def cells_touched(segments: DataFrame, size: float) -> DataFrame:
    """fid, tx, ty for every grid cell a feature's segments touch, once each."""
    return _cells_met(segments, size).distinct()


def sample_max(segments: DataFrame, cells: DataFrame, size: float, value: str, keys: list[str] | None = None) -> DataFrame:
    """Per feature the highest value over the cells it touches, 0 where none. cells: tx, ty, value."""
    keys = keys or []
    # A maximum needs no distinct cells, and features without a hit join the same aggregation.
    hit = _cells_met(segments, size).join(cells, ["tx", "ty"]).select("fid", *keys, value)
    if keys:
        return hit.groupBy("fid", *keys).agg(F.max(value).alias(value))
    every = segments.select("fid", F.lit(None).cast(cells.schema[value].dataType).alias(value))
    return every.unionByName(hit).groupBy("fid").agg(F.coalesce(F.max(value), F.lit(0.0)).alias(value))


# --- Overlay kernels -----------------------------------------------------------------------------


def ring_area(ring: Column) -> Column:
    """Shoelace area of a ring, open or closed."""
    terms = F.transform(_edges(ring), lambda e: e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"])
    return F.abs(F.aggregate(terms, F.lit(0.0), lambda acc, t: acc + t)) / F.lit(2.0)


def clipped_area(edges: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Area of a ring inside a rectangle, from the ring's edges.

    Over the rectangle's width every edge adds the integral of its height, held between the
    rectangle's bottom and top, with the sign of its direction. Held so, an edge is three straight
    pieces at most: they part where it crosses bottom and top.
    """
    zero, one = F.lit(0.0), F.lit(1.0)
    hold = lambda v, low, high: F.least(F.greatest(v, low), high)

    def part(e: Column) -> Column:
        ax, bx = hold(e["a"]["x"], x0, x1), hold(e["b"]["x"], x0, x1)
        run = e["b"]["x"] - e["a"]["x"]
        slope = (e["b"]["y"] - e["a"]["y"]) / F.when(run != 0, run).otherwise(one)
        # Heights at the held ends; an end that lies within the width keeps its own.
        height = lambda own, held: F.when(own["x"] == held, own["y"]).otherwise(e["a"]["y"] + (held - e["a"]["x"]) * slope)
        ay, by = height(e["a"], ax), height(e["b"], bx)
        rise = F.when(by != ay, by - ay)
        cross = lambda level: F.coalesce(hold((level - ay) / rise, zero, one), zero)
        first, second = F.least(cross(y0), cross(y1)), F.greatest(cross(y0), cross(y1))
        at = lambda t: hold(ay + t * (by - ay), y0, y1) - y0
        start, end = hold(ay, y0, y1) - y0, hold(by, y0, y1) - y0
        mean = (start + at(first)) * first + (at(first) + at(second)) * (second - first) + (at(second) + end) * (one - second)
        return F.when(ax == bx, zero).otherwise((bx - ax) * mean / 2)

    return F.abs(F.aggregate(F.transform(edges, part), zero, lambda acc, v: acc + v))


def spans_inside(ax: Column, ay: Column, bx: Column, by: Column, edges: Column) -> Column:
    """The parts of a segment inside a ring as (low, high) shares of its way: it is split where it
    crosses an edge, and each piece is judged by its middle."""
    dx, dy = bx - ax, by - ay

    def crossing(e: Column) -> Column:
        px, py = e["a"]["x"] - ax, e["a"]["y"] - ay
        ex, ey = e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"]
        den = dx * ey - dy * ex
        den = F.when(den != 0, den)
        t, u = (px * ey - py * ex) / den, (px * dy - py * dx) / den
        return F.when((u >= 0) & (u <= 1) & (t > 0) & (t < 1), t)

    met = F.filter(F.transform(edges, crossing), lambda t: t.isNotNull())
    stops = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0.0), F.lit(1.0)), met)))
    pieces = F.transform(
        F.sequence(F.lit(1), F.size(stops) - 1),
        lambda k: F.struct(F.element_at(stops, k).alias("low"), F.element_at(stops, k + 1).alias("high")))
    middle = lambda p: (p["low"] + p["high"]) / 2
    return F.filter(pieces, lambda p: _within(ax + middle(p) * dx, ay + middle(p) * dy, edges))


def overlap(shapes: DataFrame, cells: DataFrame, size: float) -> DataFrame:
    """zone_id, cell_id, area_m2 of every zone with every grid cell it really overlaps.

    A cell gets the ring's edges beside or above it, the only ones that add to its area; areas of
    under a billionth of the cell are rounding.
    """
    x0, y0, x1, y1 = ring_box(F.col("ring"))
    boxed = shapes.withColumns({"bx0": x0, "by0": y0, "bx1": x1, "by1": y1})
    s = F.lit(size)
    left, low, right, high = F.col("tx") * s, F.col("ty") * s, (F.col("tx") + 1) * s, (F.col("ty") + 1) * s
    adds = lambda e: (
        (F.greatest(e["a"]["x"], e["b"]["x"]) > left) & (F.least(e["a"]["x"], e["b"]["x"]) < right)
        & (F.greatest(e["a"]["y"], e["b"]["y"]) > low))
    tiled = tiles_of_box(boxed, "bx0", "by0", "bx1", "by1", size).select(
        "zone_id", "tx", "ty", F.filter(_edges(F.col("ring")), adds).alias("edges")).filter(F.size("edges") > 0)
    return (
        tiled.join(cells.select("cell_id", "tx", "ty"), ["tx", "ty"])
        .select("zone_id", "cell_id", clipped_area(F.col("edges"), left, low, right, high).alias("area_m2"))
        .filter(F.col("area_m2") > 1e-9 * size * size)
    )


def zone_cells(overlap_df: DataFrame, zones: DataFrame, cells: DataFrame, tile: float) -> DataFrame:
    """zone_id, cell_id membership by overlap; zones that overlap nothing take the cells whose
    centre lies in their box. zones: zone_id, bx0, by0, bx1, by1; cells: cell_id, x, y."""
    got = overlap_df.select("zone_id", "cell_id").distinct()
    none = zones.join(got.select("zone_id").distinct(), "zone_id", "left_anti")
    tiled = tiles_of_box(none, "bx0", "by0", "bx1", "by1", tile)
    c = cells.withColumn("tx", grid_key(F.col("x"), tile)).withColumn("ty", grid_key(F.col("y"), tile))
    inside = F.col("x").between(F.col("bx0"), F.col("bx1")) & F.col("y").between(F.col("by0"), F.col("by1"))
    return got.unionByName(c.join(tiled, ["tx", "ty"]).filter(inside).select("zone_id", "cell_id"))


def _legs_in_zones(segments: DataFrame, shapes: DataFrame, tile: float) -> DataFrame:
    """(the legs' columns, zone_id, edges): legs whose box meets the zone's; rings join last, once per pair."""
    x0, y0, x1, y1 = ring_box(F.col("ring"))
    boxed = shapes.select("zone_id", x0.alias("bx0"), y0.alias("by0"), x1.alias("bx1"), y1.alias("by1"))
    tiled = tiles_of_box(boxed, "bx0", "by0", "bx1", "by1", tile)
    legs = segments.withColumns({
        "lx": F.least("ax", "bx"), "ly": F.least("ay", "by"), "hx": F.greatest("ax", "bx"), "hy": F.greatest("ay", "by"),
    })
    meets = (
        (F.col("hx") >= F.col("bx0")) & (F.col("lx") <= F.col("bx1"))
        & (F.col("hy") >= F.col("by0")) & (F.col("ly") <= F.col("by1"))
    )
    # A leg and a zone can share many tiles; the one with the lower corner of their common box counts.
    owner = (F.col("tx") == grid_key(F.greatest("lx", "bx0"), tile)) & (F.col("ty") == grid_key(F.greatest("ly", "by0"), tile))
    pairs = tiles_of_box(legs, "lx", "ly", "hx", "hy", tile).join(tiled, ["tx", "ty"]).filter(meets & owner)
    rings = shapes.select("zone_id", _edges(F.col("ring")).alias("edges"))
    return measured_join(pairs.select(*segments.columns, "zone_id"), rings, ["zone_id"], "fid")


def line_lengths(segments: DataFrame, shapes: DataFrame, tile: float) -> DataFrame:
    """fid, zone_id, length_m of lines inside zones. segments: fid, ax, ay, bx, by (one per leg)."""
    ends = [F.col(c) for c in ("ax", "ay", "bx", "by")]
    share = F.aggregate(spans_inside(*ends, F.col("edges")), F.lit(0.0), lambda acc, p: acc + p["high"] - p["low"])
    length = share * F.hypot(ends[2] - ends[0], ends[3] - ends[1])
    return (
        _legs_in_zones(segments, shapes, tile).select("fid", "zone_id", length.alias("m"))
        .groupBy("fid", "zone_id").agg(F.sum("m").alias("length_m")).filter("length_m > 0")
    )


def clip_lines(lines: DataFrame, shapes: DataFrame, tile: float) -> DataFrame:
    """fid, zone_id, piece, seq, ax, ay, bx, by: lines cut to zones, their pieces numbered in order.

    lines: fid, seq (whole numbers without gaps along a line), ax, ay, bx, by. Parts that touch
    within the zone are one piece; what runs along the outline itself counts by even-odd.
    """
    ends = [F.col(c) for c in ("ax", "ay", "bx", "by")]
    kept = _legs_in_zones(lines, shapes, tile).select(
        "fid", "zone_id", "seq", "ax", "ay", "bx", "by", F.inline(spans_inside(*ends, F.col("edges"))))
    w = Window.partitionBy("fid", "zone_id").orderBy("seq", "low")  # a line's own legs in one zone
    last_seq, last_high = F.lag("seq").over(w), F.lag("high").over(w)
    follows = ((last_seq == F.col("seq")) & (last_high == F.col("low"))) | (
        (last_seq == F.col("seq") - 1) & (last_high == 1) & (F.col("low") == 0))
    along = lambda p, q, t: F.when(F.col(t) == 0, F.col(p)).when(F.col(t) == 1, F.col(q)).otherwise(
        F.col(p) + (F.col(q) - F.col(p)) * F.col(t))
    return (
        kept.withColumn("begins", F.when(F.coalesce(follows, F.lit(False)), 0).otherwise(1))
        .withColumn("piece", F.sum("begins").over(w))
        .select(
            "fid", "zone_id", "piece", "seq", along("ax", "bx", "low").alias("ax"), along("ay", "by", "low").alias("ay"),
            along("ax", "bx", "high").alias("bx"), along("ay", "by", "high").alias("by"),
        )
    )


def centroids(lines: DataFrame) -> DataFrame:
    """fid, x, y: the middle of mass of each line of legs; of its points where it has no length."""
    length = F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"))
    middle = lambda p, q: (F.col(p) + F.col(q)) / 2
    sums = lines.groupBy("fid").agg(
        F.sum(length).alias("l"), F.sum(length * middle("ax", "bx")).alias("sx"), F.sum(length * middle("ay", "by")).alias("sy"),
        F.avg(middle("ax", "bx")).alias("mx"), F.avg(middle("ay", "by")).alias("my"))
    whole = F.when(F.col("l") > 0, F.col("l"))
    return sums.select("fid", F.coalesce(F.col("sx") / whole, "mx").alias("x"), F.coalesce(F.col("sy") / whole, "my").alias("y"))


def nearest_zone(points: DataFrame, shapes: DataFrame, tile: float, extent_m: float = 4.1e7) -> DataFrame:
    """pid, zone_id, distance_m: the zone nearest to each point, 0 inside; ties to a micrometre go to the lowest ord.

    Edges lie in the tiles they touch. A point looks at the tiles around its own; a distance within
    the tile size is final, and only the rest looks again, in tiles four times as large.
    """
    work = WorkTables(points.sparkSession, "nearest-zone")
    held = containing(points.select("pid", "x", "y"), shapes, tile, True).groupBy("pid").agg(F.min_by("zone_id", "ord").alias("zone_id"))
    held = work.save(held.withColumn("distance_m", F.lit(0.0)))
    edge = shapes.select("zone_id", "ord", F.posexplode(_edges(F.col("ring")))).select(
        F.struct("ord", "zone_id", "pos").alias("fid"), F.col("col.a.x").alias("ax"), F.col("col.a.y").alias("ay"),
        F.col("col.b.x").alias("bx"), F.col("col.b.y").alias("by"))
    edge = WorkTables(points.sparkSession, "zone-edges").save(edge)
    left, done = points.select("pid", "x", "y").join(held, "pid", "left_anti"), held
    around = F.sequence(F.lit(-1), F.lit(1))
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    square = dx * dx + dy * dy
    t = F.coalesce(((F.col("x") - F.col("ax")) * dx + (F.col("y") - F.col("ay")) * dy) / F.when(square > 0, square), F.lit(0.0))
    t = F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))
    away = F.hypot(F.col("ax") + t * dx - F.col("x"), F.col("ay") + t * dy - F.col("y"))
    size = tile
    while True:
        placed = cells_touched(edge, size).join(edge, "fid")
        asked = left.withColumn("i", F.explode(around)).withColumn("j", F.explode(around)).withColumns({
            "tx": grid_key(F.col("x"), size) + F.col("i"), "ty": grid_key(F.col("y"), size) + F.col("j")}).drop("i", "j")
        best = F.min(F.struct(F.round(away, 6).alias("d"), F.col("fid.ord").alias("ord"), F.col("fid.zone_id").alias("zone_id"))).alias("b")
        found = asked.join(placed, ["tx", "ty"]).groupBy("pid").agg(best)
        final = F.lit(True) if size >= extent_m else F.coalesce(F.col("b.d") <= size, F.lit(False))
        table, open_rows = work.save_counting(left.join(found, "pid", "left").withColumn("open", ~final), "open")
        done = done.unionByName(
            table.filter("NOT open AND b IS NOT NULL").select("pid", "b.zone_id", F.col("b.d").alias("distance_m")))
        if not open_rows:
            return done
        left, size = table.filter("open").select("pid", "x", "y"), size * 4


def densify(lines: DataFrame, step: float) -> DataFrame:
    """fid, pos, x, y: points at most `step` apart along each line of (fid, seq, ax, ay, bx, by)."""
    return _leg_points(_mark_last(lines), step).select("fid", F.struct("seq", "i").alias("pos"), "x", "y")


def _mark_last(lines: DataFrame) -> DataFrame:
    """lines with is_last: the legs that end their line."""
    return lines.withColumn("is_last", F.col("seq") == F.max("seq").over(Window.partitionBy("fid")))  # a line's own legs


def _leg_points(legs: DataFrame, step: float) -> DataFrame:
    """legs with i, x, y: points at most `step` apart from a leg's start; its end only where is_last."""
    ax, ay, bx, by = F.col("ax"), F.col("ay"), F.col("bx"), F.col("by")
    n = F.greatest(F.lit(1), F.ceil(F.hypot(bx - ax, by - ay) / F.lit(step)).cast("int"))
    last = F.when(F.col("is_last"), F.col("n")).otherwise(F.col("n") - 1)
    return legs.withColumn("n", n).withColumn("i", F.explode(F.sequence(F.lit(0), last))).withColumns({
        "x": ax + (bx - ax) * F.col("i") / F.col("n"), "y": ay + (by - ay) * F.col("i") / F.col("n")}).drop("n")


def blocks_along(lines: DataFrame, shapes: DataFrame, step: float, tile: float, min_share: float = 0.05) -> DataFrame:
    """fid, zone_id, first_pos, share: zones a line runs through in order, slivers left out (the
    largest one is kept when all are slivers). A line through none has the zone nearest to its
    middle, with no first_pos and a share of 0."""
    pts = densify(lines, step)
    n = pts.groupBy("fid").agg(F.count(F.lit(1)).alias("total"))
    keyed = pts.withColumn("pid", F.struct("fid", "pos"))
    inside = containing(keyed.select("pid", "x", "y"), shapes, tile)
    seen = inside.groupBy(F.col("pid.fid").alias("fid"), "zone_id").agg(
        F.min("pid.pos").alias("first_pos"), F.count(F.lit(1)).alias("n")
    )
    seen = WorkTables(lines.sparkSession, "blocks").save(seen)
    best = seen.groupBy("fid").agg(F.max(F.struct("n", "zone_id")).alias("top"), F.max("n").alias("most"))
    lone = lines.join(seen.select("fid").distinct(), "fid", "left_anti")
    near = nearest_zone(centroids(lone).withColumnRenamed("fid", "pid"), shapes, tile).select(
        F.col("pid").alias("fid"), "zone_id", F.lit(None).cast(seen.schema["first_pos"].dataType).alias("first_pos"),
        F.lit(0.0).alias("share"))
    through = (
        seen.join(n, "fid").join(best, "fid")
        .withColumn("share", F.col("n") / F.col("total"))
        .filter(
            (F.col("share") >= min_share)
            | ((F.col("most") < F.col("total") * min_share) & (F.col("zone_id") == F.col("top.zone_id")))
        )
        .select("fid", "zone_id", "first_pos", "share")
    )
    return through.unionByName(near)


# --- Nearest -------------------------------------------------------------------------------------


def _box_distance(level_size: Column, far: bool) -> Column:
    """Distance from (x, y) to the nearest (or farthest) point of cell (cx, cy)."""
    out = []
    for p, c in (("x", "cx"), ("y", "cy")):
        low, high = F.col(c) * level_size, (F.col(c) + 1) * level_size
        if far:
            out.append(F.greatest(F.abs(F.col(p) - low), F.abs(F.col(p) - high)))
        else:
            out.append(F.greatest(F.lit(0.0), low - F.col(p), F.col(p) - high))
    return F.hypot(*out)


def _cells_at(targets: DataFrame, size: float) -> DataFrame:
    return targets.groupBy(
        grid_key(F.col("tx"), size).alias("cx"), grid_key(F.col("ty"), size).alias("cy")
    ).agg(F.count(F.lit(1)).alias("n"))


def _search(work: WorkTables, points: DataFrame, targets: DataFrame, size: float, dense: int, levels: int) -> DataFrame:
    """The nearest target among those in the 3 x 3 cells around each point.

    Cells with more than `dense` targets are split in four and pruned by distance bounds until the
    remaining ones are small, so points around a crowded spot never meet all its targets.
    """
    around = F.sequence(F.lit(-1), F.lit(1))
    level_size = F.lit(size) / F.pow(F.lit(2.0), F.col("level"))
    cand = (
        points.withColumn("dx", F.explode(around)).withColumn("dy", F.explode(around))
        .select(
            "pid", "x", "y", F.lit(0).alias("level"),
            (grid_key(F.col("x"), size) + F.col("dx")).alias("cx"),
            (grid_key(F.col("y"), size) + F.col("dy")).alias("cy"),
        )
        .join(_cells_at(targets, size), ["cx", "cy"])
    )
    w = Window.partitionBy("pid")

    def prune(df: DataFrame) -> DataFrame:
        return (
            df.withColumn("limit", F.min(_box_distance(level_size, True)).over(w))
            .filter(_box_distance(level_size, False) <= F.col("limit"))
            .drop("limit")
            .withColumn("crowded", (F.col("n") > dense) & (F.col("level") < levels))
        )

    cand, crowded = work.save_counting(prune(cand), "crowded")
    level = 0
    while crowded:
        level += 1
        corner = F.sequence(F.lit(0), F.lit(1))
        children = (
            cand.filter("crowded")
            .withColumn("qx", F.explode(corner)).withColumn("qy", F.explode(corner))
            .select(
                "pid", "x", "y", F.lit(level).alias("level"),
                (F.col("cx") * 2 + F.col("qx")).alias("cx"), (F.col("cy") * 2 + F.col("qy")).alias("cy"),
            )
            .join(_cells_at(targets, size / 2**level), ["cx", "cy"])
        )
        kept = cand.filter("NOT crowded").select(*children.columns)
        cand, crowded = work.save_counting(prune(kept.unionByName(children)), "crowded")
    placed = None
    for i in range(level + 1):
        s = size / 2**i
        at = targets.select(
            "tid", "tx", "ty", F.lit(i).alias("level"), grid_key(F.col("tx"), s).alias("cx"), grid_key(F.col("ty"), s).alias("cy")
        )
        placed = at if placed is None else placed.unionByName(at)
    return (
        cand.join(placed, ["level", "cx", "cy"])
        .withColumn("d", F.hypot(F.col("x") - F.col("tx"), F.col("y") - F.col("ty")))
        .groupBy("pid")
        .agg(F.min(F.struct("d", "tid")).alias("b"))
        .select("pid", "b.tid", F.col("b.d").alias("distance_m"))
    )


def nearest(
    points: DataFrame, targets: DataFrame, size: float, max_m: float | None = None,
    extent_m: float = 4.1e7, dense: int = 64, levels: int = 20,
) -> DataFrame:
    """pid, tid, distance_m: the exact nearest target (lowest id on ties), within max_m if given.

    points: pid, x, y; targets: tid, tx, ty. Co-located targets are one, and so are co-located
    points: each spot is asked for once and its points get the answer by one join at the end. An
    answer is final once its distance is within the cell size searched; only the rest is searched
    again, four times coarser.
    """
    work = WorkTables(points.sparkSession, "nearest-target")
    distinct = work.save(targets.groupBy("tx", "ty").agg(F.min("tid").alias("tid")).select("tid", "tx", "ty"))
    left = work.save(points.select("x", "y").distinct().withColumn("pid", F.monotonically_increasing_id()))
    done: DataFrame | None = None
    limit = max_m if max_m is not None else extent_m
    while True:
        found = _search(work, left, distinct, size, dense, levels)
        last = size >= limit
        final = F.lit(True) if last else F.coalesce(F.col("distance_m") <= size, F.lit(False))
        table, open_rows = work.save_counting(
            left.join(found, "pid", "left").withColumn("open", ~final), "open"
        )
        good = table.filter("NOT open AND tid IS NOT NULL").select("x", "y", "tid", "distance_m")
        done = good if done is None else done.unionByName(good)
        if open_rows == 0:
            done = done if max_m is None else done.filter(F.col("distance_m") <= max_m)
            return points.select("pid", "x", "y").join(done, ["x", "y"]).select("pid", "tid", "distance_m")
        left = table.filter("open").select("pid", "x", "y")
        size *= 4.0


def snap(points: DataFrame, nodes: DataFrame, size: float, max_m: float = 2000.0) -> DataFrame:
    """pid, node, distance_m, too_far: the nearest network node, flagged beyond max_m."""
    found = nearest(points, nodes, size)
    return found.select(
        "pid", F.col("tid").alias("node"), "distance_m", (F.col("distance_m") > max_m).alias("too_far")
    )


def nearest_outline(unnamed: DataFrame, named: DataFrame, max_m: float, step: float = 5.0) -> DataFrame:
    """fid, kept, distance_m: each unnamed outline's nearest named one within max_m, outline to
    outline at `step` resolution. Both: fid, seq, ax, ay, bx, by (a point is a zero leg).

    Legs that several outlines share are cut into points once, so copies of an outline add no points.
    """
    leg = ["ax", "ay", "bx", "by", "is_last"]
    work = WorkTables(unnamed.sparkSession, "outline-legs")
    own = work.save(_mark_last(unnamed).select("fid", *leg))
    legs = work.save(own.select(*leg).distinct().withColumn("leg", F.monotonically_increasing_id()))
    p = _leg_points(legs, step).select(F.struct("leg", "i").alias("pid"), "x", "y")
    held = work.save(_mark_last(named).groupBy(*leg).agg(F.min("fid").alias("tid")))
    t = _leg_points(held, step).select("tid", F.col("x").alias("tx"), F.col("y").alias("ty"))
    near = nearest(p, t, max_m, max_m=max_m)
    best = near.groupBy(F.col("pid.leg").alias("leg")).agg(F.min(F.struct("distance_m", "tid")).alias("b"))
    return (
        own.join(legs.join(best, "leg").drop("leg"), leg)
        .groupBy("fid").agg(F.min("b").alias("b"))
        .select("fid", F.col("b.tid").alias("kept"), F.col("b.distance_m").alias("distance_m"))
    )


# --- Proximity dedupe ----------------------------------------------------------------------------


def greedy_dedupe(df: DataFrame, key: str, priority: str, radius: float) -> DataFrame:
    """id, keeper: the greedy result of walking each key's records by priority, where a kept record
    drops every later one within `radius`. keeper = id for the kept.

    df: id, key, priority (unique within a key, lower first), x, y.

    Records of a cell narrower than the radius are all within it of each other, so at most one
    per cell survives. A round looks only at each cell's best undecided record: it is kept if no
    undecided record before it lies within the radius, and then drops the others around it. Every
    record meets at most one representative in each of 25 cells, whatever the size of a key or
    the number of copies at one spot; no pairs of a group are listed.
    """
    work = WorkTables(df.sparkSession, "dedupe")
    cell = radius / 2**0.5 * 0.999999
    base = df.select("id", F.col(key).alias("k"), F.col(priority).alias("p"), "x", "y")
    spot = base.groupBy("k", "x", "y").agg(F.min(F.struct("p", "id")).alias("b"))
    sites = work.save(
        spot.select(
            "k", F.col("b.p").alias("p"), F.col("b.id").alias("id"), "x", "y",
            grid_key(F.col("x"), cell).alias("gx"), grid_key(F.col("y"), cell).alias("gy"),
        )
    )
    span = F.sequence(F.lit(-2), F.lit(2))

    def meet(rows: DataFrame, reps: DataFrame) -> DataFrame:
        """rows joined with the representatives (rid, rp) within the radius around them."""
        near = (
            rows.withColumn("ox", F.explode(span)).withColumn("oy", F.explode(span))
            .withColumn("gx", F.col("gx") + F.col("ox")).withColumn("gy", F.col("gy") + F.col("oy"))
        )
        r = reps.select("k", "gx", "gy", F.col("id").alias("rid"), F.col("p").alias("rp"), F.col("x").alias("rx"), F.col("y").alias("ry"))
        return near.join(r, ["k", "gx", "gy"]).filter(
            F.hypot(F.col("x") - F.col("rx"), F.col("y") - F.col("ry")) <= radius
        )

    undecided, kept = sites, None
    while True:
        reps = undecided.groupBy("k", "gx", "gy").agg(F.min(F.struct("p", "id", "x", "y")).alias("b")).select(
            "k", "gx", "gy", "b.p", "b.id", "b.x", "b.y"
        )
        blocked = meet(undecided, reps).filter(F.col("p") < F.col("rp")).select(F.col("rid").alias("id")).distinct()
        winners = work.save(reps.join(blocked, "id", "left_anti"))
        kept = winners if kept is None else kept.unionByName(winners)
        gone = meet(undecided, winners).select("id").distinct()
        undecided, open_rows = work.save_counting(
            undecided.join(gone, "id", "left_anti").withColumn("open", F.lit(True)), "open"
        )
        undecided = undecided.drop("open")
        if open_rows == 0:
            break
    keeper = meet(sites, kept).groupBy("k", "x", "y").agg(F.min(F.struct("rp", "rid")).alias("b"))
    return base.join(keeper.select("k", "x", "y", F.col("b.rid").alias("keeper")), ["k", "x", "y"]).select("id", "keeper")


def dedupe_stand_ins(records: DataFrame, ranks: dict[str, int], radius: float = 50.0) -> DataFrame:
    """The records without stand-ins near another of the same name or, both unnamed, of the same kind.

    records: id, kind, name_key (null or empty: unnamed), is_area, x, y; ranks: the stand-in kinds,
    the lowest first. Of two, the lower rank stays, then an area over a node, then the lower id.
    Kinds without a rank are real and always stay.
    """
    rank = F.element_at(F.create_map(*[F.lit(v) for kv in ranks.items() for v in kv]), F.col("kind"))
    stand_ins = records.filter(F.col("kind").isin(*ranks)).select(
        "id", F.when(F.length("name_key") > 0, F.concat(F.lit("name:"), "name_key")).otherwise(F.concat(F.lit("kind:"), "kind")).alias("key"),
        F.struct(rank.alias("rank"), (~F.col("is_area")).alias("node"), F.col("id").alias("own")).alias("priority"), "x", "y")
    dropped = greedy_dedupe(stand_ins, "key", "priority", radius).filter("keeper <> id").select("id")
    return records.join(dropped, "id", "left_anti")


# --- Cell-set algebra ----------------------------------------------------------------------------


def zone_areas(land: DataFrame, zone: DataFrame, protected: DataFrame, cell_m2: float) -> DataFrame:
    """Land, water and inhabited area per zone on a fine cell table. land / protected: tx, ty;
    zone: zone_id, tx, ty."""
    marked = (
        zone.join(land.select("tx", "ty", F.lit(True).alias("land")).distinct(), ["tx", "ty"], "left")
        .join(protected.select("tx", "ty", F.lit(True).alias("prot")).distinct(), ["tx", "ty"], "left")
    )
    on_land = F.coalesce("land", F.lit(False))
    return marked.groupBy("zone_id").agg(
        (F.count_if(on_land) * cell_m2).alias("land_m2"),
        (F.count_if(~on_land) * cell_m2).alias("water_m2"),
        (F.count_if(on_land & F.col("prot").isNull()) * cell_m2).alias("inhabited_m2"),
    )


def unscored_pieces(land: DataFrame, zone: DataFrame, cell_m2: float, min_m2: float) -> DataFrame:
    """Land no zone covers, as connected pieces (by cell sides) of at least min_m2, largest first."""
    from stormledger.operators.network import components

    left = land.join(zone.select("tx", "ty").distinct(), ["tx", "ty"], "left_anti").select("tx", "ty").distinct()
    cells = left.withColumn("id", pack(F.col("tx"), F.col("ty")))
    sides = cells.select(
        F.col("id").alias("v"),
        F.explode(F.array(pack(F.col("tx") - 1, F.col("ty")), pack(F.col("tx"), F.col("ty") - 1))).alias("u"),
    ).join(cells.select(F.col("id").alias("u")), "u", "left_semi")
    comp = components(sides).select(F.col("node").alias("id"), "comp")
    return (
        cells.join(comp, "id", "left").groupBy(F.coalesce("comp", "id").alias("piece"))
        .agg((F.count(F.lit(1)) * cell_m2).alias("area_m2"))
        .filter(F.col("area_m2") >= min_m2)
        .orderBy(F.desc("area_m2"), "piece")
    )


def pack(tx: Column, ty: Column) -> Column:
    """A cell index as one long (each part within +-2^30)."""
    return (tx + F.lit(1 << 30)) * F.lit(1 << 31) + (ty + F.lit(1 << 30))


def closing(cells: DataFrame, keys: list[str] | None = None, reach: int = 1) -> DataFrame:
    """Dilate then erode a cell set (fills gaps up to twice the reach)."""
    from stormledger.functions.grid import scatter

    keys = keys or []
    full = (2 * reach + 1) ** 2
    grown = scatter(cells.withColumn("on", F.lit(1)), keys, "ty", "tx", ["on"], reach).select(*keys, "tx", "ty").distinct()
    sent = scatter(grown.withColumn("on", F.lit(1)), keys, "ty", "tx", ["on"], reach)
    return sent.groupBy(*keys, "tx", "ty").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == full).drop("n")
