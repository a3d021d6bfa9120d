"""Pixels as rows: masks, focal filters, change detection, morphology, zonal means, resampling.

Pixels are (scene, row, col, value). Small neighbourhoods are scattered rows (functions.grid);
wide focal windows run on tiles of bounded size that carry a halo, so a scene of any size is cut
into equal pieces by Spark and no piece depends on the scene's extent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stormledger.functions.grid import at, scatter
from stormledger.operators.spatial import pack
from stormledger.session import WorkTables, materialise

# Radar thresholds.
MIN_DB, CHANGE_DB, WATER_DB, PERMANENT_PCT, LOOKS, FLOODED_SHARE = -30.0, -2.5, -15.5, 20.0, 4.4, 0.1
MAX_SLOPE, MIN_CLUSTER = 5.0, 5  # degrees, pixels


def mask_noise(pixels: DataFrame, value: str = "db", floor: float = MIN_DB) -> DataFrame:
    """Values under the floor become null (a value at the floor is kept)."""
    return pixels.withColumn(value, F.when(F.col(value) >= floor, F.col(value)))


def power(db: Column) -> Column:
    return F.pow(F.lit(10.0), db / F.lit(10.0))


def decibel(p: Column) -> Column:
    return F.lit(10.0) * F.log10(F.greatest(F.lit(1e-5), p))


def focal(
    pixels: DataFrame, keys: list[str], method: str = "median", kernel: int = 7, tile: int = 256, looks: float = LOOKS,
) -> DataFrame:
    """(keys, row, col, db): boxcar, median or local-statistics filter in linear power.

    Edges are padded by reflection. Every pixel is sent to the tiles whose halo it belongs to (one
    for most); a tile is at most (tile + kernel - 1) squared pixels, whatever the scene.
    """
    if method not in ("boxcar", "median", "lee"):
        raise ValueError(f"no filter is called {method!r}")
    pad = kernel // 2
    span = pixels.groupBy(*keys).agg(F.max("row").alias("last_row"), F.max("col").alias("last_col"))

    def tiles(x: str) -> Column:
        return F.sequence(
            F.greatest(F.lit(0), F.floor((F.col(x) - pad) / tile).cast("int")), F.floor((F.col(x) + pad) / tile).cast("int")
        )

    sent = (
        pixels.select(*keys, "row", "col", "db").join(span, keys)
        .withColumn("tile_r", F.explode(tiles("row"))).withColumn("tile_c", F.explode(tiles("col")))
        .filter((F.col("tile_r") * tile <= F.col("last_row")) & (F.col("tile_c") * tile <= F.col("last_col")))
    )
    names = list(keys)
    schema = pixels.select(*keys).schema.add("row", "long").add("col", "long").add("db", "double")

    def run(pdf):
        import numpy as np
        import pandas as pd

        r0, c0 = int(pdf["tile_r"].iloc[0]) * tile, int(pdf["tile_c"].iloc[0]) * tile
        last_r, last_c = int(pdf["last_row"].iloc[0]), int(pdf["last_col"].iloc[0])
        lo_r, lo_c = max(0, r0 - pad), max(0, c0 - pad)
        hi_r, hi_c = min(last_r, r0 + tile - 1 + pad), min(last_c, c0 + tile - 1 + pad)
        grid = np.full((hi_r - lo_r + 1, hi_c - lo_c + 1), np.nan)
        grid[pdf["row"].to_numpy() - lo_r, pdf["col"].to_numpy() - lo_c] = 10.0 ** (pdf["db"].to_numpy() / 10.0)
        # Only true scene edges are reflected; inner tile edges already carry their halo.
        end_r, end_c = min(last_r, r0 + tile - 1), min(last_c, c0 + tile - 1)
        grid = np.pad(
            grid,
            ((pad - (r0 - lo_r), pad - (hi_r - end_r)), (pad - (c0 - lo_c), pad - (hi_c - end_c))),
            mode="reflect",
        )
        win = np.lib.stride_tricks.sliding_window_view(grid, (kernel, kernel))
        own = grid[pad : pad + win.shape[0], pad : pad + win.shape[1]]
        if method == "boxcar":
            out = np.nanmean(win, axis=(2, 3))
        elif method == "median":
            out = np.nanmedian(win, axis=(2, 3))
        else:
            mean, var = np.nanmean(win, axis=(2, 3)), np.nanvar(win, axis=(2, 3))
            noise = 1.0 / max(1.0, looks)
            weight = np.clip(np.maximum(0.0, var - mean**2 * noise) / np.maximum(1e-6, var * (1.0 + noise)), 0.0, 1.0)
            out = mean + weight * (own - mean)
        rows, cols = np.mgrid[r0 : r0 + out.shape[0], c0 : c0 + out.shape[1]]
        data = {k: pdf[k].iloc[0] for k in names}
        keep = ~np.isnan(own).ravel()
        frame = pd.DataFrame({"row": rows.ravel()[keep], "col": cols.ravel()[keep], "db": (10.0 * np.log10(np.maximum(1e-5, out))).ravel()[keep]})
        for k in names:
            frame[k] = data[k]
        return frame[[*names, "row", "col", "db"]]

    return sent.groupBy(*keys, "tile_r", "tile_c").applyInPandas(run, schema)


def change_mask(before: DataFrame, after: DataFrame, water: DataFrame | None, keys: list[str]) -> DataFrame:
    """(keys, row, col, flooded): a clear drop to a dark value, permanent water left out."""
    on = [*keys, "row", "col"]
    b = before.select(*on, F.col("db").alias("was"))
    a = after.select(*on, F.col("db").alias("now"))
    both = a.join(b, on)
    flooded = (F.col("now") - F.col("was") <= CHANGE_DB) & (F.col("now") <= WATER_DB)
    if water is not None:
        both = both.join(water.select(*on, "occurrence"), on, "left")
        flooded = flooded & ~F.coalesce(F.col("occurrence") >= PERMANENT_PCT, F.lit(False))
    return both.select(*on, F.coalesce(flooded, F.lit(False)).alias("flooded"))


def permanent_water(pixels: DataFrame, value: str = "occurrence") -> DataFrame:
    return pixels.withColumn("permanent", F.coalesce(F.col(value) >= PERMANENT_PCT, F.lit(False)))


def opening(mask: DataFrame, keys: list[str]) -> DataFrame:
    """3 x 3 erosion then dilation of the flooded pixels; the scene's border never survives."""
    span = mask.groupBy(*keys).agg(
        F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("col").alias("c0"), F.max("col").alias("c1")
    )
    wet = mask.filter("flooded").select(*keys, "row", "col").withColumn("on", F.lit(1))
    inner = (F.col("row") > F.col("r0")) & (F.col("row") < F.col("r1")) & (F.col("col") > F.col("c0")) & (F.col("col") < F.col("c1"))
    eroded = (
        scatter(wet, keys, "row", "col", ["on"]).groupBy(*keys, "row", "col").agg(F.count(F.lit(1)).alias("n"))
        .filter("n = 9").drop("n").withColumn("on", F.lit(1))
    )
    grown = scatter(eroded, keys, "row", "col", ["on"]).select(*keys, "row", "col").distinct()
    return grown.join(span, keys).filter(inner).select(*keys, "row", "col")


def drop_small(mask: DataFrame, scene: str, min_pixels: int) -> DataFrame:
    """Flooded pixels in 8-connected clusters of at least min_pixels."""
    from stormledger.operators.network import components

    work = WorkTables(mask.sparkSession, "flooded")  # the mask is read several times, and made once
    wet = work.save(mask.select(scene, "row", "col").withColumn("id", pack(F.col("col").cast("long"), F.col("row").cast("long"))))
    before = [(-1, -1), (-1, 0), (-1, 1), (0, -1)]
    near = F.array(*[pack(F.col("col").cast("long") + dc, F.col("row").cast("long") + dr) for dr, dc in before])
    sides = wet.select(scene, F.col("id").alias("v"), F.explode(near).alias("u")).join(
        wet.select(scene, F.col("id").alias("u")), [scene, "u"], "left_semi"
    )
    comp = components(work.save(sides), [scene]).select(scene, F.col("node").alias("id"), "comp")
    labelled = wet.join(comp, [scene, "id"], "left").withColumn("comp", F.coalesce("comp", "id"))
    big = labelled.groupBy(scene, "comp").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_pixels)
    return labelled.join(big.select(scene, "comp"), [scene, "comp"], "left_semi").select(scene, "row", "col")


def zonal(pixels: DataFrame, keys: list[str], size: int, value: str) -> DataFrame:
    """Mean per grid cell of size x size pixels, and whether at least a tenth is set."""
    cell = [F.floor(F.col(c) / size).cast("long").alias(n) for c, n in (("row", "cell_r"), ("col", "cell_c"))]
    return pixels.groupBy(*keys, *cell).agg(F.avg(F.col(value).cast("double")).alias("mean")).withColumn(
        "observed", F.col("mean") >= FLOODED_SHARE
    )


def area_km2(mask: DataFrame, keys: list[str], pixel_m2: float) -> DataFrame:
    return mask.groupBy(*keys).agg((F.count_if("flooded") * pixel_m2 / 1e6).alias("km2"))


def vector_mean(pixels: DataFrame, keys: list[str], u: str, v: str) -> DataFrame:
    return pixels.groupBy(*keys).agg(F.avg(F.hypot(F.col(u), F.col(v))).alias("mean_speed"))


def scenes(
    catalogue: DataFrame, box: tuple[float, float, float, float], start, end, mode: str | None = None,
    polarisation: str | None = None, orbit_pass: str | None = None, orbit: int | None = None,
) -> DataFrame:
    """Catalogue rows meeting a box and an inclusive date range; the rest only if given."""
    x0, y0, x1, y1 = box
    out = catalogue.filter(
        (F.col("max_x") >= x0) & (F.col("min_x") <= x1) & (F.col("max_y") >= y0) & (F.col("min_y") <= y1)
        & (F.col("ts") >= start) & (F.col("ts") < end + F.expr("interval 1 day"))
    )
    if mode is not None:
        out = out.filter(F.col("mode") == mode)
    if polarisation is not None:
        out = out.filter(F.array_contains("polarisations", polarisation))
    if orbit_pass is not None:
        out = out.filter(F.col("orbit_pass") == orbit_pass)
    return out if orbit is None else out.filter(F.col("orbit") == orbit)


def bilinear(cells: DataFrame, keys: list[str], value: str, factor: int = 8) -> DataFrame:
    """factor x factor samples per cell, interpolated between cell centres, clamped at the edges.

    Every cell gathers its 3 x 3 neighbourhood in one shuffle; the samples then unfold in place. A
    missing cell inside the grid counts as 0, beyond the grid as the edge.
    """
    span = cells.groupBy(*keys).agg(
        F.min("r").alias("r0"), F.max("r").alias("r1"), F.min("c").alias("c0"), F.max("c").alias("c1")
    )
    near = {f"n{dr + 1}{dc + 1}": at(dr, dc, value) for dr in (-1, 0, 1) for dc in (-1, 0, 1)}
    block = (
        scatter(cells, keys, "r", "c", [value]).groupBy(*keys, "r", "c")
        .agg(*[F.coalesce(e, F.lit(0.0)).alias(n) for n, e in near.items()])
        .join(span, keys)
        .filter(F.col("r").between(F.col("r0"), F.col("r1")) & F.col("c").between(F.col("c0"), F.col("c1")))
    )
    steps = F.sequence(F.lit(0), F.lit(factor - 1))
    s = block.withColumn("i", F.explode(steps)).withColumn("j", F.explode(steps))

    def axis(cell: str, sub: str, low: str, high: str):
        pos = F.col(cell) + (F.col(sub) + F.lit(0.5)) / F.lit(float(factor)) - F.lit(0.5)
        pos = F.least(F.greatest(pos, F.col(low).cast("double")), F.col(high).cast("double"))
        base = F.floor(pos)
        # Offsets of the two samples inside the 3 x 3 block; the last cell pairs with itself.
        one = (base - F.col(cell) + 1).cast("int")
        two = (F.least(base + 1, F.col(high)) - F.col(cell) + 1).cast("int")
        return one, two, pos - base

    r1, r2, fr = axis("r", "i", "r0", "r1")
    c1, c2, fc = axis("c", "j", "c0", "c1")
    flat = F.array(*[F.col(f"n{a}{b}") for a in range(3) for b in range(3)])
    v = lambda r, c: F.element_at(flat, r * 3 + c + 1)
    low = v(r1, c1) * (F.lit(1.0) - fc) + v(r1, c2) * fc
    high = v(r2, c1) * (F.lit(1.0) - fc) + v(r2, c2) * fc
    return s.select(
        *keys, (F.col("r") * factor + F.col("i")).alias("row"), (F.col("c") * factor + F.col("j")).alias("col"),
        (low * (F.lit(1.0) - fr) + high * fr).alias(value),
    )


# Which sides of a 2 x 2 quad a level line joins, by the corners above it (sw, se, ne, nw as bits
# 1, 2, 4, 8). Sides: s, e, n, w. The two saddles are cut into two segments.
QUAD_SIDES = {
    1: [("w", "s")], 2: [("s", "e")], 3: [("w", "e")], 4: [("e", "n")], 5: [("w", "n"), ("s", "e")],
    6: [("s", "n")], 7: [("w", "n")], 8: [("n", "w")], 9: [("n", "s")], 10: [("w", "s"), ("e", "n")],
    11: [("n", "e")], 12: [("e", "w")], 13: [("e", "s")], 14: [("s", "w")],
}


def isolines(grid: DataFrame, keys: list[str], value: str, levels: list[float]) -> DataFrame:
    """One row per level-line segment in each quad of four neighbouring samples: level, x0, y0, x1, y1.

    Quads exist only between samples, so no segment runs along the grid's border.
    """
    corners = {"sw": at(0, 0, value), "se": at(0, 1, value), "ne": at(1, 1, value), "nw": at(1, 0, value)}
    quads = (
        scatter(grid, keys, "r", "c", [value]).filter("dr >= 0 AND dc >= 0").groupBy(*keys, "r", "c")
        .agg(*[e.alias(n) for n, e in corners.items()])
        .dropna(subset=list(corners))
        .withColumn("level", F.explode(F.array(*[F.lit(float(x)) for x in levels])))
    )
    above = lambda c, bit: F.when(F.col(c) >= F.col("level"), bit).otherwise(0)
    quads = quads.withColumn("case", above("sw", 1) + above("se", 2) + above("ne", 4) + above("nw", 8))

    def cross(a: str, b: str) -> Column:
        gap = F.col(b) - F.col(a)
        return F.when(gap != 0, (F.col("level") - F.col(a)) / gap).otherwise(F.lit(0.0))

    x, y = F.col("c").cast("double"), F.col("r").cast("double")
    point = {
        "s": F.struct((x + cross("sw", "se")).alias("x"), y.alias("y")),
        "e": F.struct((x + 1.0).alias("x"), (y + cross("se", "ne")).alias("y")),
        "n": F.struct((x + cross("nw", "ne")).alias("x"), (y + 1.0).alias("y")),
        "w": F.struct(x.alias("x"), (y + cross("sw", "nw")).alias("y")),
    }
    picked = None
    for case, sides in QUAD_SIDES.items():
        segs = F.array(*[F.struct(point[a].alias("a"), point[b].alias("b")) for a, b in sides])
        picked = F.when(F.col("case") == case, segs) if picked is None else picked.when(F.col("case") == case, segs)
    return quads.select(*keys, "r", "c", "level", F.explode(picked).alias("s")).select(
        *keys, "r", "c", "level", F.col("s.a.x").alias("x0"), F.col("s.a.y").alias("y0"),
        F.col("s.b.x").alias("x1"), F.col("s.b.y").alias("y1"),
    )


def burn(cells: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Cell labels on a pixel grid: cells carry p0..p1, q0..q1 (index windows) and `ord`; where
    windows meet, the last cell wins."""
    return (
        cells.withColumn("row", F.explode(F.sequence("p0", "p1"))).withColumn("col", F.explode(F.sequence("q0", "q1")))
        .groupBy(*keys, "row", "col").agg(F.max_by(label, "ord").alias(label))
    )


def flat_only(mask: DataFrame, slope: DataFrame, keys: list[str], max_slope: float = MAX_SLOPE) -> DataFrame:
    """The mask without steep pixels; they stay in the table, so the scene keeps its border. slope: keys, row, col, slope."""
    on = [*keys, "row", "col"]
    steep = slope.filter(F.col("slope") > max_slope).select(*on, F.lit(True).alias("steep"))
    flat = F.col("steep").isNull()
    return mask.join(steep, on, "left").select(*on, (F.col("flooded") & flat).alias("flooded"))


def flood_pipeline(
    before: DataFrame, after: DataFrame, water: DataFrame | None, keys: list[str], kernel: int = 7,
    method: str = "median", tile: int = 256, slope: DataFrame | None = None, max_slope: float = MAX_SLOPE, min_pixels: int = MIN_CLUSTER,
) -> DataFrame:
    """(keys, row, col) of flooded pixels: noise mask, speckle filter, change detection, slope mask, opening, and
    clusters of min_pixels at least; one chain over all scenes. keys: one column, the scene."""
    prepared = [focal(mask_noise(p).dropna(subset=["db"]), keys, method, kernel, tile) for p in (before, after)]
    mask = change_mask(prepared[0], prepared[1], water, keys)
    if slope is not None:
        mask = flat_only(mask, slope, keys, max_slope)
    (scene,) = keys
    return drop_small(opening(materialise(mask, "change-mask"), keys), scene, min_pixels)
