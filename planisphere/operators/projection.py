"""Before a map projection: which pixels see the surface, the extent, the pixel size and the affine fit."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.vec import Vec
from . import footprints, inversion
from .staging import stage

SMALLEST, DEPTH = 4, 10


def quadtree(images: DataFrame, sees: DataFrame, depth: int = DEPTH) -> DataFrame:
    """image, line0, line1, sample0, sample1, state of the leaves of a validity quadtree.

    images: image, lines, samples. sees: image, line, sample of the pixels that see the
    surface. A node is `valid` if its corners see it, `invalid` if neither corners nor
    centre do, `mixed` if it is too small to split; others split in four, level by
    level, each level a join of its test pixels.
    """
    node = images.select("image", F.lit(0).alias("line0"), F.col("lines").alias("line1"), F.lit(0).alias("sample0"), F.col("samples").alias("sample1"))
    leaves = None
    half = lambda a, b: F.floor((F.col(a) + F.col(b)) / 2).cast("int")
    # staged once for all levels; always merged, as pixels are many however small Catalyst takes them to be
    hit = stage(sees.select("image", F.col("line").alias("l"), F.col("sample").alias("s")).distinct(), "hit").withColumn("hit", F.lit(1)).hint("merge")
    for level in range(depth + 1):
        node = node.withColumns({"lm": half("line0", "line1"), "sm": half("sample0", "sample1")})
        probes = F.array(*(F.struct(F.col(a).alias("l"), F.col(b).alias("s"), F.lit(c).alias("corner")) for a, b, c in (("line0", "sample0", 1), ("line0", "sample1", 1), ("line1", "sample0", 1), ("line1", "sample1", 1), ("lm", "sm", 0))))
        key = ["image", "line0", "line1", "sample0", "sample1", "lm", "sm"]
        asked = node.select(*key, F.explode(probes).alias("p")).select(*key, "p.*").join(hit, ["image", "l", "s"], "left")
        told = asked.groupBy(*key).agg(F.sum(F.when((F.col("corner") == 1) & F.col("hit").isNotNull(), 1).otherwise(0)).alias("corners"), F.max(F.when(F.col("corner") == 0, F.col("hit"))).alias("centre"))
        small = (F.col("line1") - F.col("line0") <= SMALLEST) | (F.col("sample1") - F.col("sample0") <= SMALLEST) | F.lit(level == depth)
        state = F.when(F.col("corners") == 4, "valid").when((F.col("corners") == 0) & F.col("centre").isNull(), "invalid").when(small, "mixed")
        told = stage(told.withColumn("state", state), "quads")
        done = told.where("state is not null").select("image", "line0", "line1", "sample0", "sample1", "state")
        leaves = done if leaves is None else leaves.unionByName(done)
        parts = F.array(*(F.struct(F.col(a).alias("line0"), F.col(b).alias("line1"), F.col(c).alias("sample0"), F.col(d).alias("sample1")) for a, b in (("line0", "lm"), ("lm", "line1")) for c, d in (("sample0", "sm"), ("sm", "sample1"))))
        node = told.where("state is null").select("image", F.explode(parts).alias("q")).select("image", "q.*")
        if node.isEmpty():
            break
    return leaves


def pixel_size(bounds: DataFrame, samples: Column, lines: Column) -> DataFrame:
    """bounds (min_x, max_x, min_y, max_y) with the mean size of a pixel."""
    return bounds.withColumn("pixel", ((F.col("max_x") - F.col("min_x")) / samples + (F.col("max_y") - F.col("min_y")) / lines) / 2)


def affine_fit(points: DataFrame, least: int = 10) -> DataFrame:
    """image, n and the least-squares affine map from (sample, line) to (x, y): x = x0 + xs * sample + xl * line.

    Images with fewer than `least` points, or points on a line, have no row. All sums
    are built-in aggregates.
    """
    s, line = "sample", "line"
    out = points.where("x is not null and y is not null").groupBy("image").agg(
        F.count("*").alias("n"), *(F.avg(c).alias(f"m_{c}") for c in (s, line, "x", "y")), F.var_pop(s).alias("ss"), F.var_pop(line).alias("ll"), F.covar_pop(s, line).alias("sl"),
        *(F.covar_pop(a, b).alias(f"{a[0]}{b}") for a in (s, line) for b in "xy"),
    )
    out = out.withColumn("det", F.col("ss") * F.col("ll") - F.col("sl") * F.col("sl")).where((F.col("n") >= least) & (F.col("det") > 1e-12))
    for c in "xy":
        out = out.withColumns({f"{c}s": (F.col(f"s{c}") * F.col("ll") - F.col(f"l{c}") * F.col("sl")) / F.col("det"), f"{c}l": (F.col(f"l{c}") * F.col("ss") - F.col(f"s{c}") * F.col("sl")) / F.col("det")})
        out = out.withColumn(f"{c}0", F.col(f"m_{c}") - F.col(f"{c}s") * F.col("m_sample") - F.col(f"{c}l") * F.col("m_line"))
    return out.select("image", "n", "x0", "xs", "xl", "y0", "ys", "yl")


def metres_to_degrees(x: Column, y: Column, radius: float) -> tuple[Column, Column]:
    """lon, lat of equirectangular metres on a body of the given radius."""
    return x / radius * (180 / math.pi), y / radius * (180 / math.pi)


def sample_differences(grid: DataFrame) -> DataFrame:
    """A made-up reprojection difference over a grid (lat, lon in radians), in pixels: for trying out displays."""
    seed = F.sin(F.degrees("lat") * 0.1) * F.cos(F.degrees("lon") * 0.1)
    g = grid.withColumns({"diff_x": seed * 2 - 1, "diff_y": seed * 1.5 - 0.75})
    return g.withColumn("size", F.sqrt(F.col("diff_x") ** 2 + F.col("diff_y") ** 2))


def boundary(images: DataFrame, grid: DataFrame, a: float, c: float, n: int = 50) -> DataFrame:
    """image, nth, x, y, z, lat, lon (degrees) of an image's outline, clockwise from the upper left; pixels that see no ground are skipped.

    images: image, samples, lines. grid: the nodes of `inversion`, of a body with the radii a and c.
    """
    seen = inversion.image_to_ground(footprints.edge_pixels(images, n), grid)
    lat, lon = geo.ecef_to_geodetic(Vec(*(F.col(k) for k in "xyz")), a, c)
    return seen.select("image", "nth", "x", "y", "z", F.degrees(lat).alias("lat"), F.degrees(lon).alias("lon"))


#: Cells on a side of a tile.
TILE = 8


def resample(targets: DataFrame, grid: DataFrame, cells: DataFrame, nodata: float, scale: float = 1.0) -> DataFrame:
    """targets (image, x, y, z of output pixels and what else they have) with `value`, bilinear between the image's cells around them.

    cells: image, px, py, value; a cell's centre is at sample px * scale and line py * scale. Cells without data, or not there, have
    no weight, and the others' weights are brought to 1; a target without any, or that its image does not see, is nodata. Cells are
    put into tiles, those on an edge into each tile that may ask for them, so a target is sent once, to the tile of its first cell.
    """
    kept = [c for c in targets.columns if c != "value"]
    hidden = {c: f"{c}_kept_" for c in ("sample", "line") if c in kept}  # of these names the targets' own go through
    found = inversion.ground_to_image(targets.select(*(F.col(c).alias(hidden.get(c, c)) for c in kept)), grid, unseen=True)
    found = found.withColumns({"s_": F.col("sample") / scale, "l_": F.col("line") / scale}).drop("sample", "line")
    # a pixel within rounding of a centre is at that centre
    found = found.withColumns({c: F.when(F.abs(F.col(c) - F.round(c)) < 1e-7, F.round(c)).otherwise(F.col(c)) for c in ("s_", "l_")})
    found = found.withColumns({"tx_": F.floor(F.floor("s_") / TILE), "ty_": F.floor(F.floor("l_") / TILE)})
    held = cells.where(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs(F.col("value") - nodata) >= 1e-6)).select("image", F.col("px").cast("long").alias("px"), F.col("py").cast("long").alias("py"), F.col("value").alias("v"))
    for t, p in (("tx_", "px"), ("ty_", "py")):
        held = held.withColumn(t, F.explode(F.array_distinct(F.array(F.floor(F.col(p) / TILE), F.floor((F.col(p) - 1) / TILE)))))
    tile = ["image", "tx_", "ty_"]
    nth = lambda x, y: ((x - F.col("tx_") * TILE) * (TILE + 1) + y - F.col("ty_") * TILE).cast("int")
    # dealt once, by tiles: a cell may be there several times, and each counts
    each = held.repartition(*tile).groupBy(*tile, nth(F.col("px"), F.col("py")).alias("k")).agg(F.sum("v").alias("v"), F.count("*").alias("n"))
    tiles = each.groupBy(*tile).agg(F.map_from_entries(F.collect_list(F.struct("k", F.struct("v", "n")))).alias("tile_"))
    # always merged: cells are many, however small Catalyst takes them to be
    near = found.join(tiles.hint("merge"), tile, "left").withColumns({"s0_": F.floor("s_"), "l0_": F.floor("l_")}).withColumns({"u_": F.col("s_") - F.col("s0_"), "v_": F.col("l_") - F.col("l0_")})
    near = near.withColumns({f"c{i}{j}_": F.col("tile_")[nth(F.col("s0_") + i, F.col("l0_") + j)] for i in (0, 1) for j in (0, 1)})
    w = {(i, j): (F.col("u_") if i else 1 - F.col("u_")) * (F.col("v_") if j else 1 - F.col("v_")) for i in (0, 1) for j in (0, 1)}
    total = lambda c: sum((F.coalesce(w[k] * F.col(f"c{k[0]}{k[1]}_.{c}"), F.lit(0.0)) for k in w), F.lit(0.0))
    made = total("v") / F.nullif(total("n"), F.lit(0.0))
    return near.select(*(F.col(hidden.get(c, c)).alias(c) for c in kept), F.coalesce(made, F.lit(float(nodata))).alias("value"))
