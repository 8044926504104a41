"""Rasters as cells (px, py, value): elevation lookup and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.vec import Vec, magnitude


def lookup(points: DataFrame, cells: DataFrame, gt: tuple[float, ...], nodata: float) -> DataFrame:
    """points (lat, lon in degrees) with the value of their cell; nodata outside and where a cell has (nearly) that value."""
    px, py = geo.to_pixel(F.col("lat"), F.col("lon"), gt)
    out = points.withColumns({"px": px, "py": py}).join(cells, ["px", "py"], "left")
    return out.withColumn("value", F.when(F.col("value").isNull() | (F.abs(F.col("value") - nodata) < 1e-6), F.lit(nodata)).otherwise(F.col("value")))


def heights(found: DataFrame, nodata: float, a: float, c: float, kind: str = "height") -> DataFrame:
    """height and radius from looked-up values that are heights or radii; without a value, 0 and the ellipsoid's radius."""
    r = geo.radius_at(F.radians("lat"), F.radians("lon"), a, a, c)
    none, v = F.col("value") == nodata, F.col("value")
    high = v if kind == "height" else v - r
    far = v + r if kind == "height" else v
    return found.withColumns({"height": F.when(none, 0.0).otherwise(high), "radius": F.when(none, r).otherwise(far)})


def intersect(rays: DataFrame, cells: DataFrame, gt: tuple[float, ...], nodata: float, a: float, c: float, rounds: int = 20, tolerance: float = 1e-4) -> DataFrame:
    """Rays (pos, look) to the raster's surface: the ellipsoid point, moved along its own radius to
    the raster's radius until it rests. The point does not stay on the ray.

    A move along the radius does not change latitude or longitude, so one lookup settles it.
    """
    seed = geo.ray_ellipsoid(Vec.of("pos"), Vec.of("look"), a, a, c).put(rays, "hit")
    p = Vec.of("hit")
    at = seed.withColumns({"lat": F.degrees(F.atan2(p.z, F.sqrt(p.x * p.x + p.y * p.y))), "lon": F.degrees(F.atan2(p.y, p.x))})
    found = heights(lookup(at, cells, gt, nodata), nodata, a, c)
    return geo.on_radius(p, F.col("radius")).put(found, "hit").withColumn("local_radius", magnitude(Vec.of("hit")))


def value_range(cells: DataFrame, nodata: float) -> DataFrame:
    return cells.where(F.col("value") != nodata).agg(F.min("value").alias("low"), F.max("value").alias("high"), F.count("*").alias("n"))


def centroid(cells: DataFrame, nodata: float, stride: int = 10) -> DataFrame:
    """Mean column and row of the valid cells on a stride."""
    some = cells.where((F.col("px") % stride == 0) & (F.col("py") % stride == 0) & (F.col("value") != nodata))
    return some.agg(F.avg("px").alias("cx"), F.avg("py").alias("cy"))


def farthest_by_quadrant(cells: DataFrame, nodata: float, cx: float, cy: float, stride: int = 5) -> DataFrame:
    """quadrant, px, py: the valid cell farthest from a centre; the first in scan order of equals."""
    some = cells.where((F.col("px") % stride == 0) & (F.col("py") % stride == 0) & (F.col("value") != nodata))
    d = (F.col("px") - cx) ** 2 + (F.col("py") - cy) ** 2
    quadrant = F.concat(F.when(F.col("py") < cy, "n").otherwise("s"), F.when(F.col("px") < cx, "w").otherwise("e"))
    best = some.groupBy(quadrant.alias("quadrant")).agg(F.max(F.struct(d.alias("d"), (-F.col("py")).alias("y"), (-F.col("px")).alias("x"))).alias("m"))
    return best.select("quadrant", (-F.col("m.x")).alias("px"), (-F.col("m.y")).alias("py"))
