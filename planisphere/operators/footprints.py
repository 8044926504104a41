"""Image outlines: edge pixels, WKT polygons, GeoJSON, bounds and pixel validity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.binding import let


def edge_pixels(images: DataFrame, n: int = 50) -> DataFrame:
    """image, nth, line, sample: the outline clockwise from the upper left, n points a side, corners once."""
    side = F.explode(F.sequence(F.lit(0), F.lit(4 * (n - 1) - 1)))
    e = images.withColumn("nth", side).withColumns({"edge": F.floor(F.col("nth") / (n - 1)), "t": (F.col("nth") % (n - 1)) / F.lit(float(n - 1))})
    w, h, t = F.col("samples") - 1, F.col("lines") - 1, F.col("t")
    sample = F.when(F.col("edge") == 0, t * w).when(F.col("edge") == 1, w.cast("double")).when(F.col("edge") == 2, (1 - t) * w).otherwise(0.0)
    line = F.when(F.col("edge") == 0, 0.0).when(F.col("edge") == 1, t * h).when(F.col("edge") == 2, h.cast("double")).otherwise((1 - t) * h)
    return e.select("image", "nth", line.alias("line"), sample.alias("sample"))


def _ring(points: DataFrame) -> DataFrame:
    grouped = points.where("lat is not null and lon is not null").groupBy("image").agg(F.array_sort(F.collect_list(F.struct("nth", "lon", "lat"))).alias("p"))
    return grouped.select("image", F.concat("p", F.slice("p", 1, 1)).alias("p"))


def wkt(points: DataFrame) -> DataFrame:
    """image, wkt: a closed polygon of lon lat in six decimals. Images without a point have no row."""
    pair = lambda p: F.format_string("%.6f %.6f", p["lon"], p["lat"])
    return _ring(points).select("image", F.concat(F.lit("POLYGON(("), F.array_join(F.transform("p", pair), ", "), F.lit("))")).alias("wkt"))


def geojson(points: DataFrame) -> DataFrame:
    ring = F.array(F.transform("p", lambda p: F.array(p["lon"], p["lat"])))
    shape = F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Polygon").alias("type"), ring.alias("coordinates")).alias("geometry"), F.struct("image").alias("properties"))
    return _ring(points).select("image", F.to_json(shape).alias("geojson"))


def bounds(points: DataFrame) -> DataFrame:
    """The extent of the points that could be projected."""
    return points.where("x is not null and y is not null").groupBy("image").agg(*(f(c).alias(f"{n}_{c}") for c in "xy" for n, f in (("min", F.min), ("max", F.max))))


def _millimetres(v: Column) -> Column:
    """v with three decimals, as C prints it: to the nearest, by the double's exact value, ties to even.

    Java's formatter rounds the shortest decimal text of a double instead. 2000 v is p + e exactly (a product's error by splitting v).
    """

    def text(v: Column) -> Column:
        p, big = v * 2000.0, v * 134217729.0
        high = big - (big - v)
        e = (high * 2000.0 - p) + (v - high) * 2000.0
        q = F.floor(p / 2.0)
        over = p - 2.0 * q.cast("double") - 1.0
        n = q + F.when((over > -e) | ((over == -e) & (q % 2 != 0)), 1).otherwise(0)
        sign = F.when((v < 0) | (F.signum(v).cast("string") == "-0.0"), "-").otherwise("")
        return F.concat(sign, F.floor(F.abs(n) / F.lit(1000)).cast("string"), F.lit("."), F.lpad((F.abs(n) % 1000).cast("string"), 3, "0"))

    return F.when(F.abs(v) < 1e12, let(v, text)).otherwise(F.format_string("%.3f", v))


def ecef_wkt(x: Column, y: Column, z: Column) -> Column:
    return F.concat(F.lit("POINT Z("), F.concat_ws(" ", *(_millimetres(c) for c in (x, y, z))), F.lit(")"))
