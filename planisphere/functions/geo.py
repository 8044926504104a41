"""Ellipsoids, geodetic coordinates, rays and rasters: built-in expressions only.

Latitudes are named for what they are: geodetic (normal to the ellipsoid) or centric.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vec import Vec, dot, magnitude, scale, unit

MARS = (3396190.0, 3376200.0)
WGS84 = (6378137.0, 6356752.314245)


def ellipsoid(a: float, c: float = 0.0) -> tuple[float, float]:
    """(a, c) of an ellipsoid of revolution; a smaller radius that is not positive means a sphere; a larger one is an error."""
    if not a > 0:
        raise ValueError("the radii of an ellipsoid must be positive")
    return float(a), float(c if c > 0 else a)


def strict_ellipsoid(a: float, c: float) -> tuple[float, float]:
    """(a, c), both of which must be positive."""
    if not (a > 0 and c > 0):
        raise ValueError("the radii of an ellipsoid must be positive")
    return float(a), float(c)


def surface_normal(p: Vec, a: float, b: float, c: float) -> Vec:
    return unit(Vec(p.x / (a * a), p.y / (b * b), p.z / (c * c)))


def ray_ellipsoid(pos: Vec, look: Vec, a: float, b: float, c: float) -> Vec:
    """The nearer intersection ahead, else the other; for a miss the ray's closest point in scaled space."""
    d, p = Vec(look.x / a, look.y / b, look.z / c), Vec(pos.x / a, pos.y / b, pos.z / c)
    square, half = dot(d, d), dot(p, d)
    qa = F.nullif(square, F.lit(0.0))  # no direction, no point
    disc = half * half - qa * (dot(p, p) - 1)
    root = F.sqrt(F.greatest(disc, F.lit(0.0)))
    near, far = (-half - root) / qa, (-half + root) / qa
    t = F.when(disc < 0, -half / qa).when(near >= 0, near).otherwise(far)
    return Vec(pos.x + t * look.x, pos.y + t * look.y, pos.z + t * look.z)


def radius_at(lat: Column, lon: Column, a: float, b: float, c: float) -> Column:
    """Radius of a triaxial ellipsoid at a centric latitude."""
    u = F.pow(b * c * F.cos(lat) * F.cos(lon), F.lit(2.0)) + F.pow(a * c * F.cos(lat) * F.sin(lon), F.lit(2.0)) + F.pow(a * b * F.sin(lat), F.lit(2.0))
    low = F.sqrt(u)
    return F.when(low < 1e-10, F.lit(a)).otherwise(F.lit(a * b * c) / F.nullif(low, F.lit(0.0)))


def viewer_radius(lat: Column, a: float, c: float) -> Column:
    """The simpler radius that maps use: sqrt(a² cos² + c² sin²)."""
    return F.sqrt(a * a * F.cos(lat) * F.cos(lat) + c * c * F.sin(lat) * F.sin(lat))


def geodetic_to_ecef(lat: Column, lon: Column, h: Column, a: float, c: float) -> Vec:
    e2 = 1 - (c * c) / (a * a)
    n = F.lit(a) / F.sqrt(1 - e2 * F.sin(lat) * F.sin(lat))
    return Vec((n + h) * F.cos(lat) * F.cos(lon), (n + h) * F.cos(lat) * F.sin(lon), (n * (1 - e2) + h) * F.sin(lat))


def ecef_to_geodetic(p: Vec, a: float, c: float, rounds: int = 5) -> tuple[Column, Column]:
    """Geodetic latitude and longitude, radians, by a fixed number of fixed-point rounds."""
    e2, flat = 1 - (c * c) / (a * a), F.sqrt(p.x * p.x + p.y * p.y)

    def step(lat: Column, _: Column) -> Column:
        n = F.lit(a) / F.sqrt(1 - e2 * F.sin(lat) * F.sin(lat))
        return F.atan2(p.z + e2 * n * F.sin(lat), flat)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.atan2(p.z, flat), step), F.atan2(p.y, p.x)


def geodetic(df, p: str, lat: str, lon: str, a: float, c: float, rounds: int = 5):
    """df with the geodetic latitude and longitude of a column vector; each round is a column, so that all of them are compiled."""
    v, e2 = Vec.of(p), 1 - (c * c) / (a * a)
    df = df.withColumns({"flat_": F.sqrt(v.x * v.x + v.y * v.y)}).withColumn("lat_0", F.atan2(v.z, F.col("flat_")))
    for k in range(rounds):
        s = F.sin(f"lat_{k}")
        df = df.withColumn(f"lat_{k + 1}", F.atan2(v.z + e2 * (F.lit(a) / F.sqrt(1 - e2 * s * s)) * s, F.col("flat_")))
    return df.withColumns({lat: F.col(f"lat_{rounds}"), lon: F.atan2(v.y, v.x)}).drop("flat_", *(f"lat_{k}" for k in range(rounds + 1)))


def bowring(p: Vec, a: float, c: float) -> tuple[Column, Column, Column]:
    """Latitude and longitude in degrees and height, in one step of Bowring's method; height fails at the poles."""
    e2, flat = 1 - (c * c) / (a * a), F.sqrt(p.x * p.x + p.y * p.y)
    th = F.atan2(p.z * a, flat * c)
    cube = lambda v: F.pow(v, F.lit(3.0))
    lat = F.atan2(p.z + e2 * c * cube(F.sin(th)), flat - e2 * a * cube(F.cos(th)))
    n = F.lit(a) / F.sqrt(1 - e2 * F.sin(lat) * F.sin(lat))
    return F.degrees(lat), F.degrees(F.atan2(p.y, p.x)), flat / F.cos(lat) - n


def quantize(lat: Column, lon: Column) -> tuple[Column, Column]:
    """(qlon, qlat) as smallints over the whole globe."""
    fit = lambda v: F.greatest(F.lit(-32768.0), F.least(F.lit(32767.0), F.round(v))).cast("smallint")
    return fit(lon * (65535 / (2 * math.pi))), fit(lat * (65535 / math.pi))


def dequantize(qlon: Column, qlat: Column) -> tuple[Column, Column]:
    return qlat * (math.pi / 65535), qlon * (2 * math.pi / 65535)


def chebyshev(a: Vec, b: Vec) -> Column:
    return F.greatest(F.abs(a.x - b.x), F.abs(a.y - b.y), F.abs(a.z - b.z))


def to_pixel(lat: Column, lon: Column, gt: tuple[float, ...]) -> tuple[Column, Column]:
    """Column and row of a position by the inverse of an affine transform; cut towards zero; (-1, -1) if it has none."""
    det = gt[1] * gt[5] - gt[2] * gt[4]
    if abs(det) < 1e-10:
        return F.lit(-1), F.lit(-1)
    dx, dy = lon - gt[0], lat - gt[3]
    return ((gt[5] * dx - gt[2] * dy) / det).cast("int"), ((gt[1] * dy - gt[4] * dx) / det).cast("int")


def on_radius(p: Vec, radius: Column) -> Vec:
    """A point moved along its own radius (not along a ray) to a given radius."""
    return scale(p, radius / F.nullif(magnitude(p), F.lit(0.0)))


def shape_model(kind: str, lat: Column, lon: Column, height: float, a: float, b: float, c: float) -> tuple[Column, Column]:
    """Height and radius (metres) at a position in degrees of a shape of constant height.

    A shape given by a raster is `raster.lookup` and `raster.heights`; no other kind is known.
    """
    if kind != "constant":
        raise ValueError(f"no shape model {kind}")
    strict_ellipsoid(a, c)
    return F.lit(float(height)), radius_at(F.radians(lat), F.radians(lon), a, b, c) + height


def ellipsoid_from_text(text: str) -> tuple[float, float, bool]:
    """(a, c, found) from WKT or PROJ text; WGS84 if nothing is found. An inverse flattening of 0 is a sphere."""
    number = r"([-+]?[0-9.]+(?:[eE][-+]?[0-9]+)?)"
    wkt = re.search(r'(?i)(?:SPHEROID|ELLIPSOID)\s*\[\s*"[^"]*"\s*,\s*' + number + r"\s*,\s*" + number, text or "")
    if wkt:
        a, inv = float(wkt[1]), float(wkt[2])
        return a, a if inv == 0 else a * (1 - 1 / inv), True
    given = dict(re.findall(r"\+(a|b|rf|f|R)=" + number, text or ""))
    if "R" in given:
        return float(given["R"]), float(given["R"]), True
    if "a" in given:
        a = float(given["a"])
        if "b" in given:
            return a, float(given["b"]), True
        f = 1 / float(given["rf"]) if float(given.get("rf", 0)) else float(given.get("f", 0))
        return a, a * (1 - f), True
    return *WGS84, "WGS84" in (text or "")


def ellipsoid_columns(text: Column) -> tuple[Column, Column, Column]:
    """a, c and found of a text column, WKT or PROJ, as `ellipsoid_from_text` reads them: WGS84 and false where nothing is named."""
    wkt = r'(?i)(?:SPHEROID|ELLIPSOID)\s*\[\s*"[^"]*"\s*,\s*([-+0-9.eE]+)\s*,\s*([-+0-9.eE]+)'
    of = lambda pattern, k: F.regexp_extract(text, pattern, k).try_cast("double")
    given = lambda name: of(rf"\+{name}=([-+]?[0-9.]+(?:[eE][-+]?[0-9]+)?)", 1)
    flat = lambda a, inv: F.when(inv == 0, a).otherwise(a * (1 - 1 / F.nullif(inv, F.lit(0.0))))
    named, inverse, r, big = of(wkt, 1), of(wkt, 2), given("R"), given("a")
    by_wkt = F.when(named.isNotNull() & inverse.isNotNull(), F.struct(named.alias("a"), flat(named, inverse).alias("c")))
    sphere = F.when(r.isNotNull(), F.struct(r.alias("a"), r.alias("c")))
    small = F.coalesce(given("b"), flat(big, F.nullif(given("rf"), F.lit(0.0))), big * (1 - F.coalesce(given("f"), F.lit(0.0))))
    by_proj = F.when(big.isNotNull(), F.struct(big.alias("a"), small.alias("c")))
    found = F.coalesce(by_wkt, sphere, by_proj)
    known = found.isNotNull() | F.coalesce(text.contains("WGS84"), F.lit(False))
    return F.coalesce(found["a"], F.lit(WGS84[0])), F.coalesce(found["c"], F.lit(WGS84[1])), known
