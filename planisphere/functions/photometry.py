"""Angles of light and view, sensor and sun geometry, over a table of sensor states.

A sensor state row holds the vectors pos (sensor), ground and sun (direction to the
sun, nullable) as name_x, name_y, name_z. No sensor model is included: positions are
inputs. Each step adds columns by name, so that no expression is repeated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import geo
from .vec import Vec, clamped_acos, cross, distance, dot, magnitude, scale, separation_angle, unit

#: km
AU = 149597870.7


def phase_angle(ground: Vec, sensor: Vec, sun: Vec) -> Column:
    return separation_angle(sensor.minus(ground), sun.minus(ground))


def emission_angle(normal: Vec, look: Vec) -> Column:
    return separation_angle(normal, look)


def incidence_angle(ground: Vec, sun: Vec, normal: Vec) -> Column:
    return separation_angle(normal, sun.minus(ground))


def angles(df: DataFrame) -> DataFrame:
    """emission, incidence and phase in degrees; without a sun, incidence from the normal's z and phase as the difference."""
    df = unit(Vec.of("pos").minus(Vec.of("ground"))).put(df, "to")
    n, to, sun = Vec.of("normal"), Vec.of("to"), unit(Vec.of("sun"))
    deg = lambda c: F.degrees(clamped_acos(c))
    df = df.withColumn("emission", deg(dot(n, to)))
    lit = F.col("sun_x").isNotNull()
    df = df.withColumn("incidence", F.when(lit, deg(dot(n, sun))).otherwise(deg(n.z / F.nullif(magnitude(n), F.lit(0.0)))))
    return df.withColumn("phase", F.when(lit, deg(dot(to, sun))).otherwise(F.abs(F.col("emission") - F.col("incidence"))))


def local_frame(df: DataFrame) -> DataFrame:
    """east and north at the surface, from the pole and the normal."""
    df = unit(cross(Vec.lit(0, 0, 1), Vec.of("normal"))).put(df, "east")
    return unit(cross(Vec.of("normal"), Vec.of("east"))).put(df, "north")


def azimuth(v: Vec) -> Column:
    """Degrees in [0, 360) of a direction in the local frame."""
    # east and north are at right angles to the normal, so the vector's part along the normal has no say
    return F.pmod(F.degrees(F.atan2(dot(v, Vec.of("east")), dot(v, Vec.of("north")))), F.lit(360.0))


def spacecraft(df: DataFrame, a: float, c: float) -> DataFrame:
    """Nadir point, altitude, off-nadir angle and azimuth. look must be a column vector."""
    down = scale(Vec.of("pos"), -1.0)
    df = geo.geodetic(geo.ray_ellipsoid(Vec.of("pos"), down, a, a, c).put(df, "nadir"), "nadir", "sub_spacecraft_lat", "lon_", a, c)
    return df.withColumns({
        "sub_spacecraft_lon": F.pmod(F.col("lon_"), F.lit(6.283185307179586)),
        "spacecraft_altitude": distance(Vec.of("pos"), Vec.of("nadir")),
        "off_nadir": F.degrees(clamped_acos(dot(Vec.of("look"), unit(down)))),
        "spacecraft_azimuth": azimuth(Vec.of("pos").minus(Vec.of("ground"))),
    }).drop("lon_")


def sun(df: DataFrame, a: float, c: float, distance_au: float = 1.52) -> DataFrame:
    """Sun position (km), sub-solar point and azimuth; zeros without a sun."""
    df = unit(Vec.of("sun")).put(df, "sd")
    df = geo.geodetic(geo.ray_ellipsoid(Vec.of("ground"), Vec.of("sd"), a, a, c).put(df, "subsolar"), "subsolar", "lat_", "lon_", a, c)
    lit = F.col("sun_x").isNotNull()
    some = lambda v: F.when(lit, v).otherwise(F.lit(0.0))
    df = df.withColumns({f"sun_km_{k}": some(F.col(f"sd_{k}") * (distance_au * AU)) for k in "xyz"})
    to = Vec.of("subsolar").minus(Vec.of("ground"))
    return df.withColumns({"sub_solar_lat": some(F.col("lat_")), "sub_solar_lon": some(F.pmod(F.col("lon_"), F.lit(6.283185307179586))), "solar_distance": some(F.lit(distance_au)), "sub_solar_azimuth": some(azimuth(to))}).drop("lat_", "lon_")


def azimuths(df: DataFrame) -> DataFrame:
    """sun_azimuth, spacecraft_azimuth and north_azimuth (the same as the spacecraft's) in degrees, of the directions to_sun and to_sc.

    The frame is the ground's own, from `normal`, which is of unit length.
    """
    df = local_frame(df)
    return df.withColumns({"sun_azimuth": azimuth(Vec.of("to_sun")), "spacecraft_azimuth": azimuth(Vec.of("to_sc"))}).withColumn("north_azimuth", F.col("spacecraft_azimuth"))


def resolution(df: DataFrame) -> DataFrame:
    """Metres a pixel from the ground points of the pixel (ground) and its neighbours (ground_s, ground_l)."""
    df = df.withColumns({"sample_resolution": distance(Vec.of("ground"), Vec.of("ground_s")), "line_resolution": distance(Vec.of("ground"), Vec.of("ground_l"))})
    mean = (F.col("sample_resolution") + F.col("line_resolution")) / 2
    return df.withColumns({"pixel_resolution": mean, "oblique_resolution": mean / F.cos(F.radians("emission"))})


def camera_points(df: DataFrame, a: float, c: float, compat: bool = False) -> DataFrame:
    """One record for each sensor state: coordinates, angles, distances, spacecraft and sun geometry.

    lat_geodetic and lat_centric are what they say; compat adds planetographic_lat,
    which converts a geodetic latitude once more, for comparison with older records.
    """
    df = geo.geodetic(df, "ground", "lat_geodetic", "lon_", a, c)
    df = df.withColumns({"lon_east": F.pmod(F.col("lon_"), F.lit(6.283185307179586)), "lat_centric": F.atan2(F.col("ground_z"), F.sqrt(F.col("ground_x") ** 2 + F.col("ground_y") ** 2))}).drop("lon_")
    if compat:
        df = df.withColumn("planetographic_lat", F.atan(F.tan("lat_geodetic") / F.lit((c / a) ** 2)))
    df = geo.surface_normal(Vec.of("ground"), a, a, c).put(df, "normal")
    df = df.withColumns({"slant_distance": distance(Vec.of("pos"), Vec.of("ground")), "target_center_distance": magnitude(Vec.of("pos")), "local_radius": magnitude(Vec.of("ground"))})
    df = spacecraft(local_frame(angles(df)), a, c)
    return sun(df, a, c).withColumn("north_azimuth", F.col("spacecraft_azimuth"))


def longitudes(lon_east_radians: Column) -> dict[str, Column]:
    """The four ways to write a longitude, in degrees; at 0, west 360 is 360."""
    e360 = F.pmod(F.degrees(lon_east_radians), F.lit(360.0))
    e180 = F.when(e360 > 180, e360 - 360).otherwise(e360)
    w360 = 360 - e360
    return {"e360": e360, "e180": e180, "w360": w360, "w180": F.when(w360 > 180, w360 - 360).otherwise(w360)}
