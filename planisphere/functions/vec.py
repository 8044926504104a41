"""Three-vectors as triples of columns: built-in expressions only."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Vec(NamedTuple):
    x: Column
    y: Column
    z: Column

    @staticmethod
    def of(name: str) -> Vec:
        """The columns name_x, name_y, name_z."""
        return Vec(*(F.col(f"{name}_{a}") for a in "xyz"))

    @staticmethod
    def lit(x: float, y: float, z: float) -> Vec:
        return Vec(*(F.lit(float(a)) for a in (x, y, z)))

    def put(self, df: DataFrame, name: str) -> DataFrame:
        """df with the vector as columns, so that later expressions refer to it by name."""
        return df.withColumns({f"{name}_{a}": c for a, c in zip("xyz", self)})

    def minus(self, b: Vec) -> Vec:
        return Vec(self.x - b.x, self.y - b.y, self.z - b.z)


def clamped_acos(c: Column) -> Column:
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c)))


def dot(a: Vec, b: Vec) -> Column:
    return a.x * b.x + a.y * b.y + a.z * b.z


def magnitude(a: Vec) -> Column:
    return F.sqrt(dot(a, a))


def distance(a: Vec, b: Vec) -> Column:
    return magnitude(a.minus(b))


def separation_angle(a: Vec, b: Vec) -> Column:
    """Radians; 0 if either vector has no length."""
    norms = magnitude(a) * magnitude(b)
    return F.when(norms == 0, F.lit(0.0)).otherwise(clamped_acos(dot(a, b) / F.nullif(norms, F.lit(0.0))))


def scale(a: Vec, s: Column | float) -> Vec:
    return Vec(a.x * s, a.y * s, a.z * s)


def unit(a: Vec) -> Vec:
    """The zero vector stays."""
    m = F.nullif(magnitude(a), F.lit(0.0))
    return Vec(*(F.coalesce(c / m, F.lit(0.0)) for c in a))


def cross(a: Vec, b: Vec) -> Vec:
    return Vec(a.y * b.z - a.z * b.y, a.z * b.x - a.x * b.z, a.x * b.y - a.y * b.x)


def perpendicular(a: Vec, b: Vec) -> Vec:
    """The part of b that is at right angles to a; b itself if a has no length."""
    s = F.coalesce(dot(a, b) / F.nullif(dot(a, a), F.lit(0.0)), F.lit(0.0))
    return b.minus(scale(a, s))


def lon_degrees(lon: Column) -> Column:
    """Radians to degrees in [0, 360)."""
    return F.pmod(F.degrees(lon), F.lit(360.0))


def spherical_to_rect(lat: Column, lon: Column, r: Column) -> Vec:
    return Vec(r * F.cos(lat) * F.cos(lon), r * F.cos(lat) * F.sin(lon), r * F.sin(lat))


def rect_to_spherical(a: Vec) -> tuple[Column, Column, Column]:
    """lat, lon, radius; zeros below a radius of 1e-10."""
    r = magnitude(a)
    some = lambda c: F.when(r < 1e-10, F.lit(0.0)).otherwise(c)
    return some(F.asin(a.z / F.when(r < 1e-10, F.lit(1.0)).otherwise(r))), some(F.atan2(a.y, a.x)), some(r)


def ground_azimuth(lat: Column, lon: Column, sub_lat: Column, sub_lon: Column) -> Column:
    """Degrees in [0, 360): the bearing from the sub-point to the ground point."""
    d = lon - sub_lon
    east = F.sin(d) * F.cos(lat)
    north = F.cos(sub_lat) * F.sin(lat) - F.sin(sub_lat) * F.cos(lat) * F.cos(d)
    return F.pmod(F.degrees(F.atan2(east, north)), F.lit(360.0))
