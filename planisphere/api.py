"""The engine's functions under one roof: what a program that works with networks, shapes, labels and camera points calls.

Each name is the function of a module below, where it is documented; columns and
DataFrames go in and out, and nothing is computed before the caller asks for rows.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame

from .functions.geo import bowring, chebyshev, dequantize, ecef_to_geodetic, ellipsoid, ellipsoid_columns, ellipsoid_from_text, geodetic, geodetic_to_ecef, quantize, radius_at, ray_ellipsoid, shape_model, strict_ellipsoid, surface_normal, to_pixel, viewer_radius
from .functions.photometry import angles, azimuths, camera_points, emission_angle, incidence_angle, longitudes, phase_angle, resolution
from .functions.vec import Vec, cross, distance, dot, ground_azimuth, magnitude, perpendicular, rect_to_spherical, scale, separation_angle, spherical_to_rect, unit
from .operators.footprints import bounds, ecef_wkt, edge_pixels, wkt
from .operators.labels import dispatch, product, register, resolve, translate
from .operators.lines import filaments, line_order
from .operators.lod import allotment, azimuth_order, coalesce_windows, density, drill_down, gaussian, meshgrid, mixture, resample, ring_grid
from .operators.net import concatenate, counts, differences, flatten, measure_range, offsets, point_at, reorder_by_track, runs, slice_points, slice_rows, snap, track_keys, unflatten, where_range
from .operators.projection import affine_fit, metres_to_degrees, pixel_size, quadtree
from .operators.raster import centroid, farthest_by_quadrant, heights, intersect, lookup, value_range
from .operators.specs import document, import_labels, load
from .sources.documents import body, raster_check, read_labels, sensor_check, state_text, url_check
from .sources.facade import infer_format, point_rows, read_flat, read_flat_bytes, read_layer, read_lines, read_network, read_xyz, shape, write_bundle, write_flat, write_lines, write_xyz
from .sources.netpb import NetSource, read_header, read_net, write_net
from .streaming.windows import convert, each_batch, tumbling


def columns(rows: DataFrame, names: list[str], start: int, count: int) -> pa.Table:
    """A window of rows (by row_ord), some columns of it, as an Arrow table for a program that is not Spark.

    The window comes to the caller's memory, so count must be given.
    """
    if count <= 0:
        raise ValueError("count must be positive")
    return slice_rows(rows, start, count).orderBy("row_ord").select(*names).toArrow()


__all__ = [name for name, value in list(globals().items()) if not name.startswith("_") and getattr(value, "__module__", "").startswith("planisphere")]
