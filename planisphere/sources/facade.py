"""Reading and writing networks: flat Parquet, bundles of Parquet tables, .net files."""

from __future__ import annotations

import io

import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.vec import Vec, magnitude
from ..operators import lines, lod, net
from ..operators.staging import discard, stage
from . import netpb

_MORE = "measure_logType array<int>, measure_logValue array<double>"
#: The columns of flat rows, in their order. Absent ones read as null.
FLAT = ", ".join([*(f"{n} string" for n in net.HEADER), *(f"{n} {netpb._SQL[k]}" for n, k in (*netpb.POINT.values(), *netpb.MEASURE.values())), _MORE])
LAYERS = ("points", "measures", "summary", "lines", "density")


def infer_format(path: str) -> str:
    """parquet, bundle (.stards names a bundle of tables) or net, by the name without its query; any case."""
    name = path.split("?", 1)[0].lower()
    return "parquet" if name.endswith(".parquet") else "bundle" if name.endswith((".stards", ".bundle")) else "net"


def read_flat(spark: SparkSession, path: str, columns: list[str] | None = None, where: str | None = None, window: tuple[int, int] | None = None, declared: bool = False) -> DataFrame:
    """Flat rows; only the columns asked for (id always) are read, and the filter reaches the scan.

    window: (start, count) of rows in the order of points and measures; count 0 is all.
    declared: rows of the schema FLAT and their ordinals, whatever the files lack or have besides.
    """
    rows = spark.read.schema(f"{FLAT}, point_idx long, measure_ord long").parquet(path) if declared else spark.read.parquet(path)
    if window and window[1]:
        ranked = rows if "row_ord" in rows.columns else net.ordinal(rows, "point_idx", F.coalesce("measure_ord", F.lit(0)), name="row_ord")
        rows = net.slice_rows(ranked, *window)
    rows = rows.where(where) if where else rows
    return rows.select("id", *(c for c in columns if c != "id" and c in rows.columns)) if columns else rows


def read_flat_bytes(spark: SparkSession, raw: bytes, columns: list[str] | None = None) -> DataFrame:
    """Flat rows of a Parquet file that the caller holds in memory; bytes of another kind raise."""
    found = pq.ParquetFile(io.BytesIO(raw))
    held = found.schema_arrow.names
    return spark.createDataFrame(found.read([c for c in held if not columns or c == "id" or c in columns]))


def write_flat(rows: DataFrame, path: str, codec: str = "gzip", target: int | None = None) -> None:
    """Rows ranged and sorted by point, so that files hold whole points and their statistics prune ranges.

    target: about so many rows a file. Rows are worked out once, into a staged table that is counted, sampled and dealt.
    """
    staged = stage(rows, "rows")
    parts = (max(1, -(-staged.count() // target)),) if target else ()
    staged.repartitionByRange(*parts, "point_idx").sortWithinPartitions("point_idx", "measure_ord").write.mode("overwrite").parquet(path, compression=codec)
    discard(staged)


def shape(rows: DataFrame) -> dict:
    """Row count (from file footers), present columns, and the header that all rows repeat."""
    held = [c for c in net.HEADER if c in rows.columns]
    first = rows.select(*held).first() if held else None
    return {"rows": rows.count(), "columns": rows.columns, "header": {c: (first[c] if first else None) or "" for c in held}}


def point_rows(rows: DataFrame) -> DataFrame:
    """point_idx, id, first_row, n_rows: the points as runs of one id, read from two columns (id, row_ord) alone."""
    found = net.runs(rows.select("row_ord", "id")).groupBy("run").agg(F.min("id").alias("id"), F.min("row_ord").alias("first_row"), F.count("*").alias("n_rows"))
    return found.withColumnRenamed("run", "point_idx")


def write_bundle(path: str, points: DataFrame, measures: DataFrame, header: dict[str, str] | None = None, segments: int = 0, by_tracks: bool = False, reordered: bool = False) -> None:
    """points, measures, meta and, with segments, a Gaussian summary, of points reordered by track if asked."""
    spark = points.sparkSession
    if segments and by_tracks:
        order = net.reorder_by_track(points, measures).select("point_idx", "new_idx")
        renamed = lambda df: df.join(order, "point_idx").drop("point_idx").withColumnRenamed("new_idx", "point_idx")
        points, measures = renamed(points), renamed(measures)
    for name, df in (("points", points), ("measures", measures)):
        df.repartitionByRange("point_idx").sortWithinPartitions("point_idx").write.mode("overwrite").parquet(f"{path}/{name}")
    stamps = {**(header or {}), "pointsReordered": str(int(reordered or bool(segments and by_tracks)))}
    spark.createDataFrame(list(stamps.items()), "key string, value string").coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")
    if segments:
        held = spark.read.parquet(f"{path}/points")
        lod.gaussian(held, segments, held.count()).write.mode("overwrite").parquet(f"{path}/summary")


def write_lines(path: str, points: DataFrame, measures: DataFrame, header: dict[str, str] | None = None, cell: float = lines.CELL, turn: float = lines.TURN, min_length: int = lines.MIN_LENGTH, epsilon: float = lines.EPSILON, a: float = geo.MARS[0], c: float = geo.MARS[1]) -> None:
    """A bundle whose points stand in filament order, with the layers lines and density.

    Positions are x, y, z or adjustedX, adjustedY, adjustedZ. The stamp pointsReordered tells whether there was any filament.
    """
    xyz = Vec(*located(points))
    placed = stage(points.select("point_idx", *(k.alias(n) for n, k in zip("xyz", xyz))), "placed")
    traced = stage(lines.filaments(placed, cell, turn, min_length, epsilon), "filaments")
    order = stage(lines.line_order(placed, traced, min_length), "order")
    renamed = lambda df: df.join(order, "point_idx").drop("point_idx").withColumnRenamed("new_idx", "point_idx")
    made = stage(lines.layer(placed, traced, a, c, min_length), "lines")
    count = made.count()
    write_bundle(path, renamed(points), renamed(measures), {**(header or {}), "summaryMethod": "lines", "lineCount": str(count), "linesRadiusA": repr(a), "linesRadiusC": repr(c)}, reordered=count > 0)
    made.write.mode("overwrite").parquet(f"{path}/lines")
    lat, lon = geo.ecef_to_geodetic(Vec(*(F.col(k) for k in "xyz")), a, c)
    lod.density(placed.where("x is not null").select(lat.alias("lat"), lon.alias("lon"))).write.mode("overwrite").parquet(f"{path}/density")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """line, v, x, y, z: the vertices of a bundle's lines on the ellipsoid that its stamps name."""
    meta = {r.key: r.value for r in read_layer(spark, path, "meta", "key string, value string").where("key like 'linesRadius%'").collect()}
    found = read_layer(spark, path, "lines", "line long, range_start long, range_count long, vertices array<struct<qlon:smallint,qlat:smallint>>")
    return lines.vertices(found, float(meta.get("linesRadiusA", geo.MARS[0])), float(meta.get("linesRadiusC", geo.MARS[1])))


def located(points: DataFrame) -> list[Column]:
    """The columns of adjusted positions: the first of the known names that the points have."""
    for names in (["x", "y", "z"], ["adjustedX", "adjustedY", "adjustedZ"], ["adjX", "adjY", "adjZ"]):
        if all(n in points.columns for n in names):
            return [F.col(n) for n in names]
    raise ValueError("no columns of positions")


def read_xyz(points: DataFrame, start: int, count: int) -> tuple[DataFrame, DataFrame]:
    """point_idx, x, y, z (floats) of a window of points, clamped to what is there; and its largest radius."""
    cut = net.slice_points(points, start, count)
    xyz = Vec(*located(cut))
    return cut.select("point_idx", *(k.cast("float").alias(n) for n, k in zip("xyz", xyz))), cut.agg(F.max(magnitude(xyz)).alias("radius"))


def read_layer(spark: SparkSession, path: str, layer: str, schema: str | None = None) -> DataFrame:
    """A bundle's table; a layer that is not there has no rows (of the schema given)."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(f"{path}/{layer}")
    except AnalysisException:
        return spark.createDataFrame([], schema or "point_idx long")


def read_network(spark: SparkSession, path: str, declared: bool = False) -> tuple[DataFrame, DataFrame]:
    """points and measures of any of the formats. declared: flat rows are read by the schema FLAT, whatever the files hold."""
    kind = infer_format(path)
    if kind == "bundle":
        return read_layer(spark, path, "points"), read_layer(spark, path, "measures")
    if kind == "net":
        p = stage(netpb.read_net(spark, path), "decoded")  # once, for points and measures
        m = p.select("point_idx", F.posexplode("measures").alias("measure_ord", "m")).select("point_idx", F.col("measure_ord").cast("long"), "m.*")
        return p.drop("measures"), m
    rows = read_flat(spark, path, declared=declared)
    if "point_idx" not in rows.columns:
        raise ValueError("flat rows need point_idx: scans have no order")
    inner = [c for c in rows.columns if c.startswith("measure_") or c in {n for n, _ in netpb.MEASURE.values()}]
    outer = [c for c in rows.columns if c not in inner and c != "point_idx"]
    nth = F.coalesce("measure_ord", F.lit(0))  # a column each, so that only those asked for are read and carried
    first = rows.groupBy("point_idx").agg(*(F.min_by(c, nth).alias(c) for c in outer))
    real = rows.where("serialnumber is not null or measure_type is not null").select("point_idx", *inner)
    return first, real


def xyz_extract(points: DataFrame, limit: int) -> DataFrame:
    """Float coordinates of the adjusted points among the first `limit`, with their azimuth and its rank."""
    some = net.slice_points(points, 0, limit).where("x is not null").select("point_idx", "x", "y", "z")
    return lod.azimuth_order(some).select("azimuth_rank", "point_idx", "azimuth", *(F.col(c).cast("float").alias(c) for c in "xyz"))


def write_xyz(points: DataFrame, path: str, limit: int) -> None:
    """The extract in the order of azimuths: files, and rows in them, follow one another."""
    xyz_extract(points, limit).repartitionByRange("azimuth_rank").sortWithinPartitions("azimuth_rank").write.mode("overwrite").parquet(path, compression="gzip")
