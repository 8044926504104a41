"""Networks stored with their offsets: windows and snaps are range reads of a few files.

A stored network is a folder of three tables, written once:

- points, by point_idx, with n_measures, measure_start (measures before the point) and row_start (flat rows before it; a point without
  measures has one row);
- measures, by point and measure_ord, with measure_idx, their ordinal in the network;
- index: layer, file, its rows, and the least and greatest ordinals of points, measures and rows that the file holds.

A reader looks the window up in the index and opens only the files that meet it; inside a file, the sorted columns let the scan
skip row groups. No read sums or numbers anything again.

Files are named relative to the folder, so a stored network may be moved.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import net
from ..operators.staging import discard, stage

ROWS_PER_FILE = 1_000_000
_INDEX = "layer string, file string, n long, point_low long, point_high long, measure_low long, measure_high long, row_low long, row_high long"


def write(path: str, points: DataFrame, measures: DataFrame, rows_per_file: int = ROWS_PER_FILE) -> None:
    """Store a network. Points are numbered densely from 0; measures of one point may be spread over files."""
    n = measures.groupBy("point_idx").agg(F.count("*").alias("n_measures"))
    per = points.select("point_idx").join(n, "point_idx", "left").withColumn("n_measures", F.coalesce("n_measures", F.lit(0)).cast("long"))
    # offsets are numbered over counts alone; a point's rows are its measures, or one: points without any before it make the difference
    placed = net.ordinal(per.withColumn("bare", (F.col("n_measures") == 0).cast("long")), "point_idx", name="nth_", running="n_measures", into="measure_start", also={"bare": "bare_before"})
    offsets = stage(placed.select("point_idx", "n_measures", "measure_start", (F.col("measure_start") + F.col("bare_before")).alias("row_start")), "offsets")
    placed = points.join(offsets, "point_idx")
    numbered = measures.join(offsets.select("point_idx", "measure_start"), "point_idx").withColumn("measure_idx", F.col("measure_start") + F.col("measure_ord")).drop("measure_start")
    for layer, df, order in (("points", placed, ["point_idx"]), ("measures", numbered, ["measure_idx"])):
        df.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).parquet(f"{path}/{layer}")
    discard(offsets)
    _index(points.sparkSession, path).coalesce(1).write.mode("overwrite").parquet(f"{path}/index")


def _index(spark: SparkSession, path: str) -> DataFrame:
    """A row a file, from the ordinal columns alone."""
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    p = spark.read.parquet(f"{path}/points").withColumn("file", name)
    ends = {"measure": F.col("measure_start") + F.col("n_measures") - 1, "row": F.col("row_start") + F.greatest(F.lit(1), "n_measures") - 1}
    of_points = p.groupBy("file").agg(
        F.count("*").alias("n"), F.min("point_idx").alias("point_low"), F.max("point_idx").alias("point_high"), F.min("measure_start").alias("measure_low"), F.max(ends["measure"]).alias("measure_high"),
        F.min("row_start").alias("row_low"), F.max(ends["row"]).alias("row_high"),
    )
    m = spark.read.parquet(f"{path}/measures").withColumn("file", name)
    of_measures = m.groupBy("file").agg(F.count("*").alias("n"), F.min("point_idx").alias("point_low"), F.max("point_idx").alias("point_high"), F.min("measure_idx").alias("measure_low"), F.max("measure_idx").alias("measure_high"))
    none = {c: F.lit(None).cast("long") for c in ("row_low", "row_high")}
    names = [c.split()[0] for c in _INDEX.split(", ")]
    return of_points.withColumn("layer", F.lit("points")).select(*names).unionByName(of_measures.withColumns({"layer": F.lit("measures"), **none}).select(*names))


class Stored(NamedTuple):
    """A stored network. Windows are (start, count); what of a window is beyond the network is empty."""

    spark: SparkSession
    path: str

    def _read(self, layer: str, by: str, low: int, high: int) -> DataFrame:
        """The files of a layer that may hold ordinals low to high of `by` (point, measure or row)."""
        index = self.spark.read.schema(_INDEX).parquet(f"{self.path}/index")
        hit = (F.col("layer") == layer) & (F.col(f"{by}_low") <= high) & (F.col(f"{by}_high") >= low)
        files = [f"{self.path}/{layer}/{r.file}" for r in index.where(hit).select("file").collect()]  # a window's files, as a listing would name them
        schema = self.spark.read.parquet(f"{self.path}/{layer}").schema
        return self.spark.read.schema(schema).parquet(*files) if files else self.spark.createDataFrame([], schema)

    def points(self, start: int, count: int) -> DataFrame:
        """The points of a window of point ordinals."""
        return self._read("points", "point", start, start + count - 1).where((F.col("point_idx") >= start) & (F.col("point_idx") < start + count))

    def measures(self, start: int, count: int) -> DataFrame:
        """All measures of a window of points."""
        return self._read("measures", "point", start, start + count - 1).where((F.col("point_idx") >= start) & (F.col("point_idx") < start + count))

    def measure_window(self, start: int, count: int) -> DataFrame:
        """The measures of a window of measure ordinals."""
        return self._read("measures", "measure", start, start + count - 1).where((F.col("measure_idx") >= start) & (F.col("measure_idx") < start + count))

    def snap(self, start: int, count: int) -> DataFrame:
        """The whole points that own a measure of a window of measure ordinals."""
        held = self._read("points", "measure", start, start + count - 1)
        return held.where((F.col("measure_start") < start + count) & (F.col("measure_start") + F.col("n_measures") > start) & (F.col("n_measures") > 0))

    def rows(self, start: int, count: int, header: dict[str, str] | None = None) -> DataFrame:
        """Flat rows, with row_ord, of a window of row ordinals: points that reach into it, joined with the measures of their span."""
        held = self._read("points", "row", start, start + count - 1)
        held = held.where((F.col("row_start") < start + count) & (F.col("row_start") + F.greatest(F.lit(1), "n_measures") > start))
        span = held.agg(F.min("measure_start").alias("low"), F.max(F.col("measure_start") + F.col("n_measures")).alias("high")).first()
        own = self.measure_window(span.low or 0, (span.high or 0) - (span.low or 0)).drop("measure_idx")
        flat = net.flatten(held, own, header).withColumn("row_ord", F.col("row_start") + F.coalesce("measure_ord", F.lit(0)))
        return net.slice_rows(flat, start, count).drop("row_start", "measure_start", "n_measures") if count else flat.limit(0)

    def measure_range(self, i: int) -> tuple[int, int]:
        """The first measure's ordinal and the number of measures of point i, from one row; an index out of range raises."""
        row = self.points(i, 1).select("measure_start", "n_measures").first()
        if row is None:
            raise IndexError(i)
        return row.measure_start, row.n_measures

    def size(self) -> tuple[int, int, int]:
        """Points, measures and flat rows, from the index alone."""
        r = self.spark.read.schema(_INDEX).parquet(f"{self.path}/index").where("layer = 'points'").agg(F.sum("n").alias("p"), F.max("measure_high").alias("m"), F.max("row_high").alias("r")).first()
        return (r.p, r.m + 1, r.r + 1) if r.p else (0, 0, 0)
