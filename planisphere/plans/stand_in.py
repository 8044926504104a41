"""A control network made of the test tables: orders are points, lineitems their measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..operators.net import ordinal

A, C = geo.MARS
ITEM = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """point_idx, id, type, lat, lon, h (radians, metres), x, y, z (null if not adjusted), aprioriX/Y/Z, aprioriCovar."""
    o = ordinal(_read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), "o_orderkey", name="point_idx")
    lat = F.radians((F.col("o_orderkey") * 7919 % 18000) / F.lit(100.0) - 89.9963)
    lon = F.radians((F.col("o_orderkey") * 104729 % 36000) / F.lit(100.0) - 179.9957)
    o = o.select("point_idx", F.col("o_orderkey").alias("key"), F.concat(F.lit("pt"), "o_orderkey").alias("id"), (F.col("o_orderkey") % 3).cast("int").alias("type"), lat.alias("lat"), lon.alias("lon"), (F.col("o_totalprice") / 100).alias("h"), (F.col("o_orderstatus") != "P").alias("adjusted"))
    p = geo.geodetic_to_ecef(F.col("lat"), F.col("lon"), F.col("h"), A, C)
    o = o.withColumns({f"apriori{n}": c for n, c in zip("XYZ", p)})
    o = o.withColumns({c: F.when(F.col("adjusted"), F.col(f"apriori{c.upper()}")) for c in "xyz"})
    return o.withColumn("aprioriCovar", F.array(*(F.lit(float(k)) + F.col("type") for k in range(6))))


def measures(spark: SparkSession, sf_dir: str, pts: DataFrame | None = None, *also: str | Column) -> DataFrame:
    """point_idx, measure_ord, serialnumber, measure_type, sample, line, residual, sigma, ignore; also: columns of the points."""
    nth = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*ITEM)) - 1
    m = _read(spark, sf_dir, "lineitem").withColumn("measure_ord", nth.cast("long"))
    kind = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    m = m.select("l_orderkey", "measure_ord", F.concat(F.lit("SN"), "l_suppkey").alias("serialnumber"), kind.alias("measure_type"), F.col("l_extendedprice").alias("sample"), F.col("l_quantity").alias("line"), F.col("l_discount").alias("sampleResidual"), F.col("l_tax").alias("samplesigma"), (F.col("l_linestatus") == "F").cast("int").alias("measure_ignore"))
    pts = points(spark, sf_dir) if pts is None else pts
    keyed = any(isinstance(c, str) and c == "key" for c in also)
    of = pts.select("point_idx", F.col("key").alias("l_orderkey"), *(c for c in also if not (isinstance(c, str) and c == "key")))
    m = m.join(of, "l_orderkey")
    return m.withColumnRenamed("l_orderkey", "key") if keyed else m.drop("l_orderkey")  # as key, rows are known to be dealt by it


#: The same two tables for DuckDB.
SQL = f"""
pts0 AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS point_idx, o_orderkey AS key, 'pt' || o_orderkey AS id, (o_orderkey % 3)::INT AS type,
  radians((o_orderkey * 7919 % 18000) / 100.0e0 - 89.9963e0) AS lat, radians((o_orderkey * 104729 % 36000) / 100.0e0 - 179.9957e0) AS lon,
  o_totalprice / 100 AS h, o_orderstatus <> 'P' AS adjusted FROM orders),
pts1 AS (SELECT *, {A}e0 / sqrt(1 - {1 - C * C / (A * A)!r}e0 * sin(lat) * sin(lat)) AS nn FROM pts0),
pts2 AS (SELECT *, (nn + h) * cos(lat) * cos(lon) AS ax, (nn + h) * cos(lat) * sin(lon) AS ay, (nn * {C * C / (A * A)!r}e0 + h) * sin(lat) AS az FROM pts1),
pts AS (SELECT *, CASE WHEN adjusted THEN ax END AS x, CASE WHEN adjusted THEN ay END AS y, CASE WHEN adjusted THEN az END AS z FROM pts2),
mes AS (SELECT p.point_idx, row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(ITEM)}) - 1 AS measure_ord, 'SN' || l_suppkey AS serialnumber,
  CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS measure_type, l_extendedprice AS sample, l_quantity AS line, l_discount AS sampleResidual, l_tax AS samplesigma,
  (l_linestatus = 'F')::INT AS measure_ignore FROM lineitem JOIN pts p ON l_orderkey = p.key)"""
