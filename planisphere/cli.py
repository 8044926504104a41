"""Command line: convert, filter and summarize networks.

    python -m planisphere.cli IN OUT [--where COL:LO..HI] [--start N --count N] [--summarize K [--method segment|tracks|lines]]
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import net
from .sources import facade, netpb


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> dict:
    p = argparse.ArgumentParser(prog="planisphere")
    p.add_argument("input")
    p.add_argument("output")
    p.add_argument("--where")
    p.add_argument("--start", type=int, default=0)
    p.add_argument("--count", type=int)
    p.add_argument("--summarize", type=int, default=0)
    p.add_argument("--method", choices=("segment", "tracks", "lines"), default="tracks")
    a = p.parse_args(argv)
    spark = spark or SparkSession.builder.getOrCreate()
    points, measures = facade.read_network(spark, a.input)
    if a.where:
        points, measures = net.where_range(points, measures, *net.parse_where(a.where))
    if a.count is not None:
        points, measures = net.slice_points(points, a.start, a.count), net.slice_points(measures, a.start, a.count)
    kind = facade.infer_format(a.output)
    if a.method == "lines" and kind != "bundle":
        p.error("--method lines needs a bundle as output")
    if a.method == "lines":
        facade.write_lines(a.output, points, measures)
    elif kind == "bundle":
        facade.write_bundle(a.output, points, measures, segments=a.summarize, by_tracks=a.method == "tracks")
    elif kind == "parquet":
        facade.write_flat(net.flatten(points, measures), a.output)
    else:
        inner = [c for c in measures.columns if c not in ("point_idx", "measure_ord")]
        lists = measures.groupBy("point_idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("measure_ord", F.struct(*inner).alias("m")))), lambda x: x["m"]).alias("measures"))
        netpb.write_net(points.join(lists, "point_idx", "left"), a.output, {})
    said = net.counts(points, measures).first().asDict()
    print(said)
    return said


if __name__ == "__main__":
    main()
