"""Camera queries at size: what their plans must not do."""

from __future__ import annotations

from pyspark.sql import functions as F

from planisphere.operators import inversion, projection


def _grid(spark):
    node = spark.range(9).select((F.col("id") % 3).alias("i"), F.floor(F.col("id") / 3).alias("j"))
    at = {"image": F.lit(1).cast("long"), "sample": F.col("i") * 10.0, "line": F.col("j") * 10.0, "x": F.lit(1000.0), "y": F.col("i") * 5.0, "z": F.col("j") * 5.0}
    return node.withColumns(at)


def test_cells_are_never_broadcast(spark):
    """exploded cells look as small as the images they come from; they were broadcast through the driver."""
    cells = spark.range(9).select(F.lit(1).cast("long").alias("image"), (F.col("id") % 3).alias("px"), F.floor(F.col("id") / 3).alias("py"), F.col("id").cast("double").alias("value"))
    ground = spark.createDataFrame([(1, 1000.0, 2.5, 5.0)], "image long, x double, y double, z double")
    found = projection.resample(ground, _grid(spark), cells, -1.0, 10.0)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not [p for p in plan.splitlines() if "BroadcastHashJoin" in p and "px" in p]
    assert abs(found.first().value - 3.5) < 1e-9


def test_newton_steps_run_on_batches(spark):
    """the steps made one generated method that the JVM runs but does not compile."""
    ground = spark.createDataFrame([(1, 1000.0, 2.5, 5.0), (1, 1000.0, 7.0, 9.0), (1, -1000.0, 2.5, 5.0)], "image long, x double, y double, z double")
    found = inversion.ground_to_image(ground, _grid(spark))
    assert "MapInArrow" in found._jdf.queryExecution().executedPlan().toString()
    assert sorted((round(r.sample, 9), round(r.line, 9)) for r in found.collect()) == [(5.0, 10.0), (14.0, 18.0)]


def test_quads_hold_no_map(spark):
    """each node went to four quads, whose map a task held before its shuffle; pixels exploded from images were broadcast."""
    grid = _grid(spark).where("not (i = 2 and j = 2)")
    made = inversion.quads(grid)
    assert "Aggregate" not in made._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.i, r.j, r.sample0, r.sample1, r.line0, r.line1, r.p01_z, r.p10_y) for r in made.collect()) == [(0, 0, 0.0, 10.0, 0.0, 10.0, 5.0, 5.0), (0, 1, 0.0, 10.0, 10.0, 20.0, 10.0, 5.0), (1, 0, 10.0, 20.0, 0.0, 10.0, 5.0, 10.0)]
    images = spark.createDataFrame([(1, 21, 21)], "image long, samples int, lines int")
    plan = projection.boundary(images, grid.withColumn("image", F.floor(F.col("i") * 0.0) + 1), 1000.0, 1000.0, 3)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [image" in plan


def test_targets_are_sent_once(spark):
    """Targets went by their keys to sizes, cells, results and, four times, to cells of values, and then back to themselves."""
    ground = spark.createDataFrame([(1, 1000.0, 2.5, 5.0)], "image long, x double, y double, z double")
    cells = spark.range(9).select((F.floor(F.col("id") / 100) + 1).alias("image"), (F.col("id") % 3).alias("px"), F.floor(F.col("id") / 3).alias("py"), F.col("id").cast("double").alias("value"))
    count = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert count(inversion.ground_to_image(ground, _grid(spark))) <= 3
        assert count(projection.resample(ground, _grid(spark), cells, -1.0, 10.0)) <= 5
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_results_do_not_hang_on_batches(spark):
    """A target on an edge meets up to four quads, whose rows may stand in several batches; the smallest line, then sample, is taken."""
    at = [(1, 1000.0, 0.5 * a, 0.5 * b) for a in range(-1, 22) for b in range(-1, 22)] + [(2, 1000.0, 1.0, 1.0), (1, None, 1.0, 1.0), (1, 1000.0, 5.0, 5.0)]
    ground = spark.createDataFrame(at, "image long, x double, y double, z double").coalesce(1)
    got = []
    for n in (1, 2, 3, 10_000):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", n)
        try:
            got.append([sorted(map(str, inversion.ground_to_image(ground, _grid(spark), unseen=u).collect())) for u in (False, True)])
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert all(g == got[0] for g in got)
    assert len(got[0][0]) == 21 * 21 + 1 and len(got[0][1]) == len(at)


def test_cells_beside_tiles_and_twice(spark):
    """Cells of neighbouring tiles meet a target on the edge; a cell that is there twice counts twice."""
    side = 20
    node = spark.range(4).select((F.col("id") % 2).alias("i"), F.floor(F.col("id") / 2).alias("j"))
    grid = node.withColumns({"image": F.lit(1).cast("long"), "sample": F.col("i") * 20.0, "line": F.col("j") * 20.0, "x": F.lit(1000.0), "y": F.col("i") * 20.0, "z": F.col("j") * 20.0})
    value = {(a, b): float(a * a + 7 * b) for a in range(side) for b in range(side) if (a, b) != (7, 8)}
    rows = [(1, a, b, v) for (a, b), v in value.items()] + [(1, 8, 8, 1000.0)]
    cells = spark.createDataFrame(rows, "image long, px int, py int, value double")
    at = [(k, 1, 1000.0, y, z) for k, (y, z) in enumerate((a + 0.25, b + 0.75) for a in range(18) for b in range(18))]
    got = {r.key: r.value for r in projection.resample(spark.createDataFrame(at, "key long, image long, x double, y double, z double"), grid, cells, -1.0).collect()}
    for k, _, _, y, z in at:
        total = weight = 0.0
        for i in (0, 1):
            for j in (0, 1):
                for _, a, b, v in [r for r in rows if r[1:3] == (int(y) + i, int(z) + j)]:
                    w = (0.25 if i else 0.75) * (0.75 if j else 0.25)
                    total, weight = total + w * v, weight + w
        assert abs(got[k] - total / weight) < 1e-6
    assert len(got) == len(at)
