"""Stored offsets, equality in any order, camera grids and parallel chains against plain versions."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from planisphere.operators import equality, inversion, lines, lod, net, projection, tracing
from planisphere.sources import csr, netpb

POINT = "point_idx long, id string, x double, aprioriCovar array<double>"
MEASURE = "point_idx long, measure_ord long, serialnumber string, measure_type int, sample double, line double"


def network(spark, counts, nan=False):
    pts = [(i, f"p{i // 2}", math.nan if nan and i == 1 else None if i % 5 == 4 else float(i), [1.0, float(i)] if i % 3 else None) for i in range(len(counts))]
    mes = [(i, k, f"S{k % 3}" if k else None, 1, 10.0 * i + k, -0.0) for i, n in enumerate(counts) for k in range(n)]
    return spark.createDataFrame(pts, POINT), spark.createDataFrame(mes, MEASURE)


# stored offsets


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    counts = [3, 0, 1, 0, 0, 250, 2, 7, 0, 4] * 20
    path = str(tmp_path_factory.mktemp("csr"))
    pts, mes = network(spark, counts)
    csr.write(path, pts, mes, rows_per_file=100)
    return csr.Stored(spark, path), counts


def test_stored_windows_against_plain(stored):
    s, counts = stored
    starts = np.concatenate([[0], np.cumsum(counts)])
    assert s.size() == (len(counts), sum(counts), sum(max(1, n) for n in counts))
    for start, count in ((0, 1), (150, 500), (300, 5), (7, 0)):
        want = [i for i in range(len(counts)) if start <= i < start + count]
        assert sorted(r.point_idx for r in s.points(start, count).collect()) == want
        assert s.measures(start, count).count() == sum(counts[i] for i in want)
    for start, count in ((0, 1), (250, 10), (5000, 100), (9999, 5)):
        want = [i for i, n in enumerate(counts) if n and starts[i] < start + count and starts[i] + n > start]
        assert sorted(r.point_idx for r in s.snap(start, count).collect()) == want
        assert s.measure_window(start, count).count() == max(0, min(sum(counts), start + count) - start)
    flat = [(i, k if n else None) for i, n in enumerate(counts) for k in range(max(1, n))]
    for start, count in ((3, 1), (4, 400), (len(flat) - 2, 9), (len(flat), 3), (5, 0)):
        got = [(r.row_ord, r.point_idx, r.measure_ord) for r in s.rows(start, count).orderBy("row_ord").collect()]
        assert got == [(k, *flat[k]) for k in range(start, min(len(flat), start + count))]
    assert s.measure_range(5) == (4, 250) and s.measure_range(4) == (4, 0)
    with pytest.raises(IndexError):
        s.measure_range(200)


def test_stored_windows_open_few_files(stored):
    s, counts = stored
    everything = s.spark.read.parquet(f"{s.path}/measures").inputFiles()
    assert len(everything) > 20
    for df in (s.measures(55, 1), s.measure_window(3000, 40), s.points(10, 3), s.snap(3000, 40)):
        assert 1 <= len(df.inputFiles()) <= 4
    plan = s.measures(55, 1)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "Exchange" not in plan and "Aggregate" not in plan


def test_stored_edges(spark, tmp_path):
    pts, mes = network(spark, [])
    csr.write(f"{tmp_path}/none", pts, mes)
    none = csr.Stored(spark, f"{tmp_path}/none")
    assert none.size() == (0, 0, 0) and none.points(0, 5).count() == none.snap(0, 5).count() == none.rows(0, 5).count() == 0
    pts, mes = network(spark, [0, 0, 0])
    csr.write(f"{tmp_path}/bare", pts, mes)
    bare = csr.Stored(spark, f"{tmp_path}/bare")
    assert bare.snap(0, 9).count() == 0 and [r.row_ord for r in bare.rows(1, 5).orderBy("row_ord").collect()] == [1, 2]


def test_offsets_are_numbered_once_over_counts_alone(spark, tmp_path, monkeypatch):
    """Whole points were dealt and staged for each of two sums."""
    seen, plain = [], csr.net.ordinal
    monkeypatch.setattr(csr.net, "ordinal", lambda df, *order, **more: seen.append(df.columns) or plain(df, *order, **more))
    csr.write(f"{tmp_path}/s", *network(spark, [2, 0, 3, 0, 0, 1]))
    assert seen == [["point_idx", "n_measures", "bare"]]
    rows = csr.Stored(spark, f"{tmp_path}/s").points(0, 6).orderBy("point_idx").collect()
    assert [(r.n_measures, r.measure_start, r.row_start) for r in rows] == [(2, 0, 0), (0, 2, 2), (3, 2, 3), (0, 5, 6), (0, 5, 7), (1, 5, 8)]


# equality


def test_bags_are_compared_once(spark):
    """rows of either side were worked out twice, once for each direction."""
    a = spark.createDataFrame([(1, "x"), (1, "x"), (1, "x"), (2, None), (3, "z")], "v int, k string")
    b = spark.createDataFrame([("x", 1), (None, 2), (None, 2), ("y", 4)], "k string, v int")
    found = net.differences(a, b)
    assert sorted((r.side, r.v, r.k or "") for r in found.collect()) == [("a", 1, "x"), ("a", 1, "x"), ("a", 3, "z"), ("b", 2, ""), ("b", 4, "y")]
    assert found.columns == ["k", "v", "side"]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 2


def test_equality_in_any_order(spark):
    pts, mes = network(spark, [3, 0, 40, 2, 1, 5, 0, 0], nan=True)
    b = pts.withColumn("point_idx", 7 - F.col("point_idx")), mes.withColumn("point_idx", 7 - F.col("point_idx")).withColumn("measure_ord", 99 - F.col("measure_ord"))
    assert equality.differences((pts, mes), b).count() == 0
    zero = b[1].withColumn("line", F.lit(0.0))  # -0.0 equals 0.0
    assert equality.differences((pts, mes), (b[0], zero)).count() == 0
    sides = lambda p, m, **how: sorted((r.side, r.point_idx) for r in equality.differences((pts, mes), (p, m), **how).collect())
    covar = pts.withColumn("aprioriCovar", F.when(F.col("point_idx") == 2, F.array(F.lit(1.0), F.lit(2.5))).otherwise(F.col("aprioriCovar")))
    assert sides(covar, mes) == [("a", 2), ("b", 2)]
    fewer = mes.where("not (point_idx = 3 and measure_ord = 1)")
    assert sides(pts, fewer) == [("a", 3), ("b", 3)]
    swapped = mes.withColumn("sample", F.when(F.col("sample") == 20.0, 21.0).when(F.col("sample") == 21.0, 20.0).otherwise(F.col("sample")))
    assert sides(pts, swapped) == [("a", 2), ("b", 2)]  # samples 20 and 21 changed their serials
    assert sides(pts.where("point_idx <> 6"), mes) == [("a", 6)]
    assert sides(pts.limit(0), mes.limit(0)) == [("a", i) for i in range(8)]


def test_equality_counts_repeated_points(spark):
    pts = spark.createDataFrame([(i, "same", 1.0, None) for i in range(5)], POINT)
    mes = spark.createDataFrame([(i, k, "S", 1, 1.0, 1.0) for i in range(5) for k in range(2)], MEASURE)
    got = equality.differences((pts, mes), (pts.where("point_idx < 3"), mes.where("point_idx < 3"))).collect()
    assert sorted((r.side, r.point_idx) for r in got) == [("a", 3), ("a", 4)]
    twice = mes.where("measure_ord = 0").unionByName(mes.where("measure_ord = 0"))  # a bag keeps repeats: here the same ones
    assert equality.differences((pts, mes), (pts, twice)).count() == 0


def test_equality_stages_names_and_hashes_alone(spark, monkeypatch):
    """points left over were staged whole, and digests that one point alone has were looked up again."""
    seen, plain = [], equality.stage
    monkeypatch.setattr(equality, "stage", lambda df, name: seen.append((name, df.columns)) or plain(df, name))
    pts, mes = network(spark, [3, 0, 40, 2, 1, 5, 0, 0])
    far = mes.withColumn("sample", F.col("sample") * F.when(F.col("point_idx") == 4, 1.001).otherwise(1 + 1e-9))
    assert sorted((r.side, r.point_idx) for r in equality.differences((pts, mes), (pts, far), 1e-6).collect()) == [("a", 4), ("b", 4)]
    assert [n for n, _ in seen].count("digests") == 2 and "shared" not in dict(seen)
    assert {c for _, columns in seen for c in columns} <= {"point_idx", "id", "d1", "d2", "n_a", "n_b", "a_idx", "b_idx", "same"}


def test_equality_of_kinds_and_nulls(spark):
    nan, zero = float("nan"), -0.0
    mes = spark.createDataFrame([(0, "S", 1, 2.0), (0, None, None, nan), (1, "T", 2, zero)], "point_idx long, serialnumber string, kind int, sample double")
    pts = spark.createDataFrame([(0, "p", [zero, None], None), (1, "q", [None, 1.0], 5), (2, None, [], 0), (3, None, None, 1)], "point_idx long, id string, c array<double>, n int")
    other = spark.createDataFrame([(0, "p", [0.0, None], None), (1, "q", [1.0, None], 5), (2, None, None, 0), (3, None, None, 1)], "point_idx long, id string, c array<double>, n long")
    wide = mes.withColumn("kind", F.col("kind").cast("long")).withColumn("sample", F.when(F.col("sample") == 0, 0.0).otherwise(F.col("sample"))).withColumn("none", F.lit(None).cast("double"))
    for more in ({}, {"tolerance": 1e-6}):
        found = equality.differences((pts, mes), (other, wide), **more)
        assert sorted((r.side, r.point_idx) for r in found.collect()) == [("a", 1), ("a", 2), ("b", 1), ("b", 2)]
    text = wide.withColumn("kind", F.col("kind").cast("string"))
    assert equality.differences((pts, mes), (pts, text)).count() == 0
    assert equality.differences((pts, mes), (pts, text.where("point_idx = 0")), 1e-6).select("side", "point_idx").distinct().count() == 2


def test_many_pairs_are_merged(spark, monkeypatch):
    monkeypatch.setattr(equality, "_FEW", 2)
    pts, mes = network(spark, [3, 0, 40, 2, 1, 5, 0, 0])
    pts = pts.withColumn("id", F.concat(F.lit("q"), "point_idx"))
    far = mes.where("point_idx <> 5 or measure_ord <> 1").withColumn("sample", F.col("sample") * F.when(F.col("point_idx") == 2, 1.001).otherwise(1 + 1e-9))
    moved = [df.withColumn("point_idx", F.col("point_idx") * 3 % 8) for df in (pts, far)]
    assert sorted((r.side, r.id, r.point_idx) for r in equality.differences((pts, mes), tuple(moved), 1e-6).collect()) == [("a", "q2", 2), ("a", "q5", 5), ("b", "q2", 6), ("b", "q5", 7)]


def test_equality_within_a_tolerance(spark):
    pts, mes = network(spark, [3, 0, 40, 2, 1, 5, 0, 0])
    off = lambda by, where: mes.withColumn("sample", F.when(F.expr(where), F.col("sample") * (1 + by)).otherwise(F.col("sample")))
    assert equality.differences((pts, mes), (pts, off(1e-9, "true")), 1e-6).count() == 0
    assert equality.differences((pts, mes), (pts, off(1e-9, "true"))).count() > 0
    far = equality.differences((pts, mes), (pts, off(1e-3, "point_idx = 2")), 1e-6).collect()
    assert sorted((r.side, r.point_idx) for r in far) == [("a", 2), ("b", 2)]
    assert equality.differences((pts, mes), (pts.withColumn("aprioriCovar", F.transform("aprioriCovar", lambda v: v + 1e-12)), mes), 1e-6).count() == 0


# camera grids


def grid_of(spark, image, where, nodes=6, hole=()):
    """A distorted camera that looks at a direction; sample and line from 10 on, a step of 50."""
    c = np.array(where, float) / np.linalg.norm(where)
    e = np.cross(c, [1, 0, 0] if abs(c[0]) < 0.6 else [0, 1, 0])
    e /= np.linalg.norm(e)
    n = np.cross(c, e)
    rows = []
    for i in range(nodes):
        for j in range(nodes):
            p, q = (i - nodes / 2) * 0.03, (j - nodes / 2) * 0.04
            v = c + (p + 0.5 * p * q) * e + (q - 0.8 * p * p) * n
            v = None if (i, j) in hole else v / np.linalg.norm(v) * (1000 + 3 * i + j)
            rows.append((image, i, j, 10.0 + 50 * i, 10.0 + 50 * j, *([None] * 3 if v is None else map(float, v))))
    return spark.createDataFrame(rows, "image string, i int, j int, sample double, line double, x double, y double, z double")


@pytest.mark.parametrize("where", [(1, 2, 3), (0, 0, 1), (-1, 1e-3, 0.5)])
def test_pixels_round_trip(spark, where):
    grid = grid_of(spark, "a", where).unionByName(grid_of(spark, "b", (1, 1, 1)))
    rng = np.random.default_rng(1)
    pixels = [(k, "a" if k % 3 else "b", *map(float, rng.uniform(10, 260, 2))) for k in range(300)] + [(900 + k, "a", s, v) for k, (s, v) in enumerate([(10.0, 10.0), (260.0, 260.0), (60.0, 110.0), (260.0, 10.0)])]
    px = spark.createDataFrame([*pixels, (999, "a", 9.0, 50.0), (998, "a", 50.0, 261.0), (997, "none", 50.0, 50.0)], "key long, image string, sample double, line double")
    ground = inversion.image_to_ground(px, grid)
    assert ground.count() == len(pixels)
    back = {r.key: (r.sample, r.line) for r in inversion.ground_to_image(ground, grid).collect()}
    assert set(back) == {p[0] for p in pixels}
    for key, _, s, v in pixels:
        assert back[key] == pytest.approx((s, v), abs=1e-6)


def test_ground_that_no_image_sees(spark):
    grid = grid_of(spark, "a", (1, 2, 3), hole={(2, 2)})
    center = np.array([1.0, 2.0, 3.0])
    targets = [(1, "a", *map(float, -center)), (2, "a", 3.0, -1.0, 0.0), (3, "a", None, 1.0, 1.0), (4, "b", 1.0, 2.0, 3.0), (5, "a", 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(targets, "key long, image string, x double, y double, z double")
    assert inversion.ground_to_image(df, grid).count() == 0
    inside = inversion.image_to_ground(spark.createDataFrame([("a", 120.0, 120.0), ("a", 220.0, 220.0)], "image string, sample double, line double"), grid)
    assert [(r.sample, r.line) for r in inside.collect()] == [(220.0, 220.0)]  # a hole's quads are gone
    twice = inside.unionByName(inside)
    assert inversion.ground_to_image(twice, grid).count() == 2


def test_resampling_with_and_without_data(spark):
    grid = grid_of(spark, "a", (1, 2, 3))
    pixels = [(1, 60.0, 60.0), (2, 70.0, 60.0), (3, 70.0, 85.0), (4, 110.0, 110.0), (5, 250.0, 250.0)]
    ground = inversion.image_to_ground(spark.createDataFrame([(k, "a", s, v) for k, s, v in pixels], "key long, image string, sample double, line double"), grid).withColumn("value", F.lit("mine"))
    beyond = spark.createDataFrame([(6, "a", 0.0, 0.0, -1.0)], "key long, image string, x double, y double, z double").selectExpr("key", "image", "0D sample", "0D line", "x", "y", "z", "'mine' value")
    cells = spark.createDataFrame([("a", 1, 1, 10.0), ("a", 2, 1, 30.0), ("a", 1, 2, -1.0), ("a", 2, 2, 50.0), ("a", 9, 9, 7.0)], "image string, px int, py int, value double")
    got = {r.key: r.value for r in projection.resample(ground.select(*beyond.columns).unionByName(beyond), grid, cells, -1.0, 50.0).collect()}
    # bilinear in units of 50: (1.2, 1.2), (1.4, 1.2), (1.4, 1.7), (2.2, 2.2), (5, 5); the cell (1, 2) has no data
    blend = lambda u, v: ((1 - u) * (1 - v) * 10 + u * (1 - v) * 30 + u * v * 50) / (1 - (1 - u) * v)
    assert got[1] == pytest.approx(blend(0.2, 0.2)) and got[2] == pytest.approx(blend(0.4, 0.2)) and got[3] == pytest.approx(blend(0.4, 0.7))
    assert got[4] == pytest.approx(50.0) and got[5] == got[6] == -1.0


def test_boundary_skips_what_sees_no_ground(spark):
    grid = grid_of(spark, "a", (1, 2, 3), hole={(3, 0)})
    images = spark.createDataFrame([("a", 261, 261)], "image string, samples int, lines int")
    shifted = grid.withColumns({c: (F.col(c) - 10) * 1.04 for c in ("sample", "line")})
    seen = projection.boundary(images, shifted, 1000.0, 1000.0, 6).orderBy("nth").collect()
    assert [r.nth for r in seen] == [k for k in range(20) if k not in (2, 3)] and all(abs(r.lat) <= 90 for r in seen)


# chains


def placed(spark, xyz):
    return spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(xyz)], "point_idx long, x double, y double, z double")


def found(df):
    got: dict = {}
    for r in df.orderBy("seed", "position").collect():
        got.setdefault(r.seed, []).append(r.point_idx)
    return list(got.values())


def test_chains_in_blocks_are_the_sequential_ones(spark):
    xyz = np.random.default_rng(1).integers(0, 60, (400, 3)).astype(float)  # with ties
    assert found(tracing.chains(placed(spark, xyz), 9.0, 60.0, target=60)) == lines.chains_of(xyz, 9.0, 60.0)


def test_one_component_of_many_points_in_several_tasks(spark):
    """A field of neighbours in one component (README has the figures of 100,000 points)."""
    side, rng = 100, np.random.default_rng(7)
    flat = np.stack(np.meshgrid(np.arange(side), np.arange(side)), -1).reshape(-1, 2) + rng.normal(0, 0.25, (side * side, 2))
    xyz = rng.permutation(np.concatenate([flat, np.zeros((side * side, 1))], axis=1))
    points = placed(spark, xyz)
    assert tracing.blocks(points, 1.6, 2_500).select("block").distinct().count() >= 4
    got = {r.point_idx: (r.seed, r.position) for r in tracing._settled(points, 1.6, 45.0, 2_500, 40).collect()}  # no growth of blocks
    assert got == {i: (c[0], k) for c in lines.chains_of(xyz, 1.6, 45.0) for k, i in enumerate(c)}


def test_components_are_not_cut(spark):
    """blocks never reached over the axes, so chains about a pole took a round for each crossing."""
    xyz = np.random.default_rng(4).normal(0, 6, (300, 3))
    xyz[150:] += (400.0, -300.0, 50.0)
    points = placed(spark, xyz)
    held = tracing.blocks(points, 9.0, 160)
    assert held.select("block").distinct().count() == 2 and held.where("size(readers) > 0").isEmpty()
    assert found(tracing._settled(points, 9.0, 60.0, 160, 1)) == lines.chains_of(xyz, 9.0, 60.0)
    assert tracing.blocks(points, 9.0, 40, whole=160).select("block").distinct().count() == 2
    assert tracing.blocks(points, 9.0, 40).where("size(readers) > 0").count() > 0


def test_winding_chains_make_blocks_grow(spark, monkeypatch):
    monkeypatch.setattr(tracing, "ROUNDS", 2)
    t = np.linspace(0, 20 * math.pi, 300)
    xyz = np.stack([(10 + t) * np.cos(t), (10 + t) * np.sin(t), 0 * t], axis=1)
    assert tracing._settled(placed(spark, xyz), 4.0, 60.0, 20, 2) is None
    assert found(tracing.chains(placed(spark, xyz), 4.0, 60.0, target=80)) == lines.chains_of(xyz, 4.0, 60.0)


def test_long_chains_are_simplified_in_rounds(spark):
    rng = np.random.default_rng(2)
    chains = {5: np.cumsum(rng.normal(0, 1, (300, 3)), axis=0), 9: np.zeros((4, 3)), 11: np.array([[0, 0, 0], [1, 0, 0]], float), 12: np.array([[1.0, 1, 1]])}
    rows = [(s, k, *map(float, p)) for s, xyz in chains.items() for k, p in enumerate(xyz)]
    kept = tracing.simplify(spark.createDataFrame(rows, "seed long, position long, x double, y double, z double"), 2.0)
    want = sorted((s, k) for s, xyz in chains.items() for k, v in enumerate(lines.simplified(xyz, 2.0)) if v)
    assert sorted((r.seed, r.position) for r in kept.collect()) == want


def test_filaments_with_and_without_rounds(spark):
    rng = np.random.default_rng(5)
    df = placed(spark, np.cumsum(rng.normal(0, 3, (200, 3)), axis=0)).unionByName(spark.createDataFrame([(500, None, 1.0, 1.0)], "point_idx long, x double, y double, z double"))
    a, b = (sorted(map(tuple, lines.filaments(df, 9.0, 60.0, 4, 2.0, long=n).collect())) for n in (3, 1000))
    assert a == b and len(a) == 200
    assert lines.filaments(df.limit(0), 9.0, 60.0).count() == 0


def _columns(rng, many, copies):
    """Points in columns, as heights over few places make them, some of them at the same place as others."""
    at = rng.integers(0, 5, (many, 3)) * np.array([7.0, 7.0, 0.0])
    at[:, 2] = rng.uniform(0, 5, many)
    return rng.permutation(np.concatenate([at, at[:copies], at[: copies // 2]]))


@pytest.mark.parametrize("crowd, leaf, small", [(1500, 32, 24), (20, 4, 2), (20, 4, 10**9), (10**9, 4, 2)])
def test_steps_are_found_in_small_cells_and_in_leaves(monkeypatch, crowd, leaf, small):
    for name, n in (("CROWD", crowd), ("LEAF", leaf), ("SMALL", small)):
        monkeypatch.setattr(tracing, name, n)
    rng = np.random.default_rng(11)
    for xyz in (_columns(rng, 300, 100), rng.integers(0, 30, (500, 3)).astype(float), rng.normal(0, 6, (500, 3))):
        block = tracing._Block(np.arange(len(xyz)), xyz, 9.0, 50.0)
        block.run()
        got = {int(i): (int(s), int(p)) for i, s, p in zip(block.idx, block.seed, block.position)}
        assert got == {i: (c[0], k) for c in lines.chains_of(xyz, 9.0, 50.0) for k, i in enumerate(c)}


def test_a_step_looks_into_few_of_many_neighbours(monkeypatch):
    """each step looked at every free point of 27 cells, so work grew with the square of the points at a place."""
    seen, scores = [], tracing.scores
    monkeypatch.setattr(tracing, "scores", lambda x, *rest: seen.append(len(x)) or scores(x, *rest))
    rng = np.random.default_rng(12)
    for n in (3_000, 12_000):
        xyz = np.stack([*(rng.integers(0, 3, (2, n)) * 4_000.0), rng.uniform(0, 5_000, n)], axis=1)
        seen.clear()
        tracing._Block(np.arange(n), xyz, 30_000.0, 45.0).run()
        assert sum(seen) < 200 * n


def test_blocks_of_many_points_tell_each_other(spark):
    xyz = _columns(np.random.default_rng(13), 400, 100)
    points = placed(spark, xyz)
    assert tracing.blocks(points, 9.0, 120).where("size(readers) > 0").count() > 0
    assert found(tracing._settled(points, 9.0, 50.0, 120, 60, 0)) == lines.chains_of(xyz, 9.0, 50.0)


def test_snap_of_a_network_without_offsets_is_the_same(stored, spark):
    s, counts = stored
    pts, mes = network(spark, counts)
    assert sorted(r.point_idx for r in net.snap(pts, mes, 300, 40).collect()) == sorted(r.point_idx for r in s.snap(300, 40).collect())


# windows


def fold(rows, budget):
    out = []
    for g, start, n in sorted(rows, key=lambda r: (r[0] is not None, r)):
        if out and out[-1][0] == g and out[-1][1] + out[-1][2] == start and out[-1][2] + n <= budget:
            out[-1][2] += n
        else:
            out.append([g, start, n])
    return sorted(map(tuple, out), key=lambda r: (r[0] is not None, r))


def test_long_runs_of_windows_are_folded_in_pieces(spark):
    rng, rows = np.random.default_rng(8), []
    for g, many in ((1, 300), (2, 40), (None, 60), (3, 1)):
        at = 0
        for _ in range(many):
            n = int(rng.integers(0, 9)) if rng.random() > 0.05 else 50  # some alone exceed the budget
            rows.append((g, at, n))
            at += n + (7 if rng.random() < 0.02 else 0)
    rows = list(dict.fromkeys(rows))
    df = spark.createDataFrame([rows[k] for k in rng.permutation(len(rows))], "grp int, range_start long, range_count int")
    want = fold(rows, 25)
    for longest in (7, 10_000):
        got = lod.coalesce_windows(df, 25, longest)
        assert got.dtypes == df.dtypes
        assert sorted(map(tuple, got.collect()), key=lambda r: (r[0] is not None, r)) == want


# network files


def test_parts_of_a_file_are_written_in_place(spark, tmp_path, monkeypatch):
    """Byte for byte the file that one writer would make."""
    monkeypatch.setattr(netpb, "BLOB", 300)
    rows = [(k, f"p{k}", 1, [("S", 1, float(k), 2.0)] * (k % 4)) for k in range(500)]
    df = spark.createDataFrame(rows, "point_idx long, id string, type int, measures array<struct<serialnumber:string,measure_type:int,sample:double,line:double>>")
    header = {"networkId": "n", "targetName": "Mars"}
    assert netpb.write_net(df.repartition(5), f"file://{tmp_path}/deep/a.net", header) == 500
    encoded = b"".join(len(raw).to_bytes(4, "little") + raw for r in df.orderBy("point_idx").collect() if (raw := netpb.encode_point(r.asDict(recursive=True))) is not None)
    whole = (tmp_path / "deep/a.net").read_bytes()
    assert whole.endswith(encoded) and netpb.header_of(whole[netpb.LABEL_BYTES : len(whole) - len(encoded)])[0]["networkId"] == "n"
    back = netpb.read_net(spark, f"{tmp_path}/deep/a.net")
    assert [(r.point_idx, r.id, len(r.measures)) for r in back.orderBy("point_idx").collect()] == [(k, i, len(m)) for k, i, _, m in rows]
    assert netpb.write_net(df.limit(0), f"{tmp_path}/none.net", {}) == 0 and netpb.read_net(spark, f"{tmp_path}/none.net").count() == 0
    with pytest.raises(ValueError):
        netpb.write_net(df, "hdfs://x/y.net", {})


def test_a_stopped_stream_of_points_goes_on(spark, tmp_path):
    """The second batch fails; a new query with the same checkpoint gives each point once."""
    from planisphere.streaming import windows

    rows = [(k, f"p{k}", 1, f"{k}" * 400, []) for k in range(3000)]
    df = spark.createDataFrame(rows, "point_idx long, id string, type int, chooserName string, measures array<struct<serialnumber:string>>")
    netpb.write_net(df, f"{tmp_path}/a.net", {})
    netpb.cut_net(spark, f"{tmp_path}/a.net", f"{tmp_path}/cut", windows_per_file=1)
    stream, seen = netpb.stream_net(spark, f"{tmp_path}/cut"), []

    def take(fail):
        def each(batch, number):
            if fail and number == 1:
                raise RuntimeError("stopped")
            seen.append([r.point_idx for r in batch.select("point_idx").collect()])

        return each

    with pytest.raises(Exception, match="stopped"):
        windows.each_batch(stream, take(True), f"{tmp_path}/state").awaitTermination()
    assert len(seen) == 1 and 0 < len(seen[0]) < 3000
    windows.each_batch(stream, take(False), f"{tmp_path}/state").awaitTermination()
    assert len(seen) >= 3 and sorted(i for batch in seen for i in batch) == list(range(3000))


def test_quadtree_never_broadcasts_pixels(spark):
    """Catalyst takes exploded pixels for as small as the images they come from; they were broadcast through the driver."""
    images = spark.range(4).select(F.col("id").alias("image"), F.lit(16).alias("lines"), F.lit(16).alias("samples"))
    line = images.select("image", F.explode(F.sequence(F.lit(0), F.lit(16))).alias("line"))
    sees = line.select("image", "line", F.explode(F.sequence(F.lit(0), F.lit(16))).alias("sample")).where("sample >= image * 4")
    plans, told = [], projection.stage

    def stage(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString()) if name == "quads" else None
        return told(df, name)

    projection.stage = stage
    try:
        leaves = projection.quadtree(images, sees).collect()
    finally:
        projection.stage = told
    assert plans and not any("Broadcast" in p for p in plans)
    assert sum((r.line1 - r.line0) * (r.sample1 - r.sample0) for r in leaves) == 4 * 16 * 16


def test_mixture_is_drawn_by_many_tasks(spark, monkeypatch):
    """one segment's points were all drawn by the task that held its row."""
    monkeypatch.setattr(lod, "BLOCK", 10)
    one = spark.createDataFrame([(0, 95, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 1.0, 0.0, 1.0)], "segment long, weight long, mu_x double, mu_y double, mu_z double, s0 double, s1 double, s2 double, s3 double, s4 double, s5 double")
    drawn = lod.mixture(one, 1.0).withColumn("task", F.spark_partition_id())
    rows = drawn.collect()
    assert sorted(r.nth for r in rows) == list(range(1, 96)) and len({r.task for r in rows}) > 1


def test_neighbours_send_few_copies(spark):
    """each point was sent to 27 cells; pairs are the same as by brute force, negative coordinates and cell borders included."""
    rng = np.random.default_rng(3)
    xyz = np.vstack([rng.uniform(-4, 4, (300, 3)), np.array([[-2.0, 0, 0], [-1.0, 0, 0], [0, 0, 0], [1.0, 0, 0], [2.0, 0, 0], [2.0, 1.0, 0], [2.0, 1.0, 0]])])
    pts = spark.createDataFrame([(int(k), *map(float, xyz[n])) for n, k in enumerate(rng.permutation(len(xyz)))], "point_idx long, x double, y double, z double")
    place = {r.point_idx: np.array([r.x, r.y, r.z]) for r in pts.collect()}
    want = sorted((a, b) for a in place for b in place if a < b and ((place[b] - place[a]) ** 2).sum() <= 1.0)
    found = lines.neighbours(pts, 1.0)
    assert sorted((r.a, r.b) for r in found.collect()) == want
    # counted where the join takes them in: one row a copy
    around, _ = lines.copies(pts, 1.0)
    assert around.groupBy("a").count().agg(F.max("count")).first()[0] <= 14 and around.count() < 7 * len(xyz)


def test_windows_are_decoded_by_many_tasks(spark):
    """a file's windows came from one task and were decoded by one."""
    raw = netpb.encode_point({"id": "p", "type": 1, "measures": []})
    one = spark.range(40).coalesce(1).select(F.lit(0).cast("long").alias("ahead"), F.col("id").alias("first"), F.array(F.lit(0).cast("long")).alias("starts"), F.array(F.lit(len(raw)).cast("long")).alias("sizes"), F.lit(raw).alias("raw"))
    rows = netpb.decoded(netpb.dealt(one)).select("point_idx", "id", F.spark_partition_id().alias("task")).collect()
    assert sorted((r.point_idx, r.id) for r in rows) == [(k, "p") for k in range(40)] and len({r.task for r in rows}) > 1


def _rich(k):
    """A point with every kind of field, present, empty or absent."""
    return {"id": f"p{k}" if k % 5 else "", "type": k % 3, "ignore": -1 if k % 7 == 0 else None, "referenceIndex": 300 + k, "aprioriX": k / 3 if k % 4 else None, "aprioriCovar": [float(j) for j in range(k % 7)], "measures": [
        {"serialnumber": f"Sé{m}" if m else "", "measure_type": m * 100, "sample": m + 0.5 if m % 2 else None, "measure_logType": list(range(m)), "measure_logValue": [float(j) for j in range(m)]} for m in range(k % 4)]}


def test_batches_are_encoded_and_decoded_as_points_are():
    """each row went through Python objects of its own, field by field."""
    kind = pa.struct([("serialnumber", pa.string()), ("measure_type", pa.int32()), ("sample", pa.float64()), ("measure_logType", pa.list_(pa.int32())), ("measure_logValue", pa.list_(pa.float64()))])
    schema = pa.schema([("id", pa.string()), ("type", pa.int32()), ("ignore", pa.int32()), ("referenceIndex", pa.int32()), ("aprioriX", pa.float64()), ("aprioriCovar", pa.list_(pa.float64())), ("measures", pa.list_(kind))])
    rows = [_rich(k) for k in range(60)] + [{"id": "last", "type": 1, "measures": None}]
    batch = pa.RecordBatch.from_pylist(rows, schema=schema)
    for some in (batch, batch.slice(7, 20), batch.slice(61)):
        raw = netpb._encoded(some)
        assert raw == [netpb.encode_point(r) for r in some.to_pylist()]
    points = [netpb.point(r) for r in netpb._encoded(batch)]
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(netpb.SCHEMA))
    assert netpb._columns(points, 5, arrow).to_pylist() == pa.RecordBatch.from_pylist([{"point_idx": 5 + k, **p} for k, p in enumerate(points)], schema=arrow).to_pylist()


def test_a_file_is_sent_and_staged_once(spark, tmp_path, monkeypatch):
    """a file's bytes were staged as chunks, sent to be cut, staged as windows and sent again."""
    rows = [(k, f"p{k}", 1, []) for k in range(50)]
    netpb.write_net(spark.createDataFrame(rows, "point_idx long, id string, type int, measures array<struct<serialnumber:string>>"), f"{tmp_path}/a.net", {})
    staged, plans, told = [], [], netpb.stage

    def stage(df, name, *rest):
        staged.append(name)
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return told(df, name, *rest)

    monkeypatch.setattr(netpb, "stage", stage)
    back = netpb.read_net(spark, f"{tmp_path}/a.net")
    assert staged == ["windows"] and plans[0].count("Exchange") == 1
    assert "REPARTITION" not in back._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.point_idx for r in back.collect()) == list(range(50))


def test_a_batch_of_a_stream_is_decoded_by_many_tasks(spark, tmp_path):
    """a batch was one file, which one task decoded while the others waited."""
    from planisphere.streaming import windows

    rows = [(k, f"p{k}", 1, f"{k}" * 400, []) for k in range(6000)]
    netpb.write_net(spark.createDataFrame(rows, "point_idx long, id string, type int, chooserName string, measures array<struct<serialnumber:string>>"), f"{tmp_path}/a.net", {})
    netpb.cut_net(spark, f"{tmp_path}/a.net", f"{tmp_path}/cut", windows_per_file=1)
    seen = []
    stream = netpb.stream_net(spark, f"{tmp_path}/cut", netpb.files_for_all(spark))
    windows.each_batch(stream, lambda batch, n: seen.append(batch.select("point_idx").collect()), f"{tmp_path}/state").awaitTermination()
    assert len(seen) == 1 and sorted(r.point_idx for r in seen[0]) == list(range(6000))
