"""Camera grids: image to ground by interpolation, ground to image by its inverse.

A grid holds, for each image, the ground position of the nodes of a regular raster of samples and lines: image, i, j (dense node
numbers), sample, line, x, y, z; nodes that do not see the ground are absent or null. Four neighbouring nodes are a quad, in which
positions are bilinear in sample and line.

Ground to image looks for the quads that a target's direction from the body's centre passes. Quads are entered into cells of the unit
sphere, of a size of their image, so that a target meets a few quads in an equi-join on (image, cell), however many there are. Seen
along the target's direction a quad is a bilinear map of the plane, which Newton steps invert; neither poles nor the date line are
special. A target that no quad holds has no row; one that several hold (on an edge, or where the image sees it twice) has the pixel of
the smallest line, then sample.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import product
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions.vec import Vec, unit
from .staging import stage

STEPS, EDGE = 8, 1e-9
_CORNERS = list(product((0, 1), repeat=2))


def quads(grid: DataFrame) -> DataFrame:
    """image, i, j, sample0, sample1, line0, line1 and the corners p00_x ... p11_z (sample, then line).

    A node looks at the next of its samples and then of its lines, each in sorted rows, so no map of quads is held in memory.
    """
    at = ["sample", "line", *"xyz"]
    node = grid.where("x is not null and y is not null and z is not null").select("image", "i", "j", F.struct(*at).alias("a"))
    along = node.withColumn("b", F.lead(F.struct("j", "a")).over(Window.partitionBy("image", "i").orderBy("j"))).where("b.j = j + 1")
    along = along.select("image", "i", "j", "a", F.col("b.a").alias("b"))
    made = along.withColumn("c", F.lead(F.struct("i", "a", "b")).over(Window.partitionBy("image", "j").orderBy("i"))).where("c.i = i + 1")
    node_at = {(0, 0): "a", (0, 1): "b", (1, 0): "c.a", (1, 1): "c.b"}
    ends = [F.col(f"{node_at[k, k]}.{c}").alias(f"{c}{k}") for c in ("sample", "line") for k in (0, 1)]
    return made.select("image", "i", "j", *ends, *(F.col(f"{node_at[k]}.{c}").alias(f"p{k[0]}{k[1]}_{c}") for k in _CORNERS for c in "xyz"))


def _bilinear(u: Column, v: Column, corner) -> Column:
    return corner(0, 0) * (1 - u) * (1 - v) + corner(1, 0) * u * (1 - v) + corner(0, 1) * (1 - u) * v + corner(1, 1) * u * v


def image_to_ground(pixels: DataFrame, grid: DataFrame) -> DataFrame:
    """pixels (image, sample, line) with x, y, z between the nodes around them; pixels outside the grid go.

    Rasters are regular, so a pixel's quad follows from the image's first node and steps; a pixel of the last
    sample or line takes the quad before it, others that after their node.
    """
    q = quads(grid)
    steps = grid.groupBy("image").agg(*(f(c).alias(f"{n}_{c}") for c in ("sample", "line", "i", "j") for n, f in (("low", F.min), ("high", F.max))))
    at = pixels.join(steps.hint("merge"), "image")  # pixels may be exploded from few images: never broadcast
    for c, k in (("sample", "i"), ("line", "j")):
        size = (F.col(f"high_{c}") - F.col(f"low_{c}")) / F.nullif(F.col(f"high_{k}") - F.col(f"low_{k}"), F.lit(0))
        nth = F.floor((F.col(c) - F.col(f"low_{c}")) / size) + F.col(f"low_{k}")
        inside = F.col(c).between(F.col(f"low_{c}"), F.col(f"high_{c}"))
        at = at.where(inside).withColumn(k, F.least(nth, F.col(f"high_{k}") - 1))
    at = at.drop(*(f"{n}_{c}" for c in ("sample", "line", "i", "j") for n in ("low", "high")))
    q = q.withColumns({k: F.col(k).cast("long") for k in "ij"})
    found = at.withColumns({k: F.col(k).cast("long") for k in "ij"}).join(q, ["image", "i", "j"])
    u = (F.col("sample") - F.col("sample0")) / (F.col("sample1") - F.col("sample0"))
    v = (F.col("line") - F.col("line0")) / (F.col("line1") - F.col("line0"))
    return found.select(*pixels.columns, *(_bilinear(u, v, lambda a, b, c=c: F.col(f"p{a}{b}_{c}")).alias(c) for c in "xyz"))


def _directions(q: DataFrame) -> DataFrame:
    """Quads with the box of their corners' directions and its diagonal."""
    corners = F.array(*(F.struct(*(c.alias(k) for c, k in zip(unit(Vec.of(f"p{a}{b}")), "xyz"))) for a, b in _CORNERS))
    q = q.withColumn("dirs", corners)
    ends = {f"{n}_{c}": f(F.col(f"dirs.{c}")) for c in "xyz" for n, f in (("low", F.array_min), ("high", F.array_max))}
    q = q.withColumns(ends).drop("dirs")
    return q.withColumn("wide", F.sqrt(sum(((F.col(f"high_{c}") - F.col(f"low_{c}")) ** 2 for c in "yz"), (F.col("high_x") - F.col("low_x")) ** 2)))


def _pixels(t: list[np.ndarray], p: dict, low: tuple, high: tuple) -> tuple[np.ndarray, np.ndarray]:
    """line, sample of each quad's point in the direction t, by Newton steps from the quad's middle; NaN where it has none.

    Whole batches at once: compiled into one generated method, the steps were too long for the JVM to compile further.
    """
    cross_ = lambda a, b: [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]
    dot_ = lambda a, b: a[0] * b[0] + a[1] * b[1] + a[2] * b[2]
    some = np.abs(t[0]) < 0.6
    e = cross_(t, [np.where(some, 1.0, 0.0), np.where(some, 0.0, 1.0), 0.0])  # of any length, but at right angles to t
    # the plane's coordinates: m0 + m1 u + m2 v + m3 u v
    m = []
    for axis in (e, cross_(t, e)):
        f = {k: dot_(p[k], axis) for k in _CORNERS}
        m.append((f[0, 0], f[1, 0] - f[0, 0], f[0, 1] - f[0, 0], f[0, 0] - f[1, 0] - f[0, 1] + f[1, 1]))
    u, v = np.full(len(t[0]), 0.5), np.full(len(t[0]), 0.5)
    for _ in range(STEPS):
        g = [k[0] + k[1] * u + k[2] * v + k[3] * u * v for k in m]
        gu, gv = [k[1] + k[3] * v for k in m], [k[2] + k[3] * u for k in m]
        det = gu[0] * gv[1] - gv[0] * gu[1]
        det = np.where(det == 0, np.nan, det)
        # steps stay near the quad, on their branch
        u, v = np.clip(u - (g[0] * gv[1] - g[1] * gv[0]) / det, -2.0, 3.0), np.clip(v - (g[1] * gu[0] - g[0] * gu[1]) / det, -2.0, 3.0)
    at = [p[0, 0][k] * (1 - u) * (1 - v) + p[1, 0][k] * u * (1 - v) + p[0, 1][k] * (1 - u) * v + p[1, 1][k] * u * v for k in range(3)]
    off = cross_(at, t)
    inside = (u >= -EDGE) & (u <= 1 + EDGE) & (v >= -EDGE) & (v <= 1 + EDGE) & (dot_(at, t) > 0) & (np.sqrt(dot_(off, off)) <= 1e-9 * np.sqrt(dot_(at, at)))
    return tuple(np.where(inside, a + w * (b - a), np.nan) for a, b, w in zip(low, high, (v, u)))


def _solved(met: DataFrame, kept: list[str], unseen: bool) -> DataFrame:
    """kept, sample and line of each target whose direction t one of its quads holds; with `unseen`, also of others, null.

    met: rows of one target follow one another; nth is 0 or null (no quad at all) where the next target begins. Of several quads
    the pixel of the smallest line, then sample, is taken; a target's rows may reach over batches, so the last one waits.
    """
    ends = ["line0", "sample0", "line1", "sample1"]
    corners = [f"p{a}{b}_{c}" for a, b in _CORNERS for c in "xyz"]
    met = met.select(*kept, "nth", *(f"t_{c}" for c in "xyz"), *(F.col(f"quad.{c}").alias(c) for c in [*corners, *ends]))
    fields = [met.schema[k] for k in kept]
    schema = StructType([*fields, StructField("sample", DoubleType()), StructField("line", DoubleType())])

    def told(rows: list[pa.Table], sample, line) -> pa.RecordBatch:
        columns = [pa.concat_arrays([r.column(k) for r in rows]) for k in range(len(kept))]
        out = pa.RecordBatch.from_arrays([*columns, pa.array(sample, mask=np.isnan(sample)), pa.array(line, mask=np.isnan(sample))], names=[*kept, "sample", "line"])
        return out if unseen else out.filter(pa.array(~np.isnan(sample)))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wait = None  # the last target so far: its row, sample and line
        for batch in batches:
            if not batch.num_rows:
                continue
            n = {c: batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in [*(f"t_{c}" for c in "xyz"), *corners, *ends]}
            at = {(a, b): [n[f"p{a}{b}_{c}"] for c in "xyz"] for a, b in _CORNERS}
            with np.errstate(all="ignore"):
                line, sample = _pixels([n[f"t_{c}"] for c in "xyz"], at, (n["line0"], n["sample0"]), (n["line1"], n["sample1"]))
            none = np.isnan(line) | np.isnan(sample)
            line, sample = np.where(none, np.nan, line), np.where(none, np.nan, sample)
            first = batch.column("nth").fill_null(0).to_numpy(zero_copy_only=False) == 0
            rows = batch.select(kept)
            if wait is not None and not first[0]:  # goes on with the target that waits
                line, sample, first = np.r_[wait[2], line], np.r_[wait[1], sample], np.r_[True, first]
                rows = [wait[0], rows]
            elif wait is not None:
                yield told([wait[0]], np.array([wait[1]]), np.array([wait[2]]))
                rows = [rows]
            else:
                first[0], rows = True, [rows]
            starts, target = np.flatnonzero(first), np.cumsum(first) - 1
            order = np.lexsort((sample, line, target))  # NaN comes last
            best = order[np.searchsorted(target[order], np.arange(len(starts)))]
            held = pa.Table.from_batches(rows).take(pa.array(starts)).combine_chunks().to_batches()[0]
            wait = held.slice(len(starts) - 1), float(sample[best[-1]]), float(line[best[-1]])
            if len(starts) > 1:
                yield told([held.slice(0, len(starts) - 1)], sample[best[:-1]], line[best[:-1]])
        if wait is not None:
            yield told([wait[0]], np.array([wait[1]]), np.array([wait[2]]))

    return met.mapInArrow(each, schema)


def ground_to_image(targets: DataFrame, grid: DataFrame, unseen: bool = False) -> DataFrame:
    """targets (image, x, y, z and what else they have) with the sample and line at which their image sees their direction.

    With `unseen`, targets that it does not see stay, with nulls. Of columns named sample or line the result takes the place.
    A target is sent once, to its cell of the sphere, where the quads about that cell stand in one row.
    """
    q = stage(_directions(quads(grid)), "quads")  # planned by itself: filters below would be inferred through all of it
    sizes = stage(q.groupBy("image").agg(F.nullif(F.max("wide"), F.lit(0.0)).alias("cell")), "sizes")  # its size is known, so few images are not shuffled for
    pad = F.col("wide") * F.col("wide") + 1e-9  # the sphere's bulge over a quad, and rounding
    entered = q.join(sizes, "image")
    for c in "xyz":
        low, high = (F.floor((F.col(f"{n}_{c}") + sign * pad) / F.col("cell")) for n, sign in (("low", -1), ("high", 1)))
        entered = entered.withColumn(f"cell_{c}", F.explode(F.sequence(low, high)))
    cell = ["image", "cell_x", "cell_y", "cell_z"]
    inner = [c for c in q.columns if c not in ("image", "i", "j", "wide")]
    there = entered.groupBy(*cell).agg(F.collect_list(F.struct(*inner, pad.alias("pad"))).alias("quads"))
    kept = targets.drop("sample", "line")
    asked = kept.join(sizes, "image", "left" if unseen else "inner")
    asked = unit(Vec(*(F.col(c) for c in "xyz"))).put(asked, "t")
    asked = asked.withColumns({f"cell_{c}": F.floor(F.col(f"t_{c}") / F.col("cell")) for c in "xyz"}).drop("cell")
    met = asked.join(there.hint("merge"), cell, "left" if unseen else "inner")
    within = lambda b: reduce(and_, (F.col(f"t_{c}").between(b[f"low_{c}"] - b["pad"], b[f"high_{c}"] + b["pad"]) for c in "xyz"))
    met = met.select(*kept.columns, *(f"t_{c}" for c in "xyz"), F.posexplode_outer(F.filter("quads", within)).alias("nth", "quad"))  # the quad's own box
    return _solved(met, kept.columns, unseen)
