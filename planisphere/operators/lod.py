"""Levels of detail: Gaussian segments, density grids, windows, sampling."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .net import ordinal
from .staging import discard, stage


#: Points of a mixture that are counted out from one row.
BLOCK = 20_000


def segment(idx: Column, n: Column, k: int) -> Column:
    """The segment of an ordinal: boundaries floor(s * n / k), for min(k, n) segments."""
    least = F.least(F.lit(k), n)
    return F.expr("0").cast("long") + F.floor(((idx + 1) * least - 1) / n)


def gaussian(points: DataFrame, k: int, n: int, xyz: tuple[str, str, str] = ("x", "y", "z")) -> DataFrame:
    """Means, population covariances (xx xy xz yy yz zz) and weights of k contiguous segments.

    Points without coordinates count for the range, not for the weight; a segment
    without any has no row.
    """
    x, y, z = xyz
    seg = points.withColumn("segment", segment(F.col("point_idx"), F.lit(n), k).cast("long"))
    have = F.col(x).isNotNull()
    pairs = [(x, x), (x, y), (x, z), (y, y), (y, z), (z, z)]
    out = seg.groupBy("segment").agg(
        F.min("point_idx").alias("range_start"), F.count("*").alias("range_count"), F.count_if(have).alias("weight"),
        *(F.avg(c).alias(f"mu_{a}") for a, c in zip("xyz", xyz)),
        *(F.covar_pop(a, b).alias(f"s{i}") for i, (a, b) in enumerate(pairs)),
    )
    return out.where("weight > 0")


def density(lat_lon: DataFrame, tiles_lon: int = 72, tiles_lat: int = 36) -> DataFrame:
    """ty, tx, n over the dense grid; lat and lon in radians, clamped to the edges."""
    cell = lambda v, n: F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor(v * n))).cast("int")
    found = lat_lon.where("lat is not null").groupBy(cell((F.col("lat") + math.pi / 2) / math.pi, tiles_lat).alias("ty"), cell((F.col("lon") + math.pi) / (2 * math.pi), tiles_lon).alias("tx")).agg(F.count("*").alias("n"))
    grid = lat_lon.sparkSession.range(tiles_lat * tiles_lon).select(F.floor(F.col("id") / tiles_lon).cast("int").alias("ty"), (F.col("id") % tiles_lon).cast("int").alias("tx"))
    return grid.join(found, ["ty", "tx"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def drill_down(summary: DataFrame, points: DataFrame, k: int, n: int) -> DataFrame:
    """The points of each segment: the range join as an equi-join on the segment."""
    return points.withColumn("segment", segment(F.col("point_idx"), F.lit(n), k).cast("long")).join(summary, "segment")


def wedges(points: DataFrame) -> DataFrame:
    """x and z turned to an azimuth, atan2(x, z)."""
    return points.withColumn("azimuth", F.atan2("x", "z"))


def azimuth_order(points: DataFrame, digits: int | None = None) -> DataFrame:
    """points with azimuth (rounded to digits, if given) and azimuth_rank, from 0; equal azimuths in the order of point_idx."""
    turned = wedges(points)
    turned = turned if digits is None else turned.withColumn("azimuth", F.round("azimuth", digits))
    return ordinal(turned, "azimuth", "point_idx", name="azimuth_rank")


def coalesce_windows(windows: DataFrame, budget: int, longest: int = 100_000) -> DataFrame:
    """Adjacent (range_start, range_count) windows of a group merged, from the first on, while a merged one stays within budget.

    Windows are first cut at gaps into runs, by ordinals of all windows. If no run is longer than `longest`, a task folds each run's
    sorted rows; otherwise `_jumps` folds them in pieces of that many windows, with the same result. Counts are not negative.
    """
    ranked = ordinal(windows.select("grp", "range_start", "range_count"), "grp", "range_start", "range_count", name="at", running="range_count", into="ahead")
    before = ranked.select((F.col("at") + 1).alias("at"), F.col("grp").alias("grp_before"), (F.col("range_start") + F.col("range_count")).alias("end_before"))
    joined = F.col("grp").eqNullSafe(F.col("grp_before")) & F.col("range_start").eqNullSafe(F.col("end_before"))
    marked = ranked.join(before, "at", "left").withColumn("starts", F.when(joined, 0).otherwise(1)).drop("grp_before", "end_before")
    runs = stage(ordinal(marked, "at", name="nth", running="starts", into="run").withColumn("run", F.col("run") + F.col("starts")), "runs")
    ends = runs.groupBy("run").agg(F.count("*").alias("n"), (F.max("at") + 1).alias("end"))
    if (ends.agg(F.max("n")).first()[0] or 0) > longest:
        return _jumps(runs, ends, budget, longest).select(*(F.col(c).cast(t).alias(c) for c, t in windows.select("grp", "range_start", "range_count").dtypes))

    def fold(batches):
        last = None
        for pdf in batches:
            out = []
            for row in zip(pdf["run"], pdf["grp"], pdf["range_start"], pdf["range_count"]):
                if last and last[0] == row[0] and last[3] + row[3] <= budget:
                    last = (*last[:3], last[3] + row[3])
                else:
                    out += [last[1:]] if last else []
                    last = row
            yield pd.DataFrame(out, columns=["grp", "range_start", "range_count"])
        if last:
            yield pd.DataFrame([last[1:]], columns=["grp", "range_start", "range_count"])

    kinds = dict(windows.dtypes)
    schema = f"grp {kinds['grp']}, range_start {kinds['range_start']}, range_count {kinds['range_count']}"
    return runs.select("run", "at", "grp", "range_start", "range_count").repartition("run").sortWithinPartitions("run", "at").mapInPandas(fold, schema)


def _jumps(runs: DataFrame, ends: DataFrame, budget: int, piece: int) -> DataFrame:
    """The fold of long runs: where each window's merged window would end is known from running sums alone; then only the path of these
    jumps from each run's first window has to be found, inside pieces by a task each and from piece to piece by doubled jumps.
    """
    # the first window that no longer fits: so many ends lie within the budget from a window's own start
    value, least = F.col("ahead") + F.col("range_count"), runs.select("at", (F.col("ahead") + budget).alias("value"), F.lit(1).alias("kind"), F.lit(0).cast("long").alias("is_end"))
    events = least.unionByName(runs.select("at", value.alias("value"), F.lit(0).alias("kind"), F.lit(1).cast("long").alias("is_end")))
    found = ordinal(events, "value", "kind", "at", name="nth_", running="is_end", into="within").where("kind = 1").select("at", "within")
    steps = runs.join(found, "at").join(ends.select("run", "end"), "run")
    steps = steps.withColumn("next", F.least("end", F.greatest(F.col("at") + 1, "within"))).withColumn("last", F.col("next") >= F.col("end"))
    steps = stage(steps.select("at", "grp", "range_start", "ahead", "next", "last", F.col("starts").alias("head"), F.floor(F.col("at") / piece).alias("piece")), "steps")

    def leave(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("at")
        low, at, nxt, last = int(pdf["at"].iloc[0]), pdf["at"].tolist(), pdf["next"].tolist(), pdf["last"].tolist()
        out: list[int | None] = [None] * len(at)
        for k in reversed(range(len(at))):
            if not last[k]:
                out[k] = nxt[k] if nxt[k] - low >= len(at) else out[nxt[k] - low]
        return pd.DataFrame({"at": at, "to": pd.array(out, dtype="Int64")})

    # jumps out of the piece, doubled until none is left
    far = [stage(steps.groupBy("piece").applyInPandas(leave, "at long, to long").where("to is not null"), "jumps")]
    while not far[-1].isEmpty():
        again = far[-1].select(F.col("at").alias("to"), F.col("to").alias("further"))
        far.append(stage(far[-1].join(again, "to").select("at", F.col("further").alias("to")), "jumps"))
    reached = stage(steps.where("head = 1").select("at"), "reached")
    for jumps in reversed(far[:-1]):
        more = reached.join(jumps, "at").select(F.col("to").alias("at"))
        was, reached = reached, stage(reached.unionByName(more).distinct(), "reached")
        discard(was)

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("at")
        low, at, nxt, last = int(pdf["at"].iloc[0]), pdf["at"].tolist(), pdf["next"].tolist(), pdf["last"].tolist()
        out = []
        for k in pdf["entry"].to_numpy().nonzero()[0].tolist():
            while True:
                out.append((at[k], nxt[k]))
                if last[k] or nxt[k] - low >= len(at):
                    break
                k = nxt[k] - low
        return pd.DataFrame(out, columns=["at", "next"])

    entered = steps.join(reached.withColumn("entry", F.lit(True)), "at", "left").select("at", "next", "last", "piece", F.coalesce("entry", F.lit(False)).alias("entry"))
    starts = entered.groupBy("piece").applyInPandas(walk, "at long, next long")
    total = runs.agg(F.sum("range_count")).first()[0]
    upto = steps.select(F.col("at").alias("next"), F.col("ahead").alias("upto"))
    whole = starts.join(upto, "next", "left").join(steps.select("at", "grp", "range_start", "ahead"), "at")
    return whole.select("grp", "range_start", (F.coalesce("upto", F.lit(total)) - F.col("ahead")).alias("range_count"))


def allotment(weights: DataFrame, total: int) -> DataFrame:
    """idx, share: total dealt by weight, as differences of the rounded running sum."""
    every = float(weights.agg(F.sum("weight")).first()[0] or 0.0) or 1.0
    summed = ordinal(weights.select("idx", F.col("weight").cast("double").alias("weight")), "idx", name="nth", running="weight", into="ahead")
    upto = lambda c: F.round(c / every * total)
    return summed.select("idx", (upto(F.col("ahead") + F.col("weight")) - upto(F.col("ahead"))).cast("long").alias("share"))


def cholesky(s: list[Column]) -> list[Column]:
    """Lower triangle (l00 l10 l11 l20 l21 l22) of a covariance xx xy xz yy yz zz; small pivots give zeros."""
    root = lambda v: F.sqrt(F.greatest(v, F.lit(0.0)))
    over = lambda v, p: F.when(p > 1e-9, v / F.nullif(p, F.lit(0.0))).otherwise(F.lit(0.0))
    xx, xy, xz, yy, yz, zz = s
    l00 = root(xx)
    l10, l20 = over(xy, l00), over(xz, l00)
    l11 = root(yy - l10 * l10)
    l21 = over(yz - l20 * l10, l11)
    return [l00, l10, l11, l20, l21, root(zz - l20 * l20 - l21 * l21)]


def normal(counter: Column) -> Column:
    """A standard normal number that depends on the counter's text alone: two uniform numbers of its digest, by Box and Muller."""
    digest = F.md5(counter)
    word = lambda at: F.conv(F.substring(digest, at, 13), 16, 10).cast("long")
    return F.sqrt(-2 * F.log((word(1) + 0.5) / 2.0**52)) * F.cos(2 * math.pi * (word(14) / 2.0**52))


def mixture(summary: DataFrame, per_weight: float, seed: int = 7) -> DataFrame:
    """Points drawn from each segment's Gaussian: mu + L z. A point depends on seed, segment and nth, not on partitions or order."""
    low = cholesky([F.col(f"s{i}") for i in range(6)])
    # numbers in blocks, dealt to all tasks before they are counted out: segments are few, and as large as the network
    many = F.greatest(F.lit(1), F.round(F.col("weight") * per_weight).cast("int"))
    df = summary.withColumns({f"l{i}": c for i, c in enumerate(low)}).withColumn("many", many).withColumn("block", F.explode(F.sequence(F.lit(0), F.floor((F.col("many") - 1) / BLOCK).cast("int"))))
    df = df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "segment", "block")
    df = df.withColumn("nth", F.explode(F.sequence(F.col("block") * BLOCK + 1, F.least("many", (F.col("block") + 1) * BLOCK))))
    df = df.withColumns({f"g{i}": normal(F.concat_ws(":", F.lit(str(seed)), F.col("segment").cast("string"), F.col("nth").cast("string"), F.lit(str(i)))) for i in range(3)})
    g = [F.col(f"g{i}") for i in range(3)]
    q = [F.col(f"l{i}") for i in range(6)]
    return df.select("segment", "nth", (F.col("mu_x") + q[0] * g[0]).alias("x"), (F.col("mu_y") + q[1] * g[0] + q[2] * g[1]).alias("y"), (F.col("mu_z") + q[3] * g[0] + q[4] * g[1] + q[5] * g[2]).alias("z"))


def resample(vertices: DataFrame, spacing: float, budget: int) -> DataFrame:
    """Equal steps of arc length along each line: line_id, nth, x, y, z.

    vertices: line_id, v (order), x, y, z. A line gets max(its vertices, floor(arc / eff)
    + 1) samples, eff the spacing or, if coarser, all arc over the budget.
    """
    w = Window.partitionBy("line_id").orderBy("v")
    nxt = lambda c: F.lead(c).over(w)
    seg = vertices.withColumns({f"{c}1": nxt(c) for c in "xyz"}).withColumn("len", F.coalesce(F.sqrt(sum(((F.col(f"{c}1") - F.col(c)) ** 2 for c in "yz"), (F.col("x1") - F.col("x")) ** 2)), F.lit(0.0)))
    seg = seg.withColumn("at", F.sum("len").over(w) - F.col("len"))
    line = seg.groupBy("line_id").agg(F.sum("len").alias("arc"), F.count("*").alias("nv"), F.max("v").alias("last"))
    total = line.agg(F.sum("arc")).first()[0] or 0.0
    eff = max(spacing, total / max(1, budget))
    line = line.withColumn("ns", F.when(F.col("nv") <= 1, F.col("nv")).otherwise(F.greatest("nv", F.floor(F.col("arc") / eff) + 1)))
    want = line.withColumn("nth", F.explode(F.sequence(F.lit(0).cast("long"), F.col("ns") - 1))).withColumn("target", F.when(F.col("ns") <= 1, F.lit(0.0)).otherwise(F.col("nth") * (F.col("arc") / F.greatest(F.lit(1), F.col("ns") - 1))))
    # samples and vertices in one order along the line: each sample takes the last vertex at or before it
    at = seg.join(line.select("line_id", "nv"), "line_id").where(F.col("x1").isNotNull() | (F.col("nv") == 1))
    vertex = F.struct(*(F.col(c) for c in ("x", "y", "z", "x1", "y1", "z1", "len", "at")))
    both = at.select("line_id", F.col("at").alias("pos"), (-F.col("v")).alias("tie"), vertex.alias("p"), F.lit(None).cast("long").alias("nth"))
    both = both.unionByName(want.select("line_id", F.col("target").alias("pos"), F.lit(1).cast(dict(vertices.dtypes)["v"]).alias("tie"), F.lit(None).cast(both.schema["p"].dataType).alias("p"), "nth"))
    along = Window.partitionBy("line_id").orderBy("pos", "tie").rowsBetween(Window.unboundedPreceding, 0)
    pick = both.withColumn("p", F.last("p", ignorenulls=True).over(along)).where("nth is not null")
    t = F.when(F.col("p.len") > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("pos") - F.col("p.at")) / F.nullif("p.len", F.lit(0.0))))).otherwise(0.0)
    return pick.select("line_id", "nth", *((F.col(f"p.{c}") + t * (F.coalesce(f"p.{c}1", f"p.{c}") - F.col(f"p.{c}"))).alias(c) for c in "xyz"))


def meshgrid(spark, low_lon: float, high_lon: float, nx: int, low_lat: float, high_lat: float, ny: int) -> DataFrame:
    """row, col, lat, lon (radians) over a grid with both ends; one row or column stands at the low end."""
    step = lambda a, b, n: (b - a) / (n - 1) if n > 1 else 0.0
    g = spark.range(nx * ny).select(F.floor(F.col("id") / nx).alias("row"), (F.col("id") % nx).alias("col"))
    return g.select("row", "col", F.radians(low_lat + F.col("row") * step(low_lat, high_lat, ny)).alias("lat"), F.radians(low_lon + F.col("col") * step(low_lon, high_lon, nx)).alias("lon"))


def ring_grid(spark, rings: int, equator: int, a: float, c: float) -> DataFrame:
    """ring, k, x, y, z: rings at latitude centres (parametric), fewer points towards the poles."""
    r = spark.range(rings).select(F.col("id").alias("ring"), (-math.pi / 2 + math.pi * ((F.col("id") + 0.5) / rings)).alias("lat"))
    r = r.withColumn("n", F.greatest(F.lit(1), F.round(equator * F.cos("lat")).cast("int"))).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    lon = 2 * math.pi * F.col("k") / F.col("n")
    return r.select("ring", "k", (a * F.cos("lat") * F.cos(lon)).alias("x"), (a * F.cos("lat") * F.sin(lon)).alias("y"), (c * F.sin("lat")).alias("z"))
