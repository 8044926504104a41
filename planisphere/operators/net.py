"""Control networks: points own measures.

points: point_idx long and the point columns; measures: point_idx, measure_ord and the
measure columns. Order is data here: ordinals are columns, never the order of a scan.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import stage

#: Columns of a network's header, and what follows each serial in a track's key; fixed values.
HEADER = ["networkId", "targetName", "created", "lastModified", "description", "userName"]
SEPARATOR = "\x1f"


def ordinal(df: DataFrame, *order: Column | str, name: str = "ord", running: str | None = None, into: str | None = None, also: dict[str, str] | None = None) -> DataFrame:
    """df with its rank from 0 in a total order and, if asked, `into`: the sum of `running` over all rows before.

    also: further columns of whole numbers and the names of their sums.
    Rows are range-partitioned and sorted, and numbered as they are staged: a row's
    number holds its partition and its place there, so ranks take one shuffle. The
    partitions' counts, one row each (hence the broadcast), give the offsets.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = stage(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("at_", F.monotonically_increasing_id()), "ordered")
    part, value = F.shiftright("at_", 33), F.col(running) if running else F.lit(0)
    more = also or {}
    counts = dealt.groupBy(part.alias("part_")).agg(F.count("*").alias("n_"), F.sum(value).alias("all_"), *(F.sum(c).alias(f"all_{c}_") for c in more))
    ahead = Window.orderBy("part_")
    before = counts.select("part_", (F.sum("n_").over(ahead) - F.col("n_")).alias("before_"), (F.sum("all_").over(ahead) - F.col("all_")).alias("upto_"), *((F.sum(f"all_{c}_").over(ahead) - F.col(f"all_{c}_")).alias(f"upto_{c}_") for c in more))
    made = {name: (F.col("before_") + F.col("at_").bitwiseAND(F.lit(2**33 - 1))).cast("long")}
    inside = dealt.withColumn("part_", part)
    if into:
        w = Window.partitionBy("part_").orderBy("at_").rowsBetween(Window.unboundedPreceding, -1)
        inside = inside.withColumn("sum_", F.coalesce(F.sum(value).over(w), F.lit(0)))
        made[into] = (F.col("upto_") + F.col("sum_")).cast("double" if dict(df.dtypes)[running] in ("double", "float") else "long")
    if more:
        w = Window.partitionBy("part_").orderBy("at_").rowsBetween(Window.unboundedPreceding, -1)
        inside = inside.withColumns({f"sum_{c}_": F.coalesce(F.sum(c).over(w), F.lit(0)) for c in more})
        made |= {n: (F.col(f"upto_{c}_") + F.col(f"sum_{c}_")).cast("long") for c, n in more.items()}
    return inside.join(F.broadcast(before), "part_").withColumns(made).drop("part_", "at_", "sum_", "before_", "upto_", *(f"{k}_{c}_" for c in more for k in ("sum", "upto")))


def counts(points: DataFrame, measures: DataFrame) -> DataFrame:
    """n_points, n_measures, n_rows (measures and one sentinel for each point without any)."""
    per = with_counts(points, measures)
    return per.agg(F.count("*").alias("n_points"), F.sum("n_measures").alias("n_measures"), F.sum(F.greatest(F.lit(1), "n_measures")).alias("n_rows"))


def with_counts(points: DataFrame, measures: DataFrame) -> DataFrame:
    n = measures.groupBy("point_idx").agg(F.count("*").alias("n_measures"))
    return points.join(n, "point_idx", "left").withColumn("n_measures", F.coalesce("n_measures", F.lit(0)).cast("long"))


def flatten(points: DataFrame, measures: DataFrame, header: dict[str, str] | None = None) -> DataFrame:
    """One row a measure; a point without measures has a sentinel row; covariances stand on a point's first row only."""
    rows = points.join(measures.withColumn("serialnumber", F.nullif("serialnumber", F.lit(""))), "point_idx", "left")
    first = F.coalesce("measure_ord", F.lit(0)) == 0
    for c in ("aprioriCovar", "adjustedCovar"):
        if c in points.columns:
            rows = rows.withColumn(c, F.when(first & F.col(c).isNotNull(), F.col(c)).otherwise(F.array().cast("array<double>")))
    return rows.withColumns({k: F.lit(v or None).cast("string") for k, v in (header or {}).items()}) if header else rows


def unflatten(rows: DataFrame, point_columns: list[str], measure_columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """points and measures from flat rows that carry `row_ord`: a point is a run of rows with one id."""
    ranked = runs(rows)
    first = ranked.groupBy("run").agg(F.min_by(F.struct(*point_columns), "row_ord").alias("p"))
    points = first.select(F.col("run").alias("point_idx"), "p.*")
    real = ranked.where("serialnumber is not null or measure_type is not null")
    nth = F.row_number().over(Window.partitionBy("run").orderBy("row_ord")) - 1
    return points, real.select(F.col("run").alias("point_idx"), nth.cast("long").alias("measure_ord"), *measure_columns)


def runs(rows: DataFrame) -> DataFrame:
    """rows with `run`: the same id in two separate runs is two points. row_ord is the order, dense from 0."""
    before = rows.select((F.col("row_ord") + 1).alias("row_ord"), F.col("id").alias("id_before"))
    marked = rows.join(before, "row_ord", "left").withColumn("starts", F.coalesce((~F.col("id").eqNullSafe(F.col("id_before"))), F.lit(True)).cast("long"))
    marked = marked.withColumn("starts", F.when(F.col("row_ord") == 0, F.lit(1)).otherwise(F.col("starts"))).drop("id_before")
    counted = ordinal(marked, "row_ord", name="nth_", running="starts", into="run")
    return counted.withColumn("run", F.col("run") + F.col("starts") - 1).drop("nth_", "starts")


def where_range(points: DataFrame, measures: DataFrame, column: str, low: float, high: float) -> tuple[DataFrame, DataFrame]:
    """Points with the measures whose column is in [low, high]; nulls go; a string column matches nothing.

    A point keeps its covariances whichever of its measures match.
    """
    side = measures if column in measures.columns else points
    if column not in side.columns:
        raise ValueError(f"no column {column}")
    kind = dict(side.dtypes)[column]
    keep = F.col(column).between(low, high) if kind in ("double", "int") else F.lit(False)
    if side is measures:
        held = measures.where(keep)
        return points.join(held.select("point_idx").distinct(), "point_idx", "left_semi"), held
    some = points.where(keep)
    return some, measures.join(some.select("point_idx"), "point_idx", "left_semi")


def parse_where(text: str) -> tuple[str, float, float]:
    """COL:LO..HI"""
    column, colon, rest = text.partition(":")
    low, dots, high = rest.partition("..")
    if not (colon and dots):
        raise ValueError(f"not COL:LO..HI: {text}")
    return column, float(low), float(high)


def slice_points(df: DataFrame, start: int, count: int) -> DataFrame:
    return df.where((F.col("point_idx") >= start) & (F.col("point_idx") < start + count))


def point_at(points: DataFrame, i: int) -> DataFrame:
    out = points.where(F.col("point_idx") == i)
    if out.isEmpty():
        raise IndexError(i)
    return out


def offsets(points: DataFrame, measures: DataFrame) -> DataFrame:
    """point_idx, n_measures, measure_start: running sums of counts."""
    per = with_counts(points.select("point_idx"), measures)
    return ordinal(per, "point_idx", name="nth_", running="n_measures", into="measure_start").drop("nth_")


def measure_range(points: DataFrame, measures: DataFrame, i: int) -> tuple[int, int]:
    """The first measure's ordinal and the number of measures of point i; an index out of range raises."""
    ahead = measures.where(F.col("point_idx") < i).count()
    point_at(points, i)
    return ahead, measures.where(F.col("point_idx") == i).count()


def slice_rows(rows: DataFrame, start: int, count: int) -> DataFrame:
    """A window of rows by ordinal; count 0 is all."""
    return rows if count == 0 else rows.where((F.col("row_ord") >= start) & (F.col("row_ord") < start + count))


def snap(points: DataFrame, measures: DataFrame, start: int, count: int) -> DataFrame:
    """The whole points that own a measure in the window [start, start + count) of measure ordinals."""
    at = offsets(points, measures)
    return at.where((F.col("measure_start") < start + count) & (F.col("measure_start") + F.col("n_measures") > start))


def track_keys(measures: DataFrame) -> DataFrame:
    """point_idx, track_key: the sorted serials, each followed by the separator."""
    serials = F.array_sort(F.collect_list(F.coalesce("serialnumber", F.lit(""))))
    return measures.groupBy("point_idx").agg(F.array_join(F.transform(serials, lambda s: F.concat(s, F.lit(SEPARATOR))), "").alias("track_key"))


def reorder_by_track(points: DataFrame, measures: DataFrame) -> DataFrame:
    """point_idx, track_key, new_idx: a stable order by the images that see a point; byte order."""
    keyed = points.select("point_idx").join(track_keys(measures), "point_idx", "left").withColumn("track_key", F.coalesce("track_key", F.lit("")))
    return ordinal(keyed, "track_key", "point_idx", name="new_idx")


def dictionary(df: DataFrame, column: str, order: str) -> DataFrame:
    """value, code: values in the order they are first seen."""
    first = df.groupBy(F.coalesce(column, F.lit("")).alias("value")).agg(F.min(order).alias("first_"))
    return ordinal(first, "first_", "value", name="code").select("value", "code")


def decode(codes: DataFrame, dictionary: DataFrame) -> DataFrame:
    """value for each code; a code out of range is an empty string."""
    return codes.join(dictionary, "code", "left").withColumn("value", F.coalesce("value", F.lit("")))


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of either table that the other lacks, with the side: empty if they are equal as bags."""
    cols = sorted(a.columns)
    both = a.select(*cols).withColumn("w_", F.lit(1)).unionByName(b.select(*cols).withColumn("w_", F.lit(-1)))
    # either side is worked out once: rows that balance go, of the others as many are left as one side has more
    rest = both.groupBy(*cols).agg(F.sum("w_").alias("w_")).where("w_ <> 0")
    side = F.when(F.col("w_") > 0, "a").otherwise("b")
    return rest.withColumn("n_", F.explode(F.sequence(F.lit(1).cast("long"), F.abs("w_")))).withColumn("side", side).drop("w_", "n_")


def concatenate(parts: list[tuple[DataFrame, DataFrame]], sizes: list[int]) -> tuple[DataFrame, DataFrame]:
    """Networks one after the other; sizes are their numbers of points."""
    starts = [sum(sizes[:k]) for k in range(len(sizes))]
    shift = lambda df, s: df.withColumn("point_idx", F.col("point_idx") + s)
    both = [[shift(part[side], s) for part, s in zip(parts, starts)] for side in (0, 1)]
    return tuple(reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), dfs) for dfs in both)
