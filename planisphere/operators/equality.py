"""Equality of two networks as sets of whole points, in any order.

A point's digest takes its attributes and the bag of its measures; ordinals have no part in it. A digest is two 64-bit hashes of typed
values, a bag's is sums of three 32-bit pieces of its measures' hashes, so measures are summed before they are shuffled and a point may
have any number of them. Networks are equal if each digest is held by as many points on either side.

Nulls equal nulls, NaN equals NaN, -0.0 equals 0.0; lists compare in their order. Columns that only one side has count as null on
the other. Points without partners are compared again within a tolerance, if one is given.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import discard, stage

_ORDINALS = {"point_idx", "measure_ord", "measure_idx", "measure_start", "row_start", "n_measures", "row_ord"}
#: Kinds whose values are the same in a wider one; a side's column is hashed as that.
_WIDER = {**dict.fromkeys(("tinyint", "smallint", "int"), "bigint"), "float": "double", **{f"array<{k}>": "array<bigint>" for k in ("tinyint", "smallint", "int")}, "array<float>": "array<double>"}
_TYPED = {"bigint", "double", "string", "boolean", "array<bigint>", "array<double>", "array<string>"}
#: Pairs whose numbers are sent to every task, so that other points' measures stay where they are.
_FEW = 1_000_000


def _text(column: str, kind: str) -> Column:
    """A value as text that equals another's if, and only if, the values do."""
    c = F.col(column)
    zero = lambda v: F.when(v == 0, F.lit(0).cast("double")).otherwise(v.cast("double")).cast("string")
    if kind in ("double", "float"):
        c = zero(c)
    elif kind.startswith("array<"):
        each = zero if kind in ("array<double>", "array<float>") else lambda v: v.cast("string")
        c = F.array_join(F.transform(c, lambda v: F.coalesce(each(v), F.lit("\x02"))), "\x1e")
    return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("\x01"))


def _kinds(a: DataFrame, b: DataFrame) -> dict[str, str]:
    """The compared columns and the kind that both sides' values are hashed as; text where it is not one of the usual or not the same."""
    held = [{c: _WIDER.get(k, k) for c, k in df.dtypes} for df in (a, b)]
    kinds = {c: {h[c] for h in held if c in h} for c in compared(a, b)}
    return {c: k if len(ks) == 1 and (k := next(iter(ks))) in _TYPED else "text" for c, ks in kinds.items()}


def _digest(df: DataFrame, kinds: dict[str, str]) -> list[Column]:
    """Two hashes of a row's values, each beside whether it is null, as hashes skip nulls."""
    own, parts = dict(df.dtypes), []
    for c, kind in kinds.items():
        if kind == "text":
            parts.append(_text(c, own[c]) if c in own else F.lit("\x01"))
            continue
        v = F.col(c).cast(kind) if c in own else F.lit(None).cast(kind)
        v = F.when(v == 0, F.lit(0.0)).otherwise(v) if kind == "double" else v
        parts += [v, F.transform(v, lambda e: e.isNull()) if kind.startswith("array<") else F.lit(False), v.isNull()]
    return [F.xxhash64(F.lit(seed), *parts) for seed in (1, 2)]


def digests(points: DataFrame, measures: DataFrame, point_kinds: dict[str, str], measure_kinds: dict[str, str]) -> DataFrame:
    """point_idx, d1, d2 of every point: its digest."""
    low = F.lit(2**32 - 1)
    h1, h2 = _digest(measures, measure_kinds)
    each = measures.select("point_idx", h1.alias("h1"), h2.alias("h2"))
    bag = each.groupBy("point_idx").agg(F.sum(F.col("h1").bitwiseAND(low)).alias("s1"), F.sum(F.shiftrightunsigned("h1", 32)).alias("s2"), F.sum(F.col("h2").bitwiseAND(low)).alias("s3"))
    own = points.select("point_idx", *(h.alias(n) for n, h in zip(("o1", "o2"), _digest(points, point_kinds))))
    sums = [F.coalesce(c, F.lit(-1)) for c in ("s1", "s2", "s3")]  # -1: no measures
    return own.join(bag, "point_idx", "left").select("point_idx", *(F.xxhash64(o, *sums).alias(d) for o, d in (("o1", "d1"), ("o2", "d2"))))


def compared(a: DataFrame, b: DataFrame) -> list[str]:
    return sorted((set(a.columns) | set(b.columns)) - _ORDINALS)


def unmatched(a: tuple[DataFrame, DataFrame], b: tuple[DataFrame, DataFrame]) -> DataFrame:
    """side, point_idx of the points that have no equal on the other side: of n and m equal points, the last n - m in order; a staged table.

    A digest that one point alone has names it; only digests that several points share, in unequal numbers, are looked up again.
    """
    kinds = _kinds(a[0], b[0]), _kinds(a[1], b[1])
    both = [stage(digests(*x, *kinds), "digests") for x in (a, b)]
    each = reduce(DataFrame.unionByName, (d.withColumn("is_b", F.lit(k)) for k, d in enumerate(both)))
    counts = each.groupBy("d1", "d2").agg(F.count("*").alias("n"), F.sum("is_b").alias("n_b"), F.min("point_idx").alias("point_idx"))
    several = lambda c: F.when(F.col("n") > 1, F.col(c)).alias(c)
    held = stage(counts.where("n <> 2 * n_b").select(several("d1"), several("d2"), (F.col("n") - F.col("n_b")).alias("n_a"), "n_b", "point_idx"), "counts")
    side = lambda of: F.when(of, F.lit("b")).otherwise(F.lit("a")).alias("side")
    left = held.where("n_a + n_b = 1").select(side(F.col("n_b") == 1), "point_idx")
    shared = held.where("n_a + n_b > 1").drop("point_idx")
    if shared.limit(1).count():
        shared = stage(shared, "shared")
        for s, d, other in (("a", both[0], "n_b"), ("b", both[1], "n_a")):
            rest = d.join(shared, ["d1", "d2"]).where(f"n_{s} > {other}")
            alone = rest.where(f"{other} = 0")  # no ranks where all are without partner
            nth = F.row_number().over(Window.partitionBy("d1", "d2").orderBy("point_idx"))
            some = rest.where(f"{other} > 0").withColumn("nth", nth).where(F.col("nth") > F.col(other)).drop("nth")
            left = left.unionByName(alone.unionByName(some).select(F.lit(s).alias("side"), "point_idx"))
        left = stage(left, "unmatched")
    discard(*both)
    return left


def differences(a: tuple[DataFrame, DataFrame], b: tuple[DataFrame, DataFrame], tolerance: float | None = None) -> DataFrame:
    """side, id, point_idx of the points without an equal on the other side; none if the networks are equal.

    With a tolerance, points left over are paired by id, their order among those of one id, and measures by serial number and the
    order of their samples; pairs go whose numbers all differ by no more than tolerance * max(1, size) and whose other values are equal.
    """
    left = unmatched(a, b)
    named = lambda s, x, *more: x[0].select("id", "point_idx", *more).join(left.where(F.col("side") == s).select("point_idx"), "point_idx", "left_semi").select(F.lit(s).alias("side"), "*")
    if tolerance is None:
        return named("a", a).unionByName(named("b", b)).select("side", "id", "point_idx")
    kinds = _kinds(a[0], b[0])
    own = lambda df: (h.alias(n) for n, h in zip(("o1", "o2"), _digest(df, kinds)))
    met = stage(_met(named("a", a, *own(a[0])).unionByName(named("b", b, *own(b[0])))), "met")
    pairs = met.where("a_idx is not null and b_idx is not null")
    far = stage(_far_points(pairs.where("not same"), a[0], b[0], tolerance).union(_far_measures(pairs.select("a_idx", "b_idx"), a[1], b[1], tolerance)).distinct(), "far")
    out = met.where("a_idx is null or b_idx is null").unionByName(pairs.join(far, "a_idx", "left_semi"), allowMissingColumns=True)
    sides = F.array(*(F.struct(F.lit(s).alias("side"), F.col(f"{s}_idx").alias("point_idx")) for s in "ab"))
    return out.select("id", F.explode(sides).alias("p")).where("p.point_idx is not null").select("p.side", "id", "p.point_idx")


def _met(rows: DataFrame) -> DataFrame:
    """id, a_idx, b_idx, same (own values are equal) of points (side, id, point_idx, o1, o2) in pairs of one id and place; a null where one is alone."""
    nth = F.row_number().over(Window.partitionBy("id", "side").orderBy("point_idx"))
    at = lambda s: F.min(F.when(F.col("side") == s, F.col("point_idx"))).alias(f"{s}_idx")
    same = (F.min("o1") == F.max("o1")) & (F.min("o2") == F.max("o2"))
    return rows.where("id is not null").repartition("id").withColumn("nth", nth).groupBy("id", "nth").agg(at("a"), at("b"), same.alias("same")).drop("nth").unionByName(
        rows.where("id is null").select("id", *(F.when(F.col("side") == s, F.col("point_idx")).alias(f"{s}_idx") for s in "ab"), F.lit(False).alias("same"))
    )


def _alike(df_a: DataFrame, df_b: DataFrame, columns: list[str], tolerance: float) -> Column:
    """Whether the columns of a joined row (a_..., b_...) agree."""
    kinds_a, kinds_b, out = dict(df_a.dtypes), dict(df_b.dtypes), F.lit(True)
    near = lambda x, y: F.coalesce(F.abs(x - y) <= tolerance * F.greatest(F.lit(1.0), F.abs(x)), F.lit(False)) | x.eqNullSafe(y)
    for c in columns:
        x, y = F.col(f"a_{c}"), F.col(f"b_{c}")
        if c not in kinds_a or c not in kinds_b:
            out = out & (y if c in kinds_b else x).isNull()
        elif kinds_a[c] in ("double", "float") and kinds_b[c] in ("double", "float"):
            out = out & near(x.cast("double"), y.cast("double"))
        elif kinds_a[c] in ("array<double>", "array<float>"):
            each = F.coalesce((F.size(x) == F.size(y)) & F.forall(F.zip_with(x, y, near), lambda ok: ok), F.lit(False))
            out = out & (x.eqNullSafe(y) | each)
        else:
            out = out & x.eqNullSafe(y)
    return out


def _far_points(pairs: DataFrame, pa: DataFrame, pb: DataFrame, tolerance: float) -> DataFrame:
    """a_idx of the pairs whose own values do not agree."""
    pairs = stage(pairs.select("a_idx", "b_idx"), "pairs")
    columns = [c for c in compared(pa, pb) if c != "id"]
    named = lambda df, s: df.select(*(F.col(c).alias(f"{s}_idx" if c == "point_idx" else f"{s}_{c}") for c in df.columns if c == "point_idx" or c in columns))
    both = pairs.join(named(pa, "a"), "a_idx").join(named(pb, "b"), "b_idx")
    return both.where(~_alike(pa, pb, columns, tolerance)).select("a_idx")


def _far_measures(pairs: DataFrame, ma: DataFrame, mb: DataFrame, tolerance: float) -> DataFrame:
    """a_idx of the pairs whose measures do not agree (and, where pairs are many, of points in no pair).

    Measures of both sides are dealt by pair once and meet as neighbours in its order, so that neither ranks nor partners are shuffled.
    """
    columns, held = compared(ma, mb), [dict(m.dtypes) for m in (ma, mb)]
    few = pairs.limit(_FEW + 1).count() <= _FEW
    by = [c for c in ("sample", "line") if c in ma.columns and c in mb.columns] or ["measure_ord"]

    def own(m: DataFrame, k: int) -> DataFrame:
        value = lambda c: (F.col(c) if c in held[k] else F.lit(None)).cast(_common({h[c] for h in held if c in h})).alias(c)
        return m.select(F.col("point_idx").alias(f"{'ab'[k]}_idx"), F.lit(k).alias("is_b"), *(value(c) for c in dict.fromkeys([*columns, *by])))

    mine = own(ma, 0)
    mine = mine.join(F.broadcast(pairs.select("a_idx")), "a_idx", "left_semi") if few else mine
    other = own(mb, 1).join(F.broadcast(pairs) if few else pairs, "b_idx").drop("b_idx")
    dealt = mine.unionByName(other).repartition("a_idx").withColumn("serial", F.coalesce("serialnumber", F.lit("\x01")))
    mth = F.row_number().over(Window.partitionBy("a_idx", "serial", "is_b").orderBy(*by))
    pair = Window.partitionBy("a_idx", "serial", "mth").orderBy("is_b")
    met = dealt.withColumn("mth", mth).withColumns({"a": F.lag(F.struct(*columns)).over(pair), "before": F.lag("is_b").over(pair), "after": F.lead("is_b").over(pair)})
    met = met.select("a_idx", "is_b", "before", "after", *(F.col("a")[c].alias(f"a_{c}") for c in columns), *(F.col(c).alias(f"b_{c}") for c in columns))
    return met.where(F.when(F.col("is_b") == 0, F.col("after").isNull()).otherwise(F.col("before").isNull() | ~_alike(ma, mb, columns, tolerance))).select("a_idx")


def _common(kinds: set[str]) -> str:
    """The kind that holds the values of both sides' columns."""
    wide = {_WIDER.get(k, k) for k in kinds}
    return next(iter(kinds)) if len(kinds) == 1 else next(iter(wide)) if len(wide) == 1 else "double" if wide == {"bigint", "double"} else "string"
