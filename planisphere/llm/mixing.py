"""Operator 4, mixing sources to target weights by entropy balancing.

Document rates r minimise the divergence sum(size * (r log r - r)) from one copy of
each document, under token constraints: each source's words meet its target, and, where
further margins are given (a language, a length class), so do the words of each of their
groups. The solution is exponentially tilted, r = exp(sum of the dual variables of the
groups a document is in). Rates depend on groups alone, so documents are first summed
into cells, and Newton steps on the convex dual run over the cells in Spark.

A step solves the joint system of all margins. Its Hessian holds the words that two
groups share. The sources' block is diagonal, as a document has one source, so sources
are eliminated where they are, a row each; what is left, the Schur complement on the
groups of the further margins (at most SMALL), is summed in Spark and solved on the
driver. Joint steps are halved until they bring the constraints closer; constraints that
stay missed, as when they contradict each other, are an error.

Rates become whole copies by order sampling: every document of a source takes
floor(rate) copies; one more goes to those that come first in the order of a hash of
doc_id, until the words that are still wanted are reached to within half a document.
Long documents are rounded first, and shorter ones make up what they left. The place
to stop is found from sums over 4096 hash ranges and then inside the one range where it
falls, so no task sees a whole source, and reruns agree. With further margins, each cell
is rounded so by itself.

Defined cases: null text has size 0; a null source is a source of its own, last in
order; without a doc_id a row is ordered by its text's hash; of rows that repeat a doc_id (or,
without one, a text) and a size, as many take one more copy as the target needs; sources without words have target 0; an empty table gives no rows.
size, source_size, target, rate, copies and taken replace columns of these names in
`mix`; `mix_copies` keeps the input's and gives its own another name.
The list of sources is ranked in one task: it holds a row for each source.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, n_words, stage

WEIGHTS, MOST = (5, 2, 1), 3
#: Newton steps at most, the longest move of a variable, and the relative miss at which they end.
STEPS, LONGEST_STEP, TOLERANCE = 60, 2.0, 1e-10
#: How often a joint step is halved before it counts as none.
HALVINGS = 10
#: Groups of all margins but the first, at most.
SMALL = 2000
_RANGES_BITS, _HASH_BITS = 12, 52
#: Documents of more words than these are rounded first.
LEVELS = (1024, 128)


def source_key(source: Column) -> Column:
    """Sorts by code point, null last, and is never null."""
    return F.coalesce(F.concat(F.lit("0"), source.cast("string")), F.lit("1"))


def order_hash(doc_id: Column, text: Column | None = None) -> Column:
    """52 bits of the MD5 of doc_id as text; of the text where there is no doc_id, so that such rows are spread too."""
    own = F.coalesce(doc_id.cast("string"), F.concat(F.lit("text:"), F.coalesce(text, F.lit(""))) if text is not None else F.lit(""))
    return F.conv(F.substring(F.md5(own.cast("binary")), 1, 13), 16, 10).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """key, mass, target, from key and mass: weights repeat in the order of keys and share all words.

    A target stops at `most` times its source's mass, and the excess is shared again by
    weight among the rest until none is above: the level at which min(most * mass,
    level * weight) sums to all words.
    """
    order = Window.orderBy("key")
    nth = (F.row_number().over(order) - 1) % len(weights)
    w = F.element_at(F.array(*map(F.lit, weights)), nth.cast("int") + 1).cast("double")
    s = sources.select("key", "mass", w.alias("w"), (F.col("mass") * F.lit(most)).alias("cap"))
    by = Window.orderBy(F.col("cap") / F.col("w"), "key")
    every = Window.partitionBy()
    s = s.select(
        "*",
        (F.sum("cap").over(by) - F.col("cap")).alias("capped_before"),
        (F.sum("w").over(every) - F.sum("w").over(by) + F.col("w")).alias("w_left"),
        F.sum("mass").over(every).alias("total"),
    )
    s = s.withColumn("level", (F.col("total") - F.col("capped_before")) / F.col("w_left"))
    free = F.col("cap") >= F.col("level") * F.col("w")
    s = s.withColumn("final", F.min(F.when(free, F.struct(F.col("cap") / F.col("w"), "key", "level"))).over(every)["level"])
    return s.select("key", "mass", F.least(F.col("cap").cast("double"), F.coalesce(F.col("final") * F.col("w"), F.col("cap").cast("double"))).alias("target"))


def _direction(cells: DataFrame, margins: list[tuple[str, str]]) -> DataFrame:
    """cells with `move`, the Newton direction of each cell's eta. cells: group and target columns, mass, eta, words, slope."""
    (first, goal), small = margins[0], margins[1:]
    rows = cells.groupBy(first).agg(F.sum("slope").alias("d_"), (F.max(goal) - F.sum("words")).alias("r_"), F.max(F.abs("eta")).alias("far_"))
    # a group whose rates are all at their limit has no slope: it stays, or steps back if it takes too much
    rows = rows.withColumn("own_", F.when(F.col("d_") > 0, F.col("r_") / F.col("d_")).when(F.col("r_") < 0, F.lit(-1.0)).otherwise(0.0))
    if not small:
        return cells.join(rows.select(first, F.col("own_").alias("move")), first)
    key = lambda k: F.concat(F.lit(f"{k}:"), F.col(small[k][0]).cast("string"))
    keys = F.array(*(key(k) for k in range(len(small))))
    each = cells.select(first, "slope", "words", F.explode(F.arrays_zip(keys.alias("g"), F.array(*(F.col(t).cast("double") for _, t in small)).alias("t"))).alias("x"))
    each = each.select(first, "slope", "words", F.col("x.g").alias("g"), F.col("x.t").alias("t"))
    shared = stage(each.groupBy(first, "g").agg(F.sum("slope").alias("b")).join(rows, first), "shared")
    gaps = each.groupBy("g").agg((F.max("t") - F.sum("words")).alias("r")).collect()
    if len(gaps) > SMALL:
        raise ValueError(f"{len(gaps)} groups in the further margins, more than {SMALL}")
    place = {r.g: k for k, r in enumerate(gaps)}
    h, rhs = np.zeros((len(gaps), len(gaps))), np.array([r.r for r in gaps])
    pairs = cells.select("slope", F.explode(keys).alias("g"), keys.alias("gs")).select("slope", "g", F.explode("gs").alias("o"))
    for r in pairs.groupBy("g", "o").agg(F.sum("slope").alias("v")).collect():
        h[place[r.g], place[r.o]] += r.v
    held = shared.where("d_ > 0")
    other = held.select(F.col(first).alias("same_"), F.col("g").alias("o"), F.col("b").alias("c"))
    for r in held.join(other, F.col(first) == F.col("same_")).groupBy("g", "o").agg(F.sum(F.col("b") * F.col("c") / F.col("d_")).alias("v")).collect():
        h[place[r.g], place[r.o]] -= r.v
    for r in held.groupBy("g").agg(F.sum(F.col("b") * F.col("r_") / F.col("d_")).alias("v")).collect():
        rhs[place[r.g]] -= r.v
    moved = np.linalg.lstsq(h, rhs, rcond=1e-9)[0]  # the margins share their sum, so the system is singular but consistent
    by = cells.sparkSession.createDataFrame([(g, float(moved[k])) for g, k in place.items()], "g string, m double")
    taken = shared.join(F.broadcast(by), "g").groupBy(first).agg(F.sum(F.col("b") * F.col("m")).alias("t_"))  # at most SMALL rows
    rows = rows.join(taken, first).select(first, F.when(F.col("d_") > 0, (F.col("r_") - F.col("t_")) / F.col("d_")).otherwise(F.col("own_")).alias("move"))
    out = cells.join(rows, first)
    for k in range(len(small)):
        mine = by.where(F.col("g").startswith(f"{k}:")).select(F.col("g").alias(f"g{k}_"), F.col("m").alias(f"m{k}_"))
        out = out.join(F.broadcast(mine), key(k) == F.col(f"g{k}_"))
    return out.withColumn("move", F.col("move") + sum(F.col(f"m{k}_") for k in range(len(small)))).select(*cells.columns, "move")


def balance(cells: DataFrame, margins: list[tuple[str, str]], most: float = MOST, steps: int = STEPS) -> DataFrame:
    """cells with a rate for each. margins: (group column, column that has the group's target), the one with most groups first.

    eta is a cell's exponent, the sum of its groups' dual variables. The dual's gradient is
    what each group takes less its target; a rate at the limit `most` no longer moves.
    """
    limit, top, one = F.lit(float(most)), F.log(F.lit(float(most))), margins[0][0]

    def seen(df: DataFrame) -> DataFrame:
        rate = F.exp(F.least(F.col("eta"), top))
        return df.withColumns({"words": F.col("mass") * rate, "slope": F.when(F.col("eta") <= top, F.col("mass") * rate).otherwise(F.lit(0.0))})

    def miss(df: DataFrame) -> float:
        parts = [df.groupBy(g).agg((F.abs(F.max(t) - F.sum("words")) / F.greatest(F.lit(1.0), F.max(t))).alias("m")) for g, t in margins]
        return max((float(p.agg(F.max("m")).first()[0] or 0.0) for p in parts), default=0.0)

    now = stage(seen(cells.where(F.col(one).isNotNull()).withColumn("eta", F.lit(0.0))), "tilted")
    gap = miss(now)
    for _ in range(steps):
        if gap <= TOLERANCE:
            break
        moved = stage(_direction(now, margins), "moved")
        longest = float(moved.agg(F.max(F.abs("move"))).first()[0] or 0.0)
        size = 1.0 if len(margins) == 1 else min(1.0, LONGEST_STEP / (longest or 1.0))
        for _ in range(HALVINGS):  # a single margin's groups move apart, each by its own bounded step
            step = F.greatest(F.lit(-LONGEST_STEP), F.least(F.lit(LONGEST_STEP), F.col("move"))) if len(margins) == 1 else F.col("move")
            after = stage(seen(moved.withColumn("eta", F.col("eta") + F.lit(size) * step)).drop("move"), "tilted")
            found = miss(after)
            if found < gap or len(margins) == 1:
                break
            discard(after)
            size /= 2
        else:
            break
        discard(now, moved)
        now, gap = after, found
    if gap > TOLERANCE:
        raise RuntimeError(f"the constraints are missed by {gap:.1e} after Newton's steps; they may contradict each other")
    return now.withColumn("rate", F.least(F.exp("eta"), limit)).drop("eta", "words", "slope")


def _span(u: Column) -> Column:
    return F.shiftright(u, _HASH_BITS - _RANGES_BITS)


def level(size: Column) -> Column:
    """Large documents first, so that what they leave over or under is made up by small ones."""
    out = F.lit(len(LEVELS))
    for k in reversed(range(len(LEVELS))):
        out = F.when(size > LEVELS[k], F.lit(k)).otherwise(out)
    return out


def stops(sized: DataFrame, cells: DataFrame) -> DataFrame:
    """The cells' columns but mass and target, base and, for each level l, at_l, last_l, some_l and all_l, where its extra copies end.

    A document takes one more copy if its hash range is below its level's `at`, or is
    `at` and its place, (hash, doc_id, size), is below `last`; of the `all` rows that stand
    at `last`, `some` take one. What a level misses is carried to the next one.
    """
    plan = cells.withColumn("base", F.floor(F.col("rate") + 1e-9))
    plan = plan.withColumns({"extra": F.greatest(F.lit(0.0), F.col("target") - F.col("base") * F.col("mass")), "carry": F.lit(0.0)})
    sums = sized.groupBy("key", "level", _span(F.col("u")).alias("at")).agg(F.sum("size").alias("words"))
    sums = stage(sums, "sums")
    for k in range(len(LEVELS) + 1):
        one, by = Window.partitionBy("key"), Window.partitionBy("key").orderBy("at")
        part = sums.where(F.col("level") == k).join(plan.select("key", "mass", "extra", "carry"), "key")
        want = F.coalesce(F.col("extra") * F.sum("words").over(one) / F.nullif("mass", F.lit(0)), F.lit(0.0)) + F.col("carry")
        part = part.select("key", "at", want.alias("want"), (F.sum("words").over(by) - F.col("words")).alias("before"))
        at = part.where((F.col("before") <= F.col("want")) | (F.col("before") == 0)).groupBy("key").agg(F.max(F.struct("at", "before", "want")).alias("m")).select("key", "m.*")
        at = stage(at, "at")
        # rows of one place are summed before any window sees them, however many they are
        inside = sized.where(F.col("level") == k).groupBy("key", "u", "doc_id", "size", _span(F.col("u")).alias("at")).agg(F.count("*").alias("all")).join(at, ["key", "at"])
        inside = inside.withColumn("ahead", F.sum(F.col("size") * F.col("all")).over(one.orderBy("u", "doc_id", "size")) - F.col("size") * F.col("all"))
        room = F.floor((F.col("want") - F.col("before") - F.col("ahead")) / F.nullif(F.col("size"), F.lit(0)) + 0.5)
        some = F.when(F.col("size") > 0, F.greatest(F.lit(0).cast("long"), F.least(F.col("all"), room))).when(F.col("before") + F.col("ahead") <= F.col("want"), F.col("all")).otherwise(F.lit(0).cast("long"))
        fit = inside.withColumn("some", some).where("some > 0").withColumn("place", F.struct("u", "doc_id", "size"))
        last = fit.groupBy("key").agg(F.max(F.struct("place", "some", "all", (F.col("ahead") + F.col("size") * F.col("some")).alias("upto"))).alias("l"))
        ends = at.join(last, "key", "left").select(
            "key", F.col("at").alias(f"at_{k}"), F.col("l.place").alias(f"last_{k}"), F.col("l.some").alias(f"some_{k}"), F.col("l.all").alias(f"all_{k}"),
            (F.col("want") - F.col("before") - F.coalesce("l.upto", F.lit(0))).alias("left_over"),
        )
        plan = plan.join(ends, "key", "left").withColumn("carry", F.coalesce("left_over", "carry")).drop("left_over")
        plan = stage(plan, "plan")
    return plan.drop("mass", "target", "extra", "carry")


NEW = ("size", "source_size", "target", "rate", "copies", "taken")


def _mixed(docs: DataFrame, weights: tuple[int, ...], most: int, margin: tuple[Column, DataFrame] | None) -> DataFrame:
    """d (the row as a struct) and the columns NEW.

    margin: a column of docs that names each document's group, and (group, share): the share
    of all words that each group is to have.
    """
    key = source_key(F.col("source"))
    group = F.coalesce(margin[0].cast("string"), F.lit("")) if margin else F.lit("")
    small = docs.select("doc_id", key.alias("key"), group.alias("grp"), n_words(F.col("text")).alias("size"), order_hash(F.col("doc_id"), F.col("text")).alias("u"))
    sized = stage(small.withColumns({"level": level(F.col("size")), "cell": F.concat("key", F.lit("\n"), "grp")}), "sizes")
    cells = stage(sized.groupBy("cell", "key", "grp").agg(F.sum("size").alias("mass")), "cells")
    goals = targets(cells.groupBy("key").agg(F.sum("mass").alias("mass")), weights, most)
    goals = stage(goals.select("key", F.col("mass").alias("source_size"), F.col("target").alias("source_target")), "targets")
    cells, margins = cells.join(goals, "key"), [("key", "source_target")]
    if margin:
        total = float(goals.agg(F.sum("source_target")).first()[0] or 0.0)
        shares = margin[1].select(F.col("group").cast("string").alias("grp"), (F.col("share") * total).alias("group_target"))
        cells, margins = cells.join(shares, "grp", "left").fillna(0.0, ["group_target"]), [*margins, ("grp", "group_target")]
    rates = balance(cells, margins, most)
    plan = rates.select("cell", "mass", (F.col("mass") * F.col("rate")).alias("target"), "rate", "source_size", "source_target")
    plan = stops(sized.drop("key").withColumnRenamed("cell", "key"), stage(plan.withColumnRenamed("cell", "key"), "rates"))

    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("d"), F.concat(key, F.lit("\n"), group).alias("key"), n_words(F.col("text")).alias("size"), order_hash(F.col("doc_id"), F.col("text")).alias("u"))
    place = F.struct(F.col("u"), F.col("d.doc_id").alias("doc_id"), F.col("size"))
    by_level = lambda of: F.coalesce(*(F.when(level(F.col("size")) == k, of(k)) for k in range(len(LEVELS) + 1)))
    at_last = lambda k: F.coalesce(place == F.col(f"last_{k}"), F.lit(False))
    ends = lambda k: (_span(F.col("u")) < F.col(f"at_{k}")) | ((_span(F.col("u")) == F.col(f"at_{k}")) & F.coalesce((place < F.col(f"last_{k}")) | at_last(k), F.lit(False)))
    more = F.coalesce(by_level(ends), F.lit(False))
    part = F.coalesce(by_level(lambda k: F.when(at_last(k), F.col(f"some_{k}") < F.col(f"all_{k}"))), F.lit(False))
    both = whole.join(plan, "key", "left").withColumns({"more": more.cast("long"), "part": part})
    if not plan.where(reduce(Column.__or__, (F.col(f"some_{k}") < F.col(f"all_{k}") for k in range(len(LEVELS) + 1)))).isEmpty():
        some = by_level(lambda k: F.col(f"some_{k}"))
        held = both.where("part").withColumns({"some": some, "lv": level(F.col("size"))})
        both = both.where("not part").unionByName(_numbered(held).withColumn("more", (F.col("nth") < F.col("some")).cast("long")).select(*both.columns))
    both = both.withColumn("copies", F.least(F.lit(most), F.col("base") + F.col("more")))
    return both.select("d", "size", "source_size", F.col("source_target").alias("target"), "rate", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def _numbered(rows: DataFrame) -> DataFrame:
    """rows, staged, with nth, from 0 within (key, lv), in the order of their staging; no task sees more than one file's rows."""
    dealt = stage(rows.withColumn("id_", F.monotonically_increasing_id()), "tied").withColumn("file_", F.shiftright("id_", 33))
    group = ["key", "lv"]
    counts = dealt.groupBy(*group, "file_").agg(F.count("*").alias("n_"))
    before = counts.select(*group, "file_", (F.sum("n_").over(Window.partitionBy(*group).orderBy("file_")) - F.col("n_")).alias("before_"))
    place = F.row_number().over(Window.partitionBy(*group, "file_").orderBy("id_")) - 1
    return dealt.withColumn("place_", place).join(before, [*group, "file_"]).withColumn("nth", F.col("before_") + F.col("place_"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, margin: tuple[Column, DataFrame] | None = None) -> DataFrame:
    """The documents with size, source_size, target (their source's), rate, copies and taken (size times copies).

    margin: (column, table of group and share) adds the constraint that each group of the
    column takes its share of all words.
    """
    cols = [F.col(f"d.`{c}`").alias(c) for c in docs.columns if c not in NEW]
    return _mixed(docs, weights, most, margin).select(*cols, *NEW)


def mix_copies(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """A row for each copy taken: the input's columns, then size, target, rate, copies and copy (from 1).

    Where the input has a column of such a name, the mix's own is called mix_ and that name.
    """
    out = _mixed(docs, weights, most, None).where("copies > 0")
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    held = {c.lower() for c in docs.columns}

    def free(name: str) -> str:
        return name if name not in held else free(f"mix_{name}")

    cols = [F.col(f"d.`{c}`").alias(c) for c in docs.columns]
    return out.select(*cols, *(F.col(c).alias(free(c)) for c in ("size", "target", "rate", "copies", "copy")))
