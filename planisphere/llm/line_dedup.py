"""Operator 8, line dedup over levelled sorted runs of line hashes. DataFrame functions only.

Runs are tables of (h1, h2, docs, holder), dealt by the hash of a key into the same
buckets and sorted in each, so that merging and anti-joining them needs no shuffle. A
batch's line keys are summed, merge-anti-joined with the runs to tell which keys are
new, and written as a run of their own at level 0; once a level has `fanout` runs, they
are merged into one run of the next level. Batches go from the largest document ids to
the smallest, so that the batch that first brings a key also holds its largest
document: the run keeps that id as holder, and later batches only add to the count.
Batches are cut at quantiles of doc_id, by comparison alone, so any ids will do.

Keys are 128 bits of hash (two 64-bit hashes with different seeds), all compared. A key
that a third of all lines share is summed before each shuffle to one row for each task.
Where the lines to drop stand was noted when the keys were made; a document's places
become a mask with an entry a line, so that dropping takes time in proportion to its lines.

Defined cases: null or empty text is one empty line; rows that repeat a doc_id count
as one document; a null doc_id sorts below all others and never holds a key; doc_id
may be any 64-bit number; the lines that stay are joined by a line break; an empty
table gives no rows. All columns of the input are kept by `drop_lines`, whatever their
names; n_lines and n_dropped of `dedup_lines` replace columns of those names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, let, lower_ascii, stage, strip, text_key

MIN_CHARS, MIN_DOCS, BATCHES, FANOUT = 40, 5, 4, 4


def line_key(line: Column) -> Column:
    return lower_ascii(strip(line))


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


class LineRuns:
    """The runs, by level; a level's runs are appended to one table. `add` takes the keys of a batch: doc_id, h1, h2, each row once."""

    def __init__(self, fanout: int = FANOUT):
        self.fanout = fanout
        #: for each level its table (None if it has no run) and its number of runs
        self.levels: list[tuple[DataFrame | None, int]] = []

    def add(self, batch: DataFrame) -> None:
        """Add a batch's keys as a run of (h1, h2, docs, holder, fresh): fresh tells which are new, and only those name a holder."""
        own = batch.groupBy("h1", "h2").agg(F.count("*").alias("docs"), F.max("doc_id").alias("holder"))
        known = F.lit(False)
        for k, (level, _) in enumerate(self.levels):  # the batch is dealt to the buckets once, the runs stay where they are
            if level is not None:
                own = own.join(level.where("fresh").select("h1", "h2", F.lit(True).alias(f"in_{k}")).hint("merge"), ["h1", "h2"], "left")
                known = known | F.col(f"in_{k}").isNotNull()
        self._put(own.select("h1", "h2", "docs", F.when(~known, F.col("holder")).alias("holder"), (~known).alias("fresh")), 0)

    def _put(self, run: DataFrame, level: int) -> None:
        if level == len(self.levels):
            self.levels.append((None, 0))
        table, n = self.levels[level]
        self.levels[level] = (stage(run, "level", buckets=("h1", "h2"), onto=table), n + 1)
        if n + 1 >= self.fanout:
            self._compact(level)

    def _compact(self, level: int) -> None:
        table, _ = self.levels[level]
        self.levels[level] = (None, 0)
        self._put(self.merged(table), level + 1)
        discard(table)

    @staticmethod
    def merged(runs: DataFrame) -> DataFrame:
        return runs.groupBy("h1", "h2").agg(F.sum("docs").alias("docs"), F.max("holder").alias("holder"), F.max("fresh").alias("fresh"))

    def finish(self) -> DataFrame | None:
        """All runs merged, lower levels into higher ones."""
        for k in range(len(self.levels) - 1):
            if self.levels[k][0] is not None:
                self._compact(k)
        table = self.levels[-1][0] if self.levels else None
        return table if table is None else self.merged(table)


def line_keys(docs: DataFrame, min_chars: int) -> DataFrame:
    """doc_id, th, at, h1, h2: the place of every line whose key has at least min_chars code points, and the key's hashes."""

    def keyed(line: Column, i: Column) -> Column:
        long_enough = lambda k: F.when(F.length(k) >= min_chars, F.struct(i.cast("int").alias("at"), F.xxhash64(k).alias("h1"), F.xxhash64(F.lit("second"), k).alias("h2")))
        return F.when(F.length(line) >= min_chars, let(line_key(line), long_enough))

    found = F.filter(F.transform(lines(F.col("text")), keyed), lambda x: x.isNotNull())
    # outer, as for an inner explode the optimizer works out the array once more to see if it is empty
    per = docs.select("doc_id", text_key(F.col("text")).alias("th"), found.alias("found"))  # apart, or the text would be hashed for each line
    each = per.select("doc_id", "th", F.explode_outer("found").alias("k"))
    return each.select("doc_id", "th", "k.at", "k.h1", "k.h2").where("h1 is not null")


def batch_of(docs: DataFrame, batches: int) -> Column:
    """The batch of a doc_id: 0 for the largest, batches - 1 for the smallest and for null."""
    shares = [k / batches for k in range(1, batches)]
    cuts = (docs.agg(F.percentile_approx("doc_id", shares, F.lit(1000))).first()[0] if shares else None) or []
    below = lambda cut: F.when(F.col("doc_id") > F.lit(cut), 1).otherwise(0)
    return F.lit(batches - 1) - sum((below(cut) for cut in cuts), F.lit(0))


def repeated_keys(keys: DataFrame, min_docs: int, batches: int, fanout: int) -> DataFrame:
    """h1, h2, holder of the keys found in at least min_docs documents; a staged table. keys: doc_id, h1, h2, batch."""
    runs = LineRuns(fanout)
    for b in range(batches):
        runs.add(keys.where(F.col("batch") == b).select("doc_id", "h1", "h2").distinct())
    hot = stage(runs.finish().where(F.col("docs") >= min_docs).select("h1", "h2", "holder"), "repeated")
    discard(*(table for table, _ in runs.levels if table is not None))
    return hot


def _dropped(docs: DataFrame, min_chars: int, min_docs: int, batches: int, fanout: int) -> DataFrame:
    """d (the row as a struct), text (what stays of it), n_lines, n_dropped."""
    keys = stage(line_keys(docs, min_chars).withColumn("batch", batch_of(docs, batches)), "line_keys", partition_by="batch")
    hot = repeated_keys(keys, min_docs, batches, fanout)
    drops = keys.join(hot, ["h1", "h2"]).where(~F.col("doc_id").eqNullSafe(F.col("holder")))
    drops = stage(drops.groupBy("doc_id", "th").agg(F.sort_array(F.collect_set("at")).alias("places")), "drops")
    discard(keys, hot)

    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("d"), "doc_id", text_key(F.col("text")).alias("th"))
    asked = drops.select(F.col("doc_id").alias("id2"), F.col("th").alias("th2"), "places")
    # one way at every size: by the size of the drops, small inputs would broadcast and large ones shuffle
    both = whole.join(asked.hint("merge"), F.col("doc_id").eqNullSafe(F.col("id2")) & (F.col("th") == F.col("th2")), "left")
    text = F.coalesce(F.col("d.text"), F.lit(""))
    gap = lambda p, k: F.concat(F.array_repeat(F.lit(False), p - F.when(k > 0, F.col("places")[k - 1]).otherwise(-1) - 1), F.array(F.lit(True)))
    mask = F.flatten(F.transform("places", gap))  # up to the last line that goes
    stays = let(mask, lambda gone: F.array_join(F.filter(lines(text), lambda _, i: ~F.coalesce(F.get(gone, i), F.lit(False))), "\n"))
    kept = F.when(F.col("places").isNull(), text).otherwise(stays)
    return both.select("d", kept.alias("text"), F.size(lines(text)).cast("long").alias("n_lines"), F.coalesce(F.size("places"), F.lit(0)).cast("long").alias("n_dropped"))


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """The documents without their repeated lines, with n_lines (before) and n_dropped."""
    out = _dropped(docs, min_chars, min_docs, batches, fanout)
    cols = [F.col("text") if c == "text" else F.col(f"d.`{c}`").alias(c) for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return out.select(*cols, "n_lines", "n_dropped")


def drop_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """The documents without their repeated lines and n_chars to match, in the input's columns; those that lose all their lines go."""
    out = _dropped(docs, min_chars, min_docs, batches, fanout).where("n_dropped = 0 or n_dropped < n_lines")
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return out.select(*(new.get(c, F.col(f"d.`{c}`")).alias(c) for c in docs.columns))
