"""Operator 2, benchmark decontamination by size-partitioned MinHash containment search.
DataFrame functions only.

A short test item inside a long document has a small Jaccard similarity, so a
signature of fixed length would miss it. Documents are therefore partitioned by size,
in powers of two, and partition c sketches with 2^c bins: one hash deals a shingle to
a bin, and each bin keeps its minimum (one-permutation MinHash). A partition has at
least two bins for each of a document's shingles, so that a contained shingle is its
bin's minimum with a probability of at least 0.78. An item is sketched with the bins of
the document's partition; as bins only split with growing c, each item shingle is a
minimum from some c on, and this c stands beside it in the index. One equal minimum
brings item and document together: an item of which 8 or more shingles must be found
is missed with a probability below 0.22^8 = 6e-6. For smaller items, if there are any,
all shingles of the documents are looked up, so that they are found for certain.

Each candidate is verified on exact shingles, as text: the share of the item's
distinct 5-word shingles that the document holds must reach 0.8. A candidate document
is cut into its shingles once, and those that an item has are counted.

The items' sketches are staged, so that Catalyst broadcasts them if their true size is
below its threshold and sorts and merges otherwise; a passage that many documents
share then meets the usual splitting of skewed joins.

Defined cases: words are runs of other than blanks, A-Z lower-cased; a text of one to
four words has one shingle, its whole sequence, so such an item is found only as a
whole document; null and blank texts hold nothing and match nothing. Items with a null
item_id count like others. Rows that repeat a doc_id, or have none, are judged each on
its own text: `leaks` gives one row for each distinct (doc_id, item_id), with the most
shingles found, and `remove_leaks` removes the rows whose own text leaks. Empty tables
give no rows. Other columns are ignored by `leaks`, kept by `remove_leaks`, whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, lower_ascii, stage, text_key, words

SHINGLE, CONTAINED, SURE = 5, 0.8, 8
_BITS = 63


def shingles(text: Column) -> Column:
    """The distinct shingles of a text, as text."""

    def of(w: Column) -> Column:
        n = F.size(w)
        many = F.transform(F.sequence(F.lit(1), n - SHINGLE + 1), lambda i: F.array_join(F.slice(w, i, SHINGLE), " "))
        return F.array_distinct(F.when(n >= SHINGLE, many).when(n > 0, F.array(F.array_join(w, " "))).otherwise(F.array().cast("array<string>")))

    return let(words(lower_ascii(text)), of)


def hashed(text: Column) -> Column:
    """The sorted non-negative hashes of a text's shingles; repeats stay; null if there are none."""

    def of(w: Column) -> Column:
        n = F.size(w)
        many = F.transform(F.sequence(F.lit(0), n - SHINGLE), lambda i: F.shiftrightunsigned(F.xxhash64(*(w[i + j] for j in range(SHINGLE))), 1))
        one = F.array(F.shiftrightunsigned(F.xxhash64(F.array_join(w, " ")), 1))
        return F.sort_array(F.when(n >= SHINGLE, many).when(n > 0, one))

    return let(words(lower_ascii(text)), of)


def partition_of(hashes: Column) -> Column:
    """The smallest c for which 2^c is at least twice the number of hashes."""
    return F.ceil(F.log2(F.size(hashes).cast("double"))).cast("int") + 1


def minima(hashes: Column) -> Column:
    """The minimum of each of 2^c bins: bins are the hashes' high bits, so each is a run of the sorted array."""

    def of(hs: Column) -> Column:
        bin_of = lambda h: F.call_function("shiftright", h, F.lit(_BITS) - partition_of(hs))
        return F.filter(hs, lambda h, i: (i == 0) | (bin_of(h) != bin_of(hs[F.greatest(i - 1, F.lit(0))])))

    return let(hashes, of)


def _from(hashes: Column) -> Column:
    """struct(h, since): a hash is its bin's minimum in the partitions from `since` on."""

    def of(hs: Column) -> Column:
        since = lambda h, i: F.when(i == 0, F.lit(0)).otherwise(_BITS + 1 - F.length(F.bin(h.bitwiseXOR(hs[F.greatest(i - 1, F.lit(0))]))))
        return F.transform(hs, lambda h, i: F.struct(h.alias("h"), since(h, i).alias("since")))

    return let(hashes, of)


def index(items: DataFrame, contained: float) -> DataFrame:
    """item, h, since, sure of every item shingle; a staged table."""
    each = items.select("item", F.array_distinct(hashed(F.col("text"))).alias("hs"))
    each = each.select("item", (F.ceil(F.size("hs") * F.lit(contained)) < SURE).alias("sure"), F.explode(_from(F.col("hs"))).alias("x"))
    return stage(each.select("item", "x.h", "x.since", "sure"), "item_sketches")


def _found(docs: DataFrame, benchmark: DataFrame, contained: float) -> DataFrame:
    """doc_id, th (the text's hash), item_id, n_shingles, n_found of each contained item; a staged table."""
    items = stage(benchmark.select("item_id", "text").distinct().select("item_id", "text", F.xxhash64("item_id", "text").alias("item")), "items")
    asked = index(items, contained)
    # outer explodes, as for inner ones the optimizer works out the arrays once more to see if they are empty
    hs, th = hashed(F.col("text")), text_key(F.col("text")).alias("th")
    both = lambda x: F.struct(partition_of(x).alias("c"), minima(x).alias("hs"))
    per = docs.select("doc_id", th, let(hs, both).alias("x"))
    seen = per.select("doc_id", "th", F.col("x.c").alias("c"), F.explode_outer("x.hs").alias("h"))
    pairs = seen.join(asked.where("not sure"), "h").where("c >= since").select("doc_id", "th", "item")
    if not asked.where("sure").isEmpty():
        every = docs.select("doc_id", th, hs.alias("hs")).select("doc_id", "th", F.explode_outer("hs").alias("h"))
        pairs = pairs.unionByName(every.join(asked.where("sure"), "h").select("doc_id", "th", "item"))
    candidates = stage(pairs.distinct(), "candidates")

    # candidates' texts are cut into shingles once, whatever the number of items; those that an item has meet it as text
    named = candidates.select(F.col("doc_id").alias("id2"), F.col("th").alias("th2")).distinct()
    texts = docs.select("doc_id", th, "text").join(named, F.col("doc_id").eqNullSafe(F.col("id2")) & (F.col("th") == F.col("th2")), "left_semi")
    held = texts.dropDuplicates(["doc_id", "th"]).select("doc_id", "th", shingles(F.col("text")).alias("held")).select("doc_id", "th", F.explode_outer("held").alias("s"))
    wanted = items.select("item", shingles(F.col("text")).alias("asked")).select("item", F.explode_outer("asked").alias("s"))
    hits = held.join(stage(wanted, "item_shingles"), "s").groupBy("doc_id", "th", "item").agg(F.count("*").alias("n_found"))
    asked_for = candidates.select(F.col("doc_id").alias("id2"), F.col("th").alias("th2"), F.col("item").alias("item2"))
    hits = hits.join(asked_for, F.col("doc_id").eqNullSafe(F.col("id2")) & (F.col("th") == F.col("th2")) & (F.col("item") == F.col("item2")), "left_semi")
    sizes = items.select("item_id", "item", F.size(shingles(F.col("text"))).cast("long").alias("n_shingles"))
    out = hits.join(sizes, "item").where(F.col("n_found") >= F.lit(contained) * F.col("n_shingles"))
    return stage(out.select("doc_id", "th", "item_id", "n_shingles", "n_found"), "leaks")


def leaks(docs: DataFrame, benchmark: DataFrame, contained: float = CONTAINED) -> DataFrame:
    """doc_id, item_id, n_shingles (of the item), n_found, containment of each contained item."""
    out = _found(docs, benchmark, contained).groupBy("doc_id", "item_id").agg(F.max(F.struct("n_found", "n_shingles")).alias("m"))
    return out.select("doc_id", "item_id", "m.n_shingles", "m.n_found", (F.col("m.n_found") / F.col("m.n_shingles")).alias("containment"))


def remove_leaks(docs: DataFrame, benchmark: DataFrame, contained: float = CONTAINED) -> DataFrame:
    """The documents that contain no item; all columns stay."""
    hit = _found(docs, benchmark, contained).select(F.col("doc_id").alias("hit_id"), F.col("th").alias("hit_th")).distinct()
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("d"), "doc_id", text_key(F.col("text")).alias("th"))
    return whole.join(stage(hit, "leaking"), F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("th") == F.col("hit_th")), "left_anti").select("d.*")
