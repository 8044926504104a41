"""Operator 6, near-duplicate groups by b-bit MinHash.

1. Each text's set of distinct 5-word shingles is hashed to 64 bits a shingle. Texts
   with equal sets form a class (a 128-bit hash of the set); what follows works on
   classes, so that thousands of copies are one row.
2. A class's signature holds the low 2 bits of 180 minima, packed in six integers.
   Bands of whole minima bring candidates together: as many rows a band as leave a pair
   at the threshold without a shared band with a probability below 1e-6 (30 bands of 6
   for 0.85, 36 of 5 for 0.8).
3. In each band bucket all classes are compared with the bucket's smallest one only (a
   star, linear in the bucket's size): the collision-corrected estimate from bit counts
   discards what is surely apart, full sets confirm the rest.
4. A bucket whose classes are then not all connected has the classes outside its largest
   component compared with all its others, in cells of 256 by 256. First the signatures
   alone tell which classes of a cell may link with one they are not connected to; only
   these bring their sets to the cell, where links are confirmed until they are
   connected. So every pair that shares a bucket is either compared or connected, no link
   between components is lost, and nothing leaves a cell but links. Buckets of the same
   classes count once.
5. Components by alternating large and small stars, in rounds cut by staged tables.

Style: Python with Arrow for hashing (one pass) and cells, DataFrame joins for everything else.

Defined cases: A text's words are runs of other than blanks, A-Z lower-cased; fewer
than five words make one shingle; null, empty and blank texts have an empty set, link
with nothing and are kept. A null doc_id takes part in links but names no component
unless all ids of a component are null. Rows that repeat a doc_id are judged each on
its own text; equal rows have equal results. Empty tables give no rows. Other columns
of the input are ignored by `near_groups`, and kept by `drop_near_copies`, whatever
their names: it keeps one row of each component, one with the component's smallest
doc_id (of several the one whose text has the smallest hash; of equal rows any one).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, stage, text_key

SHINGLE, PERCENT = 5, 85
MINIMA, BITS, MISSED = 180, 2, 1e-6
#: Pairs whose estimate is this far below the threshold (six standard errors) are not confirmed.
MARGIN = 0.24
BLOCK = 256
_LANES = 64 // BITS
_LONGS = -(-MINIMA // _LANES)
_PAIR_MASK = 0x5555555555555555


def _odd(seed: int, n: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_MIX, _PERMUTE, _PLACE, _BAND_SEED = _odd(1, SHINGLE), _odd(2, MINIMA), _odd(3, MINIMA), _odd(4, MINIMA)


def rows_of_a_band(percent: int) -> int:
    """The most rows a band for which a pair at the threshold shares a band all but surely."""
    fits = [r for r in range(1, MINIMA) if MINIMA % r == 0 and (1 - (percent / 100) ** r) ** (MINIMA // r) < MISSED]
    return max(fits, default=1)


def shingle_set(text: str | None) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and the six ASCII blanks alone
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < SHINGLE:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=7)], np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = len(h) - SHINGLE + 1
    out = h[:n] * _MIX[0]
    for j in range(1, SHINGLE):
        out ^= out >> np.uint64(29)
        out = out * _MIX[j] + h[j : j + n]
    out ^= out >> np.uint64(32)
    return np.unique(out * _MIX[0])


def minima(shingles: np.ndarray) -> np.ndarray:
    """180 minima of 32 bits; long sets are taken in pieces of bounded memory."""
    low = np.full(MINIMA, 2**32 - 1, np.uint64)
    for at in range(0, len(shingles), 2048):
        low = np.minimum(low, ((shingles[at : at + 2048, None] * _PERMUTE) >> np.uint64(32)).min(axis=0))
    return low


def band_keys(low: np.ndarray, rows: int) -> np.ndarray:
    bands = MINIMA // rows
    keys = ((low.reshape(bands, rows) + np.uint64(1)) * _PLACE[:rows]).sum(axis=1, dtype=np.uint64) * _BAND_SEED[:bands]
    return (keys ^ (keys >> np.uint64(31))).view(np.int64)


def packed(low: np.ndarray) -> np.ndarray:
    """The low bits of the minima, 32 to an integer."""
    lanes = np.zeros(_LONGS * _LANES, np.uint64)
    lanes[:MINIMA] = low & np.uint64(2**BITS - 1)
    shifts = np.arange(_LANES, dtype=np.uint64) * np.uint64(BITS)
    return np.bitwise_or.reduce(lanes.reshape(_LONGS, _LANES) << shifts, axis=1).view(np.int64)


def _class_of(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes())


_SIGNED = "doc_id long, th struct<a:bigint,b:bigint>, n long, cls binary, sig array<long>, bands array<long>"
_SETS = "cls binary, items array<long>"


def _sign(rows: int):
    """Signs rows of doc_id, th, text."""
    types = [("n", pa.int64()), ("cls", pa.binary()), ("sig", pa.list_(pa.int64())), ("bands", pa.list_(pa.int64()))]

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part, made = batch.slice(at, 1024), []
                for text in part.column(2):
                    s = shingle_set(text.as_py())
                    low = minima(s) if len(s) else None
                    made.append((len(s), _class_of(s), packed(low), band_keys(low, rows)) if len(s) else (0, None, None, None))
                new = [pa.array([m[k] for m in made], t) for k, (_, t) in enumerate(types)]
                yield pa.record_batch([part.column(0).cast(pa.int64()), part.column(1), *new], names=["doc_id", "th", *(n for n, _ in types)])

    return sign


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("cls", pa.binary()), ("items", pa.list_(pa.int64()))])
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            sets = [shingle_set(x.as_py()) for x in batch.column(0).slice(at, 512)]
            yield pa.record_batch([pa.array([_class_of(s) for s in sets], pa.binary()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], schema=schema)


def estimate(a: Column, b: Column) -> Column:
    """Similarity from two packed signatures, corrected for low bits that agree by chance."""
    apart = F.lit(0)
    for k in range(_LONGS):
        x = a[k].bitwiseXOR(b[k])
        apart = apart + F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(_PAIR_MASK)))
    chance = 2.0**-BITS
    return ((1 - apart / F.lit(MINIMA)) - chance) / (1 - chance)


def _linked(inter: Column, na: Column, nb: Column, percent: int) -> Column:
    return inter * 100 >= (na + nb - inter) * percent


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node) of every node on an edge (a, b), by large and small stars; a staged table.

    The smallest neighbours are staged before they are joined, so that a node with many
    edges is a skewed side of a plain join, which is split.
    """
    e = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = lambda x: tuple(x.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
    was = mark(e)
    while was[0]:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = stage(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("of"), F.least("a", "m").alias("m")), "smallest")
        large = both.join(low, F.col("a") == F.col("of")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "of")  # a node has few smaller neighbours: no skew
        small = large.join(least, F.col("a") == F.col("of")).select("a", "b", "m")
        pairs = F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.when(F.col("b") != F.col("m"), F.struct(F.col("b").alias("a"), F.col("m").alias("b"))))
        after = stage(small.select(F.explode(pairs).alias("p")).where("p is not null").select("p.*").distinct(), "edges")
        discard(e, low)
        e, now = after, mark(after)
        if now == was:
            break
        was = now
    out = stage(e.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("root")), F.struct(F.col("b").alias("node"), F.col("b").alias("root")))).alias("p")).select("p.*").distinct(), "components")
    discard(e)
    return out


class _Cell:
    """The outer classes of a cell and the classes to compare them with; each is cls, comp, n, sig and, later, items."""

    def __init__(self, rows: list[dict]):
        self.mine, self.other = [r for r in rows if r["outer"]], [r for r in rows if not r["outer"]]
        sig = lambda part: np.array([r["sig"] for r in part], np.int64).reshape(-1, _LONGS).view(np.uint64)
        self._sig, self._sigs = sig(self.mine), sig(self.other)
        codes: dict[bytes, int] = {}
        code = lambda part: np.array([codes.setdefault(bytes(r["comp"]), len(codes)) for r in part], np.int64)
        self._comp, self._comps = code(self.mine), code(self.other)
        self._n, self._ns = (np.array([r["n"] for r in part], np.int64) for part in (self.mine, self.other))

    def near(self, k: int, percent: int) -> np.ndarray:
        """Which others may link with the outer class k, and are not connected to it, likeliest first."""
        x = self._sigs ^ self._sig[k]
        apart = np.bitwise_count((x | (x >> np.uint64(1))) & np.uint64(_PAIR_MASK)).sum(axis=1)
        likely, n = ((1 - apart / MINIMA) - 2.0**-BITS) / (1 - 2.0**-BITS), self._n[k]
        found = np.flatnonzero((likely >= percent / 100 - MARGIN) & (np.minimum(self._ns, n) * 100 >= np.maximum(self._ns, n) * percent) & (self._comps != self._comp[k]))
        return found[np.argsort(-likely[found], kind="stable")]

    def asked(self, percent: int) -> list[bytes]:
        """The classes whose sets are needed."""
        out: set[bytes] = set()
        for k in range(len(self.mine) if len(self.other) else 0):
            if len(near := self.near(k, percent)):
                out |= {bytes(self.mine[k]["cls"]), *(bytes(self.other[j]["cls"]) for j in near)}
        return sorted(out)

    def links(self, percent: int) -> list[tuple[bytes, bytes]]:
        """Links that connect all components of the cell that links connect."""
        root = list(range(len(self.mine) + len(self.other)))

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        out = []
        for k, r in enumerate(self.mine):
            for j in self.near(k, percent) if len(self.other) else ():
                a, b, o = find(int(self._comp[k])), find(int(self._comps[j])), self.other[j]
                if a == b:
                    continue
                inter = len(np.intersect1d(r["items"], o["items"], assume_unique=True))
                if inter * 100 >= (r["n"] + o["n"] - inter) * percent:
                    out.append((bytes(r["cls"]), bytes(o["cls"])))
                    root[a] = b
        return out


_MEMBER = "outer boolean, cls binary, comp binary, n bigint, sig array<bigint>"


def _ask(percent: int):
    """cell, cls, of each cell (cell, rows) the classes whose sets it needs."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cell, rows in zip(batch.column(0), batch.column(1)):
                need = _Cell(rows.as_py()).asked(percent)
                yield pa.record_batch([pa.array([cell.as_py()] * len(need), pa.string()), pa.array(need, pa.binary())], names=["cell", "cls"])

    return ask


def _confirm(percent: int):
    """a, b: the links of each cell, whose rows have their items."""

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in batch.column(1):
                found = _Cell([r | {"items": np.array(r["items"], np.int64)} for r in rows.as_py()]).links(percent)
                yield pa.record_batch([pa.array([x[0] for x in found], pa.binary()), pa.array([x[1] for x in found], pa.binary())], names=["a", "b"])

    return confirm


def unresolved(shared: DataFrame, found: DataFrame, classes: DataFrame) -> DataFrame:
    """The cells left to compare: rows (cell, outer, cls, comp, n, sig). shared: key, cls; found: the components so far."""
    part = stage(classes.select("cls", "n", "sig").join(found.withColumnRenamed("node", "cls"), "cls", "left").select("cls", F.coalesce("root", "cls").alias("comp"), "n", "sig"), "parts")
    placed = shared.select("key", "cls").join(part.select("cls", "comp"), "cls")
    per = placed.groupBy("key", "comp").agg(F.count("*").alias("c"), F.sum(F.xxhash64("cls").cast("decimal(20,0)")).alias("h"))
    per = per.groupBy("key").agg(F.max(F.struct("c", "comp")).alias("main"), F.sum("c").alias("all"), F.sum("h").alias("h")).where("main.c < all")
    per = per.groupBy("all", "h").agg(F.min(F.struct("key", "main")).alias("m"))  # buckets of the same classes
    open_ = stage(per.select("m.key", F.col("m.main.comp").alias("main"), F.ceil((F.col("all") - F.col("m.main.c")) / BLOCK).cast("int").alias("p_outer"), F.ceil(F.col("all") / BLOCK).cast("int").alias("p_all")), "open")
    rest = stage(placed.join(open_, "key").select("key", "cls", "comp", "main", "p_outer", "p_all"), "rest")
    place = lambda parts: F.pmod(F.xxhash64("cls"), parts).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), parts - 1))
    outer = rest.where("comp <> main").select("key", place(F.col("p_outer")).alias("i"), every(F.col("p_all")).alias("j"), F.lit(True).alias("outer"), "cls")
    whole = rest.select("key", every(F.col("p_outer")).alias("i"), place(F.col("p_all")).alias("j"), F.lit(False).alias("outer"), "cls")
    cells = outer.unionByName(whole).select(F.concat_ws(":", "key", "i", "j").alias("cell"), "outer", "cls").join(part, "cls")
    cells = stage(cells.select("cell", "outer", "cls", "comp", "n", "sig"), "cells")
    discard(part, open_, rest)
    return cells


def near_classes(docs: DataFrame, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """Two staged tables: signed rows (doc_id, th, n, cls) and labels (cls, component_id, th_kept)."""
    texts = docs.select(F.col("doc_id").cast("long"), text_key(F.col("text")).alias("th"), "text")
    signed = stage(texts.mapInArrow(_sign(rows_of_a_band(percent)), _SIGNED), "signed")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("first")
    classes = stage(signed.where("n > 0").groupBy("cls").agg(first, F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("bands").alias("bands")), "classes")

    each = classes.select("cls", F.explode("bands").alias("key"))
    hubs = stage(each.groupBy("key").agg(F.min("cls").alias("hub"), F.max("cls").alias("most")).where("hub <> most").select("key", "hub"), "hubs")
    shared = stage(each.join(hubs, "key"), "shared")
    pairs = shared.where("cls <> hub").select(F.col("hub").alias("a"), F.col("cls").alias("b")).distinct()
    side = lambda x: classes.select(F.col("cls").alias(x), F.col("n").alias(f"n{x}"), F.col("sig").alias(f"s{x}"))
    sized = pairs.join(side("b"), "b").join(side("a"), "a")
    maybe = (F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent) & (estimate(F.col("sa"), F.col("sb")) >= percent / 100 - MARGIN)
    candidates = stage(sized.where(maybe).select("a", "b", "na", "nb"), "candidates")
    discard(hubs)

    def sets_of(asked: DataFrame, name: str) -> DataFrame:
        """cls, items of the classes asked for, from the one text that stands for each."""
        named = classes.select("cls", F.col("first.doc_id").alias("id2"), F.col("first.th").alias("th2")).join(asked, "cls", "left_semi")
        rows = texts.select(F.col("doc_id").alias("id"), "th", "text").join(named.select("id2", "th2").hint("merge"), F.col("id").eqNullSafe(F.col("id2")) & (F.col("th") == F.col("th2")), "left_semi")
        return stage(rows.select("text").mapInArrow(_sets, _SETS).dropDuplicates(["cls"]), name)

    sets = sets_of(candidates.select(F.col("a").alias("cls")).unionByName(candidates.select(F.col("b").alias("cls"))).distinct(), "sets")
    items = lambda x: sets.select(F.col("cls").alias(x), F.col("items").alias(f"i{x}"))
    tested = candidates.join(items("b"), "b").join(items("a"), "a")
    links = stage(tested.where(_linked(F.size(F.array_intersect("ia", "ib")), F.col("na"), F.col("nb"), percent)).select("a", "b"), "links")
    discard(candidates, sets)

    found = components(links)
    cells = unresolved(shared, found, classes)
    member = F.struct(*(f.split()[0] for f in _MEMBER.split(", ")))
    need = stage(cells.groupBy("cell").agg(F.collect_list(member).alias("rows")).mapInArrow(_ask(percent), "cell string, cls binary"), "asked")
    sets = sets_of(need.select("cls").distinct(), "cell_sets")
    filled = cells.join(need, ["cell", "cls"]).join(sets, "cls")
    member = F.struct(*(f.split()[0] for f in _MEMBER.split(", ")), "items")
    more = stage(filled.groupBy("cell").agg(F.collect_list(member).alias("rows")).mapInArrow(_confirm(percent), "a binary, b binary"), "more_links")
    discard(cells, need, sets, shared)

    joined = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))
    named = classes.select("cls", "first").join(joined.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    firsts = stage(named.groupBy("root").agg(F.min("first").alias("kept")), "firsts")
    label = stage(named.select("cls", "root").join(firsts, "root").select("cls", F.col("kept.doc_id").alias("component_id"), F.col("kept.th").alias("th_kept")), "labels")
    discard(links, found, more, joined, firsts, classes)
    return signed.select("doc_id", "th", "n", "cls"), label


def near_groups(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document."""
    signed, label = near_classes(docs, percent)
    out = signed.join(label, "cls", "left")
    own = F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"), F.col("doc_id").eqNullSafe(own).alias("kept"))


def drop_near_copies(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One document of each group, and all that are in none; all columns stay."""
    signed, label = near_classes(docs, percent)
    judged = signed.join(label, "cls").select("doc_id", "th", (F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("th") == F.col("th_kept"))).alias("stays"))
    # rows to judge: those that go, and those of which only one of several equal ones stays
    marks = judged.groupBy("doc_id", "th").agg(F.first("stays").alias("stays"), F.count("*").alias("n")).where("not stays or n > 1")
    marks = stage(marks.select(F.col("doc_id").alias("id2"), F.col("th").alias("th2"), "stays"), "marks")
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("d"), F.col("doc_id").cast("long").alias("id"), text_key(F.col("text")).alias("th"))
    both = whole.join(marks.hint("merge"), F.col("id").eqNullSafe(F.col("id2")) & (F.col("th") == F.col("th2")), "left")
    one = both.where("stays").groupBy("id", "th").agg(F.first("d").alias("d"))
    return both.where("stays is null").select("d.*").unionByName(one.select("d.*"))
