"""Operator 5, language identification by nearest centroids.

A text's letters, lower-cased, give counts of one to three letters in a row, hashed to
4096 places, damped to 1 + log(count), weighed by inverse document frequency and scaled
to length 1. Each language has up to three centroids (spherical k-means); the nearest
one by cosine names the language. A text whose best cosine is far below what texts of
its length show in training is rejected: `rejected` says so, lang_pred still names the
nearest language. A threshold never falls with length, as cosines grow with it: a few odd
training texts of one length cannot open it to random letters of that length.

Fitting uses a bounded sample, the only bound: about PER_LANG different documents of
each language, chosen by a hash, their texts whole. Counting and clustering run in
tasks, a language's sample in one; the driver sees the centroids and a threshold for each
power of two of a text's letters. Every text is judged whole. Held-out rows (crc32 of
doc_id mod 4 is 2) are not learned from; lang, source and doc_id are no inputs of a
prediction.

Defined cases: null text and text without a letter are `und`, with score 0 and rejected;
null lang is not learned from; without any language to learn, all texts are `und`;
repeated rows are judged alike and learned from once; empty tables give no rows. lang_pred,
score and rejected of `identify` replace columns of these names; `retain` keeps the rows
that are not rejected, with all their columns, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, held_out, stage

PER_LANG = 400
PLACES_BITS, CENTROIDS, ROUNDS = 12, 3, 12
#: A text is rejected below this share of this quantile of the training cosines at its length or any shorter one.
REJECT, LOWEST = 0.85, 0.005
#: So many cosines of a length at least; with fewer the threshold of the next shorter length holds.
ENOUGH = 300
_PLACES = 1 << PLACES_BITS
_LETTER = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
_A = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)


class Model(NamedTuple):
    langs: list[str]
    centroids: np.ndarray  # one row each
    owner: np.ndarray  # the language of each centroid
    idf: np.ndarray
    least: np.ndarray  # by power of two of the number of letters


def counts(text: str | None) -> np.ndarray | None:
    """Counts of letter runs by place; None without a letter."""
    if not text:
        return None
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _LETTER[c]
    if not letter.any():
        return None
    c = np.where(letter, c, np.uint32(32))
    keep = np.ones(len(c), bool)
    keep[1:] = letter[1:] | letter[:-1]
    c = np.concatenate([[np.uint32(32)], c[keep], [np.uint32(32)]]).astype(np.uint32)
    shift = np.uint32(32 - PLACES_BITS)
    one = c * _A[0]
    two = (one[:-1] ^ (one[:-1] >> np.uint32(15))) * _A[1] + c[1:] * _A[2]
    three = (two[:-1] ^ (two[:-1] >> np.uint32(13))) * _A[2] + c[2:] * _A[1]
    return np.bincount(np.concatenate([one, two ^ np.uint32(0x5BD1E995), three]) >> shift, minlength=_PLACES)


def vector(n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.where(n > 0, 1 + np.log(np.maximum(n, 1)), 0.0) * idf
    return (v / (np.linalg.norm(v) or 1.0)).astype(np.float32)


def _bucket(n: np.ndarray) -> int:
    return min(31, int(n.sum()).bit_length())


def _clusters(x: np.ndarray) -> np.ndarray:
    """Spherical k-means from far-apart rows; deterministic."""
    mean = x.mean(axis=0)
    picked = [int(np.argmax(x @ mean))]
    while len(picked) < min(CENTROIDS, len(x)):
        picked.append(int(np.argmin((x @ x[picked].T).max(axis=1))))
    c = x[picked]
    for _ in range(ROUNDS):
        near = np.argmax(x @ c.T, axis=1)
        c = np.stack([x[near == k].mean(axis=0) if (near == k).any() else c[k] for k in range(len(c))])
        c = c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c.astype(np.float32)


def _of(n: dict) -> np.ndarray:
    out = np.zeros(_PLACES, np.int64)
    out[np.asarray(n["places"], np.int64)] = n["counts"]
    return out


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, u, places, counts of texts with a letter; from lang, u, text."""
    for batch in batches:
        rows = [(lang, u, n) for lang, u, t in zip(*(batch.column(k).to_pylist() for k in range(3))) if (n := counts(t)) is not None]
        at = [np.flatnonzero(n) for _, _, n in rows]
        cols = [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array(at, pa.list_(pa.int64())), pa.array([n[k] for k, (_, _, n) in zip(at, rows)], pa.list_(pa.int64()))]
        yield pa.record_batch(cols, names=["lang", "u", "places", "counts"])


def sample(docs: DataFrame) -> DataFrame:
    """lang, u, text: about PER_LANG different documents of each language; a staged table."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    per = stage(known.groupBy("lang").agg(F.count("*").alias("n")).select(F.col("lang").alias("l"), "n"), "langs")
    u = F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 12)
    some = known.select("lang", "text", u.alias("u")).join(per, F.col("lang") == F.col("l")).where(F.col("u").cast("double") * F.col("n") < F.lit(float(PER_LANG) * 2.0**52))
    return stage(some.dropDuplicates(["lang", "u"]).select("lang", "u", "text"), "known_texts")


def fit(docs: DataFrame) -> Model | None:
    texts = sample(docs)
    found = stage(texts.mapInArrow(_counted, "lang string, u long, places array<long>, counts array<long>"), "counted")
    total, df = found.count(), np.zeros(_PLACES)
    if not total:
        return None
    for r in found.select(F.explode("places").alias("p")).groupBy("p").count().collect():  # a row a place at most
        df[r.p] = r["count"]
    idf = np.log((1 + total) / (1 + df)) + 1

    def clustered(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("u")
        c = _clusters(np.stack([vector(_of(n), idf) for n in part[["places", "counts"]].to_dict("records")]))
        return pd.DataFrame({"lang": part.lang.iloc[0], "nth": range(len(c)), "centroid": [x.tolist() for x in c]})

    rows = found.groupBy("lang").applyInPandas(clustered, "lang string, nth long, centroid array<float>").orderBy("lang", "nth").collect()
    langs = sorted({r.lang for r in rows})
    centroids, owner = np.array([r.centroid for r in rows], np.float32), np.array([langs.index(r.lang) for r in rows])

    def shown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The cosines of windows of the training texts, of many lengths, and of the whole texts."""
        for batch in batches:
            out = []
            for text in batch.column(0).to_pylist():
                for size in (*(2**k for k in range(3, 15)), len(text)):
                    for at in {(len(text) - size) * k // 4 for k in range(5)} if size <= len(text) else ():
                        if (n := counts(text[at : at + size])) is not None:
                            out.append((_bucket(n), float((centroids @ vector(n, idf)).max())))
            yield pa.record_batch([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.float64())], names=["b", "cos"])

    low = texts.select("text").mapInArrow(shown, "b long, cos double").groupBy("b").agg(F.count("*").alias("n"), F.percentile("cos", LOWEST).alias("q")).collect()
    by, least, last = {r.b: r for r in low}, np.zeros(32), 0.0
    for b in range(32):
        # cosines grow with length, so a threshold never falls: an odd text of a length must not open it for all of that length
        last = max(last, REJECT * by[b].q) if b in by and by[b].n >= ENOUGH else last
        least[b] = last
    discard(texts, found)
    return Model(langs, centroids, owner, idf, least)


def judge(text: str | None, model: Model | None) -> tuple[str, float, bool]:
    """lang_pred, score, rejected of a text."""
    n = counts(text) if model else None
    if n is None:
        return "und", 0.0, True
    cos = model.centroids @ vector(n, model.idf)
    k = int(np.argmax(cos))
    return model.langs[model.owner[k]], float(min(1.0, max(0.0, cos[k]))), bool(cos[k] < model.least[_bucket(n)])


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """lang_pred, score (the best cosine) and rejected of every row, after its other columns."""
    fields = [f for f in docs.schema.fields if f.name not in ("lang_pred", "score", "rejected")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", lang_pred string, score double, rejected boolean"
    names = [f.name for f in fields]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [judge(t.as_py(), model) for t in batch.column(names.index("text"))]
            new = [pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array([g[2] for g in got], pa.bool_())]
            yield pa.record_batch([*batch.columns, *new], names=[*names, "lang_pred", "score", "rejected"])

    return docs.select(*(F.col(f"`{c}`") for c in names)).mapInArrow(each, schema)


def retain(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows whose language is told, all columns kept."""
    at = docs.columns.index("text")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([not judge(t.as_py(), model)[2] for t in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(each, docs.schema)


def predict(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected."""
    model = fit(docs.select("doc_id", "text", "lang"))
    out = identify(docs.select(F.col("doc_id").cast("long"), "text"), model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")
