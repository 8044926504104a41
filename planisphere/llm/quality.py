"""Operator 3, quality classifier by compression.

zstandard dictionaries are trained on labelled good and bad text. A text is compressed
in pieces of 4 KB, all of it, once with either dictionary; the difference of the two
sizes over their sum is its feature, and a logistic curve fitted on labelled text that
the dictionaries have not seen turns it into a probability.

Fitting uses a bounded sample, PER_CLASS documents of each class in the order of a hash
of doc_id: the only bound. Their texts are taken whole, a dictionary is trained in a task
of its own, and the driver sees the two dictionaries and a number a sampled document.
Every text is scored whole. The class counts over all labelled rows set the curve's
prior. Held-out rows (crc32 of doc_id mod 4 is 2) are not learned from; lang, source,
doc_id and labels are no inputs.

Defined cases: of several texts of a labelled doc_id the first in order is learned from; null or empty text has difference 0 and scores by the prior alone; labels
other than 0 and 1 are ignored, and of several labels of a document the lowest counts;
with only one class labelled every score is that class's share (0.5 without labels);
repeated rows score alike; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, stage
from .mixing import order_hash

#: Labelled documents of each class that are learned from; every FRESH-th calibrates, the others train the dictionary.
PER_CLASS, FRESH = 1500, 3
PIECE, DICTIONARY, LEVEL, PASSING = 4096, 112 * 1024, 3, 0.7


class Model(NamedTuple):
    good: bytes
    bad: bytes
    slope: float
    bias: float


@lru_cache(maxsize=8)
def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary), write_content_size=False, write_checksum=False, write_dict_id=False)


def difference(text: str | None, good: bytes, bad: bytes) -> float:
    """(size with bad - size with good) / their sum; 0 for no text. Frames' fixed bytes are not counted."""
    raw = (text or "").encode("utf-8", "replace")
    if not raw:
        return 0.0
    sizes = []
    for dictionary in (good, bad):
        c = _compressor(dictionary)
        sizes.append(sum(len(c.compress(raw[at : at + PIECE])) - 5 for at in range(0, len(raw), PIECE)))
    return (sizes[1] - sizes[0]) / max(1, sizes[0] + sizes[1])


def _dictionary(texts: list[str]) -> bytes:
    pieces = [raw[at : at + 2048] for t in texts if (raw := t.encode("utf-8", "replace")) for at in range(0, len(raw), 2048)]
    try:
        return zstandard.train_dictionary(DICTIONARY, pieces).as_bytes()
    except zstandard.ZstdError:  # too little text to train on: the text itself serves
        return b"".join(pieces)[-DICTIONARY:].ljust(8, b" ")


def _logistic(x: np.ndarray, y: np.ndarray, steps: int = 30) -> tuple[float, float]:
    """Slope and bias by Newton steps with a light ridge, classes weighing the same."""
    scale = np.abs(x).mean() or 1.0
    a = np.column_stack([x / scale, np.ones(len(x))])
    w, weight = np.zeros(2), np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (weight * p * (1 - p))[:, None]).T @ a + 1e-4 * np.eye(2)
        w = w + np.linalg.solve(h, a.T @ (weight * (y - p)) - 1e-4 * w)
    return float(w[0] / scale), float(w[1])


def sample(docs: DataFrame, known: DataFrame) -> DataFrame:
    """quality, u, text: at most PER_CLASS labelled documents of each class, one text each; a staged table. known: doc_id, quality."""
    ranked = known.withColumn("u", order_hash(F.col("doc_id")))
    chosen = [ranked.where(F.col("quality") == q).orderBy("u", "doc_id").limit(PER_CLASS) for q in (0, 1)]
    chosen = chosen[0].unionByName(chosen[1]).select(F.col("doc_id").alias("id"), "quality", "u")
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("id"))
    return stage(found.groupBy("doc_id", "quality", "u").agg(F.min("text").alias("text")), "labelled_texts")


def _train(part: pd.DataFrame) -> pd.DataFrame:
    part = part.sort_values(["u", "text"])
    seen = part[part.u % FRESH != 0]
    return pd.DataFrame({"quality": [int(part.quality.iloc[0])], "dictionary": [_dictionary(list((seen if len(seen) else part).text))]})


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    known = labels.where(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    counts = {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()}
    texts = sample(docs, known)
    trained = {r.quality: bytes(r.dictionary) for r in texts.groupBy("quality").applyInPandas(_train, "quality int, dictionary binary").collect()}
    if len(trained) < 2:
        share = 0.5 if not counts else float(bool(counts.get(1)))
        return Model(b" " * 8, b" " * 8, 0.0, float(np.clip(200 * (share - 0.5), -100, 100)) if counts else 0.0)
    good, bad = trained[1], trained[0]

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [difference(t.as_py(), good, bad) for t in batch.column(2)]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(x, pa.float64())], names=["quality", "fresh", "x"])

    rows = texts.select(F.col("quality").cast("int"), (F.col("u") % FRESH == 0).alias("fresh"), "text").mapInArrow(features, "quality int, fresh boolean, x double").collect()
    fresh = {q: sorted(r.x for r in rows if r.quality == q and r.fresh) or sorted(r.x for r in rows if r.quality == q) for q in (0, 1)}
    slope, bias = _logistic(np.array(fresh[0] + fresh[1]), np.array([0] * len(fresh[0]) + [1] * len(fresh[1])))
    return Model(good, bad, slope, bias + float(np.log(counts[1] / counts[0])))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every document."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([difference(t.as_py(), model.good, model.bad) for t in batch.column(1)], float)
            p = 1 / (1 + np.exp(-np.clip(model.slope * x + model.bias, -40, 40)))
            yield pa.record_batch([batch.column(0).cast(pa.int64()), pa.array(p, pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(each, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    out = score(docs, fit(docs, labels))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= PASSING).cast("int").alias("predicted"))
