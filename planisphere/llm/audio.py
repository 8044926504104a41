"""Operator 10, media columns: chroma audio fingerprints and their alignment.

A recording (mono PCM samples) becomes pitch-class frames: the power of each short
Fourier frame folded to twelve pitch classes and scaled to length 1. Sixteen filters
over a window of 16 frames compare rectangles of the chroma image, each by four lookups
in its integral image, and give two bits each: a 32-bit integer for each frame. Two
recordings align if at any offset at most MAX_ERROR of the bits differ over an overlap of
MIN_OVERLAP frames or more. All offsets are tested, whether or not an integer is equal
there. Of those that align, the one with most equal integers is told.

The tables hold no audio, so the query renders each vector of `embeddings` as a
recording: a note for each of its numbers, the pitch set by the number.

`search` takes the fingerprints of a stated set of queries against all rows. Queries are
dealt to blocks and rows to chunks of about HELD integers each, and a task compares one
chunk with one block; nothing passes the driver, and no pair of recordings is made unless
it aligns. Some rows and a block are compared at an offset at once, frames in turn until
all pairs have more differing bits than the whole overlap may have. Work grows with the
product of the lengths. Style: Python with Arrow.

Defined cases: null or too short audio has an empty fingerprint and aligns with nothing;
silence gives equal chroma frames and fingerprints of zero difference; a recording does
not match itself by id; ties of offsets go to the fewest differing bits, then the
smallest shift, then the smaller one; repeated rows are recordings of their own, dealt
apart; a null id is no query; empty tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage

RATE, FRAME, HOP, WINDOW = 11025, 1024, 512, 16
LOWEST, HIGHEST = 110.0, 3520.0
#: A pair aligns if at most this share of bits differ over at least so many frames.
MAX_ERROR, MIN_OVERLAP = 0.15, 16
#: Integers in a block of queries or a chunk of rows, on average.
HELD = 1 << 17
QUERY_EVERY = 100
#: Rows compared at once, and integers held for it: bounds of memory only.
_ROWS, _CELLS = 8, 1 << 17
_LOW, _HIGH = -0.05, 0.05


def _filters() -> list[tuple[str, int, int, int]]:
    """(kind, first pitch class, pitch classes, frames), sixteen by rule: four kinds at four places."""
    kinds = ("across", "along", "corners", "middle")
    return [(kind, (3 * k + 2 * j) % 9, 4 if kind != "middle" else 3, (16, 8, 12, 4)[k]) for j, kind in enumerate(kinds) for k in range(4)]


FILTERS = _filters()


def _fold() -> np.ndarray:
    """Which pitch class each Fourier bin counts for: a 12-column matrix."""
    freq = np.arange(FRAME // 2 + 1) * RATE / FRAME
    ok = (freq >= LOWEST) & (freq <= HIGHEST)
    out = np.zeros((len(freq), 12))
    out[np.flatnonzero(ok), np.round(12 * np.log2(freq[ok] / 440.0)).astype(int) % 12] = 1.0
    return out


_FOLD, _HANN = _fold(), np.hanning(FRAME)


def chroma(samples: np.ndarray) -> np.ndarray:
    """frames x 12, each frame of length 1 (all zero in silence)."""
    n = (len(samples) - FRAME) // HOP + 1
    if n <= 0:
        return np.zeros((0, 12))
    out = np.empty((n, 12))
    for at in range(0, n, 1024):  # long recordings in pieces of bounded memory
        part = np.lib.stride_tricks.sliding_window_view(samples[at * HOP : (min(n, at + 1024) - 1) * HOP + FRAME], FRAME)[::HOP]
        out[at : at + 1024] = (np.abs(np.fft.rfft(part * _HANN, axis=1)) ** 2) @ _FOLD
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def fingerprint(samples: np.ndarray) -> np.ndarray:
    """One 32-bit integer for each window of 16 frames."""
    c = chroma(samples)
    n = len(c) - WINDOW + 1
    if n <= 0:
        return np.empty(0, np.uint32)
    total = np.zeros((len(c) + 1, 13))
    total[1:, 1:] = c.cumsum(axis=0).cumsum(axis=1)
    at = np.arange(n)

    def area(t0: int, t1: int, p0: int, p1: int) -> np.ndarray:
        return total[at + t1, p1] - total[at + t0, p1] - total[at + t1, p0] + total[at + t0, p0]

    out = np.zeros(n, np.uint32)
    for kind, p, high, wide in FILTERS:
        t0, t1, h, w = (WINDOW - wide) // 2, (WINDOW + wide) // 2, high // 2, wide // 2
        mid = t0 + w
        if kind == "across":
            a, b = area(t0, mid, p, p + high), area(mid, t1, p, p + high)
        elif kind == "along":
            a, b = area(t0, t1, p, p + h), area(t0, t1, p + h, p + high)
        elif kind == "corners":
            a = area(t0, mid, p, p + h) + area(mid, t1, p + h, p + high)
            b = area(mid, t1, p, p + h) + area(t0, mid, p + h, p + high)
        else:
            a, b = area(t0, t1, p + 1, p + 2) * 2, area(t0, t1, p, p + 1) + area(t0, t1, p + 2, p + 3)
        x = np.log((1 + np.maximum(a, 0)) / (1 + np.maximum(b, 0)))
        level = (x > _LOW).astype(np.uint32) + (x > 0) + (x > _HIGH)
        out = (out << np.uint32(2)) | (level ^ (level >> np.uint32(1)))  # Gray code: neighbours differ in one bit
    return out


def render(vector: np.ndarray) -> np.ndarray:
    """A recording of a vector: for each number a note of 512 samples, of 25 pitches above 220 Hz."""
    x = np.nan_to_num(np.asarray(vector, float))
    if not len(x):
        return np.empty(0)
    scaled = x / (np.sqrt((x * x).mean()) or 1.0)
    step = np.clip(np.round(scaled * 6) + 12, 0, 24)
    return np.sin(np.cumsum(np.repeat(2 * np.pi * 220.0 * 2 ** (step / 12) / RATE, HOP)))


_PRINTS = pa.schema([("id", pa.int64()), ("print", pa.list_(pa.int64()))])


def fingerprints(table: DataFrame, id_column: str, media: str, decode=np.asarray) -> DataFrame:
    """id, print of each row's media column; decode turns a value into samples."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(decode(np.asarray(v.as_py()))) if v.is_valid else np.empty(0, np.uint32) for v in batch.column(1)]
            yield pa.record_batch([batch.column(0).cast(pa.int64()), pa.array([f.astype(np.int64) for f in found], pa.list_(pa.int64()))], schema=_PRINTS)

    return table.select(F.col(id_column).cast("long").alias("id"), media).mapInArrow(each, "id long, print array<long>")


class _Block:
    """The fingerprints of some queries, by length, for comparison with rows."""

    def __init__(self, prints: list[tuple[int, np.ndarray]]):
        self.ids = [i for i, _ in prints]
        by_length: dict[int, list[int]] = {}
        for k, (_, p) in enumerate(prints):
            by_length.setdefault(len(p), []).append(k)
        #: (queries, their integers as frames x queries, the same with each integer's next beside it)
        self.groups = []
        for n, of in by_length.items():
            if n >= MIN_OVERLAP:
                frames = np.stack([np.asarray(prints[k][1], np.uint32) for k in of], axis=1)
                self.groups.append((np.array(of), frames, self._two(frames)))

    @staticmethod
    def _two(frames: np.ndarray) -> np.ndarray:
        return frames[:-1].astype(np.uint64) | (frames[1:].astype(np.uint64) << np.uint64(32))

    def aligned(self, row_id: int, p: np.ndarray) -> list[tuple[int, int, int, float]]:
        """(query id, offset, overlap, bit error) of each query that aligns with a row."""
        return [(self.ids[k], *rest) for _, k, *rest in self.of_rows([(row_id, p)])]

    def of_rows(self, rows: list[tuple[int, np.ndarray]]) -> list[tuple[int, int, int, int, float]]:
        """(row's place, query's place, offset, overlap, bit error) of all aligned pairs."""
        by_length: dict[int, list[int]] = {}
        for r, (_, p) in enumerate(rows):
            by_length.setdefault(len(p), []).append(r)
        best: dict[tuple[int, int], tuple] = {}
        for n, places in by_length.items():
            for at in range(0, len(places), _ROWS) if n >= MIN_OVERLAP else ():
                some = places[at : at + _ROWS]
                self._compare(rows, some, np.stack([np.asarray(rows[r][1], np.uint32) for r in some], axis=1), best)
        return [(r, k, shift, m, error) for (r, k), (_, error, _, shift, m) in sorted(best.items())]

    def _compare(self, rows: list[tuple[int, np.ndarray]], some: list[int], p: np.ndarray, best: dict) -> None:
        two = self._two(p)
        for of, frames, pairs in self.groups:
            step = 2 * max(1, _CELLS // (len(of) * len(some)))
            for shift in range(MIN_OVERLAP - len(frames), len(p) - MIN_OVERLAP + 1):
                a, b = max(0, -shift), max(0, shift)
                m = min(len(frames) - a, len(p) - b)
                most = int(MAX_ERROR * 32 * m) + 1  # one bit more, so that rounding drops nothing
                differ = np.zeros((len(some), len(of)), np.uint32)
                for t in range(0, m // 2 * 2, step):
                    end = min(t + step, m // 2 * 2)
                    x = pairs[a + t : a + end : 2, None, :] ^ two[b + t : b + end : 2, :, None]
                    differ += np.bitwise_count(x).sum(axis=0, dtype=np.uint32)
                    if differ.min() > most:
                        break
                row, query = np.nonzero(differ <= most)
                if not len(row):
                    continue
                bits = np.bitwise_count(frames[a : a + m, query] ^ p[b : b + m, row])
                total, votes = bits.sum(axis=0, dtype=np.int64), (bits == 0).sum(axis=0)
                for j in np.flatnonzero(total / (32 * m) <= MAX_ERROR):
                    r, k = some[row[j]], int(of[query[j]])
                    found = (-int(votes[j]), float(total[j]) / (32 * m), abs(shift), shift, m)
                    if self.ids[k] != rows[r][0] and ((r, k) not in best or found < best[r, k]):
                        best[r, k] = found


_ALIGNED = pa.schema([("query_at", pa.int64()), ("id", pa.int64()), ("offset", pa.int64()), ("overlap", pa.int64()), ("bit_error", pa.float64())])


def _compare(rows: pa.Table, queries: pa.Table) -> pa.Table:
    """The aligned pairs of a chunk of rows and a block of queries."""
    prints = lambda t: [(i, np.asarray(p or [], np.uint32)) for i, p in zip(t["id"].to_pylist(), t["print"].to_pylist())]
    ours, theirs, at = prints(rows), prints(queries), queries["at"].to_pylist()
    got = [(at[k], ours[r][0], *rest) for r, k, *rest in _Block(theirs).of_rows(ours)] if ours and theirs else []
    return pa.table([pa.array([g[k] for g in got], f.type) for k, f in enumerate(_ALIGNED)], schema=_ALIGNED)


def align(queries: DataFrame, prints: DataFrame) -> DataFrame:
    """query_at, id, offset, overlap, bit_error of the aligned pairs. Both have at (a row's own number), id, print."""

    def parts(df: DataFrame) -> int:
        return max(1, -(-int(df.agg(F.sum(F.size("print"))).first()[0] or 0) // HELD))

    blocks, chunks = parts(queries), parts(prints)
    dealt = lambda df, mine, n, other, m: df.withColumns({mine: F.pmod(F.xxhash64("at"), F.lit(n)), other: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))})
    rows = dealt(prints, "chunk", chunks, "block", blocks).groupBy("chunk", "block")
    asked = dealt(queries, "block", blocks, "chunk", chunks).groupBy("chunk", "block")
    return rows.cogroup(asked).applyInArrow(_compare, "query_at long, id long, offset long, overlap long, bit_error double")


def search(table: DataFrame, id_column: str, media: str, decode=np.asarray, query_every: int = QUERY_EVERY) -> DataFrame:
    """For each row whose id is divisible by query_every: n_matches, and the best match's id, offset, overlap and bit error."""
    prints = stage(fingerprints(table, id_column, media, decode).withColumn("at", F.monotonically_increasing_id()), "prints")
    queries = prints.where(F.col("id") % query_every == 0)
    best = align(queries, prints).groupBy("query_at").agg(F.count("*").alias("n_matches"), F.min(F.struct("bit_error", (-F.col("overlap")).alias("less"), "id", "offset")).alias("m"))
    mine = queries.select("at", F.col("id").alias(id_column), F.size("print").cast("long").alias("n_frames"))
    both = mine.join(best, F.col("at") == F.col("query_at"), "left")
    return both.select(id_column, "n_frames", F.coalesce("n_matches", F.lit(0)).cast("long").alias("n_matches"), F.col("m.id").alias("best_id"), F.col("m.offset").alias("best_offset"), (-F.col("m.less")).alias("best_overlap"), F.col("m.bit_error").alias("best_bit_error"))
