"""Centroid clustering by Yinyang grouping, exact in whole numbers.

Centroids are put into groups once. Each vector carries an upper bound of the distance to its centroid and one lower bound a group; as
centroids move, the bounds move with them. A vector whose upper bound stays below all lower bounds keeps its cluster unseen; otherwise
only the groups that may hold a nearer centroid are scanned, in full and exactly. Bounds are rounded outwards, so the result is that
of a plain scan, ties included.

A round is one pass over the vectors, which carry their bounds in a staged table, and leaves each cluster's sums with them, a few
rows a task; only these sums, summed by Spark, reach the driver, and only centroids and groups, whose number is a parameter, go out.
Nothing is shuffled by cluster, so a cluster may hold most vectors.

Defined results: rows without a vector, with another number of components or with a component that is null or not finite are left out;
repeated rows, repeated and null ids are vectors of their own (a null id is hashed as an empty one); of fewer vectors than centroids
each starts one; no vectors give no rows. Components may be of any finite size: beyond `EXACT` Python's whole numbers take the place of
doubles; a distance beyond the largest long is given as that long.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, stage

K, ROUNDS, DIMS, SCALE, SEED, PER_GROUP = 40, 5, 64, 256, 2, 10
#: With components up to here, sums of 64 products of differences are exact in doubles.
EXACT = 1 << 21
#: Sums travel in digits of so many bits, so that any number of them fits a long.
BITS = 28
_LONGEST = (1 << 63) - 1
_STATE = "vec_id bigint, q array<double>, cluster int, upper double, lower array<double>, distance bigint, at bigint, total bigint, part int"


class Move(NamedTuple):
    """Centroids as whole numbers, each one's group, and how far each went since the last assignment (None: there was none)."""

    centroids: list[list[int]]
    groups: np.ndarray
    drift: np.ndarray | None


def kept(vectors: DataFrame, vec: str = "embedding", vec_id: str = "vec_id", dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """vec_id and q, the floored multiples, of the vectors that count; a staged table."""
    x = F.col(vec).cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    largest = float(np.finfo(float).max)
    whole = F.transform(x, lambda v: F.greatest(F.lit(-largest), F.least(F.lit(largest), _floor(v * scale))))
    good = vectors.where(F.col(vec).isNotNull() & (F.size(vec) == dims) & F.coalesce(finite, F.lit(False)))
    return stage(good.select(F.col(vec_id).cast("bigint").alias("vec_id"), whole.alias("q")), "vectors")


def _floor(v: Column) -> Column:
    """floor of a double as a double; those of 2^53 and more are whole (floor itself returns longs)."""
    return F.when(F.abs(v) < 2.0**53, F.floor(v).cast("double")).otherwise(v)


def start(vectors: DataFrame, k: int = K, seed: int = SEED) -> list[list[int]]:
    """The k vectors of the smallest digest of seed and id, in its order; ties by their components."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return [[int(v) for v in r.q] for r in vectors.select(digest.alias("h"), "q").orderBy("h", "q").limit(k).collect()]


def group(centroids: list[list[int]], per_group: int = PER_GROUP, rounds: int = 5) -> np.ndarray:
    """A group for each centroid, by a few rounds of clustering among them."""
    x = np.array(centroids, float)
    n = max(1, len(x) // per_group)
    x = x / (np.abs(x).max() or 1)
    seeds = x[:n].copy()
    for _ in range(rounds):
        of = ((x[:, None] - seeds[None]) ** 2).sum(2).argmin(1)
        for g in range(n):
            if (of == g).any():
                seeds[g] = x[of == g].mean(0)
    return np.unique(of, return_inverse=True)[1]


def squared(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to rows: in doubles where all sums are whole numbers below 2^53, else as Python's numbers."""
    if q.dtype != object:
        return (q * q).sum(1)[:, None] - 2 * (q @ c.T) + (c * c).sum(1)[None]
    return np.array([[sum((a - b) ** 2 for a, b in zip(x, y)) for y in c] for x in q], object).reshape(len(q), len(c))


def _root(d: np.ndarray, beyond: float) -> np.ndarray:
    """Roots as doubles; `beyond` where no double holds one."""
    if d.dtype != object:
        return np.sqrt(d)

    def one(v: int) -> float:
        try:
            return float(math.isqrt(v) + int(beyond == np.inf))
        except OverflowError:
            return beyond

    return np.array([one(v) for v in d.ravel()], float).reshape(d.shape)


def _up(d: np.ndarray) -> np.ndarray:
    """No less than the root of an exact square."""
    return _wider(_root(d, np.inf))


def _down(d: np.ndarray) -> np.ndarray:
    """No more than the root of an exact square."""
    return _narrower(_root(d, np.finfo(float).max))


def _wider(x: np.ndarray) -> np.ndarray:
    return x * (1 + 1e-9) + 1e-9


def _narrower(x: np.ndarray) -> np.ndarray:
    return x * (1 - 1e-9) - 1e-9


def assign(q: np.ndarray, move: Move, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> int:
    """Bring the clusters and bounds of vectors up to date with the centroids, in place; returns how many distances it took."""
    c, of = np.array(move.centroids, q.dtype), move.groups
    rows, taken = np.arange(len(q)), 0
    if move.drift is None:
        upper[:], lower[:], cluster[:] = np.inf, -np.inf, 0
    else:
        upper[:] = _wider(upper + move.drift[cluster])
        far = np.array([move.drift[of == g].max() for g in range(lower.shape[1])])
        lower[:] = np.where(np.isposinf(lower), lower, _narrower(lower) - far[None])
        rows = rows[upper >= lower.min(1)]  # the global filter
    if not len(rows):
        return taken
    mine = cluster[rows]
    own = np.empty(len(rows), q.dtype)  # exact distances to the centroids held
    for k in np.unique(mine):
        own[mine == k] = squared(q[rows[mine == k]], c[k : k + 1])[:, 0]
    taken += len(rows)
    upper[rows] = _up(own)
    best, at = own.copy(), mine.copy()
    far = np.full((len(rows), lower.shape[1]), np.inf)  # the nearest centroid of a scanned group but for the vector's own
    scanned = np.zeros(far.shape, bool)
    seen: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for g in range(lower.shape[1]):
        hit = np.flatnonzero(lower[rows, g] <= _up(best))  # the group filter, against the best so far
        if not len(hit):
            continue
        members = np.flatnonzero(of == g)
        d = squared(q[rows[hit]], c[members])
        taken += d.size
        scanned[hit, g] = True
        near = d.argmin(1)  # ties: the smaller number
        value, name = d[np.arange(len(hit)), near], members[near]
        won = (value < best[hit]) | ((value == best[hit]) & (name < at[hit]))
        best[hit[won]], at[hit[won]] = value[won], name[won]
        seen.append((hit, members, d))
    for hit, members, d in seen:
        d = _down(d)
        d[members[None] == at[hit][:, None]] = np.inf
        far[hit, of[members[0]]] = d.min(1)
    low = np.where(scanned, far, lower[rows])
    left = np.flatnonzero(at != mine)  # the centroid given up now counts for its group
    low[left, of[mine[left]]] = np.minimum(low[left, of[mine[left]]], _down(own[left]))
    lower[rows], cluster[rows], upper[rows] = low, at, _up(best)
    return taken


def _sums(q: np.ndarray, cluster: np.ndarray) -> dict[tuple[int, int], int]:
    """(cluster, place) -> sum; place -1 counts the vectors, place i + j * components the j-th digit of component i."""
    out: dict[tuple[int, int], int] = {}
    for k in np.unique(cluster):
        out[int(k), -1] = int((cluster == k).sum())
        for i, v in enumerate(q[cluster == k].sum(0)):
            v, j = int(v), i
            while v:
                out[int(k), j] = (abs(v) & ((1 << BITS) - 1)) * (1 if v > 0 else -1)
                v, j = (abs(v) >> BITS) * (1 if v > 0 else -1), j + q.shape[1]
    return out


def _pass(move: Move, dims: int):
    """The task of a round: vectors with new bounds (part 0), then the task's sums and the number of distances (part 1, at)."""
    n_groups = int(move.groups.max()) + 1
    small = max(abs(v) for c in move.centroids for v in c) <= EXACT

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], int] = {}
        for b in batches:
            n = b.num_rows
            q = b.column("q").flatten().to_numpy(zero_copy_only=False).reshape(n, dims)
            if not small or n and np.abs(q).max() > EXACT:
                q = np.array([[int(v) for v in row] for row in q.tolist()], object).reshape(n, dims)
            cluster, upper, lower = np.zeros(n, np.int64), np.zeros(n), np.zeros((n, n_groups))
            if move.drift is not None:
                cluster, upper = b.column("cluster").to_numpy().astype(np.int64), b.column("upper").to_numpy().copy()
                lower = b.column("lower").flatten().to_numpy().reshape(n, n_groups).copy()
            taken = assign(q, move, cluster, upper, lower)
            centroids = np.array(move.centroids, q.dtype)
            exact = ((q - centroids[cluster]) ** 2).sum(1) if n else np.zeros(0)
            for key, v in [*_sums(q, cluster).items(), ((-1, -1), taken)]:
                total[key] = total.get(key, 0) + v
            yield pa.record_batch([
                b.column("vec_id"), b.column("q"), pa.array(cluster, pa.int32()), pa.array(upper), pa.FixedSizeListArray.from_arrays(pa.array(lower.ravel()), n_groups).cast(pa.list_(pa.float64())),
                pa.array([min(int(d), _LONGEST) for d in exact], pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.array(np.zeros(n), pa.int32()),
            ], names=_NAMES)
        if total:
            keys, n = list(total), len(total)
            empty = [pa.nulls(n, t) for t in (pa.int64(), pa.list_(pa.float64()))]
            yield pa.record_batch([
                *empty, pa.array([k for k, _ in keys], pa.int32()), pa.nulls(n, pa.float64()), pa.nulls(n, pa.list_(pa.float64())), pa.nulls(n, pa.int64()),
                pa.array([p for _, p in keys], pa.int64()), pa.array(list(total.values()), pa.int64()), pa.array(np.ones(n), pa.int32()),
            ], names=_NAMES)

    return run


_NAMES = [c.split()[0] for c in _STATE.split(", ")]


class Clusters(NamedTuple):
    """members: vec_id, cluster, distance (a staged table); centroids; distances computed in each round."""

    members: DataFrame
    centroids: list[list[int]]
    taken: list[int]


def fit(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, seed: int = SEED, per_group: int = PER_GROUP, **columns) -> Clusters:
    """`rounds` rounds of assigning and averaging from the k starting vectors, then an assignment."""
    state = kept(vectors, **columns)
    centroids, taken = start(state, k, seed), []
    if not centroids:
        return Clusters(state.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("bigint").alias("distance")), [], [])
    dims = len(centroids[0])
    move = Move(centroids, group(centroids, per_group), None)
    for last in [False] * rounds + [True]:
        rows = state.where("part = 0") if taken else state
        found = stage(rows.mapInArrow(_pass(move, dims), _STATE), "bounds", partition_by="part")
        discard(state)
        state = found
        if not last:
            move, n = _moved(move, state, dims)
        else:
            n = state.where((F.col("part") == 1) & (F.col("cluster") == -1)).agg(F.sum("total")).first()[0]
        taken.append(int(n))
    return Clusters(state.where("part = 0").select("vec_id", "cluster", "distance"), move.centroids, taken)


def _moved(move: Move, state: DataFrame, dims: int) -> tuple[Move, int]:
    """Centroids at their vectors' floored means: as many rows reach the driver as centroids have digits."""
    sums: dict[int, list[int]] = {c: [0] * dims for c in range(-1, len(move.centroids))}
    count = dict.fromkeys(sums, 0)
    for r in state.where("part = 1").groupBy("cluster", "at").agg(F.sum("total").alias("total")).collect():
        if r["at"] < 0:
            count[r.cluster] = r.total
        else:
            sums[r.cluster][r["at"] % dims] += r.total << BITS * (r["at"] // dims)
    new = [[s // count[c] for s in sums[c]] if count[c] else old for c, old in enumerate(move.centroids)]
    went = np.array([sum((a - b) ** 2 for a, b in zip(x, y)) for x, y in zip(move.centroids, new)], object)
    return Move(new, move.groups, np.where(went > 0, _up(went), 0.0)), count[-1]


def report(found: Clusters) -> DataFrame:
    """members with cluster_inertia, inertia and centroid_sha256. What is joined has a row a centroid."""
    members, spark = found.members, found.members.sparkSession
    digests = [(c, hashlib.sha256(",".join(map(str, v)).encode()).hexdigest()) for c, v in enumerate(found.centroids)]
    most = F.lit(_LONGEST).cast("decimal(38,0)")
    of = members.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(28,0)")).alias("sum"))
    rows = [(r.cluster, min(int(r.sum), _LONGEST)) for r in of.select("cluster", F.least("sum", most).alias("sum")).collect()]
    whole, by = min(sum(s for _, s in rows), _LONGEST), dict(rows)
    small = spark.createDataFrame([(c, by.get(c, 0), whole, h) for c, h in digests], "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return members.join(F.broadcast(small), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
