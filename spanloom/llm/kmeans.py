"""Operator 12, centroid clustering: Lloyd's rounds in whole numbers, nearest centroids by annulus search.

Each component x becomes ``floor(1024 * x)``, so sums, distances and centroids are whole numbers and the result
does not depend on how rows are dealt to tasks. Centroids are sorted by norm. A vector is first held against the
centroid of the nearest norm; its distance u bounds the nearest one's, whose norm must then lie within u of the vector's
(triangle inequality). A binary search in the sorted norms gives the centroids of this annulus, with a
margin for rounding so that none on its edge is missed; these alone are compared, exactly, ties going to the smaller number.

A round is one scan and no shuffle of vectors: tasks send one row of sums per centroid, which are added up in two steps,
so that the driver gets at most ``FOLDS`` rows a centroid. The kept vectors are written once and read by every round.

Defined results: rows whose vector is null, of another length, or holds nulls or non-finite components take no part;
a vector without an id takes part, but starts no cluster while others are there; of equal hashes the smaller vector
comes first; with fewer vectors than centroids there are fewer clusters; an empty table gives an empty result; repeated
rows count each. Components beyond 2**25 are computed with unbounded integers; a distance or sum that no long holds is null.
Only vec_id and embedding are read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.store import materialize

#: Sums of a centroid that reach the driver, at most.
FOLDS = 8
#: Components below this leave squared distances of up to ``2**11`` components within a long.
_SMALL = 1 << 25
_MOST = (1 << 63) - 1


def fixed_point(values: np.ndarray, scale: int) -> np.ndarray:
    """``floor(scale * x)`` of each double; longs, or Python's integers where one is large. ``scale`` is a power of two."""
    scaled = values * scale
    if not values.size or np.abs(scaled).max() < _SMALL:
        return np.floor(scaled).astype(np.int64)
    out = np.empty(values.shape, object)
    for at, x in np.ndenumerate(values):
        a, b = float(x).as_integer_ratio()
        out[at] = scale * a // b
    return out


def _root(squares: np.ndarray) -> np.ndarray:
    """Square roots: doubles, or rounded down where the numbers are Python's."""
    return np.array([math.isqrt(x) for x in squares], object) if squares.dtype == object else np.sqrt(squares.astype(np.float64))


class Annuli:
    """Centroids sorted by norm."""

    def __init__(self, centroids: np.ndarray) -> None:
        squares = (centroids * centroids).sum(axis=1)
        self.number = np.argsort(squares, kind="stable")
        self.sorted, self.norms, self.whole = centroids[self.number], _root(squares[self.number]), _root(squares[self.number].astype(object))

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each vector the number of the nearest centroid and the squared distance."""
        if vectors.dtype != self.sorted.dtype:
            vectors = vectors.astype(object)
        exact = vectors.dtype == object
        norms, k = self.whole if exact else self.norms, len(self.norms)
        size = _root((vectors * vectors).sum(axis=1))
        right = np.minimum(np.searchsorted(norms, size), k - 1)
        left = np.maximum(right - 1, 0)
        first = np.where(size - norms[left] < norms[right] - size, left, right)
        gap = vectors - self.sorted[first]
        best, number = (gap * gap).sum(axis=1), self.number[first].copy()
        bound = _root(best)
        bound = bound + (3 if exact else 1e-9 * (bound + size) + 1e-6)  # for what the roots lost
        low, high = np.searchsorted(norms, size - bound, "left"), np.searchsorted(norms, size + bound, "right")
        for place in range(k):
            rows = np.flatnonzero((low <= place) & (place < high) & (first != place))
            if len(rows):
                gap = vectors[rows] - self.sorted[place]
                found, own = (gap * gap).sum(axis=1), self.number[place]
                better = (found < best[rows]) | ((found == best[rows]) & (own < number[rows]))
                best[rows[better]], number[rows[better]] = found[better], own
        return number, best


def _matrix(column: pa.Array, width: int, scale: int) -> np.ndarray:
    """Vectors of one length as whole numbers, a row each."""
    return fixed_point(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width), scale)


def kept_vectors(rows: DataFrame, width: int) -> DataFrame:
    """vec_id and embedding of the rows that take part."""
    own = rows.select(F.col("vec_id").cast("long"), "embedding").where(F.size("embedding") == width)
    plain = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return own.where(plain)


def _first(rows: DataFrame, k: int, seed: int, scale: int, width: int) -> np.ndarray:
    """The k vectors of the smallest hashes of seed and id."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    found = rows.select(key.alias("key"), "embedding").orderBy(F.asc_nulls_last("key"), "embedding").limit(k).collect()
    return fixed_point(np.array([r["embedding"] for r in found], np.float64).reshape(-1, width), scale)


def _sums(rows: DataFrame, centroids: np.ndarray, width: int, scale: int) -> dict[int, tuple[int, int, list[int]]]:
    """Of each centroid with vectors: their number, the sum of their squared distances, and their sums by component."""
    annuli = Annuli(centroids)

    def add(total: dict, cluster: int, n: int, distance: int, parts: list[int]) -> None:
        if cluster in total:
            m, d, old = total[cluster]
            n, distance, parts = n + m, distance + d, [a + b for a, b in zip(parts, old, strict=True)]
        total[cluster] = (n, distance, parts)

    def out(total: dict) -> pa.RecordBatch:
        lines = [(c, ",".join(map(str, (n, d, *parts)))) for c, (n, d, parts) in total.items()]
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in lines], pa.int32()), pa.array([x[1] for x in lines], pa.string())], names=["cluster", "sums"])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict = {}
        for batch in batches:
            if batch.num_rows:
                vectors = _matrix(batch.column(0), width, scale)
                number, distance = annuli.nearest(vectors)
                for c in np.unique(number):
                    own = number == c
                    add(total, int(c), int(own.sum()), sum(distance[own].tolist()), list(map(int, vectors[own].sum(axis=0))))
        yield out(total)

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict = {}
        for batch in batches:
            for c, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n, d, *parts = map(int, line.split(","))
                add(total, c, n, d, parts)
        yield out(total)

    each = rows.select("embedding").mapInArrow(partial, "cluster int, sums string")
    total: dict[int, tuple[int, int, list[int]]] = {}
    for r in each.repartition(FOLDS).mapInArrow(folded, "cluster int, sums string").collect():
        n, d, *parts = map(int, r["sums"].split(","))
        add(total, r["cluster"], n, d, parts)
    return total


def _whole(rows: list[list[int]], width: int) -> np.ndarray:
    small = all(abs(x) < _SMALL for r in rows for x in r)
    return np.array(rows, np.int64 if small else object).reshape(-1, width)


def fit(rows: DataFrame, k: int, rounds: int, seed: int, width: int, scale: int) -> np.ndarray:
    """Centroids after ``rounds`` rounds over the kept vectors ``rows``."""
    centroids = _first(rows, k, seed, scale, width)
    for _ in range(rounds if len(centroids) else 0):
        moved = _sums(rows, centroids, width, scale)
        centroids = _whole([[s // moved[c][0] for s in moved[c][2]] if c in moved else list(map(int, old)) for c, old in enumerate(centroids)], width)
    return centroids


def clusters(vectors: DataFrame, k: int = 8, rounds: int = 10, seed: int = 3, width: int = 64, scale: int = 1024) -> DataFrame:
    """vec_id, cluster, squared distance, its sum over the cluster and over all, and the centroid's hash, for each kept vector."""
    rows = materialize(kept_vectors(vectors, width), "vectors")
    centroids = fit(rows, k, rounds, seed, width, scale)
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not len(centroids):
        return rows.sparkSession.createDataFrame([], schema)
    annuli, sums = Annuli(centroids), {c: d for c, (_, d, _) in _sums(rows, centroids, width, scale).items()}
    fits = lambda x: int(x) if x <= _MOST else None
    inertia = fits(sum(sums.values()))
    hashes = [hashlib.sha256(",".join(map(str, map(int, c))).encode()).hexdigest() for c in centroids]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                number, distance = annuli.nearest(_matrix(batch.column(1), width, scale))
                columns = ([fits(x) for x in distance.tolist()], [fits(sums[int(c)]) for c in number], [inertia] * len(number))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(number, pa.int32()), *(pa.array(c, pa.int64()) for c in columns), pa.array([hashes[int(c)] for c in number])], names=["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"])

    return rows.select("vec_id", "embedding").mapInArrow(assign, schema)
