"""Centroid clustering of integer vectors, exact at every size.

Distances are |x|^2 - 2x.c + |c|^2, the middle term a matrix product in float64 over blocks of rows and of centroids. All values
are integers, so the product is exact while every partial sum stays below 2^53; that holds for a row whose largest component and
the centroids' largest one satisfy dim * (|x| + |c|)^2 < 2^53. Rows beyond that bound are computed in 64-bit integers, and rows
beyond 2^63 in Python's integers. A round reads the vectors once: each task adds up its own rows (one row of k sums leaves it),
``treeAggregate`` adds up the tasks, and the driver holds k centroids, whatever the number of vectors.

Defined results: vectors that are null, of another length, or with a null or non-finite component are left out. Of equal distances
the smaller centroid wins; of equal ids the smaller components start first, and null ids start last (as the hash of nothing).
With fewer vectors than centroids each vector starts one. An empty table gives no rows. A distance or sum beyond a long is null, the
assignment is exact all the same. Other columns are ignored, so their names cannot clash; repeated rows are rows of their own.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import lean, written

#: Integers up to here are exact in float64, and in a long.
EXACT, LONG = 1 << 53, 1 << 63
ROWS, CENTROIDS = 4096, 1024


def components(column: pa.Array, dim: int, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of the vectors that count, and floor(scale * x) of their components as float64 (infinite where that passes a double)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    whole = np.asarray(pc.fill_null(pc.equal(pc.list_value_length(column), dim), False))
    flat = column.filter(pa.array(whole)).flatten()
    x = np.asarray(flat.to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim)
    fine = np.isfinite(x).all(axis=1)
    with np.errstate(over="ignore"):
        return np.flatnonzero(whole)[fine], np.floor(x[fine] * scale)


def whole_numbers(x: np.ndarray, column: pa.Array, places: np.ndarray, scale: float) -> np.ndarray:
    """The components as Python's integers; those that passed a double are large whole numbers before they are scaled."""
    out = np.empty(x.shape, object)
    for i, row in enumerate(x.tolist()):
        raw = None if np.isfinite(x[i]).all() else column[int(places[i])].as_py()
        out[i] = [int(v) if np.isfinite(v) else int(raw[j]) * int(scale) for j, v in enumerate(row)]
    return out


@dataclass
class Centroids:
    """k centroids of whole numbers (objects), with what the exact products need."""

    values: np.ndarray

    def __post_init__(self) -> None:
        self.most = max((abs(v) for v in self.values.ravel().tolist()), default=0)
        self.dim = self.values.shape[1]
        self.floats = self.values.astype(np.float64) if self.most < EXACT else None
        self.longs = self.values.astype(np.int64) if self.most < LONG else None

    def reach(self, limit: int) -> int:
        """The largest component of a row for which dim * (|x| + |c|)^2 stays below the limit; -1 if there is none."""
        return max(-1, math.isqrt((limit - 1) // self.dim) - self.most)

    def nearest(self, x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest centroid and squared distance, all of x's and c's type; the smaller number wins a tie."""
        won, best = np.zeros(len(x), np.int64), None
        own = (x * x).sum(axis=1)
        for a in range(0, len(c), CENTROIDS):
            part = c[a : a + CENTROIDS]
            d = own[:, None] - 2 * (x @ part.T) + (part * part).sum(axis=1)[None, :]
            k = d.argmin(axis=1)
            low = d[np.arange(len(x)), k]
            if best is None:
                won, best = k.astype(np.int64), low
            else:
                nearer = low < best
                won[nearer], best[nearer] = k[nearer] + a, low[nearer]
        return won, best

    def blocks(self, column: pa.Array, scale: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(places, rows, centroid, distance) of the vectors that count, in blocks of one kind of arithmetic."""
        places, x = components(column, self.dim, scale)
        size = np.abs(x).max(axis=1) if len(x) else np.zeros(0)
        by_product, by_long = size <= self.reach(EXACT), size <= self.reach(LONG)
        for which, kind in ((by_product, 0), (by_long & ~by_product, 1), (~by_long & ~by_product, 2)):
            at = np.flatnonzero(which)
            for a in range(0, len(at), ROWS):
                rows = at[a : a + ROWS]
                if kind == 0:
                    y, c = x[rows], self.floats
                elif kind == 1:
                    y, c = x[rows].astype(np.int64), self.longs
                else:
                    y, c = whole_numbers(x[rows], column, places[rows], scale), self.values
                yield places[rows], y, *self.nearest(y, c)


def sums(x: np.ndarray, of: np.ndarray, k: int) -> np.ndarray:
    """Sum of the rows of each centroid, as objects. Blocks of float64 are summed by a product, whose sums stay below 2^53 (4,096 rows under 2^27)."""
    if x.dtype == np.float64:
        one = np.zeros((k, len(x)))
        one[of, np.arange(len(x))] = 1
        return (one @ x).astype(np.int64).astype(object)
    out = np.zeros((k, x.shape[1]), object)
    for i, c in enumerate(of.tolist()):
        out[c] = out[c] + x[i].astype(object)
    return out


def first_centroids(vectors: DataFrame, *, k: int, dim: int, scale: float, seed: int) -> Centroids | None:
    """The k vectors with the smallest hash of seed and id. A task keeps its k smallest, so no more than k rows a task are sorted."""

    def smallest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        held: list[tuple] = []
        for b in batches:
            places, x = components(b.column(1), dim, scale)
            ids = b.column(0).take(pa.array(places)).to_pylist()
            keys = [(i is None, "" if i is None else hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()) for i in ids]
            # equal hashes are compared by components, so a hash as large as the kth still counts
            last = held[-1][0] if len(held) == k else None
            near = [n for n, key in enumerate(keys) if last is None or key <= last]
            if len(near) > k:
                bar = heapq.nsmallest(k, (keys[n] for n in near))[-1]
                near = [n for n in near if keys[n] <= bar]
            for a in range(0, len(near), ROWS):
                some = near[a : a + ROWS]
                numbers = whole_numbers(x[some], b.column(1), places[some], scale).tolist()
                held = heapq.nsmallest(k, held + [(keys[n], tuple(v)) for n, v in zip(some, numbers, strict=True)])
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(h) for h in held], pa.binary())], ["x"])

    found = vectors.mapInArrow(smallest, "x binary").rdd.treeAggregate([], lambda some, r: heapq.nsmallest(k, [*some, pickle.loads(r.x)]), lambda a, b: heapq.nsmallest(k, a + b))
    return Centroids(np.array([v for _, v in found], object).reshape(len(found), dim)) if found else None


def moved(vectors: DataFrame, now: Centroids, scale: float) -> Centroids:
    """Each centroid replaced by the floor of the mean of its vectors; those without vectors stay."""
    k, dim = now.values.shape

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        total, n = np.zeros((k, dim), object), np.zeros(k, np.int64)
        for b in batches:
            for _, x, of, _ in now.blocks(b.column(0), scale):
                total += sums(x, of, k)
                n += np.bincount(of, minlength=k)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((total, n.astype(object)))], pa.binary())], ["x"])

    def plus(a: tuple, b: tuple) -> tuple:
        return a[0] + b[0], a[1] + b[1]

    nothing = (np.zeros((k, dim), object), np.zeros(k, object))
    total, n = vectors.select("embedding").mapInArrow(added, "x binary").rdd.treeAggregate(nothing, lambda some, r: plus(some, pickle.loads(r.x)), plus)
    full = n > 0
    values = now.values.copy()
    values[full] = total[full] // n[full][:, None]
    return Centroids(values)


def assigned(vectors: DataFrame, now: Centroids, scale: float) -> DataFrame:
    """vec_id, cluster, distance of each vector that counts."""

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for b in batches:
            for places, _, of, far in now.blocks(b.column(1), scale):
                distance = pa.array(far.astype(np.int64)) if far.dtype != object else pa.array([v if v < LONG else None for v in far.tolist()], pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(places)), pa.array(of.astype(np.int32)), distance], ["vec_id", "cluster", "distance"])

    return vectors.mapInArrow(told, "vec_id long, cluster int, distance long")


def cluster(table: DataFrame, *, k: int = 40, rounds: int = 5, dim: int = 64, scale: float = 256.0, seed: int = 2, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of each vector that counts, after so many rounds.

    ``scale`` must be a whole number, as very large components are scaled as integers.
    """
    spark = table.sparkSession
    vectors = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("embedding"))
    now = first_centroids(vectors, k=k, dim=dim, scale=scale, seed=seed)
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if now is None:
        return spark.createDataFrame([], schema)
    for _ in range(rounds):
        now = moved(vectors, now, scale)
    found = written(assigned(vectors, now, scale), "centroids")
    # a row for each centroid, k at most
    rows = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("far"), F.count("*").alias("n"), F.count("distance").alias("told")).collect()
    of = {r["cluster"]: int(r["far"]) if r["n"] == r["told"] and r["far"] < LONG else None for r in rows}
    total = None if None in of.values() or sum(of.values()) >= LONG else sum(of.values())
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in now.values.tolist()]
    sides = spark.createDataFrame([(c, of[c], total, digest[c]) for c in sorted(of)], "__c int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(sides), F.col("cluster") == F.col("__c")).drop("__c")
