"""Centroid clustering of integer vectors by a bisector tournament.

Vectors with exactly ``dim`` components, none of them null or non-finite, take part; each component x
becomes the integer floor(scale * x). Everything after that is exact integer arithmetic.

For every pair of centroids i < j the bisector is laid down once a round: the normal ``2 (c_j - c_i)`` and
the threshold ``|c_j|^2 - |c_i|^2``. A vector x is strictly nearer to j just where ``x . normal - threshold``
is positive; zero or less favours i, the smaller number. A knockout over the centroids, neighbours first, so
that the left one of a test always has the smaller number, eliminates one loser a test: k - 1 linear tests
leave the nearest centroid (ties: the smallest number), and only its distance is computed. The first
level's pairs are the same for all vectors, a matrix product; later levels look up the bisector of the two
that are left.

A round is one pass over the vectors. A task adds its vectors up by centroid and returns k x dim sums at most;
Spark adds these, and only k x dim sums reach the driver, where every non-empty centroid
becomes floor(sum / count) and an empty one stays. The last pass writes (id, cluster, distance); the sums
over clusters are k rows, joined back. No vector is moved between tasks, so a frequent vector, cluster or
id is no hot key, and a lost executor repeats its own tasks only.

Centroids start as the k vectors with the smallest SHA-256 of ``<salt>:<id>`` (an id that is null reads
``null``; equal ids are ordered by their vectors), 0 being the first; with fewer vectors there are fewer
centroids. Rows that do not take part are not returned; repeated rows count as vectors of their own; an
empty table gives no rows. Columns other than the id and the vector are not read. Components of any finite
size are exact; a distance that does not fit a 64-bit integer raises an OverflowError.
"""

from __future__ import annotations

import dataclasses
import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._stage import released, staged
from ._vectors import finite_rows, safe, scaled

#: Vectors of one step of the tournament, which bounds its work arrays.
STEP = 2048


@dataclasses.dataclass
class Bisectors:
    """Centroids (k x dim) with the normals (k x k x dim) and thresholds (k x k) of their pairs i < j."""

    centroids: np.ndarray
    normals: np.ndarray
    thresholds: np.ndarray

    def nearest(self, x: np.ndarray) -> np.ndarray:
        """Number of the nearest centroid of each vector, ties to the smaller number."""
        return np.concatenate([self._knockout(x[a:a + STEP]) for a in range(0, len(x), STEP)] or [np.zeros(0, np.int64)])

    def _knockout(self, x: np.ndarray) -> np.ndarray:
        k = len(self.centroids)
        left, right = np.arange(0, k - 1, 2), np.arange(1, k, 2)
        kind = _kind(x, self.normals, self.thresholds)
        value = x.astype(kind)
        side = value @ self.normals[left, right].T.astype(kind) > self.thresholds[left, right].astype(kind)
        alive = np.where(side, right, left)
        odd = np.full((len(x), k % 2), k - 1)
        alive = np.concatenate([alive, odd], 1)
        while alive.shape[1] > 1:
            pairs = alive.shape[1] // 2
            for p in range(pairs):
                i, j = alive[:, 2 * p], alive[:, 2 * p + 1]
                test = (value * self.normals[i, j].astype(kind)).sum(1) > self.thresholds[i, j].astype(kind)
                alive[:, p] = np.where(test, j, i)
            alive = np.concatenate([alive[:, :pairs], alive[:, 2 * pairs:]], 1)
        return alive[:, 0]

    def distance(self, x: np.ndarray, number: np.ndarray) -> np.ndarray:
        """Squared distance of each vector from the centroid of that number."""
        d = x - self.centroids[number]
        return (d * d).sum(1)


def bisectors(centroids: np.ndarray) -> Bisectors:
    normals = 2 * (centroids[None, :, :] - centroids[:, None, :])
    size = (centroids * centroids).sum(1)
    return Bisectors(centroids, normals, size[None, :] - size[:, None])


def _kind(x: np.ndarray, normals: np.ndarray, thresholds: np.ndarray):
    """A type in which the tests are exact: double (for the matrix product) below 2**53, then int64, then Python integers."""
    if x.dtype == object or normals.dtype == object:
        return object
    most = max(int(np.abs(x).max(initial=0)) * int(np.abs(normals).max(initial=0)) * x.shape[1], int(np.abs(thresholds).max(initial=0)))
    return np.float64 if most < 1 << 53 else np.int64 if most < 1 << 62 else object


def _integers(column: pa.Array, dim: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    row, values, _ = finite_rows(column, dim)
    return row, scaled(values, scale, dim).reshape(-1, dim)


def _as_array(rows: list[list[int]], dim: int) -> np.ndarray:
    small = all(abs(v) < safe(dim) for r in rows for v in r)
    return np.array(rows, np.int64 if small else object).reshape(-1, dim)


def _taking_part(base: DataFrame, dim: int) -> DataFrame:
    fits = (F.size("vector") == dim) & ~F.exists("vector", lambda v: v.isNull() | F.isnan(v.cast("double")) | (F.abs(v.cast("double")) == float("inf")))
    return base.filter(F.coalesce(fits, F.lit(False)))


def first_centroids(base: DataFrame, k: int, dim: int, scale: int, salt: str) -> list[list[int]]:
    """The k (few) vectors that come first by the hash of their ids."""
    name = F.concat(F.lit(f"{salt}:"), F.coalesce(F.col("id").cast("string"), F.lit("null")))
    top = _taking_part(base, dim).orderBy(F.sha2(name, 256), "vector").limit(k).select("vector").collect()
    return [[int(v) for v in scaled(np.array(r["vector"], np.float64), scale, dim).tolist()] for r in top]


def _moved(base: DataFrame, centroids: list[list[int]], dim: int, scale: int) -> list[list[int]]:
    """The centroids after one round: floor(sum / count) of each one's vectors."""
    shared = base.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = bisectors(_as_array(shared.value, dim))
        k = len(shared.value)
        count, total = np.zeros(k, np.int64), np.zeros((k, dim), object)
        for b in batches:
            _, x = _integers(b.column(0), dim, scale)
            if not len(x):
                continue
            number = own.nearest(x)
            count += np.bincount(number, minlength=k)
            order = np.argsort(number, kind="stable")
            edge = np.flatnonzero(np.diff(number[order], prepend=-1))
            total[number[order][edge]] += np.add.reduceat(x[order], edge, axis=0).astype(object)
        some = np.flatnonzero(count)
        place = np.tile(np.arange(dim, dtype=np.int32), len(some))
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(some, dim).astype(np.int32)), pa.array(place), pa.array(np.repeat(count[some], dim)),
                                          pa.array([Decimal(int(v)) for v in total[some].ravel()], pa.decimal128(38, 0))], names=["cluster", "place", "n", "s"])

    sums = base.select("vector").mapInArrow(released(run), "cluster int, place int, n bigint, s decimal(38,0)").groupBy("cluster", "place").agg(
        F.sum("n").alias("n"), F.sum("s").cast("decimal(38,0)").alias("s"))
    out = [list(c) for c in centroids]
    for r in sums.collect():  # k x dim rows
        out[r["cluster"]][r["place"]] = int(r["s"]) // r["n"]
    shared.destroy()
    return out


def _assigned(base: DataFrame, centroids: list[list[int]], dim: int, scale: int) -> DataFrame:
    """(id, cluster, distance) of every vector, written once."""
    shared = base.sparkSession.sparkContext.broadcast(centroids)
    schema = f"id {dict(base.dtypes)['id']}, cluster int, distance bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = bisectors(_as_array(shared.value, dim))
        for b in batches:
            row, x = _integers(b.column(1), dim, scale)
            number = own.nearest(x)
            distance = own.distance(x, number)
            if distance.dtype == object and max(distance, default=0) >= 1 << 63:
                raise OverflowError("a squared distance does not fit a 64-bit integer")
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), pa.array(number.astype(np.int32)), pa.array(distance.astype(np.int64))],
                                             names=["id", "cluster", "distance"])

    out = staged(base.select("id", "vector").mapInArrow(released(run), schema), "clusters")
    shared.destroy()
    return out


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, dim: int = 64, scale: int = 256, salt: str = "2",
            id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, list[list[int]]]:
    """(id, cluster, distance) of every vector that takes part, after ``rounds`` rounds, and the final centroids."""
    base = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"))
    centroids = first_centroids(base, k, dim, scale, salt)
    if not centroids:
        return vectors.sparkSession.createDataFrame([], f"id {dict(base.dtypes)['id']}, cluster int, distance bigint"), []
    for _ in range(rounds):
        centroids = _moved(base, centroids, dim, scale)
    return _assigned(base, centroids, dim, scale), centroids


def digest(assigned: DataFrame, centroids: list[list[int]], id_col: str = "vec_id") -> DataFrame:
    """Per vector: id, cluster, distance, the sums of distances over its cluster and over all, and its centroid's SHA-256."""
    names = [(n, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for n, c in enumerate(centroids)]
    sums = {r[0]: r[1] for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)"))).collect()}  # one row per cluster
    rows = [(n, int(sums.get(n, 0)), int(sum(sums.values())), sha) for n, sha in names]
    known = assigned.sparkSession.createDataFrame(rows, "number int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return assigned.join(F.broadcast(known), F.col("cluster") == F.col("number")).select(
        F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
