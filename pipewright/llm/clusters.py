"""Centroid clustering by equal-average equal-variance nearest neighbour search.

Vectors are integers, floor(256 * x). Centroids are sorted by component
mean. For a vector of mean m and deviation v (the length of the vector less its
mean), and a centroid of m' and v', the squared distance is at least
dim * (m - m')^2 + (v - v')^2. The search begins at the vector's mean and goes
outward, one centroid to each side a step: where the first term alone exceeds
the least distance found, that side is done; where both do, the centroid is
passed over; what is left gets its exact integer distance. Bounds are rejected
with a margin for rounding and only if they exceed the least, so ties are
all compared and go to the smaller number.

Each round is one pass over a table of the integer vectors: a task assigns its
vectors and sends exact sums for each cluster and component, so what is
shuffled and collected is bounded by centroids times components, however many
vectors one cluster holds. Sums are decimals, means are floored exactly; a
cluster without vectors keeps its centroid.

Rows that repeat a vec_id are vectors of their own (as start centroids they are
ordered by their components). A null vec_id is assigned like any other and is no
start centroid. Vectors that are null, of another length, with a null or
non-finite component or with one over 2^27 as an integer take no part. Fewer
vectors than centroids: as many centroids as vectors with an id. An empty table,
or one without an id, gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pipewright.llm.common import saved
from pipewright.llm.vectors import DIM, matrix, rows

CENTROIDS, ROUNDS, SEED = 40, 5, 2
_ROWS = 8192


class Searcher:
    """Nearest of some centroids (k, dim); `tried` counts the exact distances taken."""

    def __init__(self, centroids: np.ndarray):
        sums = centroids.sum(axis=1)
        self.number = np.argsort(sums, kind="stable")
        self.c, self.sums = centroids[self.number], sums[self.number].astype(float)
        self.deviation = _deviation(self.c, self.sums)
        self.tried = 0

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number, squared distance) of the nearest centroid of each row."""
        n, dim, k = len(x), x.shape[1], len(self.c)
        sums = x.sum(axis=1).astype(float)
        deviation = _deviation(x, sums)
        best, at = np.full(n, np.iinfo(np.int64).max), np.full(n, k)
        right = np.searchsorted(self.sums, sums)
        sides = [(1, right, np.arange(n)), (-1, right - 1, np.arange(n))]
        while any(len(s[2]) for s in sides):
            for which, (way, place, live) in enumerate(sides):
                live = live[(place[live] >= 0) & (place[live] < k)]
                j = place[live]
                mean = (sums[live] - self.sums[j]) ** 2 / dim
                within = mean * (1 - 1e-9) <= best[live]  # further out on this side the means only part more
                live, j, mean = live[within], j[within], mean[within]
                close = (mean + (deviation[live] - self.deviation[j]) ** 2) * (1 - 1e-9) - 1 <= best[live]
                row, j = live[close], j[close]
                distance = np.square(x[row] - self.c[j]).sum(axis=1)
                self.tried += len(row)
                number = self.number[j]
                won = (distance < best[row]) | ((distance == best[row]) & (number < at[row]))
                best[row[won]], at[row[won]] = distance[won], number[won]
                place[live] += way
                sides[which] = (way, place, live)
        return at, best


def _deviation(x: np.ndarray, sums: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(np.square(x.astype(float)).sum(axis=1) - sums**2 / x.shape[1], 0.0))


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, _ROWS):
            yield b.slice(at, _ROWS)


def _summed(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, dim = centroids.shape
        search, total, many = Searcher(centroids), np.zeros((k, dim), np.int64), np.zeros(k, np.int64)
        for b in _parts(batches):
            x = matrix(b["x"], dim)
            of, _ = search.nearest(x)
            by = np.argsort(of, kind="stable")
            held, first = np.unique(of[by], return_index=True)
            total[held] += np.add.reduceat(x[by], first, axis=0)
            many += np.bincount(of, minlength=k)
        held = np.flatnonzero(many)
        columns = [np.repeat(held, dim).astype(np.int32), np.tile(np.arange(dim, dtype=np.int32), len(held)), total[held].ravel(), np.repeat(many[held], dim)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["cluster", "dim", "total", "n"])

    return run


def _assigned(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Searcher(centroids)
        for b in _parts(batches):
            of, distance = search.nearest(matrix(b["x"], centroids.shape[1]))
            yield pa.RecordBatch.from_arrays([b["vec_id"], pa.array(of.astype(np.int32)), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    return run


def starts(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors of least sha256 of `seed:vec_id`."""
    named = vectors.where("vec_id is not null").select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).alias("h"), "x")
    return np.array([r.x for r in named.orderBy("h", "x").limit(k).collect()], np.int64)


def cluster(embeddings: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED, dim: int = DIM) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every whole vector."""
    spark = embeddings.sparkSession
    names = "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
    vectors = saved(rows(embeddings, dim), "vectors")
    centroids = starts(vectors, k, seed)
    if not len(centroids):
        return spark.createDataFrame([], names)
    for _ in range(rounds):
        sums = vectors.mapInArrow(_summed(centroids), "cluster int, dim int, total bigint, n bigint").groupBy("cluster", "dim")
        centroids = centroids.copy()
        for r in sums.agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n")).collect():  # k * dim rows at most
            centroids[r.cluster, r.dim] = int(r.total) // r.n
    assigned = saved(vectors.mapInArrow(_assigned(centroids), "vec_id bigint, cluster int, distance bigint"), "assigned")
    inertia = {r.cluster: int(r.d) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    digest = lambda c: hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()
    about = spark.createDataFrame([(c, d, sum(inertia.values()), digest(c)) for c, d in inertia.items()], "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return assigned.join(F.broadcast(about), "cluster").select(*[c.split()[0] for c in names.split(", ")])  # k rows at most
