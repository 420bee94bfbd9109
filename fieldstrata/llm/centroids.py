"""Centroid clustering of integer vectors with a LAESA pivot table.

A vector's distances to a few fixed pivots are computed once and stored beside it. By the triangle inequality the
distance of a vector and a centroid is at least the difference of their distances to any pivot, so in each round the
pivots bound every centroid from below, and only centroids whose bound does not exceed the best distance found so far
receive an exact integer distance. Bounds are rounded down by more than floating point can err, so they decide how much
is computed, never the result.

A round is one pass over the stored table: tasks assign their vectors and add up each cluster's components, Spark adds
the tasks' sums, and the new centroids (a few rows) come to the driver and go out with the next round's tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, staged, unstage

#: Components must be smaller in size, so that squared distances of up to 64 components are longs.
LARGEST = 1 << 27
ASSIGNED = "vec_id bigint, cluster int, distance bigint, exact_distances int"


def _whole(batch: pa.RecordBatch, dims: int, scale: int) -> tuple[pa.Array, np.ndarray]:
    """vec_ids and integer components of the vectors that count."""
    lists = column(batch, "embedding")
    flat = lists.flatten()
    sizes = np.where(np.asarray(lists.is_valid()), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), 0)
    first = np.cumsum(sizes) - sizes
    right = np.flatnonzero(sizes == dims)
    values = flat.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
    x = values[first[right][:, None] + np.arange(dims)] if len(right) else np.empty((0, dims))
    finite = np.isfinite(x).all(1)
    x = np.floor(scale * x[finite])
    if len(x) and np.abs(x).max() >= LARGEST:
        raise ValueError(f"a component is {LARGEST} or more after scaling")
    return column(batch, "vec_id").take(pa.array(right[finite])), x.astype(np.int64)


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    d = x - y
    return np.einsum("ij,ij->i", d, d)


def pivots_of(sample: np.ndarray, count: int) -> np.ndarray:
    """That many vectors of the sample, each the one farthest from those before it (the first begins)."""
    chosen, far = [], None
    while len(sample) and len(chosen) < min(count, len(sample)):
        at = 0 if far is None else int(far.argmax())
        if far is not None and far[at] == 0:
            break
        chosen.append(at)
        d = squared(sample, sample[at][None])
        far = d if far is None else np.minimum(far, d)
    return sample[chosen]


def assign(x: np.ndarray, to_pivots: np.ndarray, centroids: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cluster, squared distance, number of exact distances) of each vector; ties go to the smaller cluster.

    to_pivots: squared distances of the vectors to the pivots.
    """
    here, there = np.sqrt(to_pivots), np.sqrt(np.stack([squared(pivots, c[None]) for c in centroids]))
    slack = 1e-10 * (1 + here.max(initial=0) + there.max(initial=0))
    bound = np.zeros((len(x), len(centroids)))
    for p in range(len(pivots)):
        np.maximum(bound, np.abs(here[:, p, None] - there[None, :, p]) - slack, out=bound)
    cluster = bound.argmin(1)
    begun, best, exact = cluster.copy(), squared(x, centroids[cluster]), np.ones(len(x), np.int32)
    for c in range(len(centroids)):
        near = np.flatnonzero((bound[:, c] <= np.sqrt(best) + slack) & (begun != c))
        d = squared(x[near], centroids[c][None])
        exact[near] += 1
        closer = (d < best[near]) | ((d == best[near]) & (c < cluster[near]))
        cluster[near[closer]], best[near[closer]] = c, d[closer]
    return cluster, best, exact


def _arrays(batch: pa.RecordBatch, dims: int, pivots: int) -> tuple[np.ndarray, np.ndarray]:
    x = column(batch, "x").flatten().to_numpy().astype(np.int64).reshape(-1, dims)
    return x, column(batch, "to_pivots").flatten().to_numpy().reshape(-1, pivots)


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: int = 3, pivots: int = 16, sample: int = 1024) -> DataFrame:
    """One row per kept vector: vec_id, cluster, distance (squared), exact_distances (how many it took at the end),
    cluster_inertia, inertia, centroid_sha256.

    Kept are vectors of exactly ``dims`` components, none null or non-finite; a component x becomes floor(scale * x). The
    first centroids are the k vectors with the smallest sha256 of ``seed:vec_id``; rows without vec_id come last, and
    equal hashes (repeated vec_ids) are ordered by their components. Each round assigns every vector to the nearest
    centroid (ties: the smaller number) and moves non-empty centroids to their vectors' componentwise floored mean; at
    last vectors are assigned once more. With fewer than k vectors there are as many centroids. Repeated rows all count.
    An empty table gives no rows; other columns are ignored. Components of 2^27 or more in size raise. ``sample`` bounds
    the rows that pivots are chosen from; it and ``pivots`` change what is computed, not the result.
    """
    spark = vectors.sparkSession
    kept = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))

    def ints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, x = _whole(batch, dims, scale)
            yield pa.RecordBatch.from_arrays([ids, pa.FixedSizeListArray.from_arrays(pa.array(x.astype(np.int32).ravel()), dims).cast(pa.list_(pa.int32()))], names=["vec_id", "x"])

    hashed = kept.mapInArrow(ints, "vec_id bigint, x array<int>").withColumn("h", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256))
    first = [r.x for r in hashed.orderBy(F.asc_nulls_last("h"), "x").limit(max(sample, k)).select("x").collect()]
    if not first:
        return spark.createDataFrame([], ASSIGNED + ", cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    chosen = pivots_of(np.array(first, np.int64)[:sample], pivots)
    centroids, n_pivots = np.array(first[:k], np.int64), len(chosen)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, x = _whole(batch, dims, scale)
            d = np.stack([squared(x, p[None]) for p in chosen], 1)
            both = [pa.FixedSizeListArray.from_arrays(pa.array(v.ravel()), w).cast(pa.list_(v_type)) for v, w, v_type in ((x.astype(np.int32), dims, pa.int32()), (d, n_pivots, pa.int64()))]
            yield pa.RecordBatch.from_arrays([ids, *both], names=["vec_id", "x", "to_pivots"])

    stored = staged(kept.mapInArrow(placed, "vec_id bigint, x array<int>, to_pivots array<bigint>"), "pivots")
    for _ in range(rounds):
        moved = _moved(stored, centroids, chosen)
        if np.array_equal(moved, centroids):
            break  # nothing would move any more
        centroids = moved

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, d = _arrays(batch, dims, n_pivots)
            of, best, exact = assign(x, d, centroids, chosen)
            yield pa.RecordBatch.from_arrays([column(batch, "vec_id"), pa.array(of.astype(np.int32)), pa.array(best), pa.array(exact)], names=["vec_id", "cluster", "distance", "exact_distances"])

    out = staged(stored.mapInArrow(last, ASSIGNED), "clusters")
    unstage(stored)
    sums = {r.cluster: int(r.s) for r in out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    digests = {c: hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest() for c in sums}
    of = lambda values, kind: F.create_map(*[F.lit(v).cast(t) for c in sums for v, t in ((c, "int"), (values[c], kind))])[F.col("cluster")]
    return out.select("*", of(sums, "bigint").alias("cluster_inertia"), F.lit(sum(sums.values())).cast("bigint").alias("inertia"), of(digests, "string").alias("centroid_sha256"))


def _moved(stored: DataFrame, centroids: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The centroids after a round; empty ones stay. A task returns a row per cluster and component."""
    k, dims = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            x, d = _arrays(batch, dims, len(pivots))
            of, _, _ = assign(x, d, centroids, pivots)
            n += np.bincount(of, minlength=k)
            for c in np.unique(of):
                sums[c] += x[of == c].sum(0)
        c, d = np.nonzero(np.repeat(n[:, None] > 0, dims, 1))
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32)), pa.array(d.astype(np.int32)), pa.array(sums[c, d]), pa.array(n[c])], names=["cluster", "dim", "total", "n"])

    parts = stored.select("x", "to_pivots").mapInArrow(run, "cluster int, dim int, total bigint, n bigint")
    moved = centroids.copy()
    for r in parts.groupBy("cluster", "dim").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n")).collect():
        moved[r.cluster, r.dim] = int(r.total) // r.n
    return moved
