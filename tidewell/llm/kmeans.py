"""Centroid clustering in exact integers: Lloyd's rounds with a partial-distance search.

Vectors are quantised to floor(scale * x) and kept as one table of small integers. The search adds up squared
differences over the dimensions with the highest variance first, a few at a time, and abandons a centroid once its sum is
strictly above the best full distance so far; what is left finishes all dimensions, so every result is exact and
ties go to the smaller number. A task sums its vectors by centroid; those sums meet by centroid and dimension, and only
k times `size` sums reach the driver, whatever the table's size.

Each round reads the written table of quantised vectors, so a lost executor costs a part of one round.

Cases: vectors that are null, of another length, or hold null or non-finite components take no part; components beyond
2^27 after scaling count as that bound, which keeps every distance within 63 bits; null ids are clustered but never start a
centroid, so a table of them gives no rows; repeated ids are vectors of their own; of equal hashes the vector with the smaller bytes starts; fewer vectors than k give
as many centroids; a centroid without vectors stays; an empty table gives no rows; extra columns are ignored. A sum of distances
beyond 2^63 - 1 counts as that bound.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

BOUND, LARGEST, STEP = 1 << 27, (1 << 63) - 1, 8


def nearest(rows: np.ndarray, centroids: np.ndarray, step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid's number and squared distance for each row; columns stand in the order of the search."""
    size = rows.shape[1]
    head = np.stack([((rows[:, :step] - c[:step]) ** 2).sum(1) for c in centroids], 1)
    first = head.argmin(1)  # the most promising one is finished first, so that its distance bounds the others
    who, best = first.copy(), head[np.arange(len(rows)), first] + ((rows[:, step:] - centroids[first, step:]) ** 2).sum(1)
    for c, centroid in enumerate(centroids):
        alive = np.flatnonzero((first != c) & (head[:, c] <= best))
        sums = head[alive, c]
        for at in range(step, size, step):
            if not len(alive):
                break
            sums = sums + ((rows[alive, at : at + step] - centroid[at : at + step]) ** 2).sum(1)
            stay = sums <= best[alive]
            alive, sums = alive[stay], sums[stay]
        wins = (sums < best[alive]) | (c < who[alive])
        who[alive[wins]], best[alive[wins]] = c, sums[wins]
    return who, best


def _matrix(rb: pa.RecordBatch, size: int) -> np.ndarray:
    """The quantised vectors of a batch of the written table."""
    cells = rb.column(1)
    if not len(cells):
        return np.zeros((0, size), np.int64)
    _, ends, data = cells.buffers()
    first = np.frombuffer(ends, np.int32)[cells.offset]
    return np.frombuffer(data, np.int32, len(cells) * size, int(first)).reshape(-1, size).astype(np.int64)


def _quantised(vectors: DataFrame, size: int, scale: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            own = rb.column(1)
            flat = own.flatten()
            values = flat.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(rb), size)
            good = np.isfinite(values).all(1)  # a null is NaN here
            whole = np.clip(np.floor(values[good] * scale), -BOUND, BOUND).astype(np.int32)
            ends = np.arange(len(whole) + 1, dtype=np.int32) * (4 * size)
            cells = pa.Array.from_buffers(pa.binary(), len(whole), [None, pa.py_buffer(ends), pa.py_buffer(whole)])
            yield pa.RecordBatch.from_arrays([rb.column(0).filter(pa.array(good)), cells], ["id", "v"])

    return vectors.where(F.size("v") == size).mapInArrow(run, "id long, v binary")


def _spread(rows: DataFrame, size: int) -> np.ndarray:
    """Dimensions by falling variance: sums of the tasks meet by dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, squares = 0, np.zeros(size), np.zeros(size)
        for rb in batches:
            own = _matrix(rb, size).astype(np.float64)
            n, total, squares = n + len(own), total + own.sum(0), squares + (own * own).sum(0)
        yield pa.RecordBatch.from_pydict({"dim": pa.array(range(size), pa.int32()), "n": pa.array([n] * size, pa.int64()), "total": total, "squares": squares})

    sums = rows.mapInArrow(run, "dim int, n long, total double, squares double").groupBy("dim").agg(*[F.sum(c).alias(c) for c in ("n", "total", "squares")]).collect()
    variance = np.zeros(size)
    for r in sums:
        variance[r.dim] = r.squares / r.n - (r.total / r.n) ** 2 if r.n else 0
    return np.argsort(-variance, kind="stable")


def _moved(rows: DataFrame, centroids: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The centroids after one round."""
    k, size = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, total = np.zeros(k, np.int64), np.zeros((k, size), np.int64)
        for rb in batches:
            own = _matrix(rb, size)
            who, _ = nearest(own[:, order], centroids[:, order])
            for c in range(k):
                total[c] += own[who == c].sum(0)
            counts += np.bincount(who, minlength=k)
        at = np.repeat(np.flatnonzero(counts), size)
        dims = np.tile(np.arange(size), int((counts > 0).sum()))
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(dims.astype(np.int32)), pa.array(counts[at]), pa.array(total[at, dims])], ["cluster", "dim", "n", "total"])

    sums = rows.mapInArrow(run, "cluster int, dim int, n long, total long").groupBy("cluster", "dim").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect()
    after = centroids.copy()
    for r in sums:  # k times size sums
        after[r.cluster, r.dim] = r.total // r.n
    return after


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, size: int = 64, scale: int = 1024, seed: int = 3, key: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, list[list[int]]]:
    """(id, cluster, distance) of every vector after `rounds` rounds from the k vectors with the smallest hashes of seed and
    id, with the sum of distances over its cluster and over all; the centroids."""
    scratch = Scratch(vectors.sparkSession, "kmeans")
    own = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    rows = scratch.table("vectors", _quantised(own, size, scale))
    named = rows.where("id is not null").select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256).alias("h"), "v")
    centroids = np.array([np.frombuffer(r.v, np.int32) for r in named.orderBy("h", "v").limit(k).collect()], np.int64).reshape(-1, size)
    if not len(centroids):
        return rows.where("false").selectExpr(f"id AS `{key}`", "0 AS cluster", *[f"0L AS {c}" for c in ("distance", "cluster_inertia", "inertia")]), []
    order = _spread(rows, size)
    for _ in range(rounds):
        centroids = _moved(rows, centroids, order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            who, best = nearest(_matrix(rb, size)[:, order], centroids[:, order])
            yield pa.RecordBatch.from_arrays([rb.column(0), pa.array(who.astype(np.int32)), pa.array(best)], [key, "cluster", "distance"])

    found = scratch.table("assigned", rows.mapInArrow(run, f"`{key}` long, cluster int, distance long"))
    sums = dict.fromkeys(range(len(centroids)), 0) | {r.cluster: int(r.s) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    by = F.array(*[F.lit(min(sums[c], LARGEST)).cast("long") for c in range(len(centroids))])
    total = F.lit(min(sum(sums.values()), LARGEST)).cast("long")
    return found.withColumns({"cluster_inertia": F.element_at(by, F.col("cluster") + 1), "inertia": total}), centroids.tolist()


def digest(centroid: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()
