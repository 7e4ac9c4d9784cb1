"""Centroid clustering against plain integers."""

import hashlib

import numpy as np
import pytest

from tidewell.llm import kmeans


def brute(rows, k, rounds, seed=3):
    """(id, cluster, distance) and centroids, in Python's integers."""
    kept = [(i, [max(-(2**27), min(2**27, int(np.floor(x * 1024.0)))) for x in v]) for i, v in rows]
    named = [(hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), np.array(v, np.int32).tobytes(), v) for i, v in kept if i is not None]
    centroids = [v for _, _, v in sorted(named)[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centroids)) for _, v in kept]

    for _ in range(rounds):
        who = [n for _, n in assign()]
        for n in range(len(centroids)):
            own = [v for (_, v), w in zip(kept, who, strict=True) if w == n]
            if own:
                centroids[n] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    return sorted(((i, n, d) for (i, _), (d, n) in zip(kept, assign(), strict=True)), key=repr), centroids


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, cluster string").repartition(3)


@pytest.mark.parametrize("size,k", [(3, 4), (11, 5), (64, 8)])
def test_brute_force(spark, size, k):
    pick = np.random.default_rng(size)
    rows = [(i, pick.normal(0, 0.3, size).astype(np.float32).tolist(), "x") for i in range(150)]
    rows += [(7, rows[7][1], "y"), (7, rows[8][1], "y"), (None, rows[3][1], None), (900, [1e30] + rows[1][1][1:], "")]  # repeats, a null id, a huge component
    bad = [(901, None, ""), (902, [0.1] * (size - 1), ""), (903, [float("nan")] * size, ""), (904, [None] + [0.0] * (size - 1), ""), (905, [float("inf")] * size, ""), (906, [], "")]
    found, centroids = kmeans.cluster(frame(spark, rows + bad), k=k, rounds=4, size=size)
    expected, there = brute([(i, v) for i, v, _ in rows], k, 4)
    got = found.collect()
    assert sorted(((r.vec_id, r.cluster, r.distance) for r in got), key=repr) == expected and centroids == there
    by = {n: sum(d for _, c, d in expected if c == n) for n in range(k)}
    assert {(r.cluster, r.cluster_inertia, r.inertia) for r in got} == {(c, by[c], sum(by.values())) for _, c, _ in expected}


def test_search_keeps_ties_with_the_smaller_number():
    centroids = np.array([[4, 0, 9], [0, 4, 9], [0, 0, 0], [0, 0, 0]], np.int64)
    rows = np.array([[0, 0, 0], [2, 2, 9], [4, 0, 9]], np.int64)
    for step in (1, 2, 8):
        who, best = kmeans.nearest(rows, centroids, step)
        assert who.tolist() == [2, 0, 0] and best.tolist() == [0, 8, 0]


def test_search_equals_all_distances():
    pick = np.random.default_rng(5)
    rows, centroids = pick.integers(-6, 7, (4000, 20)), pick.integers(-6, 7, (9, 20))
    every = ((rows[:, None] - centroids[None]) ** 2).sum(2)
    for step in (3, 8, 20):
        who, best = kmeans.nearest(rows, centroids, step)
        assert (who == every.argmin(1)).all() and (best == every.min(1)).all()


def test_empty_few_and_equal(spark):
    found, centroids = kmeans.cluster(frame(spark, []), size=2)
    assert found.collect() == [] and centroids == []
    found, centroids = kmeans.cluster(frame(spark, [(1, [0.5, 0.5], ""), (2, [0.5, 0.5], "")]), size=2, k=5)
    assert [(r.cluster, r.distance, r.inertia) for r in found.collect()] == [(0, 0, 0)] * 2 and len(centroids) == 2
