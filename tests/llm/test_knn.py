"""Exact top-k against all products."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.llm import knn


def brute(rows, k):
    good = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, e in {i: e for i, e in reversed(good) if i % 100 == 0}.items():
        scored = sorted((-sum(a * b for a, b in zip(e, f)), i) for i, f in good if i != q and len(f) == len(e))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def got(df):
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in df.collect())


@pytest.mark.parametrize("shard_rows", [5000, 90])
def test_awkward_vectors(spark, shard_rows):
    pick = random.Random(3)
    rows = [(i, [pick.gauss(0, 1) for _ in range(6)]) for i in range(700)]
    rows += [(i, [0.5] * 6) for i in range(700, 1000)]  # a hot vector: ties
    rows += [(1000, None), (1100, []), (1200, [None] * 6), (1300, [float("nan")] * 6), (1400, [float("inf")] + [0.0] * 5), (1500, [1.0, 2.0]), (1600, [0.5] * 6), (None, [1.0] * 6), (-200, [0.25] * 6), (1601, [1e6, -1e6, 3.0, 0.0, 1.0, 1e-9])]
    docs = spark.createDataFrame([(v, i, 0.0, 1) for i, v in rows], "embedding array<double>, vec_id long, score double, rank int")
    assert got(knn.search(docs, F.col("vec_id") % 100 == 0, 10, shard_rows=shard_rows, block_rows=7)) == brute(rows, 10)
    assert got(knn.search(docs.limit(0), F.col("vec_id") % 100 == 0)) == []
    few = docs.where("vec_id in (0, 1, 1500)")
    assert got(knn.search(few, F.col("vec_id") % 100 == 0)) == brute([r for r in rows if r[0] in (0, 1, 1500)], 10)


def test_huge_components_are_exact(spark):
    rows = [(0, [1e12, 3.0]), (1, [1e12, 1.0]), (2, [1e12, 2.0]), (3, [-5.0, 1e3])]
    ours = got(knn.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 100 == 0))
    bound = knn.LARGEST
    assert ours == [(q, r, i, max(-bound, min(bound, s))) for q, r, i, s in sorted((q, r + 1, i, s) for q, r, i, s in [(0, 0, 1, bound), (0, 1, 2, bound), (0, 2, 3, brute(rows, 10)[2][3])])]


def test_boxes_are_pruned_when_they_can_be():
    rng = np.random.default_rng(1)
    rows = knn.quantised(rng.normal(0, 1, (20_000, 3)))
    tree, counted = knn.Tree(np.arange(20_000), rows), [0]
    q = rows[5]
    best = tree.search(5, q, tree.bounds(q[None])[:, 0], 10, [], True, counted)
    s = (rows @ q).astype(int)
    expected = sorted(((int(x), -i) for i, x in enumerate(s) if i != 5), reverse=True)[:10]
    assert sorted(best, reverse=True) == expected and counted[0] < 0.2 * 20_000 / knn.LEAF
    tree = knn.Tree.unpack(tree.pack())
    assert (tree.rows[tree.ids.argsort()] == rows).all()


def test_repeated_ids_in_other_blocks_and_shards(spark):
    pick = random.Random(5)
    rows = [(i, [pick.gauss(0, 1) for _ in range(3)]) for i in range(150)]
    rows = rows * 2 + [r for r in rows if r[0] % 100 == 0] * 20
    docs = spark.createDataFrame([(i, v) for i, v in rows], "vec_id long, embedding array<double>")
    assert got(knn.search(docs, F.col("vec_id") % 100 == 0, 10, shard_rows=40, block_rows=3)) == brute(rows, 10)


def test_shards_that_cannot_help_are_not_reached(spark):
    """Rows in far corners: their shards' root boxes keep the blocks away from all but a few."""
    pick = random.Random(8)
    rows = [(i, [s * (5 + pick.random()) for s in ((1, 1), (1, -1), (-1, 1), (-1, -1))[i % 4]]) for i in range(800)]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    seen = []
    whole = knn._reached

    def counted(met, k):
        out = whole(met, k)
        seen.append((out.count(), met.selectExpr("sum(size(boxes))").first()[0]))
        return out

    knn._reached = counted
    try:
        assert got(knn.search(docs, F.col("vec_id") % 100 == 0, 10, shard_rows=50, block_rows=2)) == brute(rows, 10)
    finally:
        knn._reached = whole
    assert seen[0][0] < 0.8 * seen[0][1]


def test_several_lengths_over_several_packs_of_shards(spark, monkeypatch):
    monkeypatch.setattr(knn, "BOXES", 2)
    pick = random.Random(11)
    rows = [(i, [pick.gauss(0, 1) for _ in range(pick.choice([2, 5, 5, 9]))]) for i in range(0, 6000, 10)]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    assert got(knn.search(docs, F.col("vec_id") % 100 == 0, 4, shard_rows=60, block_rows=9)) == brute(rows, 4)
