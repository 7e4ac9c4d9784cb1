"""The numeric band join against all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.llm import bands


def brute(points, rows, k, least, share):
    out = set()
    for key, at in set(points):
        met = []
        if key is not None and at is not None:
            w = max(least, max(at, 0) // share)
            met = sorted((abs(u - at), u, o1, -(1 << 63) if o2 is None else o2, y, c) for u, y, o1, o2, c in rows if u is not None and y is not None and y != key and abs(u - at) <= w)
        n, gaps, checks = len(met), sum(m[0] for m in met), sum(m[5] for m in met)
        for i, m in enumerate(met[:k]):
            out.add((key, at, i + 1, m[0], m[1], m[2], None if m[3] == -(1 << 63) else m[3], m[4], n, gaps, checks))
        if not met:
            out.add((key, at, 0, None, None, None, None, None, 0, 0, 0))
    return out


def run(spark, points, rows, **params):
    a = spark.createDataFrame(points, "key long, at long").withColumn("checks", F.lit("x")).repartition(3)
    b = spark.createDataFrame(rows, "at long, key long, order1 long, order2 long, check long").withColumn("n", F.lit(None)).repartition(3)
    got = bands.nearest(a, b, **params).select("key", "at", "rank", "gap", "value", "order1", "order2", "row_key", "n", "gaps", "checks").collect()
    assert len(got) == len(set(got))
    return {tuple(r) for r in got}


@pytest.mark.parametrize("cells", [1, 7, 40])
def test_all_pairs(spark, cells):
    pick = random.Random(cells)
    value = lambda: pick.choice([pick.randrange(-60, 4000), pick.randrange(100, 140), 120, 120, 10**6 + pick.randrange(5000), 2**40])
    points = [(pick.randrange(60), value()) for _ in range(150)] + [(None, 5), (5, None), (None, None), (3, -10**9)]
    rows = [(value(), pick.choice([1, 1, pick.randrange(60)]), pick.randrange(30), pick.choice([None, 1, 2, 3]), pick.randrange(2**32)) for _ in range(900)]
    rows += rows[:200] + [(None, 1, 1, 1, 1), (120, None, 1, 1, 1)]
    for k, least, share in ((5, 10, 500), (2, 0, 7)):
        assert run(spark, points, rows, k=k, least=least, share=share, cells=cells) == brute(points, rows, k, least, share)


def test_a_hot_value_becomes_a_grid(spark):
    """A value with most rows, of many keys: several cells share it, and every pair meets once."""
    rows = [(500, i % 97, i, i % 3, i * 7) for i in range(1500)] + [(500 + i, i, i, 1, i) for i in range(-40, 40)]
    points = [(i, 490 + i % 21) for i in range(300)]
    seen = []

    def count(bins):
        for b in bins:
            b.rows = sum(b.lo <= r[0] < b.hi for r in rows)
            b.points = sum(b.lo <= p[1] < b.hi for p in points)
        seen.append(len(bins))

    regions = bands.divided(count, 460, 540, 12, 10, 500)
    hot = next(r for r in regions if r.lo <= 500 < r.hi)
    assert (hot.lo, hot.hi) == (500, 501) and hot.down * hot.across > 3 and seen == [81]
    assert [r.lo for r in regions] == [460] + [r.hi for r in regions][:-1] and regions[-1].hi == 541
    assert run(spark, points, rows, cells=12) == brute(points, rows, 5, 10, 500)


def test_regions_are_refined_round_by_round():
    """A narrow crowd in a wide range is found in a few rounds, and no region but a single value holds much more than its share."""
    values = np.concatenate([np.arange(10**12, 10**12 + 3000), [0, 2**60]])
    rounds = []

    def count(bins):
        rounds.append(len(bins))
        for b in bins:
            b.rows = int(((values >= b.lo) & (values < b.hi)).sum())

    regions = bands.divided(count, 0, 2**60, 30, 10, 500)
    held = [int(((values >= r.lo) & (values < r.hi)).sum()) for r in regions]
    assert sum(held) == len(values) and max(held) <= 300 and len(rounds) <= 12 and max(rounds) <= bands.BINS + bands.FINE * 30


def test_empty(spark):
    assert run(spark, [], []) == set()
    assert run(spark, [(1, 10)], []) == {(1, 10, 0, None, None, None, None, None, 0, 0, 0)}
    assert run(spark, [], [(1, 1, 1, 1, 1)]) == set()
    assert run(spark, [(1, 10)], [(10, 1, 1, 1, 1)]) == {(1, 10, 0, None, None, None, None, None, 0, 0, 0)}
