"""Components against a plain search."""

import random

from tidewell.llm.common import Scratch
from tidewell.llm.components import components


def test_components(spark):
    pick = random.Random(1)
    path = list(range(100, 160))
    pick.shuffle(path)
    edges = [*zip(path, path[1:]), *[(200, x) for x in range(201, 260)], *[(pick.randrange(60), pick.randrange(60)) for _ in range(45)], (7, 7), (300, 299), (299, 300)]
    near = {}
    for a, b in edges:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    expected = {}
    for v in sorted(near):
        todo = [v] if v not in expected else []
        while todo:
            x = todo.pop()
            if x not in expected:
                expected[x] = v
                todo += near[x]
    got = components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "test"), "t")
    assert {r.node: r.component for r in got.collect()} == expected and got.count() == len(expected)
    odd = spark.createDataFrame([(1, None, "x"), (None, 2, "x"), (None, None, "x"), (4, 3, "x"), (3, 4, "y"), (5, 5, "x")], "a long, b long, node string")
    assert {r.node: r.component for r in components(odd, Scratch(spark, "test"), "odd").collect()} == {3: 3, 4: 3}
    assert components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "test"), "t").count() == 0
