"""Connected components of an edge table by contraction.

A round points each node to its smallest neighbour below it, follows these pointers to their ends by doubling,
and replaces every edge by one between ends. Edges within a tree vanish, so the next round has few of them left:
a star of any size takes one round. Every table is written to the shared folder, so lineage stays short and a lost
executor costs one step. Nothing about nodes or edges reaches the driver but whether anything changed.

Cases: a null node is no node, and its edges link nothing; an edge from a node to itself and repeated edges add nothing;
either direction counts; an empty table gives no rows; extra columns are ignored. Nodes without another are not listed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, component) for every node of `edges` (a, b): the smallest node that it is connected with."""

    def distinct(pairs: DataFrame, a: str, b: str) -> DataFrame:
        return pairs.where(f"{a} <> {b}").select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct()

    left = scratch.table(f"{name}-edges-0", distinct(edges, "a", "b"))
    labels, n = None, 0
    while True:
        ends = scratch.table(f"{name}-ends-{n}-0", left.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("end")))
        step = 0
        while True:
            further = ends.select(F.col("node").alias("end"), F.col("end").alias("further"))
            step += 1
            jumped = scratch.table(f"{name}-ends-{n}-{step}", ends.join(further, "end", "left").select("node", F.coalesce("further", "end").alias("end"), F.col("further").isNotNull().alias("moved")))
            changed = jumped.where("moved").limit(1).count()
            scratch.drop(f"{name}-ends-{n}-{step - 1}")
            ends = jumped.select("node", "end")
            if not changed:
                break
        if labels is None:
            lowest = left.select(F.col("b").alias("node")).distinct().join(ends, "node", "left_anti")
            labels = ends.select("node", F.col("end").alias("component")).union(lowest.select("node", F.col("node").alias("component")))
        else:
            labels = labels.join(ends.withColumnRenamed("node", "component"), "component", "left").select("node", F.coalesce("end", "component").alias("component"))
        labels = scratch.table(f"{name}-labels-{n}", labels)
        by_a, by_b = ends.select(F.col("node").alias("a"), F.col("end").alias("x")), ends.select(F.col("node").alias("b"), F.col("end").alias("y"))
        moved = left.join(by_a, "a").join(by_b, "b", "left").select("x", F.coalesce("y", "b").alias("y"))
        n += 1
        left = scratch.table(f"{name}-edges-{n}", distinct(moved, "x", "y"))
        scratch.drop(f"{name}-edges-{n - 1}", f"{name}-ends-{n - 1}-{step}", f"{name}-labels-{n - 2}")
        if not left.limit(1).count():
            scratch.drop(f"{name}-edges-{n}")
            return labels
