"""Exact top-k search by inner product: KD-trees per shard, best-first traversal, a propagated kth score.

Vectors are quantised to floor(scale * x) and searched in integers. Rows are dealt to shards of bounded size by coarse
cells (which side of the medians of the first components they are on; a full cell goes on in the next shard); each
shard's tree (median splits on the widest dimension, tight bounding boxes, the smallest id of each node) is one row of a
table. Query rows are dealt to blocks. A block first searches the shard whose root box promises most, and the
kth score and id found there bound all that follows: first the root boxes of all shards, a small table of its own, tell which shards can hold anything better;
only those meet the block, and in them a box is opened only if its bound, the largest inner product of any point in it,
can still beat the kth result (on equal scores: if it holds a smaller id). The last step keeps the best k of what each
shard found for a query, at most k rows a shard.

Queries meet shards as blocks against blocks, dealt by shard and a salt of the block, so no task holds more than one tree
and one block, and a shard that many blocks reach is spread.

Cases: vectors that are null, empty or hold null or non-finite components take no part, as rows or as queries;
vectors of different lengths do not meet; ties go to the smaller id; repeated ids are rows of their own, a query
never finds a row with its own id, and equal query ids share one list, that of their smallest vector; fewer candidates than k give what there is; an empty
table gives no rows; extra columns are ignored. Products beyond 2^63 - 1 count as that bound.
"""

from __future__ import annotations

import heapq
import io
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

LEAF, SHARD_ROWS, BLOCK_ROWS, SCALE, BOXES = 128, 32_768, 2_048, 1024, 256
LARGEST = (1 << 63) - 1


def quantised(vectors: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) as doubles, exact: a product with a power of two and a floor lose nothing."""
    return np.floor(vectors.astype(np.float64) * scale)


def exact(a: np.ndarray, b: np.ndarray) -> bool:
    """True if all inner products of rows of a and b, and their partial sums, are exact in doubles."""
    return len(a) == 0 or len(b) == 0 or float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1] < 2.0**53


def products(rows: np.ndarray, q: np.ndarray, safe: bool) -> np.ndarray:
    if safe:
        return (rows @ q).astype(np.int64)
    wide = [int(x) for x in q.tolist()]
    return np.array([max(-LARGEST, min(LARGEST, sum(int(x) * y for x, y in zip(r, wide, strict=True)))) for r in rows.tolist()], np.int64)


def box_bounds(low: np.ndarray, high: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """For each box and query, the largest inner product that a point of the box can have, rounded up."""
    up = high @ np.maximum(queries, 0).T + low @ np.minimum(queries, 0).T
    return up if exact(np.maximum(np.abs(high), np.abs(low)), queries) else up + np.abs(up) * 1e-9 + 1


class Tree:
    """Rows in leaf order; node i has children kids[i], rows first[i] to last[i], a box and its smallest id."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, leaf: int = LEAF):
        order, spans, kids = np.arange(len(ids)), [(0, len(ids))], [(-1, -1)]
        todo = [0]
        while todo:
            node = todo.pop()
            a, b = spans[node]
            if b - a <= leaf:
                continue
            own = rows[order[a:b]]
            wide = int((own.max(0) - own.min(0)).argmax())
            middle = (b - a) // 2
            order[a:b] = order[a:b][np.argpartition(own[:, wide], middle)]
            kids[node] = (len(spans), len(spans) + 1)
            spans += [(a, a + middle), (a + middle, b)]
            todo += kids[node]
            kids += [(-1, -1), (-1, -1)]
        self.ids, self.rows, self.kids, self.spans = ids[order], rows[order], np.array(kids), np.array(spans)
        self.low = np.array([self.rows[a:b].min(0) for a, b in spans])
        self.high = np.array([self.rows[a:b].max(0) for a, b in spans])
        self.least = np.array([self.ids[a:b].min() for a, b in spans])

    def pack(self) -> bytes:
        np.savez(out := io.BytesIO(), ids=self.ids, rows=self.rows.astype(np.int32) if np.abs(self.rows).max(initial=0) < 2**31 else self.rows, kids=self.kids, spans=self.spans, low=self.low, high=self.high, least=self.least)
        return out.getvalue()

    @classmethod
    def unpack(cls, data: bytes) -> Tree:
        self = cls.__new__(cls)
        for name, value in np.load(io.BytesIO(data)).items():
            setattr(self, name, value.astype(np.float64) if name == "rows" else value)
        return self

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        return box_bounds(self.low, self.high, queries)

    def search(self, query: int, q: np.ndarray, bounds: np.ndarray, k: int, found: list[tuple[int, int]], safe: bool, counted: list[int]) -> list[tuple[int, int]]:
        """The best k of `found` and this tree, as (score, -id) in ascending order; never a row with the query's id."""
        best = sorted(found)[-k:]
        heap = [(-float(bounds[0]), int(self.least[0]), 0)]
        while heap:
            bound, least, node = heapq.heappop(heap)
            if len(best) == k:
                if -bound < best[0][0]:
                    break  # no box in the heap has a larger bound
                if -bound == best[0][0] and least > -best[0][1]:
                    continue
            if self.kids[node, 0] >= 0:
                for kid in self.kids[node].tolist():
                    heapq.heappush(heap, (-float(bounds[kid]), int(self.least[kid]), kid))
                continue
            a, b = self.spans[node]
            counted[0] += 1
            ids, scores = self.ids[a:b], products(self.rows[a:b], q, safe)
            good = ids != query
            if len(best) == k:
                good &= scores >= best[0][0]
            if good.any():
                own = sorted(zip(scores[good].tolist(), (-ids[good]).tolist(), strict=True))[-k:]
                best = sorted(best + own)[-k:]
        return best


def _rows(batches: Iterator[pa.RecordBatch], scale: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """The batches' usable rows by vector length: (ids, quantised vectors)."""
    found = defaultdict(list)
    for rb in batches:
        ids, vectors = rb.column(0), rb.column(1)
        lengths = pa.compute.list_value_length(vectors).fill_null(0).to_numpy(zero_copy_only=False)
        flat = vectors.flatten().to_numpy(zero_copy_only=False)
        at = np.concatenate([[0], np.cumsum(lengths)])
        for n in np.unique(lengths[lengths > 0]).tolist():
            rows = np.flatnonzero(lengths == n)
            own = flat[at[rows][:, None] + np.arange(n)].astype(np.float64)
            good = np.isfinite(own).all(1)
            found[n].append((ids.take(pa.array(rows[good])).to_numpy(zero_copy_only=False).astype(np.int64), quantised(own[good], scale)))
    return {n: tuple(np.concatenate(x) for x in zip(*own, strict=True)) for n, own in found.items()}


def _trees(vectors: DataFrame, scale: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        for n, (ids, rows) in _rows(batches, scale).items():
            if len(ids):
                tree = Tree(ids, rows)
                yield pa.RecordBatch.from_pydict({"shard": pa.array([TaskContext.get().partitionId()], pa.int32()), "size": pa.array([n], pa.int32()), "tree": [tree.pack()], "low": [tree.low[0].tobytes()], "high": [tree.high[0].tobytes()]})

    return vectors.mapInArrow(run, "shard int, size int, tree binary, low binary, high binary")


def _homes(met: DataFrame) -> DataFrame:
    """(block, size, bound, shard): of the boxes beside it, the one with the largest bounds for a block's queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            for r in rb.to_pylist():
                rows = np.frombuffer(r["rows"], np.float64).reshape(len(r["ids"]) // 8, -1)
                low, high = (np.array([np.frombuffer(b[side], np.float64) for b in r["boxes"]]) for side in ("low", "high"))
                total = box_bounds(low, high, rows).sum(1)
                best = int(total.argmax())
                yield pa.RecordBatch.from_pydict({"block": pa.array([r["block"]], pa.int32()), "size": pa.array([r["size"]], pa.int32()), "bound": [float(total[best])], "shard": pa.array([r["boxes"][best]["shard"]], pa.int32())})

    return met.mapInArrow(run, "block int, size int, bound double, shard int")


def _reached(met: DataFrame, k: int) -> DataFrame:
    """(block, size, shard) of the shards whose root box can hold a better row for a query of the block than it has found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            for r in rb.to_pylist():
                n = len(r["ids"]) // 8
                rows, found = np.frombuffer(r["rows"], np.float64).reshape(n, -1), np.frombuffer(r["found"], np.int64).reshape(n, k, 3)
                kth = np.where(found[:, :, 2].all(1), found[:, 0, 0].astype(np.float64), -np.inf)
                kth = np.where(np.abs(kth) < 2.0**53, kth, kth - np.abs(kth) * 1e-15 - 1)  # beyond exact doubles, rounded down
                low, high = (np.array([np.frombuffer(b[side], np.float64) for b in r["boxes"]]) for side in ("low", "high"))
                some = (box_bounds(low, high, rows) >= np.where(np.isfinite(kth), kth, -np.inf)).any(1)
                shards = [b["shard"] for b, yes in zip(r["boxes"], some.tolist(), strict=True) if yes and b["shard"] != r["home"]]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int32()) for x in ([r["block"]] * len(shards), [r["size"]] * len(shards), shards)], ["block", "size", "shard"])

    return met.mapInArrow(run, "block int, size int, shard int")


def _cells(vectors: DataFrame, shards: int) -> Column:
    """A number for the sides of the medians of the first components; the medians are one row."""
    dims = max(1, min(10, (shards - 1).bit_length() + 1))
    at = [F.try_element_at("v", F.lit(i + 1)) for i in range(dims)]
    medians = vectors.agg(*[F.percentile_approx(a, 0.5, 1000).alias(f"m{i}") for i, a in enumerate(at)]).first()
    bits = [F.when(a > F.lit(m), 1 << i).otherwise(0) for i, (a, m) in enumerate(zip(at, medians, strict=True)) if m is not None]
    return sum(bits, F.lit(0))


def _blocks(queries: DataFrame, scale: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        for n, (ids, rows) in _rows(batches, scale).items():
            ids, first = np.unique(ids, return_index=True)
            if len(ids):
                yield pa.RecordBatch.from_pydict({"block": pa.array([TaskContext.get().partitionId()], pa.int32()), "size": pa.array([n], pa.int32()), "ids": [ids.tobytes()], "rows": [rows[first].tobytes()]})

    return queries.mapInArrow(run, "block int, size int, ids binary, rows binary")


def _searched(pairs: DataFrame, k: int, packed: bool) -> DataFrame:
    """Searches each row's block in its tree, from the results in `found` on. `packed`: one row per block, else one per result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, of = None, None
        for rb in batches:
            for r in rb.to_pylist():
                if of != (r["shard"], r["size"]):  # blocks that meet one shard follow each other
                    tree, of = Tree.unpack(r["tree"]), (r["shard"], r["size"])
                ids = np.frombuffer(r["ids"], np.int64)
                rows = np.frombuffer(r["rows"], np.float64).reshape(len(ids), -1)
                before = np.frombuffer(r["found"], np.int64).reshape(len(ids), k, 3) if r.get("found") else None
                safe, bounds, counted, after = exact(tree.rows, rows), tree.bounds(rows), [0], []
                for i, query in enumerate(ids.tolist()):
                    start = [(s, x) for s, x, real in before[i].tolist() if real] if before is not None else []
                    got = tree.search(query, rows[i], bounds[:, i], k, start, safe, counted)
                    after.append(got if packed else list((Counter(got) - Counter(start)).elements()))  # a repeated row counts in each shard
                if packed:
                    full = np.array([[(*x, 1) for x in got] + [(0, 0, 0)] * (k - len(got)) for got in after], np.int64)
                    yield pa.RecordBatch.from_pydict({"block": pa.array([r["block"]], pa.int32()), "size": pa.array([r["size"]], pa.int32()), "found": [full.tobytes()]})
                else:
                    flat = [(query, -x, s) for query, got in zip(ids.tolist(), after, strict=True) for s, x in got]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*flat, strict=True) if flat else [[]] * 3)], ["query_id", "vec_id", "score"])

    return pairs.mapInArrow(run, "block int, size int, found binary" if packed else "query_id long, vec_id long, score long")


def _results(found: DataFrame, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            for r in rb.to_pylist():
                ids = np.frombuffer(r["ids"], np.int64)
                full = np.frombuffer(r["found"], np.int64).reshape(len(ids), k, 3)
                at, row = np.nonzero(full[:, :, 2])
                yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(-full[at, row, 1]), pa.array(full[at, row, 0])], ["query_id", "vec_id", "score"])

    return found.mapInArrow(run, "query_id long, vec_id long, score long")


def search(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = SCALE, key: str = "vec_id", vector: str = "embedding", shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best other rows for each row with `is_query`."""
    spark = vectors.sparkSession
    scratch, cores = Scratch(spark, "knn"), spark.sparkContext.defaultParallelism
    rows = vectors.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), is_query.alias("q"))
    usable = (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    queries = rows.where(F.col("q") & usable).groupBy("id").agg(F.min("v").alias("v"))  # before they are dealt to blocks
    n, asked = rows.agg(F.count("*"), F.count_if("q")).first()
    shards = max(-(-n // shard_rows), min(cores, -(-n // 2048)), 1)
    blocks = max(-(-asked // block_rows), 1)
    fit = rows.where(usable).select("id", "v")
    # A place within a cell by the row's number, so that equal rows, however many, go on in the next shard.
    cells = _cells(fit, shards)
    dealt = fit.repartitionByRange(shards, cells, F.xxhash64(F.monotonically_increasing_id())) if shards > 1 else fit.repartition(1)
    trees = scratch.table("trees", _trees(dealt, scale))
    block = scratch.table("blocks", _blocks(queries.repartitionByRange(blocks, cells, "id") if blocks > 1 else queries.repartition(1), scale))
    boxes = scratch.table("boxes", trees.groupBy("size", F.floor(F.col("shard") / BOXES).alias("pack")).agg(F.array_sort(F.collect_list(F.struct("shard", "low", "high"))).alias("boxes")))
    # Every block meets every pack of its length; the pack's number is in the key, so that they spread over tasks.
    packs = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(boxes.agg(F.max("pack")).first()[0] or 0).cast("long")))
    homes = _homes(block.withColumn("pack", packs).join(boxes, ["size", "pack"]).drop("pack")).groupBy("block", "size").agg(F.max(F.struct("bound", "shard"))["shard"].alias("home"))
    placed = scratch.table("placed", block.join(homes, ["block", "size"]))
    salts = max(-(-blocks // 64), 1)
    salted = trees.select("shard", "size", "tree").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salt = F.pmod("block", F.lit(salts)).alias("salt")
    home = placed.select("block", "size", "ids", "rows", F.col("home").alias("shard"), salt).join(salted, ["shard", "size", "salt"]).drop("salt")
    found = scratch.table("found", _searched(home, k, packed=True))
    asked_rows = scratch.table("asked", placed.join(found, ["block", "size"]))
    reached = scratch.table("reached", _reached(asked_rows.withColumn("pack", packs).join(boxes, ["size", "pack"]).drop("pack"), k))
    scratch.drop("placed", "boxes")
    away = reached.join(asked_rows.drop("home"), ["block", "size"]).select("*", salt)
    pairs = away.join(salted, ["shard", "size", "salt"]).drop("salt")
    first = _results(block.join(found, ["block", "size"]).select("ids", "found"), k)
    every = first.unionByName(_searched(pairs, k, packed=False))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
