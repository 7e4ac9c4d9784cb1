"""Numeric band join: points of one table with the rows of another whose values are near theirs.

A point at p meets every row of another key whose value u has |u - p| <= least or share * |u - p| <= p. For each point
the join gives the first k rows by (gap, u, order1, order2, key) and the number, the sum of gaps and the sum of checks of all.

1. Tasks sum their rows by value and key before anything is shuffled: a count, a sum of checks, and of the rows the first
   k of a key and then the first 2k of a value. A point leaves out one key at most, so those hold its first k.
2. Adaptive recursive partitioning. Tasks count rows and points over at most `BINS` bins of the values' range; bins that
   weigh more than a region should are cut and counted again, in rounds, down to single values. Then the heaviest region is split
   in two again and again, by estimated load (rows, points that reach it, pairs of values), until there are as many as there should be. A single
   value that is still too heavy becomes a grid of cells: its rows are dealt to one side's chunks, the points that reach it to the other's.
3. Rows go to the cells of their region, points to every region that their band touches (borders are replicated), one partition a cell.
4. Each cell runs range joins in duckdb, values against points' values: sums by band, and the nearest rows in a
   radius that doubles until k rows are certain.
5. A point's parts from several cells are added up, at most k rows from each.

The driver sees bins (`BINS` and `FINE` for each heavy one) and regions (`MOST`), both bounded whatever the input's size.

Cases: rows with a null value or key and points with a null value or key never pair; a null order2 sorts first; repeated rows each
count and take a place each; a point is a (key, value), so repeated points are one, and a key with two values has results for each; points
without rows have one result with rank 0; an empty table of rows gives only such; extra columns are ignored. Values stay within
2^61 of zero.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bounds, ragged

BINS, FINE, MOST, CELL_ROWS, CHUNK = 1024, 64, 4096, 400_000, 262_144
NULL, POINT = -(1 << 63), -1
PARTIAL = "at long, key long, n long, checks long, order1 long, order2 long"
LINE = "struct<gap:long,at:long,order1:long,order2:long,key:long>"


def reach(p: np.ndarray, least: int, share: int) -> np.ndarray:
    """The largest gap that pairs with a point at p."""
    return np.maximum(least, np.maximum(p, 0) // share)


def summed(at: np.ndarray, key: np.ndarray, order1: np.ndarray, order2: np.ndarray, checks: np.ndarray, k: int) -> list[np.ndarray]:
    """Columns of `PARTIAL`: a row for each value and key with its count and checks; rows that can be among a point's first k, with n = 0."""
    order = np.lexsort((order2, order1, key, at))
    at, key, order1, order2, checks = (x[order] for x in (at, key, order1, order2, checks))
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (key[1:] != key[:-1])
    firsts = np.flatnonzero(new)
    n = np.diff(np.append(firsts, len(at)))
    own = np.arange(len(at)) - np.repeat(firsts, n) < k
    a, b, c, d = (x[own] for x in (at, order1, order2, key))
    again = np.lexsort((d, c, b, a))
    a, b, c, d = (x[again] for x in (a, b, c, d))
    starts = np.flatnonzero(np.append(True, a[1:] != a[:-1])) if len(a) else np.zeros(0, np.int64)
    near = np.arange(len(a)) - np.repeat(starts, np.diff(np.append(starts, len(a)))) < 2 * k
    zeros, none = np.zeros(int(near.sum()), np.int64), np.full(len(firsts), NULL)
    sums = np.add.reduceat(checks, firsts) if len(firsts) else checks[:0]
    return [np.concatenate(x) for x in ((at[firsts], a[near]), (key[firsts], d[near]), (n, zeros), (sums, zeros), (none, b[near]), (none, c[near]))]


def _arrays(t: pa.Table | pa.RecordBatch) -> list[np.ndarray]:
    return [c.fill_null(NULL).to_numpy(zero_copy_only=False) if isinstance(c, pa.Array) else c.fill_null(NULL).to_numpy() for c in t.columns]


def partials(rows: DataFrame, k: int, chunk: int = CHUNK) -> DataFrame:
    """`rows` (at, key, order1, order2, check) summed within the tasks that read them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x) for x in summed(*_arrays(pa.Table.from_batches(held)), k)], PARTIAL.replace(" long", "").split(", "))

        held, n = [], 0
        for rb in batches:
            held, n = [*held, rb], n + len(rb)
            if n >= chunk:
                yield out()
                held, n = [], 0
        if n:
            yield out()

    return rows.select("at", "key", "order1", "order2", "check").mapInArrow(run, PARTIAL)


@dataclass
class Bin:
    """Values lo to hi - 1."""

    lo: int
    hi: int
    rows: int = 0
    points: int = 0

    def load(self, least: int, share: int) -> int:
        """Rows and points to move, and the pairs of values to compare."""
        width, band = self.hi - self.lo, 2 * int(reach(np.array(self.hi), least, share)) + 1
        return self.rows + self.points + min(self.points, width) * min(band, self.rows)


@dataclass
class Region:
    """Values lo to hi - 1 in cells first to first + across * down - 1: rows are dealt to `down` chunks, points to `across`."""

    lo: int
    hi: int
    load: int
    down: int = 1
    across: int = 1
    first: int = 0


def cut(lo: int, hi: int, parts: int) -> list[Bin]:
    """Values lo to hi - 1 in at most `parts` even bins."""
    n = min(parts, hi - lo)
    ends = [lo + (hi - lo) * i // n for i in range(n + 1)]
    return [Bin(a, b) for a, b in zip(ends, ends[1:], strict=False)]


def divided(count: Callable[[list[Bin]], None], low: int, high: int, cells: int, least: int, share: int) -> list[Region]:
    """Regions over low to high: bins are counted by `count` and refined where they are heavy, then the heaviest region is split, repeatedly."""

    def load(b: Bin) -> int:
        return b.load(least, share)

    bins = cut(low, high + 1, BINS)
    count(bins)
    while True:
        most = max(sum(map(load, bins)) / cells, 1)
        heavy = [b for b in bins if load(b) > most / 2 and b.hi - b.lo > 1]
        heavy = sorted(heavy, key=load, reverse=True)[:cells]
        if not heavy:
            break
        again = [x for b in sorted(heavy, key=lambda b: b.lo) for x in cut(b.lo, b.hi, FINE)]
        count(again)
        kept = {id(b) for b in heavy}
        bins = sorted([b for b in bins if id(b) not in kept] + again, key=lambda b: b.lo)
    ends = bounds([load(b) for b in bins])
    total = max(int(ends[-1]), 1)
    heap, done = [(-total, 0, len(bins))], []
    while heap and len(heap) + len(done) < cells:
        weight, a, b = heapq.heappop(heap)
        if b - a == 1:
            done.append((weight, a, b))
            continue
        middle = min(max(int(np.searchsorted(ends, (ends[a] + ends[b]) / 2)), a + 1), b - 1)
        if middle > a + 1 and ends[b] - ends[middle] < ends[middle - 1] - ends[a]:
            middle -= 1
        for x, y in ((a, middle), (middle, b)):
            heapq.heappush(heap, (-int(ends[y] - ends[x]), x, y))
    regions, first = [], 0
    lows, points = np.array([b.lo for b in bins]), bounds([b.points for b in bins])
    for weight, a, b in sorted(done + heap, key=lambda r: r[1]):
        r = Region(bins[a].lo, bins[b - 1].hi, -weight, first=first)
        if b - a == 1 and -weight > 2 * total / cells:
            near = int(reach(np.array(r.hi), least, share))
            x, y = np.searchsorted(lows, [r.lo - near, r.hi + near])
            some = max(total // cells, 1)
            r.down, r.across = max(-(-bins[a].rows // some), 1), max(-(-int(points[y] - points[max(x - 1, 0)]) // some), 1)
            if r.down * r.across > cells:
                scale = (cells / (r.down * r.across)) ** 0.5
                r.down, r.across = max(int(r.down * scale), 1), max(int(r.across * scale), 1)
        first += r.down * r.across
        regions.append(r)
    return regions


def _counted(rows: DataFrame, points: DataFrame) -> Callable[[list[Bin]], None]:
    """Counts rows and points within sorted bins; a row for each bin that has any reaches the driver."""
    both = rows.where("n > 0").select("at", F.lit(False).alias("point")).union(points.where("key IS NOT NULL AND at IS NOT NULL").select("at", F.lit(True).alias("point")))

    def count(bins: list[Bin]) -> None:
        lows, highs = (np.array([getattr(b, x) for b in bins]) for x in ("lo", "hi"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = np.zeros((2, len(lows)), np.int64)
            for rb in batches:
                at, point = rb.column(0).to_numpy(), rb.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
                where = np.searchsorted(lows, at, "right") - 1
                good = (where >= 0) & (at < highs[where])
                found += np.bincount(point[good] * len(lows) + where[good], minlength=2 * len(lows)).reshape(2, -1)
            some = np.flatnonzero(found.any(0))
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(found[0, some]), pa.array(found[1, some])], ["bin", "rows", "points"])

        for r in both.mapInArrow(run, "bin int, rows long, points long").groupBy("bin").agg(F.sum("rows"), F.sum("points")).collect():
            bins[r[0]].rows, bins[r[0]].points = r[1], r[2]

    return count


def _mixed(*columns: np.ndarray) -> np.ndarray:
    """A hash of whole rows."""
    h = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        h = (h ^ c.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def _dealt(rows: DataFrame, regions: list[Region], points: bool, least: int, share: int) -> DataFrame:
    """`PARTIAL` with the cell of each row, or all cells that a point meets."""
    lows, highs, down, across, first = (np.array([getattr(r, x) for r in regions], np.int64) for x in ("lo", "hi", "down", "across", "first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            cols = _arrays(rb)
            at, h = cols[0], _mixed(*cols)
            if points:
                w = reach(at, least, share)
                a, b = np.searchsorted(highs, at - w, "right"), np.searchsorted(lows, at + w, "right")
                region = ragged(a, np.maximum(b - a, 0))
                row = np.repeat(np.arange(len(at)), np.maximum(b - a, 0))
                chunk = (h[row] % across[region].astype(np.uint64)).astype(np.int64)
                copies = down[region]  # a point meets every chunk of the rows
                i = np.repeat(np.arange(len(row)), copies)
                cell = first[region[i]] + ragged(np.zeros(len(row), np.int64), copies) * across[region[i]] + chunk[i]
                row = row[i]
            else:
                region = np.searchsorted(lows, at, "right") - 1
                chunk = (h % down[region].astype(np.uint64)).astype(np.int64)
                row = np.repeat(np.arange(len(at)), across[region])
                cell = (first[region] + chunk * across[region])[row] + ragged(np.zeros(len(at), np.int64), across[region])
            yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), *[pa.array(c[row]) for c in cols]], ["cell", *rb.schema.names])

    return rows.mapInArrow(run, f"cell int, {PARTIAL}")


def matched(t: pa.Table, k: int, least: int, share: int) -> pa.Table:
    """One cell: (key, place, n, gaps, checks, lines) of every point in it that has any row. Range joins in duckdb, on values."""
    import duckdb

    con = duckdb.connect(config={"threads": 1, "temp_directory": ""})
    con.register("t", t.rename_columns(["place", *t.column_names[1:]]))
    con.execute(f"""
        CREATE TABLE points AS SELECT DISTINCT key, place AS p, greatest({least}, greatest(place, 0) // {share}) AS w FROM t WHERE n = {POINT};
        CREATE TABLE places AS SELECT DISTINCT p, w FROM points;
        CREATE TABLE own AS SELECT key, place AS u, sum(n)::BIGINT AS n, sum(checks)::BIGINT AS checks FROM t WHERE n > 0 GROUP BY ALL;
        CREATE TABLE every AS SELECT u, sum(n)::BIGINT AS n, sum(checks)::BIGINT AS checks FROM own GROUP BY u;
        CREATE TABLE near AS SELECT u, order1, order2, key FROM (
            SELECT place AS u, order1, order2, key FROM t WHERE n = 0 QUALIFY row_number() OVER (PARTITION BY place, key ORDER BY order1, order2) <= {k}
        ) QUALIFY row_number() OVER (PARTITION BY u ORDER BY order1, order2, key) <= {2 * k};
        CREATE TABLE sums AS SELECT p, sum(n)::BIGINT AS n, sum(n * abs(u - p))::BIGINT AS gaps, sum(checks)::BIGINT AS checks FROM places JOIN every ON u BETWEEN p - w AND p + w GROUP BY p;
        CREATE TABLE less AS SELECT key, p, sum(o.n)::BIGINT AS n, sum(o.n * abs(u - p))::BIGINT AS gaps, sum(o.checks)::BIGINT AS checks FROM points JOIN own o USING (key) WHERE u BETWEEN p - w AND p + w GROUP BY key, p;
        CREATE TABLE firsts (p BIGINT, u BIGINT, order1 BIGINT, order2 BIGINT, key BIGINT, r BIGINT);
        CREATE TABLE todo AS SELECT p, w FROM places SEMI JOIN (SELECT DISTINCT u FROM near) v ON v.u BETWEEN p - w AND p + w;
    """)
    radius = 0
    while True:
        con.execute(f"""
            CREATE OR REPLACE TABLE got AS SELECT p, u, order1, order2, key, w, row_number() OVER (PARTITION BY p ORDER BY abs(u - p), u, order1, order2, key) AS r FROM (
                SELECT p, w, u, order1, order2, key FROM todo JOIN near ON u BETWEEN p - least({radius}, w) AND p + least({radius}, w)
                QUALIFY row_number() OVER (PARTITION BY p, key ORDER BY abs(u - p), u, order1, order2) <= {k}
            ) QUALIFY r <= {2 * k};
            CREATE OR REPLACE TABLE settled AS SELECT p FROM todo LEFT JOIN (SELECT p, count(*) AS c FROM got GROUP BY p) USING (p) WHERE w <= {radius} OR c >= {2 * k};
            INSERT INTO firsts SELECT p, u, order1, order2, key, r FROM got SEMI JOIN settled USING (p);
            CREATE OR REPLACE TABLE todo AS SELECT p, w FROM todo ANTI JOIN settled USING (p);
        """)
        if not con.execute("SELECT count(*) FROM todo").fetchall()[0][0]:
            break
        radius = max(2 * radius, 1)
    out = con.execute(f"""
        WITH lines AS (
            SELECT a.key, a.p, list({{'gap': abs(u - a.p), 'at': u, 'order1': order1, 'order2': order2, 'key': f.key}} ORDER BY r) AS lines
            FROM (SELECT key, p FROM points) a JOIN firsts f ON a.p = f.p AND a.key <> f.key GROUP BY a.key, a.p
        )
        SELECT a.key, a.p AS place, coalesce(s.n, 0) - coalesce(l.n, 0) AS n, coalesce(s.gaps, 0) - coalesce(l.gaps, 0) AS gaps, coalesce(s.checks, 0) - coalesce(l.checks, 0) AS checks, coalesce(x.lines[:{k}], []) AS lines
        FROM points a LEFT JOIN sums s ON a.p = s.p LEFT JOIN lines x ON a.key = x.key AND a.p = x.p LEFT JOIN less l ON a.key = l.key AND a.p = l.p
        WHERE s.n IS NOT NULL OR x.lines IS NOT NULL
    """).to_arrow_table()
    con.close()
    return out


def nearest(points: DataFrame, rows: DataFrame, k: int = 5, least: int = 10, share: int = 500, cells: int | None = None) -> DataFrame:
    """key, at, rank, gap, value, order1, order2, row_key: the first k rows of every point of `points` (key, at) among `rows` (at, key,
    order1, order2, check), all longs, and over all its rows n, gaps and checks. `cells`: how many regions there should be."""
    spark = points.sparkSession
    scratch = Scratch(spark, "bands")
    summed_rows = scratch.table("rows", partials(rows.where("at IS NOT NULL AND key IS NOT NULL AND order1 IS NOT NULL"), k))
    own = scratch.table("points", points.select(F.col("key").cast("long"), F.col("at").cast("long")).distinct())
    low, high, n = summed_rows.agg(F.min("at"), F.max("at"), F.count("*")).first()
    base = own.select("key", "at", *[F.lit(0).cast("long").alias(c) for c in ("n", "gaps", "checks")], F.array().cast(f"array<{LINE}>").alias("lines"))
    if n:
        want = cells or min(max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // CELL_ROWS)), MOST)
        regions = divided(_counted(summed_rows, own), low, high, want, least, share)
        some = own.where("key IS NOT NULL AND at IS NOT NULL").select("at", "key", F.lit(POINT).cast("long").alias("n"), *[F.lit(0).cast("long").alias(c) for c in ("checks", "order1", "order2")])
        both = _dealt(summed_rows, regions, False, least, share).union(_dealt(some, regions, True, least, share))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = list(batches)
            if held:
                yield from matched(pa.Table.from_batches(held), k, least, share).rename_columns(["key", "at", "n", "gaps", "checks", "lines"]).to_batches()

        count = regions[-1].first + regions[-1].down * regions[-1].across
        parts = both.repartitionById(count, F.col("cell")).drop("cell").mapInArrow(run, f"key long, at long, n long, gaps long, checks long, lines array<{LINE}>")
        base = base.union(parts)
    whole = base.groupBy("key", "at").agg(*[F.sum(c).alias(c) for c in ("n", "gaps", "checks")], F.slice(F.array_sort(F.flatten(F.collect_list("lines"))), 1, k).alias("lines"))
    place = whole.select("key", "at", "n", "gaps", "checks", F.posexplode_outer("lines").alias("pos", "line"))
    value = {"gap": "gap", "value": "at", "order1": "order1", "row_key": "key"}
    second = F.when(F.col("line.order2") != NULL, F.col("line.order2"))
    return place.select("key", "at", F.coalesce(F.col("pos") + 1, F.lit(0)).alias("rank"), *[F.col(f"line.{b}").alias(a) for a, b in value.items()], second.alias("order2"), "n", "gaps", "checks")
