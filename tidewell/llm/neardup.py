"""N-gram Jaccard join with Bayesian candidate pruning.

1. Every whole text becomes its set of word five-grams (64-bit), a MinHash signature and a 128-bit key of the
   set. Texts with equal sets are one class; everything after works on one text of each class.
2. Candidates are pairs with an equal band of `ROWS` MinHash values in one of `BANDS` bands: a pair at the
   threshold is missed with probability (1 - t^ROWS)^BANDS, 1e-7 at 0.8. Each bucket only links its members to
   its smallest one, so a bucket of any size gives as many rows as it has members; the connected components
   of these links are clusters, and every candidate pair is inside one.
3. A cluster is cut into blocks, and each pair of blocks is a unit of work of bounded size that goes to a
   task by its own key: a hot cluster spreads over the cluster's machines. In it, candidate pairs are compared
   `STEP` independent MinHash values at a time; a pair goes as soon as the posterior probability that its
   similarity reaches the threshold (uniform prior) falls under `TOLERANCE`. What is left is verified exactly on
   the whole sets. A unit gives one row per text: how many texts and documents it is linked with there, and
   the smallest text that it is connected with there. No pair is written.
4. Sums of the links and components of the verified links are the result.

Words are `[^\\x20\\x09-\\x0D]+`, as written. Cases: a null, empty or blank text takes no part (class of its own,
no links); a text of under five words has one gram of all its words; repeated rows and equal texts are copies of
one class and counted in n_copies; ties of the smallest doc_id do not matter for class_id; an empty table gives
no rows; extra columns are ignored; a null doc_id sorts after the others.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bounds, trimmed
from .components import components

GRAM, THRESHOLD = 5, 0.8
BANDS, ROWS, EXTRA, STEP, TOLERANCE = 40, 5, 64, 16, 1e-7
BLOCK, BLOCK_GRAMS, BITS_MB = 512, 1_500_000, 48
WORD = re.compile(r"[^\x20\x09-\x0D]+")
_rng = np.random.default_rng(20240131)
MULTIPLY = _rng.integers(0, 1 << 32, BANDS * ROWS + EXTRA, np.uint32) | np.uint32(1)
ADD = _rng.integers(0, 1 << 32, BANDS * ROWS + EXTRA, np.uint32)
WEIGHT = _rng.integers(0, 1 << 63, ROWS, np.uint64) | np.uint64(1)


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        value = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        if len(self) < 60_000:
            self[word] = value
        return value


_hashes = _Hashes()


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def grams(text: str | None, n: int = GRAM) -> np.ndarray:
    """The sorted set of a text's word n-grams, as 64-bit values."""
    words = WORD.findall(text) if text else []
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    n = min(n, len(h))
    out = h[: len(h) - n + 1].copy()
    for i in range(1, n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - n + 1 + i]
    return np.unique(mixed(out + np.uint64(n)))


def signature(own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a key for each band, 16 bits of each further MinHash value)."""
    low = (own ^ (own >> np.uint64(32))).astype(np.uint32)
    least = np.full(len(MULTIPLY), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(low), 512):
        np.minimum(least, (low[i : i + 512, None] * MULTIPLY + ADD).min(0), out=least)
    banded = least[: BANDS * ROWS].reshape(BANDS, ROWS).astype(np.uint64)
    return (mixed((banded * WEIGHT).sum(1)) >> np.uint64(32)).astype(np.uint32), (least[BANDS * ROWS :] & np.uint32(0xFFFF)).astype(np.uint16)


def least_matches(threshold: float, steps: int = EXTRA, tolerance: float = TOLERANCE) -> list[int]:
    """For n = 0 .. steps compared values: the fewest matches with which a pair stays.

    With a uniform prior the posterior of the similarity after m matches is Beta(m + 1, n - m + 1), which
    reaches the threshold with the probability that of n + 1 trials at the threshold at most m succeed.
    """
    out = []
    for n in range(steps + 1):
        reach, m = 0.0, -1
        while reach < tolerance and m < n:
            m += 1
            reach += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return out


def _signed(docs: DataFrame, text: str, key: str) -> DataFrame:
    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            rows = []
            for t in rb.column(1):
                own = grams(t.as_py())
                if len(own):
                    bands, extra = signature(own)
                    high, low = np.frombuffer(xxhash.xxh3_128_digest(own.tobytes()), ">i8").tolist()
                    rows.append((high, low, len(own), bands.view(np.int32), extra.tobytes()))
                else:
                    rows.append((None, None, 0, None, None))
            names, kinds = ["k1", "k2", "n", "bands", "extra"], [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.binary()]
            yield pa.RecordBatch.from_arrays([rb.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)), rb.column(2)], ["doc_id", *names, "th"])

    out = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), F.xxhash64(F.col(text).cast("string")).alias("th")).mapInArrow(run, "doc_id long, k1 long, k2 long, n long, bands array<int>, extra binary, th long")
    return out.withColumn("uid", F.monotonically_increasing_id())


def _with_grams(docs: DataFrame, wanted: DataFrame, text: str, key: str) -> DataFrame:
    """`wanted` (uid, doc_id, th, k1, k2, ...) with the grams of the document with that key and text. The join is by key and
    hash of the text, so a key that many rows share (null, too) is spread; it is a merge join, which gives repeated rows
    one after another, and only the first of them is read."""
    texts = docs.select(F.col(key).cast("long").alias("__key"), F.xxhash64(F.col(text).cast("string")).alias("__th"), F.col(text).cast("string").alias("__text"))
    joined = texts.join(wanted.hint("merge"), F.col("doc_id").eqNullSafe(F.col("__key")) & (F.col("th") == F.col("__th"))).drop("__key", "__th")
    names = [c for c in joined.columns if c != "__text"]
    schema = ", ".join([*(f"{c} {joined.schema[c].dataType.simpleString()}" for c in names), "grams binary"])

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = None
        for rb in batches:
            uid, k1, k2, keep, found = *(rb.column(names.index(c)).to_pylist() for c in ("uid", "k1", "k2")), [], []
            for i, t in enumerate(rb.column(len(names))):
                if uid[i] == done:
                    continue
                own = grams(t.as_py()).tobytes()
                if np.frombuffer(xxhash.xxh3_128_digest(own), ">i8").tolist() == [k1[i], k2[i]]:
                    keep.append(i)
                    found.append(own)
                    done = uid[i]
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([*(c.take(at) for c in rb.columns[: len(names)]), pa.array(found, pa.binary())], [*names, "grams"])

    return joined.select(*names, "__text").mapInArrow(run, schema)


def _common(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sets a[i] and b[i]."""
    used = np.unique(np.concatenate([a, b]))
    place = np.full(len(sets), -1)
    place[used] = np.arange(len(used))
    a, b, own = place[a], place[b], [sets[i] for i in used]
    if len(a) >= 4:
        at = bounds([len(s) for s in own])
        _, code, times = np.unique(np.concatenate(own), return_inverse=True, return_counts=True)
        shared = np.cumsum(times > 1) - 1  # a gram of one set only is in no intersection
        words = max(1, (int((times > 1).sum()) + 63) // 64)
        if words * 8 * len(own) <= BITS_MB << 20:
            packed = np.empty((len(own), words), np.uint64)
            for i in range(len(own)):
                mine, row = code[at[i] : at[i + 1]], np.zeros(words * 64, bool)
                row[shared[mine[times[mine] > 1]]] = True
                packed[i] = np.packbits(row).view(np.uint64)
            out, step = np.empty(len(a), np.int64), max(1, (4 << 20) // (8 * packed.shape[1]))
            for i in range(0, len(a), step):
                out[i : i + step] = np.bitwise_count(packed[a[i : i + step]] & packed[b[i : i + step]]).sum(1, dtype=np.int64)
            return out
    return np.array([len(np.intersect1d(own[i], own[j], assume_unique=True)) for i, j in zip(a.tolist(), b.tolist(), strict=True)], np.int64)


def _verified(left: list[dict], right: list[dict] | None, threshold: float, least: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Positions (in left + right) of all pairs of one unit at or over the threshold."""
    rows = left + (right or [])
    bands = np.array([np.array(r["bands"], np.int32) for r in rows])
    extra = np.array([np.frombuffer(r["extra"], np.uint16) for r in rows])
    n, sets = np.array([r["n"] for r in rows]), [np.frombuffer(r["grams"], np.uint64) for r in rows]
    first, second = (np.arange(len(left)), np.arange(len(left)) if right is None else np.arange(len(left), len(rows)))
    out_a, out_b = [], []
    for i in range(0, len(first), 128):
        own = first[i : i + 128]
        hit = np.zeros((len(own), len(second)), bool)
        for band in range(BANDS):
            hit |= bands[own, band][:, None] == bands[second, band][None, :]
        a, b = np.nonzero(hit)
        a, b = own[a], second[b]
        if right is None:
            a, b = a[a < b], b[a < b]
        ok = np.minimum(n[a], n[b]) >= threshold * np.maximum(n[a], n[b])  # else no overlap is enough
        a, b, matches = a[ok], b[ok], np.zeros(int(ok.sum()), np.int64)
        for s in range(0, EXTRA, STEP):
            matches += (extra[a, s : s + STEP] == extra[b, s : s + STEP]).sum(1)
            stay = matches >= least[s + STEP]
            a, b, matches = a[stay], b[stay], matches[stay]
        if len(a):
            common = _common(sets, a, b)
            # Compared in integers of thousandths, so that a similarity of exactly the threshold counts.
            good = 1000 * common >= round(1000 * threshold) * (n[a] + n[b] - common)
            out_a.append(a[good])
            out_b.append(b[good])
    none = np.empty(0, np.int64)
    return np.concatenate(out_a or [none]), np.concatenate(out_b or [none])


def _linked(units: DataFrame, threshold: float) -> DataFrame:
    """One row per text and unit: its links there, and the smallest text it is connected with there."""
    least = least_matches(threshold)

    def unit(rows: list[dict]) -> list[tuple]:
        i, j = rows[0]["side_i"], rows[0]["side_j"]
        left = [r for r in rows if r["block"] == i]
        right = [r for r in rows if r["block"] == j] if i != j else None
        rows = left + (right or [])
        a, b = _verified(left, right, threshold, least)
        copies = np.array([r["n_copies"] for r in rows], np.int64)
        links, texts = np.bincount(a, copies[b], len(rows)) + np.bincount(b, copies[a], len(rows)), np.bincount(a, minlength=len(rows)) + np.bincount(b, minlength=len(rows))
        uid = np.array([r["uid"] for r in rows], np.int64)
        root = uid.copy()
        while True:  # smallest labels over this unit's links
            was = root.copy()
            np.minimum.at(root, a, was[b])
            np.minimum.at(root, b, was[a])
            if (root == was).all():
                break
        return list(zip(uid.tolist(), texts.tolist(), links.astype(np.int64).tolist(), root.tolist(), strict=True))

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * 4)], ["uid", "texts", "links", "root"])

        key, rows, done = None, [], []
        for rb in batches:
            for r in rb.to_pylist():
                if (own := (r["cluster"], r["side_i"], r["side_j"])) != key and rows:
                    done += unit(rows)
                    rows = []
                key = own
                if not rows or rows[-1]["uid"] != r["uid"]:  # a repeated row meets itself in the join
                    rows.append(r)
            if done:
                yield out(done)
                done = []
        yield out(unit(rows) if rows else [])

    return units.mapInArrow(run, "uid long, texts long, links long, root long")


def join(docs: DataFrame, threshold: float = THRESHOLD, text: str = "text", key: str = "doc_id", scratch: Scratch | None = None) -> DataFrame:
    """One row per document: doc_id, class_id (smallest doc_id connected with it by links and copies), n_links
    (other documents whose similarity reaches the threshold, copies included), n_texts (different texts among
    them), n_copies (documents with its set of grams), stays (true for one document of each class) and text_hash."""
    scratch = scratch or Scratch(docs.sparkSession, "neardup")
    signed = scratch.table("signed", _signed(docs, text, key))
    classes = signed.where("k1 is not null").groupBy("k1", "k2").agg(F.min("uid").alias("rep"), F.count("*").alias("n_copies"))
    classes = scratch.table("classes", classes)
    reps = signed.join(classes.select(F.col("rep").alias("uid"), "n_copies"), "uid")
    bucket = reps.select("uid", F.posexplode("bands").alias("band", "value")).select("uid", (F.col("band").cast("long") * F.lit(1 << 32) + F.col("value")).alias("bucket"))
    shared = bucket.groupBy("bucket").agg(F.min("uid").alias("b"), F.count("*").alias("m")).where("m > 1").select("bucket", "b")
    shared = scratch.table("shared", shared)  # plain rows on both sides of the join, so that a hot bucket can be split
    stars = bucket.join(shared, "bucket").where("uid <> b").select(F.col("uid").alias("a"), "b").distinct()
    clusters = components(scratch.table("stars", stars), scratch, "clusters").select(F.col("node").alias("uid"), F.col("component").alias("cluster"))
    members = scratch.table("members", reps.join(clusters, "uid"))
    scratch.drop("shared", "stars")
    sizes = members.groupBy("cluster").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_GRAMS)).cast("int").alias("blocks"))
    placed = members.join(sizes, "cluster").withColumn("block", F.pmod(F.xxhash64("uid"), F.col("blocks")).cast("int"))
    full = _with_grams(docs, placed, text, key)
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    units = full.withColumn("other", other).select("uid", "n", "n_copies", "bands", "extra", "grams", "cluster", "block", F.least("block", "other").alias("side_i"), F.greatest("block", "other").alias("side_j"))
    units = units.repartition("cluster", "side_i", "side_j").sortWithinPartitions("cluster", "side_i", "side_j", "uid")
    linked = scratch.table("linked", _linked(units, threshold))
    scratch.drop("members")
    sums = linked.groupBy("uid").agg(F.sum("links").alias("links"), F.sum("texts").alias("texts"))
    joined = components(linked.where("root <> uid").select(F.col("uid").alias("a"), F.col("root").alias("b")), scratch, "joined")
    texts = classes.join(sums.withColumnRenamed("uid", "rep"), "rep", "left").join(joined.select(F.col("node").alias("rep"), "component"), "rep", "left")
    texts = texts.select("k1", "k2", "n_copies", F.coalesce("component", "rep").alias("component"), F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("texts", F.lit(0)).alias("texts"))
    rows = signed.select("uid", "doc_id", "th", "k1", "k2").join(texts, ["k1", "k2"], "left")
    rows = scratch.table("rows", rows.withColumn("component", F.coalesce("component", "uid")))
    scratch.drop("signed", "classes", "linked")
    first = rows.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "uid")).alias("first"))
    return rows.join(scratch.table("first", first), "component").select(
        "doc_id",
        F.col("first.doc_id").alias("class_id"),
        F.when(F.col("n_copies").isNull(), 0).otherwise(F.col("links") + F.col("n_copies") - 1).cast("long").alias("n_links"),
        F.coalesce("texts", F.lit(0)).cast("long").alias("n_texts"),
        F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"),
        (F.col("first.uid") == F.col("uid")).alias("stays"),
        F.col("th").alias("text_hash"),
    )


def keep_one(docs: DataFrame, threshold: float = THRESHOLD, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of `docs` without all but one of each class."""
    own, scratch = Scratch(docs.sparkSession, "neardup"), Scratch(docs.sparkSession, "kept")
    linked = join(docs, threshold, text, key, own)
    stays = linked.where("stays").select(F.col("doc_id").alias("__key"), F.col("text_hash").alias("__hash"), (F.col("n_copies") > 1).alias("__again"))
    stays = scratch.table("stays", stays.distinct())
    named = docs.withColumn("__th", F.xxhash64(F.col(text).cast("string")))
    same = F.col(key).cast("long").eqNullSafe(F.col("__key")) & (F.col("__th") == F.col("__hash"))
    out = named.join(stays, same)
    repeated = linked.where("n_copies > 1").groupBy("doc_id", "text_hash").agg(F.count("*").alias("m")).where("m > 1").limit(1).count()
    own.drop()
    if repeated:  # the same row twice: both have the key and text of the one that stays. Rows without words have no copies.
        out = out.where("not __again").unionByName(out.where("__again").dropDuplicates(["__key", "__th"]))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
