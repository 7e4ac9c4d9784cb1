"""Suffix-array dedup: bytes of every 200-byte string that starts more than once in the corpus are removed.

1. Anchors. In every window of `length` bytes the `GRAM`-byte string with the smallest hash (leftmost of equal
   ones) is its anchor. That depends on the window's bytes alone, so equal windows have equal anchors, and each
   window belongs to one anchor. Windows that share an anchor's position are a run; a run's text is a chunk.
2. Only chunks whose anchor occurs more than once can hold a repeated window. Equal chunks (by the hashes of anchor
   and chunk, 128 bits together) become one with a weight, so thousands of copies of a passage are one row before any
   text is gathered; the text of one place of each is cut out then.
3. Chunks are dealt by anchor. A worker concatenates chunks of about `BATCH` bytes, builds their suffix array and
   Burrows-Wheeler transform, and finds longest common prefixes by breadth-first backward extension: intervals of
   all strings of l bytes give those of l + 1 bytes, each new right boundary has the common prefix l, and an
   interval that brings no new boundary is not followed. The search stops at `length`: boundaries not reached by
   then separate suffixes with a longer common prefix, so runs of them are the repeated windows.
4. An anchor with more than `HOT` bytes of different chunks is split, exactly: a window holds either the bytes
   just left of its anchor or those just right of it, so it goes to a part keyed by these; equal parts become one
   again. Splitting repeats until parts are small; at its end a part is a single window.
5. Repeated windows go back to the chunks' places, places are gathered by document, and overlapping ones joined.

Cases: a null text is empty; matches never cross documents; a text of under `length` bytes keeps all; equal texts
remove each other; repeated rows (same key and text) are different places; an empty table gives no rows; null keys
stay; extra columns are ignored; very long texts are cut into stretches of windows, not of text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bounds, portions, ragged, trimmed

LENGTH, GRAM, BATCH, HOT, STRETCH = 200, 48, 300_000, 600_000, 1 << 20
SYMBOLS = 4  # of nine bits each in the first sort key


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A 64-bit hash of the `gram` bytes at every position, by joining halves."""
    powers, parts, n = {1: data.astype(np.uint64) + np.uint64(1)}, [], 1
    while 2 * n <= gram:
        h = powers[n]
        powers[2 * n] = (h[:-n] * np.uint64(0x9E3779B97F4A7C15 + 2 * n) ^ (h[:-n] >> np.uint64(29))) + h[n:] * np.uint64(0xC2B2AE3D27D4EB4F)
        n *= 2
    at, out, size = 0, None, len(data) - gram + 1
    for n in sorted(powers, reverse=True):
        if at + n <= gram:
            own = powers[n][at : at + size]
            out = own if out is None else (out ^ (out >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93) + own
            at += n
            parts.append(n)
    out = (out ^ (out >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return out ^ (out >> np.uint64(29))


def runs(data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(first window, windows, anchor's place after the first window's start, anchor's hash) of every run of windows with one anchor."""
    found = []
    for base in range(0, max(0, len(data) - length + 1), STRETCH):
        part = data[base : base + STRETCH + length - 1]
        h = gram_hashes(part, gram)
        low, width, n = (h & ~np.uint64((1 << 23) - 1)) | np.arange(len(h), dtype=np.uint64), length - gram + 1, 1
        while 2 * n <= width:
            low = np.minimum(low[:-n], low[n:])
            n *= 2
        if n < width:
            low = np.minimum(low[: len(low) - (width - n)], low[width - n :])
        at = (low & np.uint64((1 << 23) - 1)).astype(np.int64)
        first = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1])
        found.append((first + base, np.diff(np.append(first, len(at))), at[first] - first, h[at[first]].view(np.int64)))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 4


def ordered(key: np.ndarray, bits: int) -> np.ndarray:
    """Positions in the order of (key, position). A key of `bits` bits is sorted with its position in one number where both fit."""
    width = len(key).bit_length()
    if bits + width > 63:
        return np.argsort(key, kind="stable")
    both = key << width | np.arange(len(key))
    both.sort()
    return both & ((1 << width) - 1)


def suffix_array(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Positions in the order of their next `depth` symbols; 0 ends a string, and every string's end differs."""
    n = len(symbols)
    padded = np.concatenate([symbols, np.zeros(SYMBOLS, symbols.dtype)]).astype(np.int64)
    key, ended = np.zeros(n, np.int64), np.zeros(n, bool)
    for i in range(SYMBOLS):
        own = np.where(ended, 0, padded[i : i + n])
        key = key << 9 | own
        ended |= own == 0
    order = ordered(key, 9 * SYMBOLS)  # of equal ends the earlier string's comes first
    changed = (np.diff(key[order]) != 0) | ended[order[1:]] | ended[order[:-1]]
    reach, width = SYMBOLS, (n + 1).bit_length()
    while True:
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(changed)])
        if reach >= depth or rank[order[-1]] == n - 1:
            return order
        key = rank << width
        key[: n - reach] |= rank[reach:] + 1
        order = ordered(key, 2 * width)
        changed, reach = np.diff(key[order]) != 0, 2 * reach


def repeated(strings: list[bytes], weights: np.ndarray, length: int) -> list[np.ndarray]:
    """For each string, a mark for every start whose next `length` bytes occur twice or more, counted by weight."""
    sizes = np.array([len(s) for s in strings], np.int64)
    at = bounds(sizes + 1)
    n, m = int(at[-1]), len(strings)
    symbols = np.zeros(n, np.uint16)
    inner = np.ones(n, bool)
    inner[at[1:] - 1] = False
    symbols[inner] = np.frombuffer(b"".join(strings), np.uint8)
    symbols[inner] += 1
    owner = np.repeat(np.arange(m), sizes + 1)
    sa = suffix_array(symbols, length)
    place = np.empty(n, np.int64)
    place[sa] = np.arange(n)
    bwt, front = symbols[sa - 1], symbols[sa]  # sa - 1 of 0 is the last end
    back = place[sa - 1]  # where the suffix that is one byte longer stands
    ahead = place[(sa + 1) % n]  # and the one a byte shorter
    known = np.zeros(n + 1, bool)
    known[0] = known[n] = True
    # Level 0: the interval of each symbol; every string's end is a symbol of its own.
    starts = np.flatnonzero(np.diff(front.astype(np.int32), prepend=-1) != 0)
    starts = np.union1d(starts, np.arange(m))
    low, high = starts, np.append(starts[1:], n)
    known[high] = True
    for level in range(1, length):
        if not len(low):
            break
        idx, top, bottom = ragged(low, high - low), np.repeat(high, high - low), np.repeat(low, high - low)
        c = bwt[idx]
        keep = c > 0
        idx, top, bottom, c = idx[keep], top[keep], bottom[keep], c[keep]
        to = back[idx]
        nxt, prv = np.minimum(to + 1, n - 1), np.maximum(to - 1, 0)
        last = (to + 1 == n) | (front[nxt] != c) | (ahead[nxt] >= top)
        first = (to == 0) | (front[prv] != c) | (ahead[prv] < bottom)
        new_low, new_high = np.sort(to[first]), np.sort(to[last]) + 1
        fresh = ~known[new_high]
        low, high = new_low[fresh], new_high[fresh]
        known[high] = True  # the common prefix at this boundary has `level` bytes
    group = np.cumsum(known[:n]) - 1
    whole = at[owner[sa] + 1] - 1 - sa >= length
    total = np.bincount(group[whole], weights[owner[sa]][whole], int(group[-1]) + 1)
    mark = np.zeros(n, bool)
    mark[sa] = whole & (total[group] >= 2)
    return [mark[at[i] : max(at[i], at[i + 1] - length)] for i in range(m)]


def mark_ranges(mark: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mark.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def digest(data: bytes) -> tuple[int, int]:
    return tuple(np.frombuffer(xxhash.xxh3_128_digest(data), ">i8").tolist())


def _portions(batches: Iterator[pa.RecordBatch], text: int, limit: int = 4_000_000) -> Iterator[tuple[int, pa.Array, pa.RecordBatch]]:
    """(first row, texts, their batch) for runs of whole texts of about `limit` bytes."""
    for rb in batches:
        for first, texts in portions(rb.column(text), limit):
            yield first, texts, rb


def _anchors(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(doc_id, th, a, m, at, h, c) of every run: first window, windows, the anchor's place and hash, a hash of its chunk."""

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a, texts, rb in _portions(batches, 2):
            got, c = [], []
            for text in texts:
                data = (text.as_py() or "").encode()
                own = runs(np.frombuffer(data, np.uint8), length, gram)
                c += [xxhash.xxh3_64_digest(data[x : x + y + length - 1]) for x, y in zip(own[0].tolist(), own[1].tolist(), strict=True)]
                got.append(own)
            row = pa.array(a + np.repeat(np.arange(len(got)), [len(g[0]) for g in got]))
            first, windows, at, h = (np.concatenate([g[i] for g in got]) if got else np.empty(0, np.int64) for i in range(4))
            yield pa.RecordBatch.from_arrays([rb.column(0).take(row), rb.column(1).take(row), *(pa.array(x.astype(np.int32)) for x in (first, windows, at)), pa.array(h), pa.array(np.frombuffer(b"".join(c), ">i8").astype(np.int64))], ["doc_id", "th", "a", "m", "at", "h", "c"])

    return docs.select("doc_id", "th", "text").mapInArrow(run, "doc_id long, th long, a int, m int, at int, h long, c long")


def _chunks(found: DataFrame, length: int) -> DataFrame:
    """(h, c1, c2, chunk, weight, at) of the listed runs of each document. Repeated documents follow one another; one is cut."""

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, done = ["h", "c1", "c2", "chunk", "weight", "at"], None
        for rb in batches:
            held, size = [], 0
            for i in range(rb.num_rows):
                own = (rb.column(0)[i].as_py(), rb.column(1)[i].as_py())
                if own == done:
                    continue
                done, data, listed = own, (rb.column(2)[i].as_py() or "").encode(), rb.column(3)[i].values
                parts = [data[x : x + y + length - 1] for x, y in zip(listed.field("a").to_pylist(), listed.field("m").to_pylist(), strict=True)]
                held.append(pa.RecordBatch.from_arrays([listed.field("h"), listed.field("h"), listed.field("c"), pa.array(parts, pa.binary()), listed.field("weight"), listed.field("at")], names))
                size += sum(map(len, parts))
                if size > 4_000_000:
                    yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                    held, size = [], 0
            if held:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return found.select("doc_id", "th", "text", "listed").mapInArrow(run, "h long, c1 long, c2 long, chunk binary, weight long, at int")


def _split(parts: DataFrame, length: int) -> DataFrame:
    """Both halves of each part: (h: new key, c1, c2, chunk, low, high, o1, o2, shift) where o is the part it came from.

    A part's windows have their anchor low to high bytes after their start, the window at 0 at high."""

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            rows = []
            for r in rb.to_pylist():
                text, anchor, low, high = r["chunk"], r["at"], r["low"], r["high"]
                middle = (r["from_low"] + r["from_high"] + 1) // 2
                for key_low, key_high in ((middle, r["from_high"]), (r["from_low"], middle - 1)):
                    # Windows with their anchor key_low .. key_high bytes after their start share these bytes around it.
                    a, b = max(low, key_low), min(high, key_high)
                    if a > b:
                        continue
                    shift = anchor - b  # where the first of them starts
                    own = text[shift : anchor - a + length]
                    around = text[anchor - key_low : anchor + length - key_high]
                    c = digest(own)
                    rows.append((digest(around + key_low.to_bytes(4, "little") + key_high.to_bytes(4, "little"))[0], *c, own, a, b, key_low, key_high, b, r["c1"], r["c2"], shift))
            names = ["h", "c1", "c2", "chunk", "low", "high", "from_low", "from_high", "at", "o1", "o2", "shift"]
            kinds = [pa.int64()] * 3 + [pa.binary()] + [pa.int32()] * 5 + [pa.int64()] * 2 + [pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True) if rows else [[]] * 12, kinds, strict=True)], names)

    return parts.mapInArrow(run, "h long, c1 long, c2 long, chunk binary, low int, high int, from_low int, from_high int, at int, o1 long, o2 long, shift int")


def _expanded(chunks: DataFrame, length: int) -> DataFrame:
    """(c1, c2, ranges of repeated windows) of chunks (h, c1, c2, chunk, weight) that are dealt and sorted by h."""

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list[tuple]) -> pa.RecordBatch:
            marks = repeated([r[3] for r in rows], np.array([r[4] for r in rows], float), length) if rows else []
            got = [(r[1], r[2], [{"s": s, "e": e} for s, e in mark_ranges(m)]) for r, m in zip(rows, marks, strict=True)]
            got = [g for g in got if g[2]]
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*got, strict=True) if got else [[]] * 3, kinds, strict=True)], ["c1", "c2", "ranges"])

        rows, size = [], 0
        for rb in batches:
            for r in zip(*(rb.column(i).to_pylist() for i in range(5)), strict=True):
                if rows and r[:3] == rows[-1][:3]:  # of a repeated document
                    continue
                if size > BATCH and r[0] != rows[-1][0]:  # an anchor's chunks stay together
                    yield out(rows)
                    rows, size = [], 0
                rows.append(r)
                size += len(r[3])
        yield out(rows)

    return chunks.select("h", "c1", "c2", "chunk", "weight").mapInArrow(run, "c1 long, c2 long, ranges array<struct<s:int,e:int>>")


def repeated_windows(chunks: DataFrame, scratch: Scratch, length: int, gram: int, hot: int = HOT) -> DataFrame:
    """(c1, c2, ranges) of the distinct `chunks` (h, c1, c2, chunk, weight, at)."""
    chunks = chunks.withColumns({"high": F.col("at"), "low": F.col("at") - (F.length("chunk") - length), "from_low": F.lit(0), "from_high": F.lit(length - gram)})
    chunks, level, parents = scratch.table("chunks", chunks), 0, []
    while True:
        size = chunks.groupBy("h").agg(F.sum(F.length("chunk")).alias("size"), F.count("*").alias("k")).where(F.col("size") > hot)
        big = scratch.table(f"big-{level}", size.select("h"))
        any_big = big.limit(1).count() > 0
        small = chunks.join(big, "h", "left_anti") if any_big else chunks
        dealt = small.repartition("h").sortWithinPartitions("h", "c1", "c2")
        results = scratch.table(f"ranges-{level}", _expanded(dealt, length))
        parents.append(results)
        if not any_big:
            break
        parts = chunks.join(big, "h")
        halves = scratch.table(f"halves-{level}", _split(parts.select("h", "c1", "c2", "chunk", "low", "high", "from_low", "from_high", "at"), length))
        weights = parts.select(F.col("c1").alias("o1"), F.col("c2").alias("o2"), "weight")
        chunks = halves.join(weights, ["o1", "o2"]).groupBy("h", "c1", "c2").agg(F.first("chunk").alias("chunk"), F.sum("weight").alias("weight"), *[F.first(x).alias(x) for x in ("low", "high", "from_low", "from_high", "at")])
        lone = chunks.groupBy("h").agg(F.sum("weight").alias("w")).where("w > 1").select("h")
        chunks = scratch.table(f"parts-{level}", chunks.join(lone, "h"))
        parents[-1] = (results, halves.select("c1", "c2", "o1", "o2", "shift"))
        level += 1
    # From the last parts back to the chunks that they came from.
    below = parents[-1]
    for own, halves in reversed(parents[:-1]):
        up = halves.join(below, ["c1", "c2"]).select(F.col("o1").alias("c1"), F.col("o2").alias("c2"), F.transform("ranges", lambda r: F.struct((r["s"] + F.col("shift")).alias("s"), (r["e"] + F.col("shift")).alias("e"))).alias("ranges"))
        below = own.union(up)
    return below


def dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, text: str = "text", key: str = "doc_id", digests: bool = False, hot: int = HOT) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept (or its SHA-256, `digests`) and the removed spans."""
    return _cut(_spanned(docs, length, gram, text, key, hot, []).drop("carried"), digests)


def dedup_texts(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, text: str = "text", key: str = "doc_id", hot: int = HOT, size: str | None = None) -> DataFrame:
    """The rows of `docs` with their texts cut, and `size` set to the new number of characters. A character that
    a span covers in part stays whole."""
    carried = [c for c in docs.columns if c not in (text, size)]

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a, texts, rb in _portions(batches, 0):
            out = [_kept_text(t.as_py(), _joined(rb.column(1)[a + i])) for i, t in enumerate(texts)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), rb.column(2)[a : a + len(out)]], ["text", "carried"])

    spanned = _spanned(docs, length, gram, text, key, hot, carried).select("text", "spans", "carried")
    cut = spanned.mapInArrow(run, f"text string, carried {spanned.schema['carried'].dataType.simpleString()}")
    new = {text: F.col("text"), size: F.length("text").cast(docs.schema[size].dataType) if size else None}
    return cut.select(*[new[c].alias(c) if c in new else F.col(f"carried.`{c}`") for c in docs.columns])


def _spanned(docs: DataFrame, length: int, gram: int, text: str, key: str, hot: int, carried: list[str]) -> DataFrame:
    """(doc_id, text, spans of repeated windows, the carried columns) of every row."""
    scratch = Scratch(docs.sparkSession, "suffixes")
    own = F.struct(*[F.col(f"`{c}`") for c in carried]) if carried else F.lit(None).cast("int")
    every = docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(F.col(text).cast("string")).alias("th"), F.col(text).cast("string").alias("text"), own.alias("carried"))
    rows = every.select("doc_id", "th", "text")
    anchors = scratch.table("anchors", _anchors(rows, length, gram))
    twice = scratch.table("twice", anchors.groupBy("h").agg(F.count("*").alias("k")).where("k > 1").select("h"))  # plain rows: a hot anchor's side of the join can be split
    places = scratch.table("places", anchors.join(twice, "h"))
    scratch.drop("anchors", "twice")
    # One place stands for all with the same chunk: its values are firsts of one row, and only its text is cut out.
    one = places.groupBy("h", "c").agg(F.count("*").alias("weight"), *[F.first(x).alias(x) for x in ("doc_id", "th", "a", "m", "at")])
    listed = one.groupBy(F.col("doc_id").alias("own_id"), F.col("th").alias("own_th")).agg(F.collect_list(F.struct("a", "m", "at", "h", "c", "weight")).alias("listed"))
    same = lambda x: (F.col("doc_id").eqNullSafe(F.col(f"{x}_id"))) & (F.col("th") == F.col(f"{x}_th"))
    chunks = _chunks(rows.join(listed.hint("merge"), same("own")), length)  # a merge join gives repeated documents in a row
    ranges = repeated_windows(chunks, scratch, length, gram, hot)
    spans = places.select(F.col("h").alias("c1"), F.col("c").alias("c2"), "doc_id", "th", "a").join(ranges, ["c1", "c2"])
    spans = spans.select("doc_id", "th", F.explode(F.transform("ranges", lambda r: F.struct((F.col("a") + r["s"]).alias("s"), (F.col("a") + r["e"] + length - 1).alias("e")))).alias("r"))
    spans = spans.groupBy(F.col("doc_id").alias("cut_id"), F.col("th").alias("cut_th")).agg(F.collect_set("r").alias("spans"))
    kept = Scratch(docs.sparkSession, "spans")
    spans = kept.table("spans", spans)
    scratch.drop()
    return every.join(spans, same("cut"), "left").select("doc_id", "text", "spans", "carried")


def _joined(found: pa.ListScalar) -> list[list[int]]:
    """Overlapping and touching spans as one."""
    out: list[list[int]] = []
    if found.is_valid:
        for s, e in sorted(zip(found.values.field("s").to_pylist(), found.values.field("e").to_pylist(), strict=True)):
            if out and s <= out[-1][1]:
                out[-1][1] = max(out[-1][1], e)
            else:
                out.append([s, e])
    return out


def _kept_text(text: str | None, spans: list[list[int]]) -> str | None:
    if not spans:
        return text
    data, out, at = text.encode(), [], 0
    for s, e in spans:
        while s < e and data[s] & 0xC0 == 0x80:  # within a character
            s += 1
        while e > s and e < len(data) and data[e] & 0xC0 == 0x80:
            e -= 1
        out.append(data[at:s])
        at = e
    return b"".join([*out, data[at:]]).decode()


def _cut(rows: DataFrame, digests: bool) -> DataFrame:
    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a, texts, rb in _portions(batches, 1):
            out = []
            for i, t in enumerate(texts):
                data, joined = (t.as_py() or "").encode(), _joined(rb.column(2)[a + i])
                edge = [0, *(x for span in joined for x in span), len(data)]
                kept = b"".join(data[x:y] for x, y in zip(edge[::2], edge[1::2], strict=True))
                last = hashlib.sha256(kept).hexdigest() if digests else kept
                out.append((len(data), len(data) - len(kept), len(joined), last, [{"start": s, "end": e} for s, e in joined]))
            kinds = [pa.int64()] * 3 + [pa.string() if digests else pa.binary(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
            names = ["n_bytes", "n_removed", "n_spans", "kept_sha256" if digests else "kept", "spans"]
            yield pa.RecordBatch.from_arrays([rb.column(0)[a : a + len(out)], *(pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 5, kinds, strict=True))], ["doc_id", *names])

    kept = "kept_sha256 string" if digests else "kept binary"
    return rows.mapInArrow(run, f"doc_id long, n_bytes long, n_removed long, n_spans long, {kept}, spans array<struct<start:long,end:long>>")
