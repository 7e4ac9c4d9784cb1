"""Packing by Karmarkar-Karp multiway differencing.

Each document becomes its token ids and an end id. Full windows are cut off first; what is left is cut
into near-equal parts of at most `PART` and a small one, and batches of about `BATCH_WINDOWS` windows of such parts are
partitioned by differencing: partial partitions start as one part beside empty windows, the two with the
largest imbalance are merged with opposing order (largest load on smallest), until one is left. Where a
window exceeds the capacity, the batch is partitioned again with one window more.

Everything happens inside the scan's partitions: no shuffle, and memory is bounded by one Arrow batch
and one batch of parts. A retried task gives the same sequences, as their ids hold the partition's number.

Cases: a null or empty text is one piece with only the end id; an empty table gives no rows; repeated
rows and null doc_ids are packed as documents of their own; extra columns are ignored; a very long text
is cut into as many windows as it needs. Sequences are padded to `capacity`, so one whose length is the
capacity (or any power of two, which readers keep as it is) has no padding.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ended, trimmed
from .wordcache import encoder

PART, SMALL, BATCH_WINDOWS = 512, 64, 128


def differencing(sizes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(window of each part, load of each window) for `k` windows."""
    n = len(sizes)
    parent = np.full(2 * n, -1, np.int64)
    made, heap = n, []
    for i, size in enumerate(sizes.tolist()):
        loads, nodes = np.zeros(k, np.int64), np.full(k, -1, np.int64)
        loads[0], nodes[0] = size, i
        heap.append((-(size if k > 1 else 0), i, loads, nodes))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, tie, a_loads, a = heapq.heappop(heap)
        _, _, b_loads, b = heapq.heappop(heap)
        loads, b = a_loads + b_loads[::-1], b[::-1]
        nodes, both = np.maximum(a, b), np.flatnonzero((a >= 0) & (b >= 0))
        new = np.arange(made, made + len(both))
        parent[a[both]] = parent[b[both]] = nodes[both] = new
        made += len(both)
        order = np.argsort(-loads, kind="stable")
        loads, nodes = loads[order], nodes[order]
        heapq.heappush(heap, (-int(loads[0] - loads[-1]), tie, loads, nodes))
    _, _, loads, nodes = heap[0]
    window = np.full(made, -1, np.int64)
    window[nodes[nodes >= 0]] = np.flatnonzero(nodes >= 0)
    for x in range(made - 1, -1, -1):
        if parent[x] >= 0:
            window[x] = window[parent[x]]
    return window[:n], loads


def balanced(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The window of each part; as few windows as differencing fills without exceeding `capacity`."""
    k = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        window, loads = differencing(sizes, k)
        if loads.max(initial=0) <= capacity:
            return window
        k += 1


def cut(sizes: np.ndarray, capacity: int, part: int = PART) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, length) of all pieces of documents with `sizes` ids: full windows, near-equal parts of the rest, and
    a small last part of 1 to `SMALL` ids off a rest that isn't small itself. Small parts of all sizes let the last merges even out."""
    full, rest = np.divmod(sizes, capacity)
    last = np.where(rest > 4 * SMALL, 1 + rest % SMALL, 0)
    body = rest - last
    m = -(-body // min(part, capacity))
    count = full + m + (last > 0)
    doc = np.repeat(np.arange(len(sizes)), count)
    k = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count + full, count)  # the place after the full windows

    def edge(k: np.ndarray) -> np.ndarray:
        return full[doc] * capacity + np.where(k < 0, k * capacity, np.where(k > m[doc], rest[doc], body[doc] * k // np.maximum(m[doc], 1)))

    start = edge(k)
    return doc, start, edge(k + 1) - start


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_length long"


class _Packer:
    """Packs pieces (doc_id, start, length, ids_crc32, doc_tokens and ids, if wanted) as they come; those of a batch wait."""

    def __init__(self, capacity: int, end_id: int, with_ids: bool):
        self.capacity, self.end_id, self.with_ids, self.waiting = capacity, end_id, with_ids, None
        self.next = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40

    def pieces(self, keys: pa.Array, ids: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
        ids, at = ended(ids, at, self.end_id)
        sizes = np.diff(at)
        doc, start, length = cut(sizes, self.capacity)
        low = at[doc] + start
        data = memoryview(ids.astype("<u4")).cast("B")
        crc = np.fromiter((zlib.crc32(data[a:b]) for a, b in zip((4 * low).tolist(), (4 * (low + length)).tolist(), strict=True)), np.int64, len(doc))
        columns = [keys.take(pa.array(doc)), *map(pa.array, (start, length, crc, sizes[doc]))]
        if self.with_ids:  # pieces stand one after another in the documents' ids
            columns.append(pa.LargeListArray.from_arrays(pa.array(np.append(low, at[-1])), pa.array(ids.astype(np.int64))).cast(pa.list_(pa.int64())))
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"][: len(columns)])

    def placed(self, pieces: pa.RecordBatch, sequence: np.ndarray, offset: np.ndarray, total: np.ndarray) -> pa.RecordBatch:
        columns = [*pieces.columns[:5], pa.array(sequence), pa.array(offset), pa.array(total), *pieces.columns[5:]]
        return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in SCHEMA.split(", ")] + ["ids"] * self.with_ids)

    def add(self, keys: pa.Array, ids: np.ndarray, at: np.ndarray) -> Iterator[pa.RecordBatch]:
        found = self.pieces(keys, ids, at)
        whole = found["length"].to_numpy() == self.capacity
        if whole.any():
            alone = found.filter(pa.array(whole))
            n = alone.num_rows
            yield self.placed(alone, self.next + np.arange(n), np.zeros(n, np.int64), np.full(n, self.capacity))
            self.next += n
        rests = found.filter(pa.array(~whole))
        self.waiting = pa.concat_batches([self.waiting, rests]) if self.waiting else rests
        while (tokens := np.cumsum(self.waiting["length"].to_numpy())).size and tokens[-1] > BATCH_WINDOWS * self.capacity:
            # a little less than the windows hold
            yield self.flush(int(np.searchsorted(tokens, BATCH_WINDOWS * (self.capacity - self.capacity // 512), "right")))

    def flush(self, n: int) -> pa.RecordBatch:
        """Packs the first `n` waiting pieces."""
        pieces, self.waiting = self.waiting[:n], self.waiting[n:]
        sizes = pieces["length"].to_numpy()
        window = balanced(sizes, self.capacity)
        total = np.bincount(window, sizes).astype(np.int64)
        number = self.next + np.cumsum(total > 0) - 1  # windows without parts get no number
        order = np.argsort(window, kind="stable")
        ends = np.cumsum(sizes[order])
        offset = np.empty(n, np.int64)
        offset[order] = ends - sizes[order] - (np.cumsum(total) - total)[window[order]]
        self.next += int((total > 0).sum())
        return self.placed(pieces, number[window], offset, total[window])


def pack(docs: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 1, with_ids: bool = False, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per piece: its place in its document and in its sequence (and its ids, `with_ids`)."""

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = _Packer(capacity, end_id, with_ids)
        for rb in batches:
            for a, b, ids, at in encoder(vocabulary).encode(rb.column(1)):
                yield from packer.add(rb.column(0)[a:b], ids, at)
        if packer.waiting:
            yield packer.flush(packer.waiting.num_rows)

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, SCHEMA + (", ids array<long>" if with_ids else ""))
