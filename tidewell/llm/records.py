"""Token ids as length-delimited binary records with a separate offset index.

A data file is a run of frames: length (u64), masked crc32 of those eight bytes (u32), payload, masked
crc32 of the payload (u32), all little-endian. A payload is the key (i64), a byte for a null key, the number
of ids (u32) and the ids (u16 where the vocabulary fits, else u32; the width is in the index). The mask is
rotate-right by 15 plus 0xa282ead8, so that a checksum stored beside checksummed bytes isn't itself a
checksum of them. The index has a header and, for each record, its byte offset and the number of ids before
it (u64 each), so records can be read in any order and each knows its place in the corpus.

Files hold ascending keys: rows are dealt by key range, so file n ends before file n + 1 begins. A task
writes under a name of its own attempt and reports it; only reported files enter the manifest, which has one
row per file, so a lost executor or a second attempt leaves nothing that is read.

Cases: a null or empty text is a record with only the end id; null keys come first; repeated keys are
records of their own, ordered by a hash of the text; an empty table gives no records; extra columns are ignored; a long
text is one record. A wrong checksum raises ValueError.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, bounds, ended, storage, trimmed
from .wordcache import encoder

MAGIC, SLICE = b"TWREC1\0\0", 4096
MANIFEST = "part long, file string, records long, ids long, bytes long"


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return (((c >> 15) | (c << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    head = struct.pack("<Q", len(payload))
    return b"".join((head, struct.pack("<I", masked(head)), payload, struct.pack("<I", masked(payload))))


def unframe(data: bytes, at: int = 0) -> tuple[bytes, int]:
    """The payload at `at` and where the next frame begins."""
    head = data[at : at + 8]
    (n,), (crc,) = struct.unpack("<Q", head), struct.unpack_from("<I", data, at + 8)
    payload = data[at + 12 : at + 12 + n]
    if crc != masked(head) or len(payload) != n or struct.unpack_from("<I", data, at + 12 + n)[0] != masked(payload):
        raise ValueError(f"damaged record at byte {at}")
    return payload, at + 16 + n


def record(key, ids: np.ndarray) -> bytes:
    """A payload; `ids` are in the file's width."""
    return struct.pack("<qBI", key or 0, key is None, len(ids)) + ids.tobytes()


def unrecord(payload: bytes, width: int) -> tuple[int | None, np.ndarray]:
    key, null, n = struct.unpack_from("<qBI", payload)
    return None if null else key, np.frombuffer(payload, f"<u{width}", n, 13)


def write(docs: DataFrame, to: str, vocabulary: str, end_id: int = 2, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Writes `docs` in ascending `key` order under the folder `to`, which all executors see; the manifest."""

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, root = storage(to)
        where.create_dir(root, recursive=True)
        part, name = TaskContext.get().partitionId(), f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
        offsets, firsts, at, total = [], [], 0, 0
        enc = encoder(vocabulary)
        width = 2 if max(enc.tokenizer.get_vocab_size(), end_id + 1) <= 65536 else 4
        with where.open_output_stream(f"{root}/{name}.rec") as out:
            for rb in batches:
                keys = rb.column(0).to_pylist()
                for a, b, ids, edge in enc.encode(rb.column(1)):
                    ids, edge = ended(ids, edge, end_id)
                    ids, edge = ids.astype(f"<u{width}"), edge.tolist()
                    frames = [frame(record(k, ids[x:y])) for k, x, y in zip(keys[a:b], edge, edge[1:], strict=False)]
                    out.write(b"".join(frames))
                    offsets.append(at + bounds(list(map(len, frames))))
                    firsts.append(total + np.array(edge, np.int64))
                    at, total = int(offsets[-1][-1]), total + edge[-1]
        with where.open_output_stream(f"{root}/{name}.idx") as out:
            index = np.array([np.concatenate([x[:-1] for x in y]) if y else [] for y in (offsets, firsts)], "<u8").T
            out.write(MAGIC + struct.pack("<QQQQ", width, len(index), at, total))
            out.write(index.tobytes())
        yield pa.RecordBatch.from_pydict({"part": [part], "file": [name], "records": [len(index)], "ids": [total], "bytes": [at]})

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), F.xxhash64(text).alias("h"))
    return rows.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h").mapInArrow(run, MANIFEST)


def read(spark: SparkSession, at: str, manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """One row per record of the manifest's files: key, ids before it in all files, how many it has, their crc32 (and the ids).

    The manifest has a row per file, so its running sum in one task grows with the files, not with the records; the
    slices of `SLICE` records that tasks read are made from it by Spark."""
    before = F.coalesce(F.sum("ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = manifest.select("file", "records", before.alias("before")).where("records > 0")
    parts = files.agg(F.sum(F.ceil(F.col("records") / SLICE))).first()[0] or 1  # one number
    splits = files.withColumn("a", F.explode(F.expr(f"sequence(0L, records - 1, {SLICE}L)")))
    splits = splits.select("file", "a", F.least(F.col("a") + SLICE, "records").alias("b"), "before")
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, root = storage(at)
        for rb in batches:
            for s in rb.to_pylist():
                with where.open_input_file(f"{root}/{s['file']}.idx") as f:
                    head = f.read(40)
                    width, n, size, _ = struct.unpack("<QQQQ", head[8:])
                    if head[:8] != MAGIC:
                        raise ValueError(f"{s['file']}.idx is not an index")
                    f.seek(40 + 16 * s["a"])
                    index = np.frombuffer(f.read(16 * (min(s["b"] + 1, n) - s["a"])), "<u8").reshape(-1, 2)
                end = int(index[s["b"] - s["a"], 0]) if s["b"] < n else size
                with where.open_input_file(f"{root}/{s['file']}.rec") as f:
                    base, place = int(index[0, 0]), 0
                    f.seek(base)
                    data, rows = f.read(end - base), []
                for i in range(s["b"] - s["a"]):
                    payload, place = unframe(data, place)
                    key, ids = unrecord(payload, width)
                    rows.append((key, s["before"] + int(index[i, 1]), len(ids), zlib.crc32(ids.astype("<u4").tobytes()), *([ids.tolist()] if with_ids else [])))
                names = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.list_(pa.int64()) if x == "ids" else pa.int64()) for x, c in zip(names, zip(*rows, strict=True), strict=True)], names)

    return splits.repartition(min(int(parts), 20_000), F.xxhash64("file", "a")).mapInArrow(run, schema)


def write_and_read(docs: DataFrame, vocabulary: str, end_id: int = 2, with_ids: bool = False) -> DataFrame:
    """Writes the documents to a folder of the shared one, then reads every record back."""
    scratch = Scratch(docs.sparkSession, "records")
    root = f"{scratch.root}/files"
    return read(docs.sparkSession, root, scratch.table("manifest", write(docs, root, vocabulary, end_id)), with_ids)
