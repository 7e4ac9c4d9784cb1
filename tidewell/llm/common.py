"""Shared helpers: whole-text portions of batches for Arrow workers and tables in the shared folder."""

from __future__ import annotations

import ctypes
import functools
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs

from tidewell.sources.shared import Scratch, scope  # noqa: F401

#: Characters of text handled at once inside one Arrow batch; bounds the arrays a worker holds.
SLAB_CHARS = 2_000_000

#: Bytes of text whose distinct words are looked up together.
PORTION_BYTES = 10_000_000


def portions(texts: pa.Array, limit: int = PORTION_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """(first, texts) for runs of whole texts with about `limit` bytes each; one longer text stands alone."""
    sizes, a = bounds(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False)), 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(sizes, sizes[a] + limit, "right")) - 1)
        yield a, texts[a:b]
        a = b


def storage(where: str) -> tuple[fs.FileSystem, str]:
    """The file system and the path in it of a folder given as a URI, as file:/x too, or as a local path."""
    where = re.sub("^file:/+", "/", where)
    return (fs.LocalFileSystem(), where) if where.startswith("/") else fs.FileSystem.from_uri(where)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions starts[i] .. starts[i] + lengths[i] - 1 of every i, one after another."""
    lengths = lengths.astype(np.int64, copy=False)
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total, dtype=np.int64)


def bounds(lengths) -> np.ndarray:
    """0 and the running sums of `lengths`."""
    out = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=out[1:])
    return out


def ended(ids: np.ndarray, at: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, boundaries) of texts with `end_id` after each."""
    return np.insert(ids, at[1:], end_id), at + np.arange(len(at))


def release() -> None:
    """Gives memory that Arrow and the C library hold for later back to the machine."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A worker's function that releases memory after every batch it gives: workers stay between tasks and stages."""

    @functools.wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in run(batches):
            yield out
            del out
            release()

    return wrapped
