"""Words of many texts at a time, as arrays: where they are, and a hash of each from its bytes."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Bytes of text that are worked on together; a longer text, or word, counts whole.
CHUNK = 1 << 18
#: Factor of the polynomial over a word's bytes, and what mixes its value; any odd numbers would do.
BYTE_FACTOR, BYTE_MIXER = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


#: Rows and bytes that reach a Python worker at a time at most, so that long texts don't come by the ten thousand.
BATCH_ROWS, BATCH_BYTES = 4_000, 16 << 20


def map_batches(rows: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow in small batches; a task gives the memory that it no longer needs back to the system, as workers outlive it."""
    conf = rows.sparkSession.conf
    for key, value in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        conf.set(f"spark.sql.execution.arrow.{key}", value)

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from function(batches)
        finally:
            pa.default_memory_pool().release_unused()
            _trim()

    return rows.mapInArrow(tidy, schema)


def _trim() -> None:
    """Hands freed memory back where the C library can."""
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


class Powers:
    """Powers of an odd factor and of its inverse modulo 2^64, as far as texts have needed them."""

    def __init__(self, factor: int) -> None:
        self.steps = (factor, pow(factor, -1, 1 << 64))
        self.tables = [np.ones(1, np.uint64) for _ in self.steps]

    def upto(self, n: int) -> list[np.ndarray]:
        """Both tables with n entries at least."""
        if len(self.tables[0]) < n:
            size = 1 << (n - 1).bit_length()
            self.tables = [np.multiply.accumulate(np.append(np.ones(1, np.uint64), np.full(size - 1, step, np.uint64))) for step in self.steps]
        return self.tables

    def sums(self, values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Polynomials of the values from each lo to hi: differences of a running one, shifted to its start."""
        up, down = self.upto(len(values) + 1)
        total = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * up[: len(values)], out=total[1:])
        return (total[hi] - total[lo]) * down[lo]


_BYTES = Powers(BYTE_FACTOR)


def together(texts: Iterable[bytes]) -> Iterator[list[bytes]]:
    """Texts in lists of about CHUNK bytes; a longer one is by itself."""
    some, size = [], 0
    for text in texts:
        if some and size + len(text) > CHUNK:
            yield some
            some, size = [], 0
        some.append(text)
        size += len(text)
    if some:
        yield some


def places(blank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the runs of bytes that are not blank begin and end."""
    edges = np.flatnonzero(np.diff(np.concatenate([[True], blank, [True]]).view(np.int8)))
    return edges[::2], edges[1::2]


def hashes(raw: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """63 bits for each word, from its bytes alone."""
    out, k = [np.zeros(0, np.uint64)], 0
    while k < len(begins):
        stop = max(k + 1, int(np.searchsorted(ends, begins[k] + CHUNK)))
        at = begins[k]
        out.append(_BYTES.sums(raw[at : ends[stop - 1]].astype(np.uint64), begins[k:stop] - at, ends[k:stop] - at))
        k = stop
    h = np.concatenate(out)
    h ^= h >> np.uint64(31)
    return (h * np.uint64(BYTE_MIXER) >> np.uint64(1)).view(np.int64)


def bounds(texts: list[bytes], begins: np.ndarray) -> np.ndarray:
    """First word of each of the texts, joined by one byte, and the number of words."""
    return np.searchsorted(begins, np.cumsum([0, *(len(t) + 1 for t in texts)]))
