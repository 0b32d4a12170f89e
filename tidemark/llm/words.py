"""Words, their hashes and word n-grams of whole batches of texts, in numpy.

A word is a run of bytes other than 0x20 and 0x09-0x0D. Hashes are polynomials modulo 2**64 over
random 64-bit byte values, followed by a mixing step; they depend only on the word's bytes.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
BLOCK_BYTES = 1 << 18
BATCH_ROWS, BATCH_BYTES = 2000, 4 << 20

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = _BYTE.copy()
_LOWER[65:91] = _BYTE[97:123]
_ROOT = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int, root: int = _ROOT) -> tuple[np.ndarray, np.ndarray]:
    """root**i and its inverse modulo 2**64, for i below n at least."""
    have = _powers.get(root)
    if have is None or len(have[0]) < n:
        size = max(n, BLOCK_BYTES) + 1
        base = np.array([root, pow(root, -1, 1 << 64)], np.uint64)
        both = []
        for b in base:
            p = np.ones(size, np.uint64)
            p[1:] = b
            both.append(np.multiply.accumulate(p))
        have = (both[0], both[1])
        if n <= BLOCK_BYTES:  # those of a longer text go with it
            _powers[root] = have
    return have


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and where each row's begin (one more entry at the end); null is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    raw = column.buffers()[2]
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.empty(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def blocks(off: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about the limit in bytes; a longer row is alone."""
    a, n = 0, len(off) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + limit, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


class Words:
    """The words of some rows: start and end byte of each, and first word of each row (one more at the end)."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        self.data, self.off = data, off
        n = len(data)
        space = SPACE[data]
        edge = np.ones(n + 1, bool)
        edge[1:n] = space[:-1] if n else edge[1:n]
        edge[off[off < n]] = True
        self.starts = np.flatnonzero(~space & edge[:n])
        edge[:n] = space
        edge[off[off < n]] = True
        after = np.ones(n, bool)
        after[: n - 1] = edge[1:n]
        self.ends = np.flatnonzero(~space & after) + 1
        self.first = np.searchsorted(self.starts, off)

    def hashes(self, lower: bool = False) -> np.ndarray:
        n = len(self.data)
        if not n:
            return np.empty(0, np.uint64)
        up, down = powers(n)
        total = np.empty(n + 1, np.uint64)
        total[0] = 0
        np.cumsum((_LOWER if lower else _BYTE)[self.data] * up[:n], out=total[1:])
        return mix((total[self.ends] - total[self.starts]) * down[self.starts] + (self.ends - self.starts).astype(np.uint64))


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive words: entry i for words i to i + k - 1 (rows are not told apart)."""
    n = len(hashes)
    if n < k:
        return np.empty(0, np.uint64)
    root = 0xD1342543DE82EF95
    up, down = powers(n, root)
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum(hashes * up[:n], out=total[1:])
    return mix((total[k:] - total[:-k]) * down[: n - k + 1] + np.uint64(k))


def parts(batch: pa.RecordBatch, text: str = "text") -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges of a batch with the bytes and offsets of their texts."""
    data, off = utf8(batch.column(batch.schema.get_field_index(text)))
    for a, b in blocks(off):
        yield a, b, data[off[a] : off[b]], off[a : b + 1] - off[a]


def give_back() -> None:
    """Return freed memory to the system, numpy's too where the C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow over batches of at most BATCH_ROWS rows and about BATCH_BYTES bytes; a longer row is alone.

    Sets the session's Arrow batch sizes, so that what a worker holds depends on its longest text and
    not on how many rows Spark would hand it at once. Memory that a partition no longer needs goes
    back to the system at its end, as workers are used again.
    """
    conf = df.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return df.mapInArrow(bounded, schema)
