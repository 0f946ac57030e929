"""Shared helpers: tables in the shared folder, Arrow batches, text hashing.

Words are maximal runs of bytes other than blank, tab, LF, VT, FF and CR;
A-Z count as a-z where an operator says so.  All separators are ASCII, so
working on UTF-8 bytes gives the same words as working on code points.
"""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from ..session import checkpoint_dir

#: the word separators as a character class and its complement (fixed values)
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

#: rows of an Arrow batch for operators that carry whole texts; Spark also
#: closes a batch by bytes, so long texts give smaller batches
TEXT_ROWS_PER_BATCH = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = TEXT_ROWS_PER_BATCH) -> None:
    """Bound the rows of one Arrow batch, so that a task holds few texts at once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def shared(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage: a lost executor does not recompute what came before, and
    every reader sees the same rows.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def released(run):
    """``run`` over batches; at its end the worker's free memory goes back to the system.

    Workers serve many tasks, and what one of them freed would else stay with the process.
    """
    def work(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except AttributeError:  # another C library
            pass
    return work


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the row offsets; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    arr = pc.fill_null(col, "").cast(pa.large_string())
    n = len(arr)
    bufs = arr.buffers()
    if n == 0 or bufs[2] is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    off = np.frombuffer(bufs[1], np.int64, n + 1, arr.offset * 8)
    data = np.frombuffer(bufs[2], np.uint8)[off[0]:off[-1]]
    return data, off - off[0]


def chunks_of(data: np.ndarray, off: np.ndarray, most: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes (one row at least), whole texts only."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_R = 0x9E3779B97F4A7C15
_RINV = pow(_R, -1, 1 << 64)
_IS_WORD = np.ones(256, bool)
_IS_WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective), elementwise."""
    x = np.asarray(x, np.uint64)
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _byte_values(lower: bool) -> np.ndarray:
    values = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(_R))
    if lower:
        values[65:91] = values[97:123]
    return values


_VALUES = {flag: _byte_values(flag) for flag in (False, True)}
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """r^i and r^-i modulo 2^64 for i < n."""
    if not _POWERS or len(_POWERS[0]) < n:
        n = max(n, 2_100_000)
        out = []
        for base in (_R, _RINV):
            p = np.full(n, np.uint64(base))
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _POWERS[:] = out
    return _POWERS[0], _POWERS[1]


class Words:
    """The words of some texts: 64-bit hash, byte span, and first word of each text.

    ``is_word`` tells the bytes of words; without it all but the word separators.
    """

    def __init__(self, data: np.ndarray, off: np.ndarray, lower: bool = True, is_word: np.ndarray = _IS_WORD):
        word = is_word[data]
        n = len(data)
        first = np.zeros(n + 1, bool)
        first[off[:-1]] = True
        start = word.copy()
        start[1:] &= ~word[:-1] | first[1:n]
        end = word.copy()
        end[:-1] &= ~word[1:] | first[1:n]
        self.start = np.flatnonzero(start)
        self.end = np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.start, off)
        up, down = _powers(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_VALUES[lower][data] * up[:n], out=total[1:])
        raw = (total[self.end] - total[self.start]) * down[self.start]
        self.hash = mix(raw + (self.end - self.start).astype(np.uint64))


def shingle_sets(words: Words, n: int) -> Iterator[np.ndarray]:
    """Per text the sorted distinct n-word shingles as 64-bit hashes.

    Fewer than n words: the whole sequence is the one shingle; no words: empty.
    """
    odd = [np.uint64(int(x) | 1) for x in mix(np.arange(11, 11 + n, dtype=np.uint64))]
    h = words.hash
    m = max(0, len(h) - n + 1)
    total = np.zeros(m, np.uint64)
    for j in range(n):
        total += h[j:j + m] * odd[j]
    total = mix(total)
    for a, b in zip(words.first[:-1], words.first[1:]):
        if b - a >= n:
            yield np.unique(total[a:b - n + 1])
        elif b > a:
            part = np.uint64(0)
            for j, x in enumerate(h[a:b]):
                part = part + x * odd[j]
            yield mix(np.array([part + np.uint64(b - a)]))
        else:
            yield np.zeros(0, np.uint64)


def text_sets(col: pa.Array, n: int) -> Iterator[np.ndarray]:
    """``shingle_sets`` of a string column, in pieces of bounded size."""
    data, off = text_bytes(col)
    with np.errstate(over="ignore"):
        for i, j in chunks_of(data, off):
            yield from shingle_sets(Words(data[off[i]:off[j]], off[i:j + 1] - off[i]), n)


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x, np.uint64).view(np.int64)
