"""Words, hashes and small frame helpers the operators share."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loglode.session import cut_lineage

CHUNK_BYTES = 1 << 20
ARROW_BATCH = "8m"
LAST_ID = (1 << 63) - 1

_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_RANDOM = np.random.Generator(np.random.PCG64(20260101))
_BYTE_VALUES = _RANDOM.integers(0, 1 << 64, 256, np.uint64)
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def stored(df: DataFrame) -> DataFrame:
    """The rows from the shared checkpoint folder, computed once."""
    return cut_lineage(df)


def map_arrow(df: DataFrame, run: Callable, schema: str | StructType) -> DataFrame:
    """mapInArrow with batches small enough for texts of any length, unless the session sets their size."""
    conf = df.sparkSession.conf
    if conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BATCH)
    return df.mapInArrow(_giving_back(run), schema)


def give_back() -> None:
    """Hand what this worker has freed back to the system.

    Workers live on between tasks and stages, and Spark uses the idle ones by turns: without this each of them keeps
    the most that any task ever took, and an executor holds the sum.
    """
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def _giving_back(run: Callable) -> Callable:
    def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return of_task


def written(df: DataFrame) -> DataFrame:
    """The rows written as Parquet to the shared checkpoint folder and read again."""
    spark = df.sparkSession
    cut_lineage(spark.range(1))  # sets the folder where none is set
    path = f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    return spark.read.parquet(path)


def plain(df: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns, however many others (of whatever name) the table has."""
    return df.select(*[F.col(f"`{c}`") for c in columns])


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches holding about `limit` bytes of the column, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = offsets(batch.column(column))[1:].astype(np.int64)
        at, base = 0, 0
        while at < batch.num_rows:
            upto = max(at + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield batch.slice(at, upto - at)
            base, at = int(ends[upto - 1]), upto


def offsets(column: pa.Array) -> np.ndarray:
    """Byte offsets of the values, the first at 0."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    if not len(column):
        return np.zeros(1, np.int64)
    raw = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1]
    return raw.astype(np.int64) - int(raw[0])


def raw_bytes(column: pa.Array) -> np.ndarray:
    """The UTF-8 bytes of all values, end to end."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    data = column.buffers()[2]
    if data is None or not len(column):
        return np.zeros(0, np.uint8)
    raw = np.frombuffer(column.buffers()[1], kind)
    return np.frombuffer(data, np.uint8)[raw[column.offset] : raw[column.offset + len(column)]]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread all bits of 64-bit values (a bijection)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_POWERS = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """The first n powers of the hash factor."""
    global _POWERS
    if len(_POWERS) < n:
        p = np.full(max(n, 1024), _FACTOR, np.uint64)
        p[0] = 1
        _POWERS = np.multiply.accumulate(p)
    return _POWERS[:n]


class Words(NamedTuple):
    """The words of several texts, in order."""

    hashes: np.ndarray  # of each word
    first: np.ndarray  # first word of each text, and the number of all
    starts: np.ndarray  # byte at which each word starts
    ends: np.ndarray

    @property
    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def words(column: pa.Array, lower: bool = False) -> Words:
    """Split texts at space and \\t to \\r; a null text has no words. With `lower`, A-Z count as a-z."""
    data, bounds = raw_bytes(column), offsets(column)
    if not len(data):
        none = np.zeros(0, np.int64)
        return Words(none.astype(np.uint64), np.zeros(len(column) + 1, np.int64), none, none)
    gap = _SEPARATOR[data]
    fresh = np.empty(len(data), bool)
    fresh[0], fresh[1:] = True, gap[:-1]
    inner = bounds[:-1][bounds[:-1] < len(data)]
    fresh[inner] = True
    starts = np.flatnonzero(~gap & fresh)
    last = np.empty(len(data), bool)
    last[-1], last[:-1] = True, gap[1:]
    last[inner[inner > 0] - 1] = True
    ends = np.flatnonzero(~gap & last) + 1
    first = np.searchsorted(starts, bounds)
    kept = np.flatnonzero(~gap)
    sizes = ends - starts
    head = np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(sizes) else np.zeros(0, np.int64)
    within = np.arange(len(kept), dtype=np.int32) - np.repeat(head.astype(np.int32), sizes)
    symbols = data[kept]
    values = _BYTE_VALUES[_LOWER[symbols] if lower else symbols]
    values *= powers(int(sizes.max()) if len(sizes) else 1)[within]
    hashes = np.add.reduceat(values, head) if len(head) else np.zeros(0, np.uint64)
    return Words(mix(hashes + sizes.astype(np.uint64) * _FACTOR), first, starts, ends)


def gram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of n values (of all texts end to end: the caller picks the runs inside one text)."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    upto = len(hashes) - n + 1
    out = hashes[:upto].copy()
    for k in range(1, n):
        out *= _FACTOR
        out += hashes[k : k + upto]
    return mix(out + np.uint64(n))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def runs_to_offsets(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
