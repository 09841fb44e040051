"""What the operators of this subpackage share: tables, durable cuts of lineage, size-checked joins."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from momentlake.lineage import cut, discard, shared_dir, sweep
from momentlake.session import ship

__all__ = ["SPACE", "broadcast_rows", "cut", "discard", "extended", "release", "scaled", "shared_dir", "ship", "slices", "small_side", "sweep", "table", "utf8", "word_bounds"]

#: Bytes of a side that may be broadcast, as rows of about so many bytes each in a JVM hash relation.
BROADCAST_BYTES = 32_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def broadcast_rows(df: DataFrame) -> int:
    """How many rows of df may be broadcast: a million of two longs, fewer of wider ones."""
    width = {"string": 48, "binary": 64}
    return BROADCAST_BYTES // (16 + sum(8 if kind in ("bigint", "int", "double", "boolean", "smallint", "tinyint", "float") else width.get(kind, 96) for _, kind in df.dtypes))


def small_side(df: DataFrame) -> DataFrame:
    """df with a broadcast hint if it is counted to be small; otherwise as it is, for a shuffled join."""
    bound = broadcast_rows(df)
    return F.broadcast(df) if df.limit(bound + 1).count() <= bound else df


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array and its n+1 offsets into them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(offsets: np.ndarray, most: int = 2_000_000):
    """Row ranges (a, b) of at most `most` bytes each, or one row if that is longer."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        yield a, b
        a = b


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times the power of two that brings their greatest component to about 1, which is exact: squares of tiny or huge
    components are lost otherwise."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, initial=0))[1][:, None])


_libc = None


def release() -> None:
    """Give memory that is free in this Python worker back to the machine: workers are many and live long."""
    global _libc
    if _libc is None:
        try:
            _libc = ctypes.CDLL("libc.so.6")
        except OSError:  # another C library
            _libc = False
    pa.default_memory_pool().release_unused()
    if _libc and hasattr(_libc, "malloc_trim"):
        _libc.malloc_trim(0)


#: Bytes that separate words: the class [\x20\x09-\x0D].
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def word_bounds(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every maximal run of non-space bytes inside each row, and the number of them per row."""
    word = ~SPACE[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True  # a row begins or ends here
    before = np.empty(len(raw), bool)
    if len(raw):
        before[0] = False
        before[1:] = word[:-1]
    starts = np.flatnonzero(word & (~before | edge[:-1]))
    after = np.empty(len(raw), bool)
    if len(raw):
        after[-1] = False
        after[:-1] = word[1:]
    ends = np.flatnonzero(word & (~after | edge[1:])) + 1
    counts = np.diff(np.searchsorted(starts, offsets))
    return starts, ends, counts


def extended(df: DataFrame, **added: str) -> T.StructType:
    """The schema of df with columns added, by name and type."""
    out = T.StructType(list(df.schema.fields))
    for name, kind in added.items():
        out = out.add(name, T.DataType.fromDDL(kind))
    return out
