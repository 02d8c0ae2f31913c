"""What several operators of this subpackage share: column handling and filters of bounded size."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall.storage import ship


def documents(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text and a key of the text; other columns, whatever their names, are left out unless named in more."""
    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64(F.col("text")).alias("text_key"), *more)


def i64(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64), pa.int64())


def binaries(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A binary column of slices of raw."""
    from rollcall.llm.codes import ragged

    counts = ends - starts
    offsets = np.zeros(len(counts) + 1, dtype=np.int64)
    np.cumsum(counts, out=offsets[1:])
    data = np.ascontiguousarray(raw[ragged(starts, counts)])
    return pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).cast(pa.binary())


def rebatched(batches: Iterator[pa.RecordBatch], rows: int = 2000) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most `rows` rows, whatever the session's settings are, so that workers fit beside a modest heap."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


@functools.cache
def _malloc_trim():
    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def trim() -> None:
    """Give memory that is free in this worker back to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    if give := _malloc_trim():
        give(0)


def fetched(df: DataFrame) -> list[np.ndarray]:
    """The columns, long or double, of a result whose size is bounded, on the driver; Arrow's copies are let go at once."""
    table = df.toArrow()
    out = [np.concatenate([np.asarray(c) for c in column.chunks]) if column.num_chunks else np.zeros(0, np.int64) for column in table.columns]
    del table
    pa.default_memory_pool().release_unused()
    return out


#: log2 of the bits of the largest filter: 16 MB. Some 11 million keys have twelve bits each in it; beyond that it lets
#: more and more through, which costs shuffle but no results.
MOST_BITS = 27


def filter_size(n: int) -> int:
    """log2 of a filter's bits: at least twelve bits a key, within what may be broadcast."""
    return min(MOST_BITS, max(16, (12 * n).bit_length()))


def bits_of(keys: DataFrame, column: str, log2_bits: int | None = None) -> np.ndarray:
    """A Bloom filter with two probes over a long column, of 2 ** log2_bits bits or as many as the count of keys asks for.

    Its size is bounded whatever the input, so it may be broadcast; when it fills up it only lets more rows through.
    """
    log2_bits = log2_bits or filter_size(keys.count())
    mask = (1 << log2_bits) - 1
    probes = F.explode(F.array(F.col(column).bitwiseAND(F.lit(mask)), F.shiftrightunsigned(F.col(column), 32).bitwiseAND(F.lit(mask)))).alias("p")
    words = keys.select(probes).groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("b"))
    w, b = fetched(words.select(F.col("w").cast("long"), "b"))
    out = np.zeros(1 << (log2_bits - 6), dtype=np.uint64)
    out[w] = b.view(np.uint64)
    return out


def may_hold(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of the keys (uint64) the filter may hold."""
    mask = np.uint64(len(bits) * 64 - 1)
    hit = np.ones(len(keys), dtype=bool)
    for p in (keys & mask, (keys >> np.uint64(32)) & mask):
        hit &= (bits[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63))) & np.uint64(1) == 1
    return hit


def same(left: DataFrame, right: DataFrame, *names: str) -> Column:
    """Join condition that matches nulls with nulls."""
    out = F.lit(True)
    for name in names:
        out = out & left[name].eqNullSafe(right[name])
    return out
