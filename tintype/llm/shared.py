"""Small helpers that several of the operators use."""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator
from contextlib import suppress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tintype.functions.scalars import let
from tintype.plans.worktables import drop_table, write_table

__all__ = ["documents", "give_back_memory", "let", "matrices", "maybe_in", "membership_filter", "slices", "words_of"]

#: Characters between words: the space and U+0009 to U+000D.
SPACES = " \t\n\x0b\f\r"
SPACE_RUN = "[ \\t-\\r]+"

#: Bits of a membership filter; its size doesn't depend on the data (8 MB).
FILTER_BITS = 26


def give_back_memory() -> None:
    """Hands freed memory back to the system, which a worker that waits for its next task would keep from other stages."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # a C library without this call
        ctypes.CDLL(None).malloc_trim(0)


def slices(batches: Iterable[pa.RecordBatch], column: int, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in parts whose texts have ``most`` bytes, or of one row, so that what a task holds doesn't grow with a batch."""
    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < len(b):
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
            yield b.slice(at, stop - at)
            at = stop
    give_back_memory()


def words_of(text: Column) -> Column:
    """The words of a text (null: none) as an array."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE_RUN))


def documents(spark, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def membership_filter(keys: DataFrame, key: str = "key", written: bool = False) -> np.ndarray:
    """A bit array of fixed size in which every key's bit is set, so a clear bit proves absence.

    The bits are put together by an aggregation, so at most 2**20 words of 64 bits reach the
    driver, whatever the number of keys. A full filter passes more rows on, but loses none.
    ``written``: they go through a table, so that ``freed_shuffles`` can free the shuffle of the keys.
    """
    word = F.shiftrightunsigned(F.col(key), 64 - FILTER_BITS + 6)
    bit = F.shiftrightunsigned(F.col(key), 64 - FILTER_BITS).bitwiseAND(F.lit(63)).cast("int")
    found = keys.groupBy(word.alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("bits"))
    if written:
        found = write_table(found, "filter")
    table = found.toArrow()
    if written:
        drop_table(found)
    bits = np.zeros(1 << (FILTER_BITS - 6), dtype=np.uint64)
    bits[table.column("w").to_numpy()] = table.column("bits").to_numpy().view(np.uint64)
    return bits


def maybe_in(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether each key's bit is set; ``keys`` are 64-bit hashes."""
    top = keys.view(np.uint64) >> np.uint64(64 - FILTER_BITS)
    return (bits[(top >> np.uint64(6)).view(np.int64)] >> (top & np.uint64(63))) & np.uint64(1) != 0


def matrices(vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix of doubles) of a list column without nulls, for each length that occurs."""
    lengths = pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
    values = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.cumsum(lengths) - lengths
    for n in np.unique(lengths):
        rows = np.flatnonzero(lengths == n)
        yield rows, values[starts[rows][:, None] + np.arange(n)[None, :]]
