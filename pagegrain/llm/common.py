"""Shared helpers: folds, Arrow slices, and words of a whole batch as numpy arrays.

A word is ``[^\\x20\\x09-\\x0D]+``. These bytes never occur inside a multi-byte UTF-8
character, so words are cut on the bytes of an Arrow column without decoding it.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from contextlib import contextmanager
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
SLICE_BYTES = 1 << 20
_MUL = np.uint64(0x9E3779B97F4A7C15)


def fold(doc_id: str | Column, mod: int) -> Column:
    """``crc32(doc_id as text) mod n``; a null id counts as the empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % mod


def held_out(doc_id: str | Column, mod: int, rest: int = 2) -> Column:
    return fold(doc_id, mod) == rest


def load(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Only the two columns that operators read, under fixed names."""
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))


def packed(docs: DataFrame) -> DataFrame:
    """doc_id, text, ``absent`` (null text) and the caller's other columns as one struct, so that no working column meets their names."""
    row = F.struct(F.lit(0).alias("-"), *(docs[f"`{c}`"] for c in docs.columns if c != "text"))
    return docs.select(F.col("doc_id"), F.col("text"), F.col("text").isNull().alias("absent"), row.alias("row"))


def unpacked(d: DataFrame, columns: list[str]) -> DataFrame:
    """The caller's columns back; a text that was null is null."""
    text = F.when(~F.col("absent"), F.col("text"))
    return d.select(*((text if c == "text" else F.col("row").getField(c)).alias(c) for c in columns))


BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_ROWS = 1000


@contextmanager
def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> Iterator[None]:
    """Whole texts reach Python at most ``rows`` at a time in the jobs run inside; the session's own setting comes back."""
    was = spark.conf.get(BATCH)
    if 0 < int(was) <= rows:
        yield
        return
    spark.conf.set(BATCH, rows)
    try:
        yield
    finally:
        spark.conf.set(BATCH, was)


def give_back() -> None:
    """Return freed memory to the system at the end of a task: workers are used again, beside those of other tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def keep_freed() -> None:
    """Let arrays of a task take the memory of earlier ones, until ``give_back``, instead of new pages from the system each time."""
    set_limit = getattr(ctypes.CDLL(None), "mallopt", None)  # glibc only
    if set_limit:
        set_limit(-3, 32 << 20)  # M_MMAP_THRESHOLD
        set_limit(-1, 128 << 20)  # M_TRIM_THRESHOLD


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result depends on every bit of ``x``."""
    with np.errstate(over="ignore"):
        x = np.asarray(x, np.uint64) + np.uint64((seed * 0xD1B54A32D192ED03 + 0x632BE59BD9B4E019) % 2**64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(256, dtype=np.uint64), 77)
_POW = np.ones(1024, np.uint64)
with np.errstate(over="ignore"):
    _POW[1:] = np.cumprod(np.full(1023, _MUL))


def powers(n: int) -> np.ndarray:
    global _POW
    if n > len(_POW):
        with np.errstate(over="ignore"):
            _POW = np.concatenate([[np.uint64(1)], np.cumprod(np.full(2 * n, _MUL))])
    return _POW


class Texts(NamedTuple):
    """Consecutive rows: their UTF-8 bytes, and where each row begins (one more than rows)."""

    data: np.ndarray
    ends: np.ndarray
    first: int
    rows: int


def texts(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[Texts]:
    """Slices of at most ``most`` bytes (a longer row is a slice by itself); null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()) if column.type != pa.large_string() else column
    column = column.fill_null("") if column.null_count else column
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + most, "right")) - 1)
        yield Texts(raw[ends[at] : ends[to]], ends[at : to + 1] - ends[at], at, to - at)
        at = to


class Words(NamedTuple):
    """Words of a slice: byte range, hash, row, and the first word of each row (rows + 1)."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    row: np.ndarray
    first: np.ndarray


PLAIN = np.arange(256, dtype=np.uint8)
PLAIN[[c for c in range(33, 127) if not chr(c).isalnum()]] = 0x20
PLAIN[0x41:0x5B] += 32


def plainly(t: Texts) -> Texts:
    """ASCII letters in lower case and ASCII punctuation as white space, byte for byte."""
    return t._replace(data=PLAIN[t.data])


def spans(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte ranges of the words and the first word of each row."""
    solid = np.ones(len(t.data) + 2, bool)
    solid[[0, -1]] = False
    solid[1:-1] = ~SPACE[t.data]
    edge = solid[1:] != solid[:-1]
    start = np.flatnonzero(edge & solid[1:])
    end = np.flatnonzero(edge & solid[:-1])
    cut = t.ends[1:-1]
    cut = np.unique(cut[(cut > 0) & (cut < len(t.data))])
    cut = cut[solid[cut] & solid[cut + 1]]  # a word runs over the end of its row
    if len(cut):
        start, end = np.sort(np.concatenate([start, cut])), np.sort(np.concatenate([end, cut]))
    return start, end, np.searchsorted(start, t.ends)


def words(t: Texts) -> Words:
    start, end, first = spans(t)
    row = np.repeat(np.arange(t.rows, dtype=np.int32), np.diff(first))
    if not len(start):
        return Words(start, end, np.zeros(0, np.uint64), row, first)
    length = end - start
    inside = np.repeat(start - np.concatenate([[0], np.cumsum(length)[:-1]]), length)
    order = np.arange(len(inside))
    at = order + inside
    begin = np.concatenate([[0], np.cumsum(length)[:-1]])
    power = powers(int(length.max()) + 1)[order - np.repeat(begin, length)]
    with np.errstate(over="ignore"):
        h = np.add.reduceat(_BYTE[t.data[at]] * power, begin)
    return Words(start, end, mix(h), row, first)


def windows(w: Words, n: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the ``n`` words from each position, and which positions have so many in their row."""
    m = len(w.hash) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    with np.errstate(over="ignore"):
        h = w.hash[:m].copy()
        for j in range(1, n):
            h *= _MUL
            h += w.hash[j : j + m]
    return mix(h, seed), w.row[:m] == w.row[n - 1 :]
