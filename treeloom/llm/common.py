"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

from treeloom.sources.tables import kept as stored
from treeloom.sources.tables import shared_dir

__all__ = ["SMALL_BATCHES", "mix64", "prepare", "shared_dir", "span_hashes", "stored", "utf8", "words"]

ARROW_ROWS, ARROW_BYTES = 256, 16 << 20
#: Where arrays of many times a batch's bytes are made of it: workers that are used again keep what the largest batch took.
SMALL_BATCHES = 64, 4 << 20


def prepare(spark: SparkSession, rows: int = ARROW_ROWS, size: int = ARROW_BYTES) -> SparkSession:
    """Bound an Arrow batch, as one row may hold a very long text."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)
    return spark


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column as its bytes and the n + 1 offsets of its rows in them; a null is an empty text."""
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    n = len(column)
    _, ends, data = column.buffers()
    if n == 0 or ends is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    at = np.frombuffer(ends, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    if data is None or at[-1] == at[0]:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit integers (xor-shift-multiply rounds)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for i, base in enumerate((_BASE, _INVERSE)):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _powers[i] = np.multiply.accumulate(table)
    return _powers[0][:n], _powers[1][:n]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, all at once, from prefix sums of a polynomial modulo 2^64."""
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    up, down = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
    return mix64((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray = _WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each run of word bytes (ASCII letters and digits, and all bytes of other characters by default). No run crosses rows."""
    if len(data) == 0:
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = is_word[data]
    first = np.zeros(len(data), bool)
    first[offsets[:-1][offsets[:-1] < len(data)]] = True
    starts = np.flatnonzero(inside & (first | np.concatenate(([True], ~inside[:-1]))))
    last = np.zeros(len(data), bool)
    last[offsets[1:][offsets[1:] > 0] - 1] = True
    ends = np.flatnonzero(inside & (last | np.concatenate((~inside[1:], [True])))) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1
